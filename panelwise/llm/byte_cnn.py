"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over windows of ``width`` bytes every
``step`` bytes, and each filter is max-pooled in overlapping chunks that
cover the whole document.  The mean and the maximum of the chunks' vectors
go through one logistic unit, so a document of any length has one
probability.  The network is fitted on a bounded sample of labelled rows;
scoring is one pass over the texts, with the weights in the task's closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.shared import ship_by_value

HELD_OUT = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class CnnShape:
    """``sample`` rows of each label are fitted on at most, of texts up to ``sample_bytes``."""

    embedding: int = 8
    filters: int = 24
    width: int = 8
    step: int = 4
    chunk: int = 128
    chunk_step: int = 96
    sample: int = 1000
    sample_bytes: int = 1 << 16
    epochs: int = 10
    batch: int = 16
    rate: float = 4e-3
    seed: int = 42


class ByteCnn:
    def __init__(self, shape: CnnShape = CnnShape()):
        self.shape, rng = shape, np.random.default_rng(shape.seed)
        e, f, w = shape.embedding, shape.filters, shape.width
        self.weights = {"bytes": rng.normal(0, 0.5, (256, e)), "filters": rng.normal(0, (2 / (e * w)) ** 0.5, (w * e, f)),
                        "bias": np.zeros(f), "out": rng.normal(0, 0.1, 2 * f), "last": np.zeros(1)}
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def windows(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The padded bytes, and for each window of the whole text the place it starts at."""
        s = self.shape
        n = -(-max(len(data) - s.width, 0) // s.step) + 1
        b = np.zeros((n - 1) * s.step + s.width, np.uint8)
        b[:len(data)] = np.frombuffer(data, np.uint8)
        return b, np.arange(n) * s.step

    def chunks(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end window of the overlapping chunks of n windows."""
        s = self.shape
        starts = np.arange(max(1, -(-max(n - s.chunk, 0) // s.chunk_step) + 1)) * s.chunk_step
        return starts, np.minimum(starts + s.chunk, n)

    def responses(self, b: np.ndarray, n: int) -> np.ndarray:
        s, w = self.shape, self.weights
        x = w["bytes"][b]
        rows = np.lib.stride_tricks.as_strided(x, (n, s.width * s.embedding), (s.step * s.embedding * 4, 4))
        return rows @ w["filters"]

    def score(self, data: bytes) -> float:
        """The probability; long texts go through in pieces of whole chunks."""
        s, w = self.shape, self.weights
        n = -(-max(len(data) - s.width, 0) // s.step) + 1
        starts, ends = self.chunks(n)
        total, most, per = np.zeros(s.filters, np.float32), np.full(s.filters, -np.inf, np.float32), 2048
        for at in range(0, len(starts), per):
            lo, hi = starts[at], ends[min(at + per, len(starts)) - 1]
            b, places = self.windows(data[lo * s.step:(hi - 1) * s.step + s.width])
            r = np.vstack((self.responses(b, len(places)), np.full((1, s.filters), -np.inf, np.float32)))
            edges = np.stack((starts[at:at + per] - lo, ends[at:at + per] - lo), 1).ravel()
            h = np.maximum(np.maximum.reduceat(r, edges, axis=0)[::2] + w["bias"], 0)
            total, most = total + h.sum(0), np.maximum(most, h.max(0))
        logit = float(np.concatenate((total / len(starts), most)) @ w["out"] + w["last"][0])
        return 1 / (1 + np.exp(-min(max(logit, -30.0), 30.0)))

    def gradients(self, data: bytes, label: int, into: dict[str, np.ndarray]) -> float:
        """Adds the gradients of one text's log loss; gives the loss."""
        s, w = self.shape, self.weights
        b, places = self.windows(data)
        r = self.responses(b, len(places))
        starts, ends = self.chunks(len(places))
        top = np.stack([a + r[a:z].argmax(0) for a, z in zip(starts, ends)])
        columns = np.arange(s.filters)
        h = np.maximum(r[top, columns] + w["bias"], 0)
        best = h.argmax(0)
        v = np.concatenate((h.mean(0), h[best, columns]))
        logit = float(v @ w["out"] + w["last"][0])
        p = 1 / (1 + np.exp(-min(max(logit, -30.0), 30.0)))
        d = p - label
        into["out"] += d * v
        into["last"] += d
        dh = np.repeat((d * w["out"][:s.filters] / len(starts))[None], len(starts), 0)
        dh[best, columns] += d * w["out"][s.filters:]
        dh *= h > 0
        into["bias"] += dh.sum(0)
        k, f = np.nonzero(dh)
        g = dh[k, f]
        at = b[places[top[k, f]][:, None] + np.arange(s.width)]
        x = w["bytes"][at].reshape(len(k), -1) * g[:, None]
        np.add.at(into["filters"].T, f, x)
        back = (w["filters"].T[f] * g[:, None]).reshape(len(k), s.width, s.embedding)
        np.add.at(into["bytes"], at, back)
        return -np.log(max(p if label else 1 - p, 1e-9))

    def fit(self, texts: list[bytes], labels: list[int]) -> "ByteCnn":
        """Adam over the texts in a seeded order; the classes weigh alike if they are sampled alike."""
        s, rng = self.shape, np.random.default_rng(self.shape.seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        t = 0
        for epoch in range(s.epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), s.batch):
                some, t = order[at:at + s.batch], t + 1
                grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
                for i in some:
                    self.gradients(texts[i], labels[i], grads)
                rate = s.rate * (1 - 0.9 * epoch / s.epochs)
                for k, w in self.weights.items():
                    g = grads[k] / len(some) + 1e-5 * w
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w -= rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-7)
        return self


def _held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, shape: CnnShape = CnnShape()) -> list[tuple[bytes, int]]:
    """At most ``shape.sample`` ids of each label, none held out, by a hash of the id; texts up to ``sample_bytes``.

    Of an id with several texts the least is taken, so the sample doesn't
    depend on the order of rows.
    """
    d = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
    d = d.select("doc_id", "quality").distinct()
    order = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{shape.seed}")))
    picked = [d.where(F.col("quality") == q).orderBy(order, "doc_id").limit(shape.sample) for q in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most twice shape.sample rows
    rows = (docs.select("doc_id", F.col("text").cast("binary").alias("data")).where(F.octet_length("data") <= shape.sample_bytes)
            .join(ids, "doc_id").groupBy("doc_id", "quality").agg(F.min("data").alias("data")).collect())
    return sorted((bytes(r["data"]), int(r["quality"])) for r in rows)


def score_documents(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.  Null and empty texts get the score of no bytes but padding."""
    names = ["doc_id", "held_out", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(x.as_py() or b"") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("data"))
    d = d.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return d.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, shape: CnnShape = CnnShape()) -> DataFrame:
    """Fit on the sample, score every document.

    With no labelled rows the untrained network's scores are given.  A null
    doc_id is held out.  Repeated rows get a row each; an empty table gives
    no rows; other columns are ignored.
    """
    sample = training_sample(docs, labels, shape)
    model = ByteCnn(shape).fit([x for x, _ in sample], [y for _, y in sample])
    return score_documents(docs, model)


ship_by_value(__name__)
