"""Embedding near-duplicates by spherical-cap filters (Becker, Ducas, Gama, Laarhoven, 2016).

A filter direction is a point of a random product code: the space is rotated
at random and cut into blocks, each block has a small code of unit vectors,
and every combination of one code vector a block is a direction.  A vector's
filters are all directions whose inner product with it reaches ``alpha``;
they are list-decoded block by block, without touching the others.  Vectors
that share a filter are compared exactly, in double precision, so no link
below the threshold is reported; a pair that shares several filters counts
in the least of them only.

Equal vectors are one class, with a count.  A filter with many vectors is
cut into chunks and each pair of chunks is a group of its own, so a dense
cluster is spread over tasks; links are counted there and only chains that
connect a group's components leave it, never its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.components import components
from panelwise.llm.shared import joined_small, ship_by_value, written


@dataclass(frozen=True)
class CapCode:
    """``per_vector`` filters are expected of a vector, ``bucket`` vectors of a filter."""

    threshold: float = 0.95
    per_vector: float = 32.0
    bucket: int = 256
    chunk: int = 1500
    seed: int = 42

    def size(self, n: int) -> int:
        """Code vectors of each of the two blocks, for n vectors."""
        return max(16, round((n * self.per_vector / self.bucket) ** 0.5))


def product_code(dims: int, size: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A random rotation, and the code of each block (rows of norm 1 / sqrt(2))."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    half = (dims + 1) // 2
    codes = []
    for width in (half, dims - half):
        c = rng.normal(size=(size, max(width, 1)))[:, :width]
        norm = np.linalg.norm(c, axis=1, keepdims=True)
        codes.append(c / np.where(norm > 0, norm, 1) / 2 ** 0.5)
    return rotation, codes


def list_decode(x: np.ndarray, rotation: np.ndarray, codes: list[np.ndarray], alpha: float) -> list[np.ndarray]:
    """Per unit vector, the sorted numbers of all directions whose inner product is alpha or more."""
    y, half = x @ rotation, codes[0].shape[1]
    first, second = y[:, :half] @ codes[0].T, y[:, half:] @ codes[1].T
    order = np.argsort(-second, axis=1)
    ranked = np.take_along_axis(second, order, axis=1)
    found = []
    for i in range(len(x)):
        # for each code vector of the first block, the prefix of the second's that is near enough
        upto = np.searchsorted(-ranked[i], first[i] - alpha, side="right")
        a = np.repeat(np.arange(len(upto)), upto)
        b = order[i][np.arange(len(a)) - np.repeat(np.cumsum(upto) - upto, upto)]
        found.append(np.sort(a * second.shape[1] + b).astype(np.int32))
    return found


def _usable(v) -> F.Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(raw: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in raw]).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _share_earlier(i: np.ndarray, j: np.ndarray, filters: list[np.ndarray], f: int) -> np.ndarray:
    """Whether each pair of rows shares a filter below f, by products of the rows' incidence with those filters."""
    used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    lists = [filters[k][filters[k] < f] for k in used]
    if not len(used):
        return np.zeros(0, bool)
    known, column, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(used)), list(map(len, lists)))
    several = count > 1
    column, row = (np.cumsum(several) - 1)[column[several[column]]], row[several[column]]
    shared = np.zeros((len(used),) * 2, bool)
    for at in range(0, int(several.sum()), 2048):
        here = (column >= at) & (column < at + 2048)
        m = np.zeros((len(used), 2048), np.float32)
        m[row[here], column[here] - at] = 1
        shared |= m @ m.T > 0.5
    return shared[place[:len(i)], place[len(i):]]


def linked_within(g: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of one group: per class, the copies it links with that count in this filter, and its local component."""
    f, lo, hi = (int(g[c].iloc[0]) for c in ("filter", "lo", "hi"))
    g = g.sort_values("rep_id", ignore_index=True)
    x, part, n = _unit(g["vector"]), g["part"].to_numpy(), len(g)
    label = np.arange(n)
    mine, pairs = np.flatnonzero(part == lo), []
    for at in range(0, len(mine), 512):
        rows = mine[at:at + 512]
        i, j = np.nonzero(x[rows] @ x.T >= threshold)
        i = rows[i]
        keep = (j > i) if lo == hi else part[j] == hi
        pairs.append((i[keep], j[keep]))
    i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    first = ~_share_earlier(i, j, [np.asarray(fs) for fs in g["filters"]], f)
    copies = g["copies"].to_numpy(np.int64)
    links = np.bincount(i[first], copies[j[first]], n).astype(np.int64) + np.bincount(j[first], copies[i[first]], n).astype(np.int64)
    while len(i):  # least label over links, then over labels
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    ids = g["rep_id"].to_numpy()
    out = pd.DataFrame({"rep_id": ids, "links": links, "to": ids[label]})
    return out[(out["links"] > 0) | (out["to"] != out["rep_id"])]


def vector_classes(embeddings: DataFrame) -> DataFrame:
    """Usable vectors, equal ones as one: ``vector, rep_id`` (the least id) and ``copies``."""
    usable = embeddings.where(_usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    return usable.groupBy(F.col("embedding").alias("vector")).agg(F.min("vec_id").alias("rep_id"), F.count("*").alias("copies"))


def near_duplicate_vectors(embeddings: DataFrame, code: CapCode = CapCode()) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    ``embeddings`` needs vec_id (long) and embedding.  Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor
    do those with a null id; vectors of other dimensions than most are
    compared among their own.  Repeated rows are equal vectors and link; an
    empty table gives no rows; other columns are ignored.
    """
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    classes = written(vector_classes(e), "vector-classes")
    links = edges = None
    for dims, n in sorted((r["dims"], r["n"]) for r in classes.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).collect()):
        found = written(_links(classes.where(F.size("vector") == dims), dims, n, code), "cap-links")
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = e.sparkSession.createDataFrame([], "rep_id bigint, links bigint, to bigint")
    sums = links.groupBy("rep_id").agg(F.sum("links").alias("links"))
    edges = components(links.select("rep_id", "to"))
    reps = classes.join(sums, "rep_id", "left").join(edges.withColumnRenamed("node", "rep_id"), "rep_id", "left")
    reps = reps.select("vector", F.col("copies"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep_id").alias("component"))
    d = e.withColumn("vector", F.when(_usable(F.col("embedding")) & F.col("vec_id").isNotNull(), F.col("embedding"))).drop("embedding")
    d = d.join(reps, "vector", "left")
    component = F.coalesce("component", "vec_id")
    return d.select("vec_id", F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, dims: int, n: int, code: CapCode) -> DataFrame:
    size = code.size(n)
    # inner products with a random direction are near normal with deviation 1 / sqrt(dims)
    alpha = NormalDist().inv_cdf(1 - min(0.5, code.per_vector / size ** 2)) / dims ** 0.5
    seed, threshold = code.seed, code.threshold

    def decode(batches):
        rotation, codes = product_code(dims, size, seed)
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at:at + 2000]
                yield part.assign(filters=list_decode(_unit(part["vector"]), rotation, codes, alpha) if len(part) else [])

    kind = classes.schema["vector"].dataType.simpleString()
    coded = written(classes.mapInPandas(decode, f"vector {kind}, rep_id bigint, copies bigint, filters array<int>"), "cap-filters")
    each = coded.withColumn("filter", F.explode("filters"))
    full = coded.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count("*").alias("n")).where("n > 1")
    each = joined_small(each, written(full, "cap-counts"), "filter")
    chunks = F.ceil(F.col("n") / code.chunk).cast("int")
    each = each.withColumn("part", F.pmod(F.xxhash64("rep_id"), chunks).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    each = each.select("filter", F.least("part", "other").cast("int").alias("lo"), F.greatest("part", "other").cast("int").alias("hi"),
                       "part", "rep_id", "copies", "vector", "filters")
    return each.groupBy("filter", "lo", "hi").applyInPandas(lambda g: linked_within(g, threshold), "rep_id bigint, links bigint, to bigint")


ship_by_value(__name__)
