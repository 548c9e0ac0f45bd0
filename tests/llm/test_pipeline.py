"""The pipeline's stages on a hard fixture, each against a brute-force version on its own input."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwise.llm import quality_divergence, sql
from panelwise.llm.order_minhash import OrderMinHash
from panelwise.llm.shared import scratch_root

FULL = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Real documents with ids that repeat (same and other texts), nulls in all columns, copies, near copies, personal data and clashing columns."""
    rng = random.Random(11)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    long = [r for r in rows if len(_words(r[1])) > 120][:6]
    rows += [rows[0], rows[0], (1, long[0][1], "en", "a"), (2, long[0][1], "en", None), (2, long[1][1], None, "b"), (None, long[2][1], "en", "a"), (None, None, None, None),
             (900, None, "en", "a"), (901, "", "en", "a"), (902, " \n", "en", "a")]
    for k, r in enumerate(long):  # near copies: one word of each changed
        w = r[1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((910 + k, " ".join(w), r[2], r[3]))
    prose = " ".join(_words(long[3][1])[:80])
    rows += [(930, prose + "\nMr Smith, a@b.org or +1 (663) 555-6869, Smith\n" + prose[::-1], "en", "a"), (931, "#$% &*| <> " * 200, "xx", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in ("digest", "_digest", "row", "kept", "rep", "component", "size", "first_words", "words", "here", "_stays"):
        d = d.withColumn(c, F.col("lang"))
    path = str(tmp_path_factory.mktemp("pipe"))
    d.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Input and output rows of each stage."""
    docs, found = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        if name != "packed":
            assert out.columns == docs.columns
        found[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()])
        docs = out
    return found


def _key(rows):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows)


def _distance(p, q):
    half = lambda a, b: a * math.log(a / ((a + b) / 2)) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum(half(a, b) + half(b, a) for a, b in zip(p, q)) / 2 / math.log(2)))


def _classes(text):
    return [len(re.findall(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f]", r"[^\x00-\x7f]")]


def test_quality_rules(stages):
    before, after = stages["quality_rules"]
    limits = quality_divergence.DivergenceLimits()
    per = {}
    for r in before:
        if len(r["text"] or "") >= limits.min_chars:
            per.setdefault(r["lang"] or "", []).append(r["text"])
    sums = {lang: [sum(x) for x in zip(*map(_classes, texts))] for lang, texts in per.items()}
    coarse = lambda c: [c[0] + c[1] + c[5], c[2], c[3], c[4]]
    share = lambda xs: [x / sum(xs) for x in xs]
    pooled = share(coarse([sum(x) for x in zip(*sums.values())]))
    kept = []
    for r in before:
        text, w, lang = r["text"] or "", _words(r["text"]), r["lang"] or ""
        grams = Counter(zip(w, w[1:], w[2:]))
        repeated = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
            continue
        own = len(per.get(lang, ())) >= limits.min_documents
        far = False
        if len(text) >= limits.min_chars:
            far = _distance(share(_classes(text)), share(sums[lang])) > 0.25 if own else _distance(share(coarse(_classes(text))), pooled) > 0.25
        if own and len(w) >= limits.min_words:
            everything = [x for t in per[lang] for x in _words(t)]
            counts = Counter(x for x in everything if re.fullmatch(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x))
            common = sorted(counts, key=lambda x: (-counts[x], x.encode()))[:24]
            here = Counter(w)
            p, q = [here[x] for x in common], [counts[x] for x in common]
            far = far or _distance(share(p + [len(w) - sum(p)]), share(q + [len(everything) - sum(q)])) > 0.31
        if not far:
            kept.append(r)
    assert _key(after) == _key(kept)
    assert not any(r["doc_id"] == 931 for r in after)  # symbols alone, in a language of their own


def _near(a, b):
    """Aligned five-word shingles over all of both, by a full table."""
    a, b = ([tuple(w[i:i + 5]) for i in range(len(w) - 4)] for w in (_words(a), _words(b)))
    if not a or not b or min(len(a), len(b)) < .8 * max(len(a), len(b)):
        return False
    if len(set(a) & set(b)) < .5 * len(set(a)):
        return False
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] >= 0.8 * (len(a) + len(b) - row[-1])


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    texts = sorted({r["text"] for r in before if r["text"] is not None and r["doc_id"] is not None})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    assert OrderMinHash().similarity == 0.8
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if find(a) != find(b) and _near(a, b):
                root[find(a)] = find(b)
    kept = Counter(find(r["text"]) for r in after if r["text"] is not None and r["doc_id"] is not None)
    assert set(kept) == {find(t) for t in texts} and set(kept.values()) == {1}  # no class is lost, one of each stays
    assert not _key(after) - _key(before)
    alone = lambda rows: Counter(r["text"] for r in rows if r["text"] is None or r["doc_id"] is None)
    assert alone(before) == alone(after)


def test_texts_of_one_id_are_judged_apart(spark):
    from panelwise.llm import order_minhash

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    for rows in ([(1, a), (2, a), (2, b), (3, c)], [(1, a), (1, b), (2, b), (3, c)], [(1, a), (1, b), (1, c), (1, c + " end"), (5, b + " end"), (5, a)]):
        found = order_minhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r["text"][0] for r in found) == ["a", "b", "c"], rows
        classes = order_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(classes) == len(rows)


def test_personal_data(stages):
    before, after = stages["personal_data"]
    assert len(before) == len(after)
    shape = lambda rows: Counter((r["doc_id"], len((r["text"] or "").split("\n")), r["lang"], r["source"]) for r in rows)
    assert shape(before) == shape(after)
    new = [r["text"] for r in after if r["doc_id"] == 930]
    assert len(new) == 1 and "Smith" not in new[0] and "a@b.org" not in new[0] and "555-6869" not in new[0]
    untouched = [r for r in before if not re.search(r"[0-9]|@|[=:]|(Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Lady|Lord|Herr|Frau|Sr|Sra|Señor|Señora|Monsieur|Madame|Mme)\b", r["text"] or "")]
    assert untouched and not _key(untouched) - _key(after)


def test_source_weights(spark, stages, tmp_path):
    """The words taken of each document are those of the mix's SQL; what is taken once more is a prefix of the text, lines and all."""
    before, after = stages["source_weights"]
    path = str(tmp_path)
    spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in before], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{path}/docs")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/docs/*.parquet')")
    expected = Counter()
    for doc_id, taken in con.sql(f"SELECT doc_id, taken FROM ({sql.mixing_sql()})").fetchall():
        expected[doc_id] += taken
    found = Counter()
    for r in after:
        found[r["doc_id"]] += len(_words(r["text"]))
    assert +found == +expected
    texts = {}
    for r in before:
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert all(any(t == r["text"] or t.startswith(r["text"]) for t in texts[r["doc_id"]]) for r in after)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_packed(stages):
    before, after = stages["packed"]
    sizes = Counter()
    for r in before:
        ids = len(FULL.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        for at in range(0, ids, 4096):
            sizes[r["doc_id"], at // 4096, at, min(4096, ids - at)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in after) == sizes
    sequences = {}
    for r in after:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1 + 1.05 * sum(r["length"] for r in after) / 4096


def test_run_gives_the_last_stage_and_leaves_its_table_alone(spark, sf_dir, stages):
    found = [r.asDict() for r in corpus_pipeline.run(spark, sf_dir).collect()]
    key = lambda rows: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(found) == key(stages["packed"][1])
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    left = [f.getPath().getName() for f in jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jvm)]
    assert sum(n.startswith("stage-") for n in left) == 1 and not any(n.startswith("scope-") for n in left)


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []
