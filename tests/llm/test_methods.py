"""Brute-force versions, round trips and held-out accuracy of what SQL can't express."""

import itertools
import random
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelwise.llm import (best_fit_packing, byte_cnn, cap_filters, components, flow_resharding, license_dice, order_minhash,
                           pii_surrogates, queries, source_mixing, warc_bundles)
from panelwise.llm.shared import scratch_path, words

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _optimum(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, bins + [items[i]])

    go(0, [])
    return best


def test_dominance_keeps_an_optimum():
    """Fixing the sets and solving the rest exactly uses as few sequences as solving all exactly."""
    rng = random.Random(5)
    fixed = 0
    for _ in range(150):
        capacity = rng.choice([10, 13, 20])
        items = sorted((rng.randint(rng.choice([1, 3]), capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        left, used = list(items), 0
        for x in items:
            if x not in left:
                continue
            others = list(left)
            others.remove(x)
            counts = {v: others.count(v) for v in others}
            found = best_fit_packing.dominating_set(x, counts, sorted(counts), capacity)
            if found is not None:
                used += 1
                for v in (x, *found):
                    left.remove(v)
        fixed += used
        assert used + (_optimum(left, capacity) if left else 0) == _optimum(items, capacity), (capacity, items)
    assert fixed > 150


def test_packing_of_whole_table(spark):
    from tokenizers import Tokenizer

    found = queries.QUERIES["op2_best_fit_packing"](spark, SF001).collect()
    full, tokenizer = Tokenizer.from_file(VOCABULARY), {}
    for r in spark.read.parquet(f"{SF001}/documents.parquet").collect():
        ids = full.encode(r["text"], add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k:k + 4096], "<u4").tobytes()
            tokenizer[r["doc_id"], k // 4096] = (k, len(part) // 4, zlib.crc32(part))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == tokenizer
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in found) // 4096) * 1.02 + 1


def test_packed_sequences_hold_the_ids(documents):
    some = documents.where("doc_id < 20")
    total = sum(len(best_fit_packing.document_ids(r["text"], VOCABULARY)) for r in some.collect())
    rows = best_fit_packing.packed_sequences(some, VOCABULARY).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows) and sum(len(r["ids"]) for r in rows) == total


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _personal(text):
    """Personal data by plain rules on words and digits, apart from the operator's patterns."""
    found, words = [], text.split()
    for i, w in enumerate(words):
        bare = w.strip(".,;:!?()[]\"'<>|")
        if "@" in bare.strip("@") and "." in bare.split("@")[-1].strip("."):
            found.append(bare)
        parts = bare.split(".")
        if len(parts) == 4 and all(p.isdigit() and len(p) < 4 and str(int(p)) == p and int(p) < 256 for p in parts):
            found.append(bare)
        for sign in "=:":
            name, at, value = w.partition(sign)
            name = name or (words[i - 1] if i else "")
            if at and name.lower().strip("\"'(") in ("password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey"):
                value = (value or (words[i + 1] if i + 1 < len(words) else "")).strip("\"'.,;)")
                if len(value) >= 8 and all(c.isalnum() or c in "+/_-" for c in value):
                    found.append(value)
    at = 0
    while at < len(text):  # runs of digits with single separators
        if not text[at].isdigit() and text[at] != "+":
            at += 1
            continue
        end = at + 1
        while end < len(text) and (text[end].isdigit() or text[end] in " .-()" and not text[end:end + 3].strip(" .-()") == ""):
            end += 1
        run = text[at:end].rstrip(" .-(")
        digits, end = [c for c in run if c.isdigit()], at + len(run)
        alone = (at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "-")) and (end == len(text) or not text[end].isalpha())
        if alone and run.startswith("+") and 9 <= len(digits) <= 13 and len(run) - len(digits) <= 7:
            found.append(run)
        if alone and len(digits) == 16 and run[0].isdigit() and _luhn(digits) and [len(p) for p in run.replace("-", " ").split()] in ([4] * 4, [16]):
            found.append(run)
        at = end
    return found


def test_surrogates_against_an_independent_scanner(spark):
    d = spark.read.parquet(f"{SF01}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in d.collect()}
    forward, kinds, touched, clean = {}, 0, 0, []
    for r in pii_surrogates.replace_entities(d, "secret").collect():
        old, new = before[r["doc_id"]], r["text"]
        personal = _personal(old)
        kinds += len(personal)
        assert not [x for x in personal if x in new], (personal, new[:200])
        assert (old == new) == (r["_n_entities"] == 0)
        if not personal and old != new:
            clean.append([x for x in zip(old.split(), new.split()) if x[0] != x[1]])
        touched += old != new
        pairs = list(zip(old.split(), new.split()))
        assert len(old.split()) == len(new.split())
        for changed, run in itertools.groupby(pairs, key=lambda x: x[0] != x[1]):
            if changed:
                run = list(run)
                forward.setdefault(" ".join(x[0] for x in run), set()).add(" ".join(x[1] for x in run))
    assert not clean, clean
    assert kinds > 50 and touched > 30 and all(len(v) == 1 for v in forward.values())
    assert len(set().union(*forward.values())) == len(forward) and not set(forward) & set().union(*forward.values())


def test_only_valid_cards_are_cards_and_surrogates_stay_valid(spark):
    cards = ["4111 1111 1111 1111", "5500-0055-5555-5559", "4012888888881881", "3782 822463 10005"]
    runs = ["4111 1111 1111 1112", "1234-5678-9012-3456", "2020110112345678"]
    banks = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    rows = [(i, f"pay {x} now") for i, x in enumerate(cards + runs + banks)]
    found = {r["doc_id"]: r["text"] for r in pii_surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, x in enumerate(cards):
        new = found[i][4:-4]
        assert new != x and _luhn([c for c in new if c.isdigit()]) and [c if not c.isdigit() else "9" for c in new] == [c if not c.isdigit() else "9" for c in x]
    assert all(found[len(cards) + i] == f"pay {x} now" for i, x in enumerate(runs))
    for i, x in enumerate(banks):
        new = found[len(cards) + len(runs) + i][4:-4]
        turned = new.replace(" ", "")
        assert new != x and new[:2] == x[:2] and int("".join(str(int(c, 36)) for c in turned[4:] + turned[:4])) % 97 == 1


def test_full_kinds_take_longer_surrogates(spark, monkeypatch):
    """With one usual derivation, colliding entities still get surrogates of their own; the text goes on."""
    monkeypatch.setattr(pii_surrogates, "ROUNDS", 0)
    rows = [(i, f"{chr(97 + i // 26)}{chr(97 + i % 26)}@b.co, 10.0.{i}.1, +1 555 {i:03} 4567, 4111 1111 1111 1111") for i in range(200)]
    found = [r["text"].split(", ") for r in pii_surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    for k in range(3):
        assert len({x[k] for x in found}) == 200 and not {x[k] for x in found} & {t.split(", ")[k] for _, t in rows}


def test_marks_in_a_text_are_text(spark):
    odd = f"a {pii_surrogates.MARK} b x@y.org {pii_surrogates.OWN} {pii_surrogates.MARK[0]} Mr Smith {pii_surrogates.MARK} Smith"
    r = pii_surrogates.replace_entities(spark.createDataFrame([(1, odd), (2, odd[:8])], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    new = r[0]["text"]
    assert "x@y.org" not in new and "Smith" not in new and r[1]["text"] == odd[:8]
    assert [c for c in new if ord(c) > 0xFD00] == [c for c in odd if ord(c) > 0xFD00] and r[0]["_n_entities"] == 3


def test_surrogates_keep_gender_script_format(spark):
    text = "Mr Smith met Mrs Anna Smith, Госпожа Иванова; A.b@x.org is a.b@x.org; +1 (663) 555-6869 or +1 663 555 6869"
    few = [(i, f"{chr(97 + i)}@b.co") for i in range(26)]  # every one-letter address: real ones are never given out
    d = spark.createDataFrame([(100, text), *few], "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in pii_surrogates.replace_entities(d, "k").collect()}
    new = found[100].replace(",", "").replace(";", "").split()
    assert new[0] == "Mr" and new[1] == new[5] and new[4].endswith("na") and new[7].endswith("к")
    assert new[8] == new[10] != "a.b@x.org" and "+1 (" in found[100]
    digits = ["".join(c for c in x if c.isdigit()) for x in found[100].split("+")[1:]]
    assert digits[0] == digits[1]
    assert len({found[i] for i in range(26)}) == 26


def test_surrogates_of_other_forms(spark):
    real = ["555-123-4567", "555.123.4567", "0049 30 1234567", "030 1234567", "020 7946 0958", "01 23 45 67 89", "3782 822463 10005", "3782-822463-10005",
            "2001:db8:85a3::8a2e:370:7334", "fe80::1", "1080:0:0:0:8:800:200C:417A", "::ffff:192.0.2.1"]
    kept = ["10:20:30", "std::vector x[1::2]", "2020-01-02", "01-2024", "version 1.2.3", "pages 100-200", "12 000 000"]
    people = ("Mrs Anna Smith came. Smith said that Anna's brother, Dr. Karl von Meyer, knew Prof. Smith; Smithson and Annals did not. Frau Dr. Müller and Sir J. O'Brien-Hall; "
              "Hall left. Dr Anna Smith stays, Mr John Paul Jones, Jones")
    rows = [(i, f"a {x}, b {x}.") for i, x in enumerate(real)] + [(100 + i, f"a {x}, b") for i, x in enumerate(kept)] + [(200, people), (201, "Smith and Anna alone")]
    found = {r["doc_id"]: r for r in pii_surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, x in enumerate(real):
        first, second = found[i]["text"][2:-1].split(", b ")
        assert first == second != x and x not in found[i]["text"] and found[i]["_n_entities"] == 2
        if ":" not in x:
            assert [c if not c.isdigit() else "9" for c in first] == [c if not c.isdigit() else "9" for c in x]
    assert all(found[100 + i]["text"] == f"a {x}, b" and found[100 + i]["_n_entities"] == 0 for i, x in enumerate(kept))
    new = found[200]["text"]
    a, s = new.split()[1], new.split()[2]
    assert a.endswith("na")
    assert new.startswith(f"Mrs {a} {s} came. {s} said that {a}'s brother, Dr. ") and f"knew Prof. {s}; Smithson and Annals did not." in new and f"Dr {a} {s} stays" in new
    assert " von " in new and "Frau Dr. " in new and "Sir J. " in new
    for x in ("Karl", "Meyer", "Müller", "O'Brien", "Hall", "John", "Paul", "Jones", "Smith ", "Smith;", "Anna "):
        assert x not in new
    assert new.split()[-1] == new.split()[-2].rstrip(",")
    assert found[201]["text"] == "Smith and Anna alone"


def test_bundles_round_trip_and_seek(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet").unionByName(
        spark.createDataFrame([(900, None, None), (None, "http://x", "y" * 1500), (901, "u\nv", "y" * 1500), (901, "u\nv", "y" * 1500)], "page_id long, url string, html string"))
    index = warc_bundles.write_bundles(pages, scratch_path(spark, "test-warc"))
    back = warc_bundles.read_bundles(index).collect()
    want = sorted((str(r["page_id"]), r["url"] or "", (r["html"] or "")) for r in pages.collect())
    got = {r["page_id"]: r for r in back}
    assert len(back) == len(want) and sorted((str(r["page_id"]), r["url"] or "") for r in back) == [x[:2] for x in want]
    for r in pages.collect():
        if got[r["page_id"]]["record_type"] == "response":
            assert got[r["page_id"]]["payload"].decode() == (r["html"] or "")
    assert got[None]["record_type"] == "revisit" and got[None]["refers_to"] == 901
    one = index.where("page_id = 900").first()
    head, payload = warc_bundles.read_one(one["bundle"], one["frame_start"], one["frame_bytes"], one["record_offset"])
    assert head["X-Page-ID"] == "900" and payload == b""
    assert warc_bundles.archived_pages(pages.limit(0)).collect() == []


def test_mixed_documents_hold_what_is_taken(documents):
    taken = source_mixing.mix_documents(documents).agg(F.sum("taken")).first()[0]
    assert source_mixing.mixed_documents(documents).agg(F.sum(F.size(words(F.col("text"))))).first()[0] == taken


def test_alignment_equals_the_full_table():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randint(0, 9) for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randint(0, 9)] * rng.randint(0, 2)
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        assert order_minhash.banded_common(a, b, 99) == row[-1]


def test_near_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").toPandas()
    sets = [order_minhash.shingles(t) for t in docs["text"]]
    root, inverted = list(range(len(docs))), {}
    for i, s in enumerate(sets):
        for v in set(s.tolist()):
            inverted.setdefault(v, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in {p for rows in inverted.values() for p in itertools.combinations(rows, 2)}:
        if order_minhash.aligned_similarity(sets[i], sets[j]) >= 0.8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    want = {int(docs["doc_id"][i]): int(docs["doc_id"][find(i)]) for i in range(len(docs))}
    assert {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op6_order_minhash"](spark, SF01).collect()} == want


def test_short_texts_that_are_near_share_a_key(spark):
    rng = random.Random(5)
    p, rows, near = order_minhash.OrderMinHash(), [], 0
    for n in range(8, 19):  # words; 4 to 14 shingles
        for _ in range(60):
            a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            b = list(a)
            for _ in range(rng.randint(1, 2)):
                if rng.random() < 0.5:
                    b = [f"w{rng.randrange(10**6)}"] * rng.randint(0, 1) + b[rng.randint(0, 1):]
                else:
                    b = b[:len(b) - rng.randint(0, 1)] + [f"w{rng.randrange(10**6)}"] * rng.randint(0, 1)
            x, y = (order_minhash.shingles(" ".join(t)) for t in (a, b))
            if a != b and max(len(x), len(y)) <= 14 and order_minhash.aligned_similarity(x, y) >= 0.8:
                assert set(order_minhash.exact_sketch(x, p)) & set(order_minhash.exact_sketch(y, p))
                near += 1
                rows += [(2 * near, " ".join(a)), (2 * near + 1, " ".join(b))]
    assert near > 150 and max(len(order_minhash.exact_sketch(order_minhash.shingles("a b c d e " * n))) for n in range(1, 30)) <= p.exact_keys
    rows += [(9000, "one two three four five six seven eight"), (9001, "one two three four five six seven eight nine"), (9002, "zero two three four five six seven eight nine")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicate_classes(d).collect()}
    assert all(found[2 * i] == found[2 * i + 1] == 2 * i for i in range(1, near + 1))
    assert (found[9000], found[9001], found[9002]) == (9000, 9000, 9002)


def test_blocks_of_a_bucket_find_the_links():
    import pandas as pd

    base = [f"word{i}" for i in range(200)]
    texts = [" ".join(base[:i] + ["new"] + base[i:]) for i in (10, 90, 150)] + [" ".join(reversed(base))]
    g = pd.DataFrame({"rep": range(4), "component": range(4), "text": texts, "part": 0, "lo": 0, "hi": 0})
    found = order_minhash.linked_in_group(g, order_minhash.OrderMinHash())
    assert sorted(found["a"].tolist() + found["b"].tolist()) == [0, 0, 1, 2]


def test_groups_of_a_bucket_stay_small_in_memory():
    import tracemalloc

    import pandas as pd

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(1200)]
    g = pd.DataFrame({"rep": range(1200), "component": range(1200), "text": texts, "part": np.arange(1200) % 2, "lo": 0, "hi": 1})
    order_minhash.linked_in_group(g.head(4), order_minhash.OrderMinHash())  # tables
    tracemalloc.start()
    order_minhash.linked_in_group(g, order_minhash.OrderMinHash())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6  # all pairs in double precision, several times over, took 29 MB


def test_parted_groups_find_the_links_of_whole_ones():
    import pandas as pd

    rng = random.Random(5)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(base), " ".join(base[:30] + ["new"] + base[30:]), " ".join(base[:50])]
    texts += ["a b a b a b a b a b", "a b a b a b a b a c", "x"]
    g = pd.DataFrame({"rep": range(len(texts)), "component": range(len(texts)), "text": texts})
    p = order_minhash.OrderMinHash()
    s = [order_minhash.shingles(t) for t in texts]
    every = {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if order_minhash.aligned_similarity(s[i], s[j]) >= 0.8}
    whole = order_minhash.linked_in_group(g.assign(part=0, lo=0, hi=0), p)
    assert every and len(whole) and set(zip(whole["a"], whole["b"])) <= every
    g["part"] = g["rep"] % 2
    found = [order_minhash.linked_in_group(d.assign(lo=lo, hi=hi), p) for lo, hi, d in (
        (0, 0, g[g["part"] == 0]), (1, 1, g[g["part"] == 1]), (0, 1, g))]
    links = {tuple(sorted(x)) for f in found for x in zip(f["a"], f["b"])}
    assert links <= every
    for pairs in (links, set(zip(whole["a"], whole["b"]))):
        root = list(range(len(s)))
        for _ in s:
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        assert all(root[i] == root[j] for i, j in every)


def test_long_texts_of_a_bucket_are_chunked_by_their_bytes(spark, monkeypatch):
    import pandas as pd

    rows = [(i, "x" * (4000 if i < 20 else 10), 0 if i < 20 else 1) for i in range(40)]
    d = spark.createDataFrame(rows, "rep long, text string, key long")
    members = d.select(F.lit(0).alias("bucket"), "key", "rep", F.col("rep").alias("component"))
    texts = d.select("rep", "text", F.octet_length("text").alias("bytes"))
    monkeypatch.setattr(order_minhash, "linked_in_group", lambda g, p: pd.DataFrame({"a": [len(g)], "b": [int(g["key"].iloc[0])]}))
    p = order_minhash.OrderMinHash(chunk_bytes=10_000)
    found = order_minhash._links_in_buckets(members, texts, p).collect()
    assert [r["a"] for r in found if r["b"] == 1] == [20]  # 200 bytes: all at once
    assert max(r["a"] for r in found if r["b"] == 0) < 20 and len([r for r in found if r["b"] == 0]) > 8


def test_a_worker_keeps_one_operators_tables():
    import sys

    from panelwise.llm import shared, token_ids

    encoder = token_ids.word_ids(VOCABULARY)
    assert token_ids.word_ids(VOCABULARY) is encoder
    order_minhash.shingles("one two three four five six")
    assert set(sys.modules["panelwise_worker_caches"].kept) == {"order_minhash"}
    tables = shared.worker_cache("order_minhash")
    assert len(tables["up"]) == len(tables["down"]) == order_minhash._LEAST_TABLE
    long = "word " * order_minhash._LEAST_TABLE
    grown = order_minhash.word_hashes(long)
    assert len(tables["up"]) > len(long) and set(grown.tolist()) == set(order_minhash.word_hashes("word").tolist())
    shared.worker_cache("order_minhash").clear()


def test_classifier_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    d = queries.QUERIES["op7_byte_cnn"](spark, SF01).join(labels, "doc_id").where("held_out").toPandas()
    assert (d["predicted"] == d["quality"]).mean() > 0.85 and d["score"].between(0, 1).all()


def test_cnn_scores_long_texts_in_pieces():
    shape = byte_cnn.CnnShape(chunk=4, chunk_step=3)
    model, data = byte_cnn.ByteCnn(shape), bytes(range(256)) * 200
    b, places = model.windows(data)
    r = model.responses(b, len(places))
    h = np.stack([np.maximum(r[a:z].max(0) + model.weights["bias"], 0) for a, z in zip(*model.chunks(len(places)))])
    logit = np.concatenate((h.mean(0), h.max(0))) @ model.weights["out"]
    assert abs(model.score(data) - 1 / (1 + np.exp(-logit))) < 1e-4 and 0 < model.score(b"") < 1


def test_gradients_equal_finite_differences():
    """Along random directions of each weight, on texts of one chunk and of many."""
    rng = np.random.default_rng(5)
    model = byte_cnn.ByteCnn(byte_cnn.CnnShape(embedding=4, filters=6, chunk=16, chunk_step=12))
    for name in ("bias", "last"):
        model.weights[name] += rng.normal(0, 0.3, model.weights[name].shape).astype(np.float32)
    loss = lambda data, label: -np.log(model.score(data) if label else 1 - model.score(data))
    for data, label in ((b"", 1), (b"a few bytes", 0), (bytes(rng.integers(0, 256, 900, np.uint8)), 1), (b"word and word again " * 40, 0)):
        grads = {k: np.zeros_like(v) for k, v in model.weights.items()}
        assert abs(model.gradients(data, label, grads) - loss(data, label)) < 1e-4
        for name, weight in model.weights.items():
            direction = grads[name] / (np.linalg.norm(grads[name]) + 1e-12) + 0.2 * rng.normal(size=weight.shape).astype(np.float32) / weight.size ** 0.5
            kept, ends = weight.copy(), []
            for step in (2e-3, -2e-3):
                model.weights[name] = (kept + step * direction).astype(np.float32)
                ends.append(loss(data, label))
            model.weights[name] = kept
            want = (ends[0] - ends[1]) / 4e-3
            assert abs(float((grads[name] * direction).sum()) - want) < 0.03 * abs(want) + 2e-3, (name, len(data))


def test_sample_does_not_depend_on_row_order(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(400)] + [(3, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(5, 1), (None, 0), (99, 1)], "doc_id long, quality int")
    shape = byte_cnn.CnnShape(sample=10)
    samples = [byte_cnn.training_sample(d.repartition(n), labels.repartition(n), shape) for d, n in ((docs, 1), (docs, 7), (docs.orderBy("text"), 3))]
    assert samples[0] == samples[1] == samples[2] and 0 < len(samples[0]) <= 20
    assert byte_cnn.training_sample(docs.limit(0), labels, shape) == byte_cnn.training_sample(docs, labels.limit(0), shape) == []


def _dice_by_definition(words, template):
    a, b = (license_dice.Counter(zip(w, w[1:])) for w in (words, template))
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def test_license_scan_against_all_windows():
    """Every window of every length against every template: the nearest is found, and no match that overlaps none is left out."""
    rng = random.Random(31)
    templates = [t for t in license_dice.standard_templates() if 5 <= len(t.words) <= 14][:6]
    scanner = license_dice.LicenseScanner(templates)
    hits = 0
    for _ in range(40):
        text = []
        for _ in range(rng.randint(0, 3)):
            notice = list(rng.choice(templates).words)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(notice))
                notice[at:at + rng.randint(0, 1)] = rng.choice([["filler"], [], [rng.choice(notice)]])
                notice = notice or ["filler"]
            text += [rng.choice(["the", "license", "other", "under"]) for _ in range(rng.randint(0, 6))] + notice
        found = scanner.scan(" ".join(text))
        near = [(d, a, z) for t in templates for a in range(len(text)) for z in range(a + 2, min(len(text), a + 3 * len(t.words)) + 1)
                if (d := _dice_by_definition(text[a:z], t.words)) >= license_dice.THRESHOLD]
        assert bool(found) == bool(near)
        if not near:
            continue
        hits += 1
        assert abs(found[0][1] - max(near)[0]) < 1e-12
        spans = sorted((a, z) for _, _, a, z in found)
        assert all(z <= a for (_, z), (a, _) in zip(spans, spans[1:]))
        for name, dice, a, z in found:
            assert abs(dice - max(_dice_by_definition(text[a:z], t.words) for t in templates if t.license == name)) < 1e-12
        assert all(any(a < y and x < z for x, y in spans) for _, a, z in near)
    assert hits > 15


def test_license_windows():
    scanner = license_dice.LicenseScanner(license_dice.standard_templates())
    assert scanner.scan("x y z\nReleased under the MIT License.\nmore")[0][:2] == ("MIT", 1.0)
    changed = license_dice.NOTICES["BSD"].replace("binary", "object", 1)
    (name, dice, first, end), = scanner.scan("Copyright (c) 2020 me\nfoo " + changed + " bar")
    assert name == "BSD" and 0.9 < dice < 1 and first in (1, 0)
    assert scanner.scan(None) == scanner.scan("") == scanner.scan("under the terms of the plain text") == []


def test_license_windows_of_other_lengths():
    scanner = license_dice.LicenseScanner(license_dice.standard_templates())
    for name in ("MIT", "BSD", "ISC"):
        words = license_dice.normalised_words(license_dice.NOTICES[name])
        n = len(words)
        cut = words[:n // 2] + words[n // 2 + n // 4:]
        more = words[:n // 2] + ["filler"] * (n // 3) + words[n // 2:]
        for notice in (cut, more):
            found = scanner.scan("alpha beta " * 20 + " ".join(notice) + " gamma delta" * 60)
            assert [x[0] for x in found] == [name] and 0.8 <= found[0][1] < 1 and found[0][2:] == (40, 40 + len(notice))
    # two cut notices side by side are two matches
    cut = " ".join(license_dice.NOTICES["BSD"].split()[12:])
    assert [x[0] for x in scanner.scan(f"{cut} {license_dice.NOTICES['BSD']} {cut}")] == ["BSD"] * 3


def test_only_copyright_statements_are_stripped():
    scanner = license_dice.LicenseScanner(license_dice.standard_templates())
    isc = """Copyright (c) 2004-2010, Some Holder, Inc.
 * Permission to use, copy, modify, and/or distribute this software for any
 * purpose with or without fee is hereby granted, provided that the above
 * copyright notice and this permission notice appear in all copies.
 *
 * THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
 * WITH REGARD TO THIS SOFTWARE"""
    found = scanner.scan(isc)
    assert found[0][:3] == ("ISC", 1.0, 0) and len(found) == 1
    for name in ("MIT", "BSD", "Apache-2.0", "ISC"):
        one_line = "Copyright (c) 2020 John Doe. All rights reserved. " + " ".join(license_dice.NOTICES[name].split())
        assert [x[:3] for x in scanner.scan(one_line + " and more text " * 9)] == [(name, 1.0, 0)]
        for width in (20, 40, 60):
            wrapped = "\n".join("# " + x for x in textwrap.wrap(license_dice.NOTICES[name], width, break_long_words=False))
            assert [x[:2] for x in scanner.scan("x y\n" + wrapped + "\n and more text" * 9)] == [(name, 1.0)]
    words = license_dice.normalised_words
    assert words("COPYRIGHT HOLDERS be\nCopyright 2020 Me\n© Them\nCopyright The Authors\n(c) You may copy") == ["copyright", "holders", "be", "c", "you", "may", "copy"]
    assert words("Copyright 2020 A B, which of all these many words is no holder of it") == words("A B, which of all these many words is no holder of it")


def test_license_families_and_all_matches(spark):
    gnu = """This {0} is free software{4} you can redistribute it and/or modify
it under the terms of the GNU {1} as published by
the Free Software Foundation{5} either version {2} of the License, or
(at your option) any later version.

This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {1} for more details."""
    notices = {
        "GPL-2.0": gnu.format("program", "General Public License", "2", "", ";", ";"),
        "GPL-3.0": gnu.format("program", "General Public License", "3", "", ":", ","),
        "AGPL-3.0": gnu.format("program", "Affero General Public License", "3", "", ":", ","),
        "LGPL-2.1": gnu.format("library", "Lesser General Public\nLicense", "2.1", "", ";", ";"),
        "LGPL-3.0": gnu.format("program", "Lesser General Public License", "3", "", ":", ","),
        "EPL-2.0": "This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n"
                   " * which is available at https://www.eclipse.org/legal/epl-2.0/",
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."}
    texts = [(i, f"int x;\n{t}\nint y;") for i, t in enumerate(notices.values())]
    for k, t in list(notices.items())[:5]:  # the first paragraph alone too
        texts.append((len(texts), t.split("\n\n")[0]))
    both = "\n".join(["one two", notices["AGPL-3.0"], "three four", license_dice.NOTICES["MIT"], "five", notices["EPL-2.0"]])
    d = spark.createDataFrame([*texts, (100, both), (101, None)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_dice.scan_documents(d).collect()}
    for i, k in enumerate([*notices, *list(notices)[:5]]):
        assert [x["license"] for x in found[i]["matches"]] == [k] == [found[i]["license"]] and found[i]["dice"] > 0.97
    assert {x["license"] for x in found[100]["matches"]} == {"AGPL-3.0", "MIT", "EPL-2.0"} and found[100]["n_matches"] == 3
    assert tuple(found[100]["matches"][0]) == tuple(found[100][x] for x in ("license", "dice", "first_word", "end_word"))
    assert found[101]["matches"] == []
    scanner = license_dice.LicenseScanner(license_dice.standard_templates())
    for k in ("MIT", "ISC", "BSD"):  # with the disclaimer
        whole = max((t for x, t in license_dice.MORE_NOTICES if x == k), key=len)
        (name, dice, first, end), = scanner.scan(whole + " gamma")
        assert (name, dice, first, end) == (k, 1.0, 0, len(license_dice.normalised_words(whole)))


def _links_by_force(x):
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    return near


def test_cap_filters_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 64))
    vectors = np.vstack((base, base[:150] + rng.normal(size=(150, 64)) * 0.15, base[:20], np.repeat(base[:1], 60, 0))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None), (5001, [0.0] * 64), (5002, [float("nan")] * 64), (5003, [])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {r["vec_id"]: r for r in cap_filters.near_duplicate_vectors(d, cap_filters.CapCode(chunk=40)).collect()}
    x = vectors.astype(np.float64)
    near = _links_by_force(x / np.linalg.norm(x, axis=1, keepdims=True))
    got = np.array([found[i]["n_links"] for i in range(len(x))])
    assert (got <= near.sum(1)).all() and got.sum() >= 0.98 * near.sum()
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] and found[i]["component_id"] == i for i in range(5000, 5004))
    assert cap_filters.near_duplicate_vectors(d.limit(0)).collect() == []


def test_list_decoding_is_complete():
    rng = np.random.default_rng(2)
    rotation, codes = cap_filters.product_code(16, 9, 3)
    x = rng.normal(size=(20, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ rotation
    for i, found in enumerate(cap_filters.list_decode(x, rotation, codes, 0.2)):
        want = [a * 9 + b for a in range(9) for b in range(9) if y[i, :8] @ codes[0][a] + y[i, 8:] @ codes[1][b] >= 0.2]
        assert found.tolist() == want


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(None, 3), (7, 7)] + [(i, i + 1) for i in range(400, 440)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in links:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {v: find(v) for v in root} and len(found) == len(root)


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(6)
    for _ in range(50):
        old = [rng.randint(0, 50) for _ in range(rng.randint(1, 5))]
        new = flow_resharding.even_capacities(sum(old), rng.randint(1, 6))
        moves = flow_resharding.transfers(old, new)
        assert [sum(r) for r in moves] == old and [sum(c) for c in zip(*moves)] == new
        moved = sum(x for i, r in enumerate(moves) for j, x in enumerate(r) if i != j)
        assert moved == sum(max(0, o - (new[i] if i < len(new) else 0)) for i, o in enumerate(old))
    assert flow_resharding.min_cost_flow([3, 2], [3, 2], [[5, 1], [1, 5]]) == [[1, 2], [2, 0]]


def test_shards_are_even_and_gapless(spark):
    rows = queries.QUERIES["op10_flow_resharding"](spark, SF01).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert len(rows) == len(texts) and set(rows["law"]) == {"bytes"}
    assert all(zlib.crc32(texts[i].encode()) == c and len(texts[i].encode()) + 1 == s for i, c, s in zip(rows["doc_id"], rows["text_crc32"], rows["size"]))
    sizes = rows.groupby("shard")["size"].sum()
    assert sorted(sizes.index) == list(range(8)) and sizes.max() < 1.05 * sizes.min()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in rows.groupby("shard"))


def _groups_in_several_shards(rows):
    return int((rows.groupby("text")["shard"].nunique() > 1).sum())


def test_equal_texts_share_a_shard(spark, documents):
    docs = spark.createDataFrame([(1000 + i, f"copy {i % 40} " * (1 + i % 2)) for i in range(600)], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(docs)
    resharded, moves = flow_resharding.reshard(docs, 5, 8)
    rows = resharded.select(F.coalesce("text", F.lit("")).alias("text"), "shard", "_size", "old_shard").toPandas()
    assert _groups_in_several_shards(rows[rows["text"].str.startswith("copy ")]) == 0
    of_text = rows.groupby("text").agg(shards=("shard", "nunique"), size=("_size", "sum"))
    assert (of_text.loc[of_text["shards"] > 1, "size"] > 2 * int(0.02 * rows["_size"].sum() / 8)).all()
    sizes = rows.groupby("shard")["_size"].sum()
    ends = {j: sum(1 for row in moves if row[j] and sum(map(bool, row)) > 1) for j in range(8)}
    assert len(sizes) == 8 and all(abs(sizes[j] - sizes.mean()) <= 2 * ends[j] * 0.02 * sizes.mean() + 1 for j in range(8))
    moved = rows.loc[rows["shard"] != rows["old_shard"], "_size"].sum()
    assert abs(moved - sum(x for i, r in enumerate(moves) for j, x in enumerate(r) if i != j)) < 0.02 * rows["_size"].sum()


def test_a_text_of_a_third_of_all_rows_is_cut_and_no_other(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot " * 30)).otherwise(
        F.concat(F.lit("text "), (F.col("id") % 1500).cast("string"), F.repeat(F.lit(" word"), 20))).alias("text"))
    rows = flow_resharding.reshard(docs, 5, 8)[0].select("text", "shard", "_size").toPandas()
    assert _groups_in_several_shards(rows) == 1
    sizes = rows.groupby("shard")["_size"].sum()
    assert len(sizes) == 8 and sizes.max() < 1.03 * sizes.min()
    plan = flow_resharding.reshard(docs, 5, 8)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_cuts_equal_those_of_a_sorted_list(spark):
    """Each boundary against the whole order of its old shard, one document at a time, with and without slack."""
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, "w" * rng.choice([3, 40, 41, 300]) + str(rng.randint(0, 25))) for i in range(400)], "doc_id long, text string")
    keys = flow_resharding._ordered(docs.withColumn("old_shard", (F.col("doc_id") % 2).cast("int"))).select("old_shard", "_at", "_size")
    rows = sorted(tuple(r) for r in keys.collect())
    cuts = [{"old_shard": i, "number": n, "byte": b, "within": ""} for i in (0, 1) for n, b in enumerate((1, 777, 5000, 9000))]
    for slack in (0, 150, 1 << 40):
        placed = flow_resharding._boundaries(keys, cuts, slack)
        for c in cuts:
            mine = [(at, size) for i, at, size in rows if i == c["old_shard"]]
            got = sum(size for at, size in mine if at < placed[c["old_shard"], c["number"]])
            ends = [0]
            texts = [0]
            for k, (at, size) in enumerate(mine):
                ends.append(ends[-1] + size)
                if k + 1 == len(mine) or mine[k + 1][0][:35] != at[:35]:
                    texts.append(ends[-1])
            whole = min(abs(e - c["byte"]) for e in texts)
            assert abs(got - c["byte"]) == (whole if whole <= slack else min(abs(e - c["byte"]) for e in ends))


def test_folder_of_shards_is_resharded(spark, tmp_path):
    """Real shards with a clashing column: untouched ones stay, rows are those of before, bytes are near even."""
    source, target = str(tmp_path / "old"), str(tmp_path / "new")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 11, "x").alias("text"),
                                   F.col("id").alias("size"), F.when(F.col("id") < 200, 0).when(F.col("id") < 300, 1).otherwise(2).alias("shard"))
    docs.write.partitionBy("shard").parquet(source)
    folders, moves = flow_resharding.reshard_folder(spark, source, target, 3, 4)
    assert sorted(folders) == [0, 1, 2, 3] and moves == [[1200, 0, 0, 1200], [0, 1200, 0, 0], [0, 0, 1200, 0]]
    assert [f.startswith(target) for _, f in sorted(folders.items())] == [True, False, False, True]
    rows = [tuple(r) for f in folders.values() for r in spark.read.parquet(f).select("doc_id", "text", "size").collect()]
    assert sorted(rows) == [(i, str(i).rjust(11, "x"), i) for i in range(400)]
    again, moves = flow_resharding.reshard_folder(spark, source, str(tmp_path / "same"), 3, 3)
    assert len(again) == 3 and all(f.startswith(str(tmp_path / "same")) for j, f in again.items() if sum(moves[j]) != moves[j][j])
    with pytest.raises(ValueError):
        flow_resharding.reshard_folder(spark, source, str(tmp_path / "few"), 2, 4)


def test_costs_of_any_kind_against_enumeration():
    def least(supply, capacity, cost):
        """By trying every way to place the first supply's next unit."""
        i = next((i for i, s in enumerate(supply) if s), None)
        if i is None:
            return 0
        rest = supply[:i] + [supply[i] - 1] + supply[i + 1:]
        return min((cost[i][j] + least(rest, capacity[:j] + [c - 1] + capacity[j + 1:], cost) for j, c in enumerate(capacity) if c), default=10 ** 9)

    rng = random.Random(21)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 2) for _ in range(n)]
        capacity = [rng.randint(0, 3) for _ in range(m)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = [[rng.randint(0, 9) for _ in range(m)] for _ in range(n)]
        flow = flow_resharding.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply and all(sum(c) <= k for c, k in zip(zip(*flow), capacity))
        assert sum(x * c for r, cs in zip(flow, cost) for x, c in zip(r, cs)) == least(supply, capacity, cost)


def test_frequent_words_of_any_length_are_counted(spark, monkeypatch):
    """Few buckets, so that rare long words share them with frequent ones: the same words as a plain count."""
    from panelwise.llm import quality_divergence as qd

    rng = random.Random(8)
    words_ = [rng.choice(["a", "of", "wide", "information", "government", "x1", "longer,"] + [f"{'w' * 6}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]) for _ in range(6000)]
    words_ += ["information"] * 500 + ["éternellement"] * 400
    each = spark.createDataFrame([("en" if i % 3 else "de", w) for i, w in enumerate(words_)], "language string, word string")
    for buckets in (1, 7, 1 << 14):
        monkeypatch.setattr(qd, "BUCKETS", buckets)
        found = {(r["language"], r["word"]): r["n"] for r in qd._frequent_words(each, 3).collect()}
        for language in ("en", "de"):
            plain = {}
            for i, w in enumerate(words_):
                if (i % 3 == 0) == (language == "de") and w.isalpha():
                    plain[w] = plain.get(w, 0) + 1
            top = sorted(plain, key=lambda w: (-plain[w], w))[:3]
            mine = {w: n for (x, w), n in found.items() if x == language}
            assert sorted(mine, key=lambda w: (-mine[w], w))[:3] == top and all(mine[w] == plain[w] for w in top)
