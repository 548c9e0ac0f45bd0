import pytest

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
TEXT = " ".join(f"w{i % 97}x{i * 7 % 31}" for i in range(120))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns that clash with working names."""
    rows = [(1, TEXT, "en", "a", 9, "k"), (1, TEXT, "en", "a", 9, "k"), (2, TEXT, "en", None, 9, "k"), (3, None, None, None, None, None),
            (4, "", "en", "b", 0, ""), (None, "null id", "de", "b", 7, None), (5, "one", None, "c", 3, "k"), (6, "two words " * 60_000, "en", "a", 1, "k"),
            (7, " \t\n ", "en", "b", 4, "k"), (8, TEXT + " changed end", "en", "a", 1, "k")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    d = spark.createDataFrame(rows, schema)
    for c in ("row", "kept", "key", "shard", "place", "words", "n_words", "prefix", "start", "taken"):
        d = d.withColumn(c, d["size"])
    return d


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")
