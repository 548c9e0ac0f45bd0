"""Quality rules by distribution divergence (native).

A document is compared with the reference of its language in two histograms:
its character classes and its counts of the language's most common words.
Both distances are Jensen-Shannon distances (base 2, so 0 to 1).  A document
is rejected if either exceeds its limit; documents under the minimum length
are not judged by divergence, for short histograms are noise.  A language with
few documents is no reference for its own: its documents are compared, in
coarser classes that no script stands out in, with those of all languages.

Two scans: the first gathers the references over all documents (one wide
aggregate and one word count, both combined before the shuffle), the second
is map-only.  No text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.shared import WORD_CLASS, joined_small, without_spaces, words, written

SYMBOLS = r"[#*$%&|<>]+"
#: A common word holds letters only: no ASCII character but a-z and A-Z.
LETTERS_ONLY = r"^[^\x00-\x40\x5B-\x60\x7B-\x7F]+$"
#: Letters of a word that is counted by itself at once, and buckets a language of longer ones.
SHORT, BUCKETS = 5, 1 << 12
CLASSES = ("lower", "upper", "digit", "space", "other_ascii", "beyond_ascii")
#: Letters of any script, digits, spaces and the rest, of those classes.
COARSE = ((0, 1, 5), (2,), (3,), (4,))


@dataclass(frozen=True)
class DivergenceLimits:
    """Parameters of the rule.

    ``common_words`` per language; ``min_words`` and ``min_chars`` guard the
    word and the class distance, ``min_documents`` (of at least ``min_chars``
    characters) a language's own reference.
    """

    common_words: int = 24
    min_documents: int = 20
    min_words: int = 100
    min_chars: int = 400
    max_class_distance: float = 0.25
    max_word_distance: float = 0.31
    min_base_words: int = 50
    max_repeat_percent: int = 50


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays that each sum to 1."""
    half = lambda a, b: F.when(a > 0, a * F.ln(a / ((a + b) / 2))).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), _total(both) / 2 / F.ln(F.lit(2.0))))


def _class_counts(d: DataFrame) -> DataFrame:
    """Adds ``compact`` and ``classes``; each class is what its removal shortens the rest by."""
    d = d.withColumn("compact", without_spaces(F.col("text")))
    d = d.withColumn("rest1", F.regexp_replace("compact", "[a-z]+", ""))
    d = d.withColumn("rest2", F.regexp_replace("rest1", "[A-Z]+", ""))
    d = d.withColumn("rest3", F.regexp_replace("rest2", "[0-9]+", ""))
    d = d.withColumn("rest4", F.regexp_replace("rest3", r"[\x00-\x7F]+", ""))
    n = [F.length(c).cast("long") for c in ("compact", "rest1", "rest2", "rest3", "rest4")]
    space = F.length("text").cast("long") - n[0]
    return d.withColumn("classes", F.array(n[0] - n[1], n[1] - n[2], n[2] - n[3], space, n[3] - n[4], n[4]))


def _coarse(classes: Column) -> Column:
    return F.array(*[reduce(lambda a, b: a + b, [F.get(classes, F.lit(i)) for i in group]) for group in COARSE])


def _frequent_words(each: DataFrame, most: int) -> DataFrame:
    """``language, word, n`` of all words of letters that may be among a language's ``most`` frequent, counted exactly.

    Short words are counted one by one, longer ones first by buckets of a
    hash.  A bucket with fewer words than the last short word in question
    holds none that is as frequent; only the words of the others are counted.
    """
    short = F.length("word") <= SHORT
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    both = each.select("language", F.when(short, F.col("word")).alias("word"), F.when(~short, bucket).alias("bucket"))
    both = written(both.groupBy("language", "word", "bucket").agg(F.count("*").alias("n")), "word-counts")
    counts = both.where(F.col("word").rlike(LETTERS_ONLY)).select("language", "word", "n")  # once a different word, not once a word
    place = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n")))
    last = counts.withColumn("place", place).where(F.col("place") == most).select("language", F.col("n").alias("least"))
    heavy = both.where("bucket IS NOT NULL").join(last, "language", "left").where(F.col("n") >= F.coalesce("least", F.lit(1)))
    heavy = written(heavy.select("language", "bucket"), "word-buckets")
    if heavy.isEmpty():
        return counts
    longer = joined_small(each.where(~short).withColumn("bucket", bucket), heavy, ["language", "bucket"])
    longer = longer.groupBy("language", "word").agg(F.count("*").alias("n"))
    return counts.unionByName(longer.where(F.col("word").rlike(LETTERS_ONLY)))


def language_references(docs: DataFrame, limits: DivergenceLimits = DivergenceLimits()) -> DataFrame:
    """One row per language: ``language, n_documents, class_sums, class_share, common, common_share``.

    They are gathered over all documents of at least ``min_chars``
    characters, those that are judged by their classes.  ``common`` are a language's most frequent words of letters (ties:
    the smaller word); ``common_share`` has their shares of all words and,
    last, the share of the rest.
    """
    d = docs.select(F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.where(F.length("text") >= limits.min_chars)
    sums = F.array(*[F.sum(F.col("classes")[i]) for i in range(len(CLASSES))])
    total = lambda xs: F.greatest(F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    classes = (_class_counts(d).withColumn("n", F.size(words(F.col("text"))))
               .groupBy("language").agg(F.count("*").alias("n_documents"), sums.alias("class_sums"), F.sum("n").alias("n_words"))
               .withColumn("class_share", F.transform("class_sums", lambda x: x / total(F.col("class_sums")))))
    counts = _frequent_words(d.select("language", F.explode(words(F.col("text"))).alias("word")), limits.common_words)
    first = Window.partitionBy("language").orderBy(F.desc("n"), "word")
    top = (counts.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limits.common_words)
           .groupBy("language").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top")))
    both = classes.join(top, "language", "left").withColumn("top", F.coalesce("top", F.expr("array()").cast(
        "array<struct<place:int,word:string,n:bigint>>")))
    n_words = F.greatest(F.col("n_words"), F.lit(1))
    rest = (F.col("n_words") - F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])) / n_words
    return both.select("language", "n_documents", "class_sums", "class_share", F.transform("top", lambda x: x["word"]).alias("common"),
                       F.concat(F.transform("top", lambda x: x["n"] / n_words), F.array(rest)).alias("common_share"))


def _pooled(refs: DataFrame) -> Column:
    """The coarse shares of all languages' documents together, four numbers; null where there are none."""
    row = refs.agg(*[F.coalesce(F.sum(F.col("class_sums")[i]), F.lit(0)) for i in range(len(CLASSES))]).first()
    sums = [sum(row[i] for i in group) for group in COARSE]
    return F.array(*[F.lit(x / sum(sums)) for x in sums]) if sum(sums) else F.lit(None).cast("array<double>")


def _base_counts(d: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long)."""
    d = _class_counts(d.withColumn("words", words(F.col("text"))))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD_CLASS)))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    w, last = F.col("words"), F.size("words") - 3
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
        F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.expr("array()").cast("array<bigint>"))
    d = d.withColumn("grams", grams)
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    d = d.withColumn("sorted", F.when(repeated, F.sort_array(
        F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("sorted")
    same = lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(
        x["h"] == F.get(s, k + 1)["h"], F.lit(False))
    d = d.withColumn("starts", F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"])))
    # each window found again covers three words, less what the next one covers as well
    gaps = F.zip_with("starts", F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))),
                      lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0))
    return d.select("*", F.length("compact").cast("long").alias("word_chars"),
                    (F.length("compact") - F.length(F.regexp_replace("compact", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                    covered.cast("long").alias("n_repeat_words"))


def divergence_report(docs: DataFrame, limits: DivergenceLimits = DivergenceLimits(),
                      references: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: its counts, ``class_distance``, ``word_distance``, ``base_failed`` and ``kept``.

    ``docs`` needs doc_id, text and lang; ``references`` (language, class_share,
    common, common_share) default to those of all of ``docs``, and those given
    hold whatever they were made of; the columns named in ``keep`` are carried along in the struct ``row``.  Null text counts
    as empty and fails the base rule; a null lang is a language of its own;
    a distance is null where its guard or a missing reference leaves the
    document unjudged, which keeps it.  Repeated rows are judged alike, one
    result row each; an empty table gives no rows.  Windows of three words
    are told apart by 64-bit hashes within one document.
    """
    row = F.struct(*keep) if keep else F.lit(None)
    d = docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("text", F.lit("")).alias("text"), row.alias("row"))
    refs = written(language_references(docs, limits) if references is None else references, "language-references")
    own = refs if references is not None else refs.where(F.col("n_documents") >= limits.min_documents)
    d = joined_small(_base_counts(d), own.select("language", "class_share", "common", "common_share"), "language", "left")
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("n_chars_all", chars)
    d = d.withColumn("frequent", F.filter("words", lambda w: F.array_contains("common", w)))  # one pass of the words, not one for each
    d = d.withColumn("common_counts", F.transform("common", lambda c: (F.size("frequent") - F.size(F.array_remove(F.col("frequent"), c))).cast("long")))
    others = F.col("n_words") - F.aggregate("common_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("all_counts", F.concat("common_counts", F.array(others)))
    share = lambda counts, n: F.transform(counts, lambda x: x / F.col(n))
    distance = js_distance(share("classes", "n_chars_all"), F.col("class_share"))
    if references is None:
        distance = F.when(F.col("class_share").isNotNull(), distance).otherwise(js_distance(share(_coarse(F.col("classes")), "n_chars_all"), _pooled(refs)))
    d = d.withColumn("class_distance", F.when(F.col("n_chars_all") >= limits.min_chars, distance))
    d = d.withColumn("word_distance", F.when(F.col("n_words") >= limits.min_words,
                                             js_distance(share("all_counts", "n_words"), F.col("common_share"))))
    d = d.withColumn("base_failed", (F.col("n_words") < limits.min_base_words)
                     | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")))
    far = F.coalesce(F.col("class_distance") > limits.max_class_distance, F.lit(False)) | F.coalesce(
        F.col("word_distance") > limits.max_word_distance, F.lit(False))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance", "row")


def keep_close_documents(docs: DataFrame, limits: DivergenceLimits = DivergenceLimits()) -> DataFrame:
    """The documents whose report says ``kept``, with all their columns.

    Null, empty and short texts fail the base rule and go; repeated rows are
    judged alike and stay each; a null language is one like others; an empty
    table gives no rows.
    """
    report = divergence_report(docs, limits, keep=tuple(docs.columns))
    # the filter needs a column that isn't deterministic: pushed down, it would repeat the whole chain of
    # expressions that the verdict hangs on
    report = report.select("kept", "row", F.monotonically_increasing_id().alias("here"))
    return report.where(F.col("kept") & (F.col("here") >= 0)).select("row.*")
