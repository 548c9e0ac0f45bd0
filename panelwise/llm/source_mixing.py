"""Mixing sources to target weights by a low-discrepancy schedule (native).

The mix is a sequence of slots, each a block of ``block`` words.  Slot k has
the k-th point of a golden-ratio sequence, and the source whose interval of
the cumulated targets holds the point; so every stretch of the schedule is
near the weights.  Each source's documents, shuffled by a keyed hash, are cut
into equal blocks; the slot of rank r within its source takes block r, going
round again after the last.  A document's share is the sum, over the blocks
it overlaps, of the overlap times the slots that take the block.

All keys are spread: documents by (source, hash prefix), slots by (source,
run of slots), pieces by (source, block).  Only per-source figures, and
per-prefix sums within a source, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.shared import SPACE_CLASS, WORD_CLASS, joined_small, words, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 128
#: Golden-ratio points in whole numbers: k * STEP mod MODULUS, a full cycle, for STEP is odd.
MODULUS = 1 << 31
STEP = 1327217885
#: Cells that the points are joined to the sources' intervals by; they are as evenly hit as the points are spread.
CELLS = 4096
#: Slots in a run, within which they are ranked by source.
RUN = 1 << 16
#: Hex digits of a document's hash that spread a source over groups.
PREFIX = 4


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per source: ``number`` (its place by code point, null last), ``source_size``, ``weight`` and ``target``.

    The targets fill ``share`` of all words by weight; a source whose target
    would pass ``most`` times its size stops there, and the excess goes to
    the others by weight until none is above: sources are filled in order of
    ``most * size / weight``, and the first that isn't full sets the level,
    which is the highest of those that leave their own source open.
    One row a source; the windows here run over those rows alone.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    d = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    d = d.withColumn("number", F.row_number().over(by_name) - 1)
    d = d.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    d = d.withColumn("limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    everything = Window.partitionBy()
    full_before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = share * F.sum("source_size").over(everything)
    d = d.withColumn("level", (total - full_before) / weight_left)
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    d = d.withColumn("final", F.max(open_level).over(everything))
    d = d.withColumn("target", F.least(F.coalesce(F.col("final") * F.col("weight"), F.col("limit")), F.col("limit")))
    return d.select("source", "number", "source_size", "weight", "target")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots: ``slot, number`` (of the source) and ``rank`` (gapless from 0 within the source).

    ``targets`` is a written table.
    """
    spark = targets.sparkSession
    n = targets.agg(F.ceil(F.coalesce(F.sum("target"), F.lit(0.0)) / block).cast("long")).first()[0]
    upto = F.sum("target").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("target").over(Window.partitionBy())
    ends = targets.withColumn("hi", F.round(upto / total * MODULUS).cast("long"))
    ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("number")), F.lit(0)))
    width = MODULUS // CELLS
    cells = (ends.where("hi > lo").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))).select("cell", "number", "lo", "hi"))
    slots = spark.range(n).withColumnRenamed("id", "slot")
    slots = slots.withColumn("point", (F.col("slot") % MODULUS + 1) * STEP % MODULUS).withColumn("cell", F.floor(F.col("point") / width))
    d = joined_small(slots, written(cells, "mix-cells"), "cell").where("point >= lo and point < hi")
    d = d.select("slot", "number", F.floor(F.col("slot") / RUN).alias("run"))
    # rank: the slots of the source in the runs before, then the place within the run
    before = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = (d.groupBy("number", "run").agg(F.count("*").alias("n"))
             .select("number", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    d = joined_small(d, written(first, "mix-runs"), ["number", "run"])
    place = Window.partitionBy("number", "run").orderBy("slot")
    return d.select("slot", "number", (F.col("first") + F.row_number().over(place) - 1).alias("rank"))


def _shuffle_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))


def document_positions(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Adds ``start``: the words before a document in its source's shuffled stream.  ``docs`` is a written table."""
    d = joined_small(docs.withColumn("key", _shuffle_key(F.col("doc_id"), seed)), targets.select(
        F.col("source").alias("_source"), "number", "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("prefix", F.substring("key", 1, PREFIX))
    before = Window.partitionBy("number").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    first = (d.groupBy("number", "prefix").agg(F.sum("size").alias("n"))
             .select("number", "prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    within = Window.partitionBy("number", "prefix").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("upto", F.sum("size").over(within)).join(first, ["number", "prefix"])
    return d.withColumn("start", F.col("first") + F.col("upto") - F.col("size")).drop("key", "prefix", "first", "upto")


def mix_documents(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS,
                  block: int = BLOCK, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, start and ``taken`` (words, repeats counted).

    ``docs`` needs doc_id, source and text.  A null text has size 0 and is
    taken 0 times; a null source is a source; repeated rows are documents
    each; an empty table gives no rows.  The source's last block in use is
    dropped where ``most`` rounds are full, so no document exceeds that
    multiple of its own size.  Reruns agree, for the order is hashed.  The
    columns named in ``keep`` are carried along.
    """
    sized = written(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), *keep), "mix-sizes")
    targets = written(source_targets(sized, share, most, weights), "mix-targets")
    placed = document_positions(sized, targets, seed)
    # a block's uses, by the slots whose rank comes round to it
    blocks = F.greatest(F.ceil(F.col("source_size") / block), F.lit(1))
    slots = joined_small(schedule(targets, block), targets.select("number", "source_size"), "number")
    uses = (slots.where(F.floor(F.col("rank") / blocks) < most).groupBy("number", (F.col("rank") % blocks).alias("block"))
            .agg(F.count("*").alias("uses")))
    last = F.greatest(F.col("start") + F.col("size") - 1, F.col("start"))
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    taken = F.sum(overlap * F.coalesce("uses", F.lit(0)))
    sums = (pieces.join(uses, ["number", "block"], "left")
            .groupBy("doc_id", "source", "start", "size", "source_size", "target", *keep)
            .agg(taken.alias("taken"), F.count("*").alias("found")))
    # equal rows of size 0 share a start; they stay rows each
    copies = F.when(F.col("size") == 0, F.col("found")).otherwise(F.lit(1))
    return sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(
        "doc_id", "source", "size", "source_size", "target", "start",
        F.when(F.col("size") > 0, F.col("taken")).otherwise(F.lit(0)).cast("long").alias("taken"), *keep)


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, its lines kept."""
    each = F.split(text, rf"(?<={SPACE_CLASS})(?={WORD_CLASS})")  # a word and the spaces after it; first, perhaps, spaces alone
    leading = text.rlike(f"^{SPACE_CLASS}").cast("int")
    return F.regexp_replace(F.array_join(F.slice(each, F.lit(1), n + leading), ""), f"{SPACE_CLASS}+$", "")


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself, with the columns of ``docs`` (a written table).

    A source's blocks are used equally often but for one more round up to a
    block, so a document is taken as whole repeats and, where that block ends
    within it, once more as its text up to its last word taken (``n_chars``, if
    there, then counts that).  Documents taken 0 times are left out, and so
    are null, empty and blank texts, which have no word to take.  Repeated
    rows are documents each, a null source is one like others, and an empty
    table gives no rows.
    """
    names = docs.columns
    d = docs.select(F.struct(*names).alias("row"), "doc_id", "source", "text")
    d = d.withColumn("id_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))).withColumn("text_key", F.xxhash64("source", "text"))
    alike = Window.partitionBy("id_key", "text_key").orderBy(F.lit(0))
    mix = mix_documents(d.select("doc_id", "source", "text", "id_key", "text_key"), keep=("id_key", "text_key"), **parameters)
    mix = mix.select("id_key", "text_key", "size", "taken", F.row_number().over(alike.orderBy("start")).alias("nth"))
    d = d.withColumn("nth", F.row_number().over(alike)).select("row", "id_key", "text_key", "nth")
    whole, part = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    d = d.join(mix.where("taken > 0"), ["id_key", "text_key", "nth"])
    times = F.concat(F.when(whole > 0, F.array_repeat(F.col("size"), whole.cast("int"))).otherwise(F.array().cast("array<bigint>")),
                     F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    d = d.select("row", "size", F.explode(times).alias("first_words"))
    cut = F.col("first_words") < F.col("size")
    text = F.when(cut, _first_words(F.col("row.text"), F.col("first_words").cast("int"))).otherwise(F.col("row.text"))
    out = {"text": text}
    if "n_chars" in names:
        out["n_chars"] = F.when(cut, F.length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return d.select(*[out.get(c, F.col("row")[c]).alias(c) for c in names])
