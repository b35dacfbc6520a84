"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Golden-ratio points are mapped through the cumulative weights of the sources, so
slot t belongs to the source whose interval holds point t, and any stretch of
slots has nearly each source's share. Slots are ranked within their source, the
documents of a source are shuffled by a hash and cut into blocks of equally many
words, and slot k of a source is joined with its block k. A source whose target
exceeds its size starts over; its blocks end at the target, and slots beyond
stay unused.

Points and interval ends are whole numbers of 62 bits, so that a source of one
block among 2**40 has its interval. Points stray from even shares by less than
the logarithm of their number, and each source gets as many slots to spare; a
block that had none even so would follow all slots, so no words are ever lost.

Null texts have no words, a null source is a source, equal rows are rows of
their own, empty tables give empty results; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwright.llm.common import chosen, table
from seqwright.scratch import written

BLOCK_WORDS = 256
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2
#: Points are whole numbers below 2 ** POINT_BITS; _STEP is that times the golden ratio's inverse, an odd number.
POINT_BITS = 62
_STEP = 2850178704830799621
SLOTS_TOGETHER = 1 << 16
ROWS_TOGETHER = 1 << 10


def sums_before(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over all rows before in ``order``, which no two rows share.

    Sums run within ranges of the order and over the ranges' totals, of which
    there is one a partition.
    """
    dealt = written(rows.withColumn("__value", value).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "mixing-ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("__range").agg(F.sum("__value").alias("own")).select("__range", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("__first"))
    inside = F.sum("__value").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    found = dealt.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(starts, "__range")
    return found.withColumn(name, F.col("__first") + F.col("__inside")).drop("__value", "__range", "__first", "__inside")


def targets(sizes: DataFrame, *, share: float = TOTAL_SHARE, repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size; a row a source) with place, weight and target.

    Sources in the order of their code points, null last, have the weights in
    turn and share ``share`` times the words of all. A target stops at
    ``repeats`` times its source's size, and the excess is shared anew: the
    level of words a weight rises, by an aggregate over the sources a round,
    until no more sources are full.
    """
    rows = sums_before(sizes, [F.col("source").isNull(), F.col("source")], F.lit(1), "place")
    rows = rows.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("place"), F.lit(len(weights))))).withColumn("cap", F.col("source_size") * repeats)
    rows = written(rows, "mixing-sources")
    total, weight = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level, n_full = share * (total or 0) / (weight or 1), 0
    while True:
        full = rows.where(F.col("cap") < F.col("weight") * F.lit(level))
        n, words, heavy = full.agg(F.count("*"), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == n_full or heavy == weight:
            break
        level, n_full = (share * total - words) / (weight - heavy), n
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))).drop("cap")


def spare_slots(blocks: int) -> int:
    """Slots beyond its blocks that each source gets: the points stray from even shares by less."""
    return 8 + blocks.bit_length()


def point(slot: Column) -> Column:
    """slot * _STEP modulo 2 ** 62, for slots below 2 ** 42, without overflow of 64 bits."""
    high, low = F.shiftright(slot, 21), slot.bitwiseAND((1 << 21) - 1)
    upper, lower = _STEP >> 31, _STEP & (1 << 31) - 1
    first = (high * upper % (1 << 31) * (1 << 21) + low * upper) % (1 << 31) * (1 << 31)
    second = (high * lower % (1 << 41) * (1 << 21) + low * lower) % (1 << 62)
    return (first + second) % (1 << 62)


def intervals(shares: DataFrame, total: int) -> DataFrame:
    """place, low, high: the points of each source, in proportion to its ``share`` of ``total``."""
    placed = sums_before(shares, [F.col("place")], F.col("share"), "before")
    scale = lambda c: F.expr(f"CAST({c} AS DECIMAL(19,0)) * CAST({1 << POINT_BITS} AS DECIMAL(19,0)) DIV CAST({total} AS DECIMAL(19,0))")
    return placed.select("place", scale("before").alias("low"), scale("before + share").alias("high"))


def schedule(spark: SparkSession, plan: DataFrame) -> tuple[DataFrame, int]:
    """slot, place, rank: which source each slot belongs to and the number of the slot within its source; and the number of slots.

    ``plan`` has place and blocks. Interval ends are found by an equi-join on
    grid cells, and ranks are counted within stretches of slots first, so no
    task sees all slots of a source.
    """
    own = plan.where(F.col("blocks") > 0)
    blocks, n = own.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count("*")).first()
    spare = spare_slots(blocks)
    total = blocks + n * spare
    slots = spark.range(total).select(F.col("id").alias("slot"), point(F.col("id")).alias("point"))
    shift = POINT_BITS - max(1, (4 * n).bit_length())  # a grid of four to eight cells a source
    spans = intervals(own.select("place", (F.col("blocks") + spare).alias("share")), max(total, 1))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))))
    placed = slots.withColumn("cell", F.shiftright("point", shift)).join(cells, "cell").where("point >= low AND point < high")
    placed = placed.select("slot", "place", F.expr(f"slot DIV {SLOTS_TOGETHER}").alias("stretch"))
    counts = placed.groupBy("place", "stretch").agg(F.count("*").alias("own"))
    before = Window.partitionBy("place").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("place", "stretch", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("place", "stretch").orderBy("slot")) - 1
    found = placed.withColumn("inside", inside).join(starts, ["place", "stretch"]).select("slot", "place", (F.col("first") + F.col("inside")).alias("rank"))
    return found, total


def streams(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` (source, key, size) with their source's columns and ``start``, the words before them in their source's shuffled stream.

    Sums run within buckets of the shuffle hash, about ROWS_TOGETHER rows each,
    and over the buckets' totals, so a hot source is spread over many tasks.
    """
    rows = docs.join(plan, docs["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    buckets = F.greatest(F.lit(1), F.expr(f"source_rows DIV {ROWS_TOGETHER}"))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 16), buckets))
    order = Window.partitionBy("place", "bucket").orderBy("key")
    rows = rows.withColumn("number", F.row_number().over(order)).withColumn("inside", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = rows.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("place").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("place", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first"))
    return rows.join(starts, ["place", "bucket"]).withColumn("start", F.col("first") + F.col("inside")).drop("first", "inside")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the shuffle key of each row of documents."""
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("size"), F.xxhash64(F.lit(7), "doc_id", "source", "text").alias("key"))


def mix(sizes: DataFrame) -> DataFrame:
    """The mix of the rows of :func:`sized`: a row a document and block that shares words with it.

    Columns doc_id, source, key, size, source_size, target, place, bucket,
    number (these three name a row), and slot, pass (0 or 1), from_word, to_word
    (the words of that document which the slot takes). Documents of which no
    word is taken have one row with null slot and words. Null sources are a
    source, null texts have no words; equal rows are rows of their own.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    plan = written(targets(totals).withColumn("quota", F.floor("target").cast("long")).withColumn("blocks", F.ceil(F.col("quota") / BLOCK_WORDS).cast("long")), "mixing-targets")
    rows = streams(sizes, plan)
    first, after = F.col("pass") * F.col("source_size") + F.col("start"), F.col("pass") * F.col("source_size") + F.col("start") + F.col("size")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1)))).withColumns({"low": first, "high": F.least(after, F.col("quota"))})
    own = F.when(F.col("low") < F.col("high"), F.sequence(F.expr(f"low DIV {BLOCK_WORDS}"), F.expr(f"(high - 1) DIV {BLOCK_WORDS}")))
    pieces = rows.withColumn("rank", F.explode_outer(own))
    low = F.greatest(F.col("low"), F.col("rank") * BLOCK_WORDS) - F.col("low")
    high = F.least(F.col("high"), (F.col("rank") + 1) * BLOCK_WORDS) - F.col("low")
    pieces = pieces.withColumns({"from_word": low, "to_word": high})
    slots, n_slots = schedule(sizes.sparkSession, plan)
    found = pieces.join(slots, ["place", "rank"], "left").withColumn("slot", F.when(F.col("rank").isNotNull(), F.coalesce("slot", F.col("rank") + n_slots)))
    keep = F.col("slot").isNotNull()
    return found.select(
        "doc_id", "source", "key", "size", "source_size", "target", "place", "bucket", "number", "slot", F.when(keep, F.col("pass")).alias("pass"), F.when(keep, F.col("from_word")).alias("from_word"), F.when(keep, F.col("to_word")).alias("to_word")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that the mix takes: a row a document and pass, its text cut to the words taken where the target ends inside it.

    Other columns stay, but n_chars, where there is one, follows the text. A
    document of which nothing is taken has no row.
    """
    names = docs.columns
    parts = mix(sized(docs)).where("slot IS NOT NULL")
    taken = parts.groupBy("doc_id", "key", "place", "bucket", "number", "size", "pass").agg(F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"))
    row = Window.partitionBy("key")
    takes = taken.withColumn("copy", F.dense_rank().over(row.orderBy("place", "bucket", "number"))).select(F.col("key").alias("__key"), F.col("copy").alias("__copy"), F.col("size").alias("__size"), "from_word", "to_word")
    own = docs.withColumn("__key", F.xxhash64(F.lit(7), "doc_id", "source", "text"))
    own = own.withColumn("__copy", F.row_number().over(Window.partitionBy("__key").orderBy("__key")))
    found = own.join(takes.withColumnsRenamed({"from_word": "__from", "to_word": "__to"}), ["__key", "__copy"])
    pieces = F.split("text", "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")  # a word and the space after it; at first perhaps only space
    lead = F.when(F.col("text").rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    own = F.array_join(F.slice(pieces, (F.col("__from") + lead + 1).cast("int"), (F.col("__to") - F.col("__from")).cast("int")), "")
    text = F.when((F.col("__from") == 0) & (F.col("__to") == F.col("__size")), F.col("text")).otherwise(own)
    found = found.withColumn("__text", text)
    chars = {"n_chars": F.char_length("__text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {}
    return found.select(*[F.col("__text").alias("text") if c == "text" else chars[c].alias(c) if c in chars else F.col(f"`{c}`") for c in names])


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chosen(table(spark, sf_dir, "documents"), doc_id="doc_id", source="source", text="text")
    sizes = written(sized(docs), "mixing-sizes")
    row = ["doc_id", "size", "source_size", "target", "place", "bucket", "number"]
    taken = mix(sizes).groupBy(*row).agg(F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")
