"""Repair of damaged conversations by the cheapest edits.

A conversation's rows, in order of turn, are faulty if blank, if an earlier row
has the same role and text, or if they are cut off (the last character that is
not white space is none of ``.!?``). Edits make the initials of its roles an
optional ``s`` and then ``ua`` once or more, or nothing: Keep costs 0, Rerole to
user or assistant 2, Delete 3, Insert an empty user or assistant row 2; blank
and duplicate rows have to be deleted, and a cut-off row that stays adds 1.

Nodes are (rows read, initials so far), arcs are edits. Forward and backward
minimum costs tell the arcs that lie on a cheapest path (tight arcs); from the
start, the set of nodes that the letters so far can lead to is followed over
tight arcs, taking the least letter each time, so that of all cheapest edits the
ASCII-least are found without listing them. Cost vectors less their minimum are
few, so steps are remembered by vector and kind of row.

A conversation may hold any share of all rows: rows are dealt in ranges of
(conversation, turn), one range of a conversation is a segment of a bounded
number of rows, and segments are joined by 4 x 4 matrices of minimum costs
(forward and backward costs at their ends), then by the sets of nodes that they
lead from and to. Only such matrices meet by conversation. Digests and edit
letters are put together from the segments in one pass over sorted rows.

Null roles and texts count as one space, and so do a null id or turn in the text
that the damage is dealt by. Null turns come first; rows of one turn are ordered
by role and the SHA-256 of the text, equal rows are rows of their own. Rows of a null id are one
conversation. A role is known by its first character. Empty tables give empty
results. Very long texts stay in Spark's rows; only kinds of rows reach Python,
and texts once for their digest. Further columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from seqwright.llm.common import chosen, table
from seqwright.scratch import written

#: Rows of a segment, about; ranges are dealt by a sample of the rows.
SEGMENT_ROWS = 5_000
WHITE = "\x20\x09\x0A\x0B\x0C\x0D"
INFINITE = 1 << 40
#: Nodes of a layer: nothing yet, s, an open u, closed by a. NEXT is by node and initial.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
START = (0, INFINITE, INFINITE, INFINITE)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1

#: Kinds of rows: one character each. Upper case is for rows that are cut off, d for those to delete.
KINDS = "suaoSUAOd"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, gone: the rows after damage, dropped ones with ``gone``."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text = F.coalesce("text", blank)
    marked = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("dice"))
    hurt = marked.select(
        "conv_id",
        "turn",
        F.when(F.col("dice") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("dice") == 1, "").when(F.col("dice") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("dice") == 0).alias("gone"),
        "dice",
    )
    copies = F.when(F.col("dice") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    # equal rows may come in any order, but that order has to be one
    return hurt.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text", "gone", (F.monotonically_increasing_id() * 2 + F.col("copy")).alias("copy"))


def faults(rows: DataFrame) -> DataFrame:
    """The rows with ``fault``: blank, duplicate, truncated or null, the first that holds; and ``digest``, of the text."""
    place = F.struct("turn", "copy")
    seen = rows.where("NOT gone").groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # a table, so that a hot key of the join can be split
    seen = written(seen.select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")], "first"), "first-turns")
    same = rows["conv_id"].eqNullSafe(seen["_conv_id"]) & (rows["role"] == seen["_role"]) & (rows["digest"] == seen["_digest"])
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(F.col("first").isNotNull() & (F.col("first") != place), "duplicate")
        .when(~F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1).isin(".", "!", "?"), "truncated")
    )
    return rows.join(seen, same, "left").select("conv_id", "turn", "role", "text", "digest", "gone", "copy", fault.alias("fault"))


def kind(role: Column, fault: Column) -> Column:
    """The character of KINDS of a row."""
    initial = F.substring(role, 1, 1)
    base = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), "d").when(fault == "truncated", F.upper(base)).otherwise(base)


def segments(rows: DataFrame, parts: int) -> DataFrame:
    """conv_id, part, kinds (a character a row), rows and counts of each run of a conversation's rows; rows are dealt to so many ranges."""
    order = ["turn", "role", "digest", "copy"]
    ordered = rows.repartitionByRange(parts, "conv_id", *order)
    r = F.struct(*order, "text", "fault", kind(F.col("role"), F.col("fault")).alias("kind"))
    grouped = ordered.withColumn("part", F.spark_partition_id()).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.when(~F.col("gone"), r))).alias("rows"))
    initials = F.transform("rows", lambda x: F.substring(x["role"], 1, 1))
    pairs = F.zip_with(F.slice("initials", 1, F.greatest(F.size("initials") - 1, F.lit(0))), F.slice("initials", 2, F.greatest(F.size("initials") - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    turns = F.filter(F.transform("rows", lambda x: x["turn"]), lambda t: t.isNotNull())

    def count(fault: str) -> Column:
        return F.size(F.filter("rows", lambda x: x["fault"] == fault)).cast("long").alias(fault)

    return grouped.withColumns({"initials": initials, "turns": turns}).select(
        "conv_id",
        "part",
        F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("rows"),
        F.array_join(F.transform("rows", lambda x: x["kind"]), "").alias("kinds"),
        count("blank"),
        count("duplicate"),
        count("truncated"),
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        F.get("initials", F.lit(0)).alias("first_initial"),
        F.get("initials", F.size("initials") - 1).alias("last_initial"),
        F.get("turns", F.lit(0)).cast("long").alias("low"),
        F.get("turns", F.size("turns") - 1).cast("long").alias("high"),
        F.size(F.array_distinct("turns")).cast("long").alias("distinct_turns"),
    )


def _arcs(node: int, kind: str) -> list[tuple[str, int, int]]:
    """(letter, node after the row, cost) of the edits that read a row of this kind."""
    found = [("D", node, DELETE)]
    if kind != "d":
        extra, to = CUT * kind.isupper(), NEXT[node]
        if kind.lower() in to:
            found.append(("K", to[kind.lower()], KEEP + extra))
        found += [("R", to[x], REROLE + extra) for x in "ua" if x in to]
    return found


_INSERTS = [[to for x, to in NEXT[node].items() if x in "ua"] for node in range(4)]
_ARCS = {(node, kind): _arcs(node, kind) for node in range(4) for kind in KINDS}


def _inserted(costs: list[int], forward: bool) -> tuple[int, ...]:
    """The costs after any inserts; two in a row reach every node that inserts can."""
    for _ in range(2):
        before = list(costs)
        for node in range(4):
            for to in _INSERTS[node]:
                a, b = (node, to) if forward else (to, node)
                costs[b] = min(costs[b], before[a] + INSERT)
    return tuple(min(c, INFINITE) for c in costs)


@lru_cache(maxsize=100_000)
def _ahead(costs: tuple[int, ...], kind: str) -> tuple[int, tuple[int, ...]]:
    """(minimum, costs less it) after a row, inserts before the next one included."""
    found = [INFINITE] * 4
    for node in range(4):
        for _, to, cost in _ARCS[node, kind]:
            found[to] = min(found[to], costs[node] + cost)
    closed = _inserted(found, True)
    least = min(closed)
    # what can follow any node can follow a closed pair for 3 more at most, so a node that costs more is on no cheapest path
    return least, tuple(c - least if c <= closed[3] + DELETE else INFINITE for c in closed)


@lru_cache(maxsize=100_000)
def _back(costs: tuple[int, ...], kind: str) -> tuple[int, tuple[int, ...]]:
    """(minimum, costs less it) to the end from before a row, inserts before it included."""
    found = [min(costs[to] + cost for _, to, cost in _ARCS[node, kind]) for node in range(4)]
    closed = _inserted(found, False)
    return min(closed), tuple(c - min(closed) if c < INFINITE else INFINITE for c in closed)


def through(costs: tuple[int, ...], kinds: str, step) -> tuple[int, ...]:
    """The costs on the other side of the rows: forward by :func:`_ahead`, backward (rows reversed) by :func:`_back`."""
    least = min(costs)
    total, own = least, tuple(c - least if c < INFINITE else INFINITE for c in costs)
    for k in kinds:
        more, own = step(own, k)
        total += more
    return tuple(total + c if c < INFINITE else INFINITE for c in own)


FIRST = _inserted(list(START), True)
LAST = _inserted([0 if node in ENDS else INFINITE for node in range(4)], False)


@lru_cache(maxsize=100_000)
def _walk(frontier: int, costs: tuple[int, ...], kind: str, after: tuple[int, ...], least: int) -> tuple[str, int]:
    """(letters, frontier behind the row) of the least letters over tight arcs through one row.

    costs holds the forward costs before the row, after the backward costs behind
    it; least is the cheapest of all paths, measured as these two are. The
    backward cost of a node before the row follows from those behind it.
    """
    raw = [min(after[to] + cost for _, to, cost in _ARCS[node, kind]) for node in range(4)]
    here = _inserted(raw, False)
    letters = ""
    while True:
        offers: dict[str, int] = {}
        for node in range(4):
            if frontier >> node & 1:
                for letter, to, cost in _ARCS[node, kind]:
                    if costs[node] + cost + after[to] == least:
                        offers[letter] = offers.get(letter, 0) | 1 << to
                for to in _INSERTS[node]:
                    if costs[node] + INSERT + here[to] == least and costs[to] == costs[node] + INSERT:
                        offers["I"] = offers.get("I", 0) | 1 << to
        letter = min(offers)
        letters, frontier = letters + letter, offers[letter]
        if letter != "I":
            return letters, frontier


def letters_of(kinds: str, before: tuple[int, ...], behind: tuple[int, ...], frontier: int, last: bool) -> tuple[str, int, int]:
    """(letters, frontier behind, cheapest cost) of a segment between forward and backward costs at its ends."""
    backs = [tuple(c - min(behind) if c < INFINITE else INFINITE for c in behind)]
    for k in reversed(kinds):
        backs.append(_back(backs[-1], k)[1])
    backs.reverse()
    base = min(before)
    total, costs, found = base, tuple(c - base if c < INFINITE else INFINITE for c in before), []
    for i, k in enumerate(kinds):
        # all costs are less a constant of their own, so the cheapest is measured anew
        raw = [min(backs[i + 1][to] + cost for _, to, cost in _ARCS[node, k]) for node in range(4)]
        least = min(a + b for a, b in zip(costs, _inserted(raw, False)))
        letters, frontier = _walk(frontier, costs, k, backs[i + 1], least)
        found.append(letters)
        more, costs = _ahead(costs, k)
        total += more
    ahead = tuple(total + c if c < INFINITE else INFINITE for c in costs)
    cheapest = min(a + b for a, b in zip(ahead, behind))
    if last:
        nodes = [n for n in range(4) if frontier >> n & 1]
        while not any(n in ENDS and ahead[n] == cheapest for n in nodes):
            nodes = sorted({to for n in nodes for to in _INSERTS[n] if ahead[n] + INSERT + behind[to] == cheapest})
            found.append("I")
    return "".join(found), frontier, cheapest


_COSTS = T.ArrayType(T.LongType())
_NODES = T.ArrayType(T.IntegerType())


@F.pandas_udf(T.StringType())
def _single(kinds: pd.Series) -> pd.Series:
    """Letters of conversations of one segment."""
    known = {k: letters_of(k, FIRST, LAST, 1, True)[0] for k in set(kinds)}
    return kinds.map(known)


@F.pandas_udf(_COSTS)
def _matrix(kinds: pd.Series) -> pd.Series:
    """Minimum costs through a segment, by node before it and node behind it; inserts behind it included."""
    unit = [tuple(0 if n == m else INFINITE for n in range(4)) for m in range(4)]
    return kinds.map(lambda k: [c for u in unit for c in through(u, k, _ahead)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("before", _COSTS), T.StructField("behind", _COSTS)])))
def _chain(matrices: pd.Series) -> pd.Series:
    """Forward and backward costs at the ends of each of a conversation's segments."""

    def of(found) -> list[dict]:
        before, behind = [FIRST], [LAST]
        for m in found:
            before.append(tuple(min(min(before[-1][a] + m[4 * a + b] for a in range(4)), INFINITE) for b in range(4)))
        for m in reversed(found):
            raw = [min(min(m[4 * a + b] + behind[-1][b] for b in range(4)), INFINITE) for a in range(4)]
            behind.append(_inserted(raw, False))
        behind.reverse()
        return [{"before": list(before[i]), "behind": list(behind[i + 1])} for i in range(len(found))]

    return matrices.map(of)


@F.pandas_udf(_NODES)
def _exits(kinds: pd.Series, before: pd.Series, behind: pd.Series) -> pd.Series:
    """The frontier behind a segment for each of the 16 before it; 0 where no cheapest path starts."""

    def of(k: str, a: tuple[int, ...], b: tuple[int, ...]) -> list[int]:
        backed = through(b, k[::-1], _back)
        least = min(x + y for x, y in zip(a, backed))
        tight = sum(1 << n for n in range(4) if a[n] + backed[n] == least)
        return [letters_of(k, a, b, f, False)[1] if f and f & tight == f else 0 for f in range(16)]

    return pd.Series([of(k, tuple(a), tuple(b)) for k, a, b in zip(kinds, before, behind)])


@F.pandas_udf(_NODES)
def _entries(exits: pd.Series) -> pd.Series:
    """The frontier before each of a conversation's segments."""

    def of(found) -> list[int]:
        frontiers = [1]
        for e in found:
            frontiers.append(e[frontiers[-1]])
        return frontiers[:-1]

    return exits.map(of)


@F.pandas_udf(T.StringType())
def _letters(kinds: pd.Series, before: pd.Series, behind: pd.Series, frontier: pd.Series, last: pd.Series) -> pd.Series:
    return pd.Series([letters_of(k, tuple(a), tuple(b), f, end)[0] for k, a, b, f, end in zip(kinds, before, behind, frontier, last)], dtype=object)


def repaired(found: DataFrame) -> DataFrame:
    """The segments with ``letters``: their part of the edits; conversations of several segments are joined by matrices."""
    found = written(found, "segments")
    counted = found.groupBy("conv_id").agg(F.count("*").alias("n"))
    several = written(counted.where("n > 1").select(F.col("conv_id").alias("_conv_id")), "long-conversations")
    same = found["conv_id"].eqNullSafe(several["_conv_id"])
    single = found.join(several, same, "left_anti").withColumn("letters", _single("kinds"))
    long_ = written(found.join(several, same, "left_semi"), "long-segments")

    def gathered(rows: DataFrame, column: str) -> DataFrame:
        return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", column))).alias("own"))

    def spread(rows: DataFrame, values: Column) -> DataFrame:
        exploded = rows.select("conv_id", F.col("own.part").alias("part"), values.alias("v")).select("conv_id", F.explode(F.arrays_zip("part", "v")).alias("x"))
        return exploded.select(F.col("conv_id").alias("_conv_id"), F.col("x.part").alias("_part"), F.col("x.v").alias("v"))

    def beside(rows: DataFrame, other: DataFrame) -> DataFrame:
        return rows.join(other, rows["conv_id"].eqNullSafe(other["_conv_id"]) & (rows["part"] == other["_part"])).drop("_conv_id", "_part")

    own = long_.select("conv_id", "part", "kinds")
    matrices = gathered(own.withColumn("m", _matrix("kinds")), "m")
    costs = spread(matrices, _chain(F.col("own.m")))
    ends = written(beside(own, costs).select("conv_id", "part", "kinds", "v.before", "v.behind"), "segment-costs")
    entered = spread(gathered(ends.withColumn("e", _exits("kinds", "before", "behind")), "e"), _entries(F.col("own.e")))
    latest = ends.groupBy("conv_id").agg(F.max("part").alias("latest"))
    latest = latest.select(F.col("conv_id").alias("_conv_id"), F.col("latest"))
    whole = beside(ends, entered)
    whole = whole.join(latest, whole["conv_id"].eqNullSafe(latest["_conv_id"])).drop("_conv_id")
    letters = whole.select(F.col("conv_id").alias("_conv_id"), F.col("part").alias("_part"), _letters("kinds", "before", "behind", "v", F.col("part") == F.col("latest")).alias("letters"))
    return single.unionByName(beside(long_, letters))


def _summed(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its segments, which come in order: counts, letters, cost and the digest of what stays."""
    own, done = None, []

    def finished() -> dict:
        gaps = own["high"] - own["low"] + 1 - own["distinct"] if own["low"] is not None else 0
        counts = {k: own[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost")}
        return counts | {"gaps": gaps, "audit": "".join(own["letters"]), "repaired_sha256": own["sha"].hexdigest()}

    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if own is None or own["conv_id"] != r["conv_id"]:
                if own is not None:
                    done.append(finished())
                own = {"conv_id": r["conv_id"], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "low": None, "high": None, "distinct": 0, "letters": [], "sha": hashlib.sha256(), "initial": None, "n": 0, "turned": False}
            for k in ("blank", "duplicate", "truncated", "illegal"):
                own[k] += r[k]
            if r["first_initial"] is not None:
                if own["initial"] is not None and own["initial"] + r["first_initial"] not in ("su", "ua", "au"):
                    own["illegal"] += 1
                own["initial"] = r["last_initial"]
            if r["low"] is not None:
                own["distinct"] += r["distinct_turns"] - (own["high"] is not None and own["high"] == r["low"])
                own["low"], own["high"] = r["low"] if own["low"] is None else own["low"], r["high"]
            own["letters"].append(r["letters"])
            rows = iter(zip(r["roles"], r["texts"], r["kinds"]))
            for letter in r["letters"]:
                role, text, kind = ("", "", "") if letter == "I" else next(rows)
                if letter == "D":
                    own["cost"] += DELETE
                    continue
                own["cost"] += (INSERT if letter == "I" else REROLE if letter == "R" else KEEP) + CUT * kind.isupper()
                if letter != "K":
                    role = "assistant" if own["turned"] else "user"
                own["turned"] = role[:1] == "u"
                own["sha"].update(("\n" * (own["n"] > 0) + f"{role}:{text}").encode())
                own["n"] += 1
        if done:
            yield pa.RecordBatch.from_pylist(done, out)
            done = []
    if own is not None:
        yield pa.RecordBatch.from_pylist([finished()], out)


def repair(rows: DataFrame, *, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row a conversation of rows conv_id, turn, role, text, copy, gone, as :func:`damage` gives them."""
    spark = rows.sparkSession
    turns = written(rows.withColumn("digest", F.sha2("text", 256)), "turns")
    parts = max(turns.count() // segment_rows, int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = repaired(segments(faults(turns), parts))
    plain = found.select("*", F.transform("rows", lambda x: x["role"]).alias("roles"), F.transform("rows", lambda x: x["text"]).alias("texts")).drop("rows")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    id_type = rows.schema["conv_id"].dataType
    schema = f"conv_id {id_type.simpleString()}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string"
    arrow = pa.schema([("conv_id", to_arrow_type(id_type)), *[(n, pa.int64()) for n in names], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(lambda batches: _summed(batches, arrow), schema)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chosen(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    return repair(damage(rows))
