"""Features of posts in a dialog: rows (doc_id, pos, user, toks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _thread():
    return Window.partitionBy("doc_id").orderBy("pos")


def length_bin(toks: Column) -> Column:
    n = F.size(toks)
    return F.concat(F.lit("postLen="), F.when(n < 3, "short").when(n < 7, "medium").when(n < 12, "long").otherwise("verylong"))


def _start(pos: Column) -> Column:
    return F.when(pos < 1, "posBegin").when(pos < 2, "posBeg1").when(pos < 4, "posBeg3").when(pos < 6, "posBeg5")


def positions(posts: DataFrame) -> DataFrame:
    """``posts`` with beginning, ending, size (bins of the place and the thread's length) and raw, (place + 1) / length."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    place = F.row_number().over(_thread()) - 1
    left = n - place
    size = F.when(n < 3, ":lnSm1:").when(n < 5, ":lnSm2:").when(n < 7, ":lnSm3:").when(n < 9, ":lnSm4:").when(n < 15, ":lnSm5:").otherwise(":lnBig:")
    return posts.withColumns({"beginning": _start(place), "ending": F.when(left < 2, "posEnd").when(left < 4, "posEnd3"), "size": size, "raw": (place + 1) / n})


def same_user(posts: DataFrame) -> DataFrame:
    """``posts`` with same: SAME_USER or DIFFERENT_USER than the post before; null for the first."""
    user = F.coalesce("user", F.lit("Unk"))
    before = F.lag(user).over(_thread())
    return posts.withColumn("same", F.when(before.isNotNull(), F.when(before == user, "SAME_USER").otherwise("DIFFERENT_USER")))


def candidates(posts: DataFrame, most_back: int, *, own: bool = False) -> DataFrame:
    """``posts`` a row for each earlier post up to ``most_back`` places before: back, ref_user and ref_toks; with ``own`` also the post itself (back 0).

    A window gathers the bounded number of earlier posts, so there is no self-join.
    """
    earlier = F.collect_list(F.struct("pos", "user", "toks")).over(_thread().rowsBetween(-most_back, 0 if own else -1))
    rows = posts.withColumn("__e", earlier).select(*posts.columns, F.posexplode("__e").alias("__i", "__r"), F.size("__e").alias("__n"))
    return rows.withColumns({"back": F.col("__n") - F.col("__i") - int(own), "ref_user": F.col("__r.user"), "ref_toks": F.col("__r.toks")}).drop("__i", "__r", "__n")


def overlap(toks: Column, other: Column) -> Column:
    """The share of the tokens of ``toks`` that ``other`` has too; 0 without tokens."""
    shared = F.filter(toks, lambda t: F.array_contains(other, t))
    return F.when(F.size(toks) > 0, F.size(shared) / F.size(toks)).otherwise(0.0)


def hundredths(share: Column) -> Column:
    """``share`` to two places, by the double that a hundred times it is: 23 of 40 tokens give 0.57, as in the SQL, where rounding its decimals gives 0.58."""
    return F.round(share * 100) / 100


def length_ratio(toks: Column, other: Column) -> Column:
    """The number of tokens over the other's; null without others."""
    return F.when(F.size(other) > 0, F.size(toks) / F.size(other))


def words(toks: Column) -> Column:
    """Words for bags: NUM for digits, HTTP for addresses, the first mark of runs of punctuation, else lower case."""
    return F.transform(toks, lambda t: F.when(t.rlike("^[0-9]+$"), "NUM").when(t.rlike("^https?:"), "HTTP").when(t.rlike("^\\p{Punct}+$"), F.substring(t, 1, 1)).otherwise(F.lower(t)))


def _binned(n: Column, name: str) -> Column:
    found, low = F.when(n < 5, f"{name}<5"), 5
    for high in (10, 20, 35, 50):
        found, low = found.when(n < high, f"{low}<{name}<{high}"), high
    return found.otherwise(f"{low}<{name}")


def _ratio_bin(toks: Column, ref: Column) -> Column:
    r, name = length_ratio(ref, toks), "hypLen/refLen"
    return F.when(r < 0.333, f"{name}<0.333").when(r < 0.666, f"0.333<{name}<0.666").when(r < 1.5, f"0.666<{name}<1.50").when(r < 3, f"1.50<{name}<3.00").otherwise(f"{name}>3.00")


def content_overlap(toks: Column, other: Column, stop_words: list[str]) -> Column:
    """:func:`overlap` of the tokens that are no stop words; -1 without any."""
    kept = F.filter(toks, lambda t: ~t.isin(stop_words)) if stop_words else toks
    return F.when(F.size(kept) > 0, overlap(kept, other)).otherwise(-1.0)


def shared_words(toks: Column, ref: Column) -> Column:
    """``overlap=`` and each word of the earlier post that this one has, once."""
    return F.transform(F.array_distinct(F.filter(ref, lambda t: F.array_contains(toks, t))), lambda t: F.concat(F.lit("overlap="), t))


def named_words(toks: Column, name: str) -> Column:
    """Each token under ``refLex=`` for this post's, ``hypLex=`` for the earlier one's."""
    return F.transform(toks, lambda t: F.concat(F.lit(f"{name}="), t))


def antecedent_features(found: DataFrame, announcer: str = "ANNOUNCEMENT") -> DataFrame:
    """``found`` (rows of :func:`candidates`) with features: distance, users, lengths, endings and mentions of the pair of posts.

    Shares are of the words of the earlier post that this one has, where words count each time.
    """
    toks, ref, back, user, other = (F.col(c) for c in ("toks", "ref_toks", "back", "user", "ref_user"))
    same = user.eqNullSafe(other)
    distance = F.concat(F.lit("dist="), back.cast("string"))
    last = F.get(ref, F.size(ref) - 1)
    mention = other.isNotNull() & F.exists(toks, lambda t: F.startswith(F.lower(t), F.lower(other)))
    basic = F.concat(F.when(user == announcer, f"{announcer}&&").when(user.isNotNull(), f"Non{announcer}&&").otherwise(""), distance)
    names = [  # fixed values: the names of the features
        distance,
        F.when(back == 0, "-SAME-").otherwise("-DIFF-"),
        F.when(same, "sameUser").otherwise("diffUser"),
        _binned(F.size(ref), "CandidateLength"),
        _binned(F.size(toks), "CurrentLength"),
        F.concat(F.lit("Overlap="), hundredths(overlap(ref, toks)).cast("string")),
        F.concat(F.lit("CandidateLength="), F.size(ref).cast("string")),
        F.concat(F.lit("curLen="), F.size(toks).cast("string")),
        _ratio_bin(toks, ref),
        F.when(last.isin(".", "!"), "HypEndingPunct").when(last == "?", "HypEndingQuestionMark").when(last.isNotNull(), "HypNoInteresingPunct").otherwise("HypLenIsZero"),
        F.when(user == announcer, "isAnnounce").otherwise("noAnnounce"),
        F.when(other == announcer, "prevIsAnnounce").otherwise("prevIsNotAnnounce"),
        F.when(mention, "MENTION"),
        F.when(F.size(toks) > 0, basic),
        F.when((F.size(toks) > 0) & (back > 0) & same, F.concat(F.lit("sameUser&&"), distance)),
    ]
    return found.withColumn("features", F.array_compact(F.array(*names)))


def act_pair(act: Column, other: Column) -> Column:
    """The dialog acts of a pair of posts as one feature; null acts count as ``None``."""
    return F.concat(F.lit("DApair="), F.coalesce(act, F.lit("None")), F.coalesce(other, F.lit("None")))
