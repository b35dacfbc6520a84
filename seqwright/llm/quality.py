"""Quality rules as weak supervision, in DataFrame operations only.

Every rule votes good (1), bad (-1) or abstains (0) on a text. Each rule looks at
a signal of its own, for votes count as independent given the class, and takes
its limits from the corpus: good is what lies within one interquartile range of
the signal's median, bad what lies more than FENCE of them away. The quartiles
are exact over the signals' bins, of which there are at most BINS a rule.
Expectation maximisation over the counts of vote patterns (at most 3 ** number
of rules rows, however large the corpus) estimates how often each rule, where it
speaks, gives each vote to good and to bad texts, and the share of good texts.
The posterior probability of being good then decides, in place of asking that
all rules pass; no vote counts for more than MOST_SAID, so no rule decides alone.

Null texts count as empty; a text of fewer than MIN_WORDS words gets no votes and
fails the base rules. Repeated rows are rows of their own. Texts are looked at
whole, one at a time, however long. An empty table gives an empty result; further
columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.llm.common import chosen, table
from seqwright.scratch import discard, written

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SENTENCE_END = "[.?!][\"'”»)]*$"
#: Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
FUNCTION_WORDS = (
    "the of and to in is was that it for with on as by at from this be are or not he she they we you have has had but which "
    "der die das und ist von mit zu den dem ein eine einen auf für nicht sich des im war auch es an wird als "
    "le la les et de du un une que qui est dans pour en au aux par sur pas ne se il elle ce cette avec "
    "el los las y por con para del al no su lo como más o pero "
    "il di e che per non una sono da "
    "os do da em um uma não com "
    "het een en van voor niet op te zijn"
).split()
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP = 0.5
ROUNDS = 50
#: Pseudo-counts of right and wrong votes in each class: a rule is thought better than chance until the data say otherwise.
PRIOR_RIGHT, PRIOR_WRONG = 4.0, 1.0
#: Interquartile ranges from the median beyond which a signal is bad.
FENCE = 3
#: Bins of a signal; the last holds all that lies beyond.
BINS = 2000
#: The largest log-likelihood ratio of one vote.
MOST_SAID = 2.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+``; no words for an empty text."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """How many words stand in 3-word windows that the text has twice or more.

    Windows are sorted by hash, so equal ones become neighbours; each of the
    found starts then covers up to three words that no later start covers.
    """
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(windows, lambda s: let(F.sort_array(F.transform(twice(s), lambda x: x["i"])), covered))


def count_of(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def facts(text: Column) -> Column:
    """A struct of what the base contract and the rules look at, from the whole text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")

    def of_words(w: Column) -> Column:
        function = F.size(F.filter(w, lambda one: F.lower(one).isin(FUNCTION_WORDS)))
        runs = F.size(F.filter(w, lambda one, i: F.coalesce(one == F.get(w, i - 1), F.lit(False))))
        ends = F.size(F.filter(w, lambda one: one.rlike(SENTENCE_END)))
        letterless = F.size(F.filter(w, lambda one: ~one.rlike("\\p{L}")))
        return F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeat"), function.alias("function"), runs.alias("runs"), ends.alias("ends"), letterless.alias("letterless"), F.size(F.array_distinct(w)).alias("distinct"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))

    def together(w: Column, x: Column) -> Column:
        return F.struct(
            w["n"].alias("n_words"),
            count_of(t, SPACES).alias("n_spaces"),
            F.char_length(t).cast("long").alias("n_chars"),
            count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
            x["dup"].alias("n_dup_lines"),
            w["repeat"].alias("n_repeat_words"),
            w["function"].alias("n_function_words"),
            w["runs"].alias("n_runs"),
            w["letterless"].alias("n_letterless"),
            w["ends"].alias("n_ends"),
            w["distinct"].alias("n_distinct"),
            x["n"].alias("n_lines"),
            (F.char_length(t) - F.char_length(F.regexp_replace(t, "\\p{Lu}", ""))).alias("n_upper"),
        )

    return let(let(words(t), of_words), lambda w: let(let(lines, of_lines), lambda x: together(w, x)))


@dataclass(frozen=True)
class Rule:
    """A signal of a text, in bins of 1 / scale, and the least number of bins that counts as its interquartile range."""

    name: str
    signal: Callable[[Column], Column]
    scale: int
    least: int


def _ratio(a: str, b: str) -> Callable[[Column], Column]:
    return lambda q: q[a] / F.when(q[b] > 0, q[b])


RULES = (
    Rule("symbols", _ratio("n_symbols", "n_chars"), 2000, 20),
    Rule("capitals", _ratio("n_upper", "n_chars"), 2000, 10),
    Rule("function_words", _ratio("n_function_words", "n_words"), 2000, 20),
    Rule("letterless_words", _ratio("n_letterless", "n_words"), 2000, 40),
    Rule("word_runs", _ratio("n_runs", "n_words"), 2000, 10),
    Rule("sentences", _ratio("n_ends", "n_words"), 2000, 20),
    Rule("line_copies", _ratio("n_dup_lines", "n_lines"), 2000, 100),
    Rule("word_length", lambda q: (q["n_chars"] - q["n_spaces"]) / F.when(q["n_words"] > 0, q["n_words"]), 100, 20),
    Rule("repeats", _ratio("n_repeat_words", "n_words"), 2000, 60),
    Rule("distinct_words", _ratio("n_distinct", "n_words"), 2000, 60),
    Rule("line_words", lambda q: F.log(q["n_words"] / F.when(q["n_lines"] > 0, q["n_lines"])), 200, 40),
)


def bins(q: Column) -> Column:
    """The bin of each rule's signal, in their order; null for a text that is too short."""
    own = [F.least(F.floor(F.greatest(r.signal(q), F.lit(0.0)) * r.scale), F.lit(BINS - 1)).cast("int") for r in RULES]
    return F.when(q["n_words"] >= MIN_WORDS, F.array(*own))


#: Bins below and above which a rule votes bad, and between which it votes good.
Limits = tuple[float, float, float, float]


def limits(binned: DataFrame, rules: tuple[Rule, ...] = RULES) -> list[Limits]:
    """Each rule's limits, from the exact quartiles of its bins; ``binned`` has bins."""
    counted = binned.where("bins IS NOT NULL").select(F.posexplode("bins").alias("rule", "bin")).groupBy("rule", "bin").agg(F.count("*").alias("n"))
    times = np.zeros((len(rules), BINS), np.int64)
    for r in counted.collect():  # BINS a rule at most
        times[r["rule"], r["bin"]] = r["n"]
    found = []
    for r, own in zip(rules, times, strict=True):
        total = own.sum()
        low, middle, high = (int(np.searchsorted(np.cumsum(own), max(1, -(-total * k // 4)))) for k in (1, 2, 3))
        spread = max(high - low, r.least)
        found.append((middle - FENCE * spread, middle - spread, middle + spread, middle + FENCE * spread))
    return found


def votes(own: Column, found: list[Limits]) -> Column:
    """An array of one of -1, 0, 1 a rule, in their order, from the bins; all 0 without bins."""

    def of(k: int, limit: Limits) -> Column:
        bad_low, low, high, bad_high = limit
        x = F.get(own, F.lit(k))
        return F.when((x < bad_low) | (x > bad_high), -1).when(x.between(low, high), 1).otherwise(0)

    return F.array(*[of(k, x) for k, x in enumerate(found)])


@dataclass(frozen=True)
class Model:
    """The log odds of a good text, and each rule's log-likelihood ratio of the votes -1, 0 and 1."""

    bias: float
    ratios: list[tuple[float, float, float]]
    accuracies: list[float] = field(default_factory=list)


def fit(voted: DataFrame, n_rules: int = len(RULES), rounds: int = ROUNDS) -> Model:
    """Expectation maximisation over the counts of the vote patterns, of which there are at most 3 ** n_rules."""
    counts = [(tuple(r["votes"]), r["n"]) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()]
    return maximise(counts, n_rules, rounds)


def maximise(counts: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> Model:
    """The model of the vote patterns and how often each occurs."""
    vote = np.array([v for v, _ in counts], np.int8).reshape(-1, n_rules)
    n = np.array([c for _, c in counts], float)
    bad_votes, spoken = (vote < 0).astype(float), (vote != 0).astype(float)
    # At first a text is good as far as no rule calls it bad.
    good = np.where(bad_votes.any(axis=1), 0.5 ** (1 + bad_votes.sum(axis=1)), 0.95)
    for _ in range(rounds):
        called_bad = np.stack([(1 - good) * n @ bad_votes, good * n @ bad_votes])  # of bad texts, of good texts
        called_good = np.stack([(1 - good) * n @ (spoken - bad_votes), good * n @ (spoken - bad_votes)])
        called_bad += np.array([[PRIOR_RIGHT], [PRIOR_WRONG]])
        called_good += np.array([[PRIOR_WRONG], [PRIOR_RIGHT]])
        share = called_bad / (called_bad + called_good)
        against, speaking_for = np.log(share[1] / share[0]), np.log((1 - share[1]) / (1 - share[0]))
        bias = float(np.log((good @ n + 1) / ((1 - good) @ n + 1)))
        total = bias + bad_votes @ against + (spoken - bad_votes) @ speaking_for
        new = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        if done:
            break
    accuracies = (called_bad[0] + called_good[1]) / (called_bad + called_good).sum(axis=0)
    against, speaking_for = (np.clip(x, -MOST_SAID, MOST_SAID) for x in (against, speaking_for))
    return Model(bias, [(float(a), 0.0, float(b)) for a, b in zip(against, speaking_for, strict=True)], accuracies.tolist())


def posterior(own: Column, model: Model) -> Column:
    """The probability that a text with the votes ``own`` is good."""

    def of_votes(v: Column) -> Column:
        total = F.lit(model.bias)
        for k, (bad, none, good) in enumerate(model.ratios):
            total = total + F.when(F.get(v, F.lit(k)) == -1, bad).when(F.get(v, F.lit(k)) == 1, good).otherwise(none)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), total))))

    return let(own, of_votes)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def keep_good(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the base rules and are good with probability KEEP or more; their columns are unchanged.

    The texts are looked at twice, once for the signals and once for the verdict;
    between the two only the signals' bins are written.
    """
    own = facts(F.col(f"`{text}`"))
    binned = written(docs.select(let(own, bins).alias("bins")), "quality-bins")
    found = limits(binned)
    model = fit(binned.select(votes(F.col("bins"), found).alias("votes")))
    discard(binned)

    # One expression, so that the filter computes the facts once.
    def verdict(q: Column) -> Column:
        return ~base_failed(q) & let(bins(q), lambda x: posterior(votes(x, found), model) >= KEEP)

    return docs.where(let(own, verdict))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chosen(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = written(docs.select("doc_id", facts(F.col("text")).alias("q")).withColumn("bins", bins(F.col("q"))), "quality")
    found = found.withColumn("votes", votes(F.col("bins"), limits(found)))
    q, model = F.col("q"), fit(found)
    failed, p_good = base_failed(q), posterior(F.col("votes"), model)
    return found.select(
        "doc_id",
        q["n_words"].alias("n_words"),
        (q["n_chars"] - q["n_spaces"]).cast("long").alias("word_chars"),
        q["n_symbols"].alias("n_symbols"),
        q["n_dup_lines"].alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (p_good >= KEEP)).alias("kept"),
        F.round(p_good, 6).alias("p_good"),
        "votes",
    )
