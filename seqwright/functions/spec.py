"""The feature language: a text of ``name as expression;`` items becomes columns of feature names.

An expression is a function, ``f over (i, j)`` (or ``@``), ``f within (i to j)``
(``W``), ``f ngram (i, j) [SUCCEED]`` (``N-``), ``f cross g`` (``X``) or
``(f) displaced``, with parentheses around parts. Each part becomes one array
column; windows of one sequence share their sorting. ``TRANSITION`` marks edge
features. A token without a feature has an empty array.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwright.functions import tokens as T
from seqwright.operators import context

_EMPTY = "array<string>"


def _one(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast(_EMPTY))


def _scored(name: str, value: Column) -> Column:
    return F.array(F.concat(F.lit(f"{name}="), value.cast("string")))


def _tagged(values: Column, offset: int) -> Column:
    return F.transform(values, lambda x: F.concat(F.lit(f"{offset}@"), x))


_TOK = F.col
#: Functions of the language by keyword: arguments -> array of feature names. Lexicons, properties and attributes are columns of the tokens.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "wdFn": lambda: _one(_TOK("tok")),
    "wdNormFn": lambda: _one(T.normalised(_TOK("tok"))),
    "caselessWdFn": lambda: _one(T.caseless(_TOK("tok"))),
    "preLabFn": lambda: _one(_TOK("pre_label")),
    "nodeFn": lambda: F.array(F.lit(":U:")),
    "edgeFn": lambda: F.array(F.lit(":E:")),
    "lexFn": lambda *only: _TOK("lexicons") if not only else F.array_intersect(_TOK("lexicons"), F.array(*map(F.lit, only))),
    "downLexFn": lambda *only: _TOK("down_lexicons") if not only else F.array_intersect(_TOK("down_lexicons"), F.array(*map(F.lit, only))),
    "wdPropFn": lambda: F.when(F.size("properties") > 0, F.array(F.array_join("properties", "&"))).otherwise(F.array().cast(_EMPTY)),
    "downWdPropFn": lambda: F.when(F.size("properties") > 0, F.array(F.array_join("properties", "&"))).otherwise(F.array().cast(_EMPTY)),
    "wdPropPrefixFn": lambda n: F.transform(F.filter("properties", lambda p: F.char_length(p) >= int(n)), lambda p: F.substring(p, 1, int(n))),
    "wdScoreFn": lambda: F.when(F.col("score").isNotNull(), _scored(":wdScore:", F.col("score"))).otherwise(F.array().cast(_EMPTY)),
    "allTagFn": lambda: F.transform(F.map_entries(F.map_filter("attrs", lambda k, _: ~k.isin("st", "en"))), lambda e: F.concat(e["key"], e["value"])),
    "attributeFn": lambda p: F.transform(F.map_entries(F.map_filter("attrs", lambda k, _: k.startswith(p))), lambda e: F.concat(e["key"], e["value"])),
    "weightedAttrs": lambda: F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].try_cast("double"), F.lit(1.0)).cast("string"))),
    "regexpFn": lambda name, pattern: _one(T.matching(_TOK("tok"), name, pattern)),
    "prefixFn": lambda n: T.prefixes(_TOK("tok"), int(n)),
    "suffixFn": lambda n: T.suffixes(_TOK("tok"), int(n)),
    "antiPrefixFn": lambda n: T.without_prefixes(_TOK("tok"), int(n)),
    "antiSuffixFn": lambda n: T.without_suffixes(_TOK("tok"), int(n)),
    "wdShape": lambda: _one(T.shape(_TOK("tok"))),
    "prefNGrams": lambda n, r: T.leading_grams(_TOK("tok"), int(n), int(r)),
    "sufNGrams": lambda n, r: T.trailing_grams(_TOK("tok"), int(n), int(r)),
    "sentPos": lambda: F.concat(_scored("sntRecip", T.position_weight(F.col("pos"))), _one(F.when(F.col("pos") == 0, "-AtStart-"))),
    "wdLen": lambda: _scored("wdLen", F.char_length("tok")),
}

#: Abbreviations of companies.
CORPORATE = ("Corp.", "Ltd.", "Co.", "Inc.", "Cos.", "CORP.", "LTD.", "CO.", "INC.", "Corp", "Ltd", "Co", "Inc", "CORP", "LTD", "CO", "INC")

_LEX = re.compile(r"\s*(?:(?P<pattern>regexpFn\(\s*(?P<rname>[\w.:-]+)\s*,(?P<regex>(?:\\\)|[^)])+)\))|(?P<word>@-?|W-?\b|N-|-?\d+|[A-Za-z_][\w.:-]*)|(?P<mark>[(),]))")


class Builder:
    """Turns the parts of a specification into array columns of a token table (doc_id, seq_id, pos, tok, …)."""

    def __init__(self, toks: DataFrame) -> None:
        self.rows, self.n = toks, 0

    def column(self, value: Column) -> str:
        """The name of a new column; parts are columns of their own, as a window can't stand in another's argument."""
        self.n += 1
        name = f"__f{self.n}"
        self.rows = self.rows.withColumn(name, F.coalesce(value, F.array().cast(_EMPTY)))
        return name

    def expression(self, text: str) -> str:
        self.items, at = [], 0
        while text[at:].strip():
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"cannot read {text[at:]!r}")
            self.items.append(("regexpFn", m["rname"], m["regex"].replace(r"\)", ")").strip()) if m["pattern"] else m["word"] or m["mark"])
            at = m.end()
        found = self._cross()
        if self.items:
            raise ValueError(f"cannot read {self.items[0]!r} in {text!r}")
        return found

    def _take(self, *words: str) -> str | None:
        return self.items.pop(0) if self.items and self.items[0] in words else None

    def _list(self) -> list[str]:
        if not self._take("("):
            raise ValueError("a list in parentheses is missing")
        found = []
        while not self._take(")"):
            found.append(self.items.pop(0))
            self._take(",")
        return found

    def _range(self) -> list[int]:
        items = self._list()
        return list(range(int(items[0]), int(items[2]) + 1)) if "to" in items else [int(i) for i in items]

    def _cross(self) -> str:
        left = self._windowed()
        if self._take("cross", "X"):
            return self.column(context.cross(F.col(left), F.col(self._cross())))
        return left

    def _windowed(self) -> str:
        if self._take("("):
            own = self._cross()
            if not self._take(")"):
                raise ValueError("a closing parenthesis is missing")
        else:
            own = self._function()
        here = F.col(own)
        if self._take("over", "@", "@-"):
            parts = [_tagged(context.at(here, o), o) for o in self._range()]
            return self.column(F.flatten(F.array_compact(F.array(*parts))))
        if self._take("within", "W", "W-"):
            return self.column(F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.array(*[context.at(here, o) for o in self._range()]))))))
        if self._take("ngram", "N-"):
            offsets = self._range()
            return self._ngram(own, offsets, bool(self._take("SUCCEED")))
        if self._take("displaced"):
            return self._displaced(own)
        return own

    def _ngram(self, own: str, offsets: list[int], succeed: bool) -> str:
        joined = F.when(F.size(own) > 0, F.array_join(own, "&"))
        return self.column(_one(context.ngram(joined if not succeed else F.coalesce(joined, F.lit("")), offsets, whole=True)))

    def _displaced(self, own: str) -> str:
        self.rows = context.displaced(self.rows, F.col(own))
        found = self.column(F.array_distinct(F.flatten("earlier")))
        self.rows = self.rows.drop("earlier")
        return found

    def _near_company(self) -> str:
        """Whether the token starts with a capital and an abbreviation of companies is one of the next three."""
        tok = F.col("tok")
        near = F.array(*[context.at(tok, o) for o in (1, 2, 3)])
        return self.column(F.when(tok.rlike("^\\p{Lu}") & F.exists(near, lambda t: F.coalesce(t.isin(*CORPORATE), F.lit(False))), F.array(F.lit("nearCorpAbbrev"))))

    def _predicate(self) -> str:
        """The given name where one of the functions gives two features or more."""
        if not self._take("("):
            raise ValueError("predicateFn needs a name and functions")
        name, parts = self.items.pop(0), []
        while self._take(","):
            parts.append(self._cross())
        if not self._take(")"):
            raise ValueError("a closing parenthesis is missing")
        several = F.greatest(*[F.size(p) for p in parts], F.lit(0), F.lit(0)) > 1
        return self.column(F.when(several, F.array(F.lit(name))))

    def _distance(self, word: str, name: str, value: str) -> str:
        """The binned distance to the nearest other token whose attribute has the value."""
        side = "left" if word == "distToLeft" else "right"
        own = context.nearest(self.rows, F.coalesce(F.try_element_at("attrs", F.lit(name)) == value, F.lit(False)))
        bin_of = _bin_name(F.col(side))
        self.n += 1
        column = f"__f{self.n}"
        self.rows = own.withColumn(column, F.array(F.concat(F.lit(f"{name}:{value}{side.title()}"), bin_of))).drop("left", "right")
        return column

    def _function(self) -> str:
        word = self.items.pop(0)
        if isinstance(word, tuple):
            return self.column(FUNCTIONS["regexpFn"](*word[1:]))
        if word == "nearCorpAbbrev":
            return self._near_company()
        if word == "predicateFn":
            return self._predicate()
        if word in ("distToLeft", "distToRight"):
            return self._distance(word, *self._list())
        if word not in FUNCTIONS:
            raise ValueError(f"unknown function {word!r}")
        args = self._list() if self.items and self.items[0] == "(" else []
        return self.column(FUNCTIONS[word](*args))


class ArrayBuilder(Builder):
    """The same for tokens that carry their sequence's tokens and marks as arrays, so that what stands around a token is read by place. What needs a window can't be read."""

    def __init__(self, toks: DataFrame, marks: dict[tuple[str, str], str]) -> None:
        super().__init__(toks)
        self.marks = marks

    def _windowed(self) -> str:
        own = super()._windowed() if self.items and self.items[0] == "(" else self._function()
        if self.items and self.items[0] in ("over", "@", "@-", "within", "W", "W-", "ngram", "N-", "displaced"):
            raise ValueError(f"{self.items[0]!r} needs a window: take a row a token and features()")
        return own

    def _near_company(self) -> str:
        near = [F.coalesce(F.get("toks", F.col("pos") + o).isin(*CORPORATE), F.lit(False)) for o in (1, 2, 3)]
        return self.column(F.when(F.col("tok").rlike("^\\p{Lu}") & (near[0] | near[1] | near[2]), F.array(F.lit("nearCorpAbbrev"))))

    def _distance(self, word: str, name: str, value: str) -> str:
        side = "Left" if word == "distToLeft" else "Right"
        d = context.nearest_in(F.col(self.marks[name, value]), F.col(f"{self.marks[name, value]}_back"), F.col("pos"))[side == "Right"]
        return self.column(F.array(F.concat(F.lit(f"{name}:{value}{side}"), _bin_name(d))))


def _bin_name(d: Column) -> Column:
    return F.when(d > 12, F.lit("MoreThan-12")).otherwise(F.concat(F.lit("Within-"), d.cast("string")))


def array_features(sequences: DataFrame, spec: str, attrs: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_id, seq_id, pos, tok and the columns of :func:`features` for sequences (doc_id, seq_id, toks), a row each, without a window; ``attrs`` makes a token's attributes.

    Functions of tokens, ``predicateFn``, ``cross``, distances and ``nearCorpAbbrev`` can be asked for, nothing over further places.
    """
    attrs = attrs or (lambda _: F.create_map().cast("map<string,string>"))
    told = dict.fromkeys(re.findall(r"distTo(?:Left|Right)\s*\(\s*([\w.:-]+)\s*,\s*([\w.:-]+)\s*\)", spec))
    marks = {own: f"__m{k}" for k, own in enumerate(told)}
    is_mark = lambda name, value: F.transform("toks", lambda t: F.coalesce(F.try_element_at(attrs(t), F.lit(name)) == value, F.lit(False)))
    rows = sequences.select("doc_id", "seq_id", "toks", *[is_mark(*own).alias(c) for own, c in marks.items()])
    rows = rows.select("*", *[F.reverse(c).alias(f"{c}_back") for c in marks.values()])
    # outer, or Spark would look at the texts' tokens once more for whether there are any
    rows = rows.select("*", F.posexplode_outer("toks").alias("pos", "tok")).where("pos IS NOT NULL").withColumn("attrs", attrs(F.col("tok")))
    return _items(ArrayBuilder(rows, marks), spec, ["doc_id", "seq_id", "pos", "tok"])


def features(toks: DataFrame, spec: str) -> DataFrame:
    """``toks`` with an array column of features for each item of the specification, named by the item; comments run to the line's end."""
    return _items(Builder(toks), spec, toks.columns)


def _items(builder: Builder, spec: str, columns: list[str]) -> DataFrame:
    kept = {}
    for item in re.split(r";\s*(?:\n|$|(?=\w[\w.:-]*\s+as\s))", re.sub(r"(?m)\s#.*$|^#.*$", "", spec)):
        if not item.strip():
            continue
        name, found, body = item.strip().partition(" as ")
        if not found:
            raise ValueError(f"no expression in {item!r}")
        kept[name.strip()] = builder.expression(re.sub(r"\s(TRANSITION|NEURAL|MULTI)\s*$", "", body))
    return builder.rows.select(*columns, *[F.col(c).alias(name) for name, c in kept.items()])


def edge_names(spec: str) -> list[str]:
    """The items that are transition features."""
    return re.findall(r"(?:^|;)\s*(\S+)\s+as\s+[^;]*\s(?:TRANSITION|MULTI)\s*(?=;|$)", spec)
