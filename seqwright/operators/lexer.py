"""Tokenizers by longest match: of all rules that match at a place the longest wins, of equal ones the earliest.

Rows a piece: doc_id, n, kind, tok, st and en (code points, en outside). Every
character is in a piece; a character that no rule takes is punctuation, a stray
opening bracket too. Null and empty texts have no rows. Texts are whole, one
text a task's step.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqwright.operators.automaton import compiled
from seqwright.operators.patterns import Grammar, merge, parse, split

# Abbreviations and clitics that are one token.
CLITICS = "'s 'd 'm 're 'll 've"
ABBREVIATIONS = """
u.s. U.S. Mr. Ms. Dr. Gen. Mrs. Adm. Co. Inc. Ltd. Corp. Mass. Calif. MR. MRS. DR. MS.
Adm. Brig. Capt. Cmdr. Col. Comdr. Dn. Drs. Geo. Gen. Gov. Govs. Hon. Jr. Lt. Maj.
Messrs. Pres. Prof. Profr. Rep. Reps. Rev. Sen. Sens. Sgt. Sr. Sra. Srta. St. Ste.
Wm. Geo. Jos. Chas. Bancorp. Bhd. Bros. Cia. Cie. Co. Cos. Corp. Inc. Ltd. Mfg. Pte. Pty.
Ala. Ariz. Ark. Ca. Calif. Colo. Conn. Del. Fla. Ga. Ind. Ill. Kan. Ky. La.
Mass. Md. Mich. Minn. Miss. Mo. Mont. Neb. Nev. Okla. Ont. Ore. Penn. Pa. Tenn. Tex.
Va. Vt. Wash. Wis. Wyo. Jan. Feb. Mar. Apr. Jun. Jul. Aug. Sep. Sept. Oct. Nov. Dec.
"""
# Pieces that a token is made of; sentence-final marks of plain text.
_ENTITY = r"&[A-z]+;"
_TIME = r"[0-9]?[0-9](?::[0-9][0-9])?[Pp]\.?[Mm]\.?"
_INITIAL = r"[A-z]\."
_NUMBER = r"\$?[0-9,.\-]*[0-9]+%?"
_WHITE = r"[ \t]+|\r\n|[\r\n]"
_PARAGRAPH = r"(?:\r?\n){2,}"
_FINAL = r"[.!?]+"
_QUOTED = "[.?!](?:''|\")"
_URL = r"[a-z]+:(?:/{1,3}|[a-z0-9%])(?:www[0-9]{0,3}\.|[a-z0-9.\-]+\.[a-z]{2,4}/)[^ \t\n\r()<>]+[^ \t\n\r`'\[\]!(){};:\".,<>?]+"

Rule = tuple[str, str]
#: Distinct tokens whose splits a task remembers.
MOST_SPLITS = 1 << 16
#: Bytes of text whose pieces a Python worker holds at a time.
PART = 1 << 20
_LEX = re.compile(r"<lex(?:\s[^<>]*)?>")
# Tokens that end a sentence.
_SOFT_ENDS = (".", "?", "!", "''")


def _listed(words: str) -> str:
    return "|".join(map(re.escape, sorted(set(words.split()), key=len, reverse=True)))


#: Text with tags.
TAGGED: list[Rule] = [
    ("ENDPUNCT", _FINAL),
    ("ENDPUNCT", _QUOTED),
    ("WHITEEND", _PARAGRAPH),
    ("TAGEND", r"</[^<>]+>"),
    ("TAGSTART", r"<[^<>]+>"),
    ("URL", _URL),
    ("ABBREV", _listed(f"{CLITICS} 't {ABBREVIATIONS}") + "|ST\\. "),
    ("PUNCT", r"[-.;(),!?`\"{}':*+=|\[\]&]+"),
    *[("TOK", r) for r in (_ENTITY, _TIME, _INITIAL, _NUMBER, r"[^ \-\r\n\t<.;(),!?`\"{}':*+\[\]&]+")],
    ("WHITE", _WHITE),
]
#: Text without tags.
PLAIN: list[Rule] = [
    ("ENDPUNCT", _FINAL + "|．|۔|｡"),
    ("ENDPUNCT", _QUOTED),
    ("WHITEEND", _PARAGRAPH),
    ("ABBREV", _listed(f"{CLITICS} n't {ABBREVIATIONS}") + "|ST\\. "),
    ("PUNCT", r"[.;(),!?`\"{}':*+=|\[\]\-/<>]+"),
    *[("TOK", r) for r in (_ENTITY, r"[A-z\-]+", _TIME, _INITIAL, _NUMBER, r"[^ \r\n\t.;(),!?`\"{}':*+\[\]/\-]+")],
    ("WHITE", _WHITE),
]


def scanner(rules: list[Rule]) -> Callable[[str], list[tuple[str, int, int]]]:
    """A function from a text to (kind, start, end) of its pieces."""
    own = compiled(tuple(r for _, r in rules))
    kinds = [*(kind for kind, _ in rules), "PUNCT"]  # the last is that of no rule, -1

    def scan(text: str) -> list[tuple[str, int, int]]:
        found, ends = own.scan(text)
        return list(zip([kinds[k] for k in found], [0, *ends], ends, strict=False))

    return scan


def _retold(text: str, found: list[tuple[str, int, int]], grammar: Grammar, splits: dict[str, list[str]]) -> list[tuple[str, int, int]]:
    """The pieces with TOKs split and neighbours merged; ``splits`` remembers tokens."""
    if grammar.splits:
        rows = []
        for kind, st, en in found:
            tok = text[st:en]
            if kind != "TOK":
                rows.append((kind, st, en))
                continue
            if tok not in splits:
                if len(splits) >= MOST_SPLITS:
                    splits.clear()
                splits[tok] = split(tok, grammar.splits)
            for part in splits[tok]:
                rows.append((kind, st, st + len(part)))
                st += len(part)
        found = rows
    if grammar.merges:
        own = [i for i, (kind, _, _) in enumerate(found) if kind not in ("WHITE", "WHITEEND", "TAGSTART", "TAGEND")]
        toks = [text[found[i][1] : found[i][2]] for i in own]
        touching = [k > 0 and own[k - 1] == i - 1 for k, i in enumerate(own)]
        joined = {own[a]: own[b - 1] for a, b in merge(toks, touching, grammar.merges)}
        rows, skip = [], -1
        for i, (kind, st, en) in enumerate(found):
            if i > skip:
                last = joined.get(i, i)
                rows.append((kind if last == i else "TOK", st, found[last][2]))
                skip = last
        found = rows
    return found


def _ready(text: str, found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The pieces between ``<lex …>`` and ``</lex>`` as one: ENDPUNCT if it is a sentence-final mark, else TOK."""
    rows, at = [], 0
    while at < len(found):
        kind, _, en = found[at]
        rows.append(found[at])
        at += 1
        if kind == "TAGSTART" and _LEX.fullmatch(text[found[at - 1][1] : en]):
            end = next((k for k in range(at, len(found)) if found[k][0] == "TAGEND" and text[found[k][1] : found[k][2]] == "</lex>"), at)
            if end > at:
                own = text[en : found[end][1]]
                rows.append(("ENDPUNCT" if own in _SOFT_ENDS else "TOK", en, found[end][1]))
                at = end
    return rows


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts that end after :data:`PART` bytes of text: pieces take many times the memory of their texts."""
    first, size = 0, 0
    for i, own in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        size += own
        if size >= PART:
            yield batch.slice(first, i + 1 - first)
            first, size = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def pieces(docs: DataFrame, rules: list[Rule] = PLAIN, *, grammar: str | None = None, keep_lex: bool = False) -> DataFrame:
    """doc_id, n, kind, tok, st and en of the pieces of every text.

    ``grammar`` splits and merges tokens, in the language of :mod:`patterns`;
    with ``keep_lex`` the content of ``<lex>`` elements is one token each.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        scan, own, splits = scanner(rules), parse(grammar) if grammar else None, {}
        for batch in (part for whole in batches for part in _small(whole)):
            counts, kinds, toks, starts, ends = [0], [], [], [], []
            for text in batch.column("text").to_pylist():
                found = scan(text)
                if keep_lex:
                    found = _ready(text, found)
                if own:
                    found = _retold(text, found, own, splits)
                counts.append(counts[-1] + len(found))
                kinds += [k for k, _, _ in found]
                toks += [text[a:b] for _, a, b in found]
                starts += [a for _, a, _ in found]
                ends += [b for _, _, b in found]
            columns = [pa.array(kinds, pa.string()), pa.array(toks, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            p = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(columns, ["kind", "tok", "st", "en"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), p], names=["doc_id", "p"])

    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, p array<struct<kind:string,tok:string,st:int,en:int>>")
    return found.select("doc_id", F.posexplode("p").alias("n", "p")).select("doc_id", "n", "p.*")


def split_tokens(toks: DataFrame, grammar: str) -> DataFrame:
    """``toks`` (with tok) with a row a piece that the grammar's patterns split a token into, and part, its number from 0."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        patterns, known = parse(grammar).splits, {}
        for own in batches:
            if len(known) >= MOST_SPLITS:
                known.clear()
            for tok in set(own.dropna()) - known.keys():
                known[tok] = split(tok, patterns)
            yield own.map(known.get, na_action="ignore")

    others = [c for c in toks.columns if c != "tok"]
    return toks.withColumn("tok", cut("tok")).select(*others, F.posexplode("tok").alias("part", "tok"))


def tokens(found: DataFrame) -> DataFrame:
    """doc_id, seq_id, pos, tok, st and en of the pieces that are neither white space nor tags.

    A sequence ends at a blank line, and at sentence-final marks that white space follows.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("n")
    white = F.col("kind").isin("WHITE", "WHITEEND")
    ends = (F.col("kind") == "WHITEEND") | (white & (F.lag("kind").over(order) == "ENDPUNCT"))
    rows = found.withColumn("seq_id", F.sum(F.when(ends, 1).otherwise(0)).over(order).cast("int")).where(~F.col("kind").isin("WHITE", "WHITEEND", "TAGSTART", "TAGEND"))
    return rows.select("doc_id", "seq_id", (F.row_number().over(Window.partitionBy("doc_id", "seq_id").orderBy("n")) - 1).alias("pos"), "tok", "st", "en")
