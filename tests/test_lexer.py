"""Longest-match tokenizers on small texts, and that no character is lost."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqwright.operators import automaton, lexer


def kinds(text, rules):
    return [(k, text[a:b]) for k, a, b in lexer.scanner(rules)(text) if k != "WHITE"]


def test_plain():
    assert kinds("Mr. Low-key paid $3.50, at 5:30p.m. He's in!''\n\nOk", lexer.PLAIN) == [
        ("ABBREV", "Mr."), ("TOK", "Low-key"), ("TOK", "paid"), ("TOK", "$3.50"), ("PUNCT", ","), ("TOK", "at"), ("TOK", "5:30p.m."), ("TOK", "He"), ("ABBREV", "'s"), ("TOK", "in"), ("ENDPUNCT", "!''"), ("WHITEEND", "\n\n"), ("TOK", "Ok"),
    ]


def test_tagged():
    assert kinds('<s a="1">See http://www.a.org/x.</s> a<b', lexer.TAGGED) == [
        ("TAGSTART", '<s a="1">'), ("TOK", "See"), ("URL", "http://www.a.org/x"), ("ENDPUNCT", "."), ("TAGEND", "</s>"), ("TOK", "a"), ("PUNCT", "<"), ("TOK", "b"),
    ]


@pytest.mark.parametrize("rules", [lexer.PLAIN, lexer.TAGGED])
@given(st.text())
def test_pieces_make_the_text(rules, text):
    found = lexer.scanner(rules)(text)
    assert "".join(text[a:b] for _, a, b in found) == text and all(b > a for _, a, b in found)


def one_by_one(rules):
    """The rules tried one after the other at every place: what the automaton has to equal."""
    compiled = [(kind, re.compile(r)) for kind, r in rules]

    def scan(text):
        found, at = [], 0
        while at < len(text):
            kind, end = "PUNCT", at + 1
            matches = [(m.end(), -k) for k, (_, rule) in enumerate(compiled) if (m := rule.match(text, at)) and m.end() > at]
            if matches:
                end, k = max(matches)
                kind = compiled[-k][0]
            found.append((kind, at, end))
            at = end
        return found

    return scan


@pytest.mark.parametrize("rules, table, column", [(lexer.PLAIN, "documents", "text"), (lexer.TAGGED, "pages", "html")])
def test_automaton_equals_the_rules_on_all_texts(spark, rules, table, column):
    found, wanted = lexer.scanner(rules), one_by_one(rules)
    for r in spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").select(column).collect():
        assert found(r[0] or "") == wanted(r[0] or "")


@given(st.text(alphabet="Mr.US'nt$5:30pm-&;<>/ \n\rwh:/ .a,!?\"", max_size=60))
def test_automaton_equals_the_rules_on_odd_texts(text):
    for rules in (lexer.PLAIN, lexer.TAGGED):
        assert lexer.scanner(rules)(text) == one_by_one(rules)(text)


EXPRESSIONS = st.recursive(
    st.sampled_from(["a", "b", "c", ".", "[ab]", "[^a]", "[a-c]", "\\.", "[\\]x-]", "\\d"]),
    lambda inner: st.one_of(st.tuples(inner, inner).map("".join), st.tuples(inner, inner).map(lambda x: f"(?:{x[0]}|{x[1]})"), st.tuples(inner, st.sampled_from(["?", "*", "+", "{2}", "{1,}", "{0,2}"])).map(lambda x: f"(?:{x[0]}){x[1]}")),
    max_leaves=6,
)


@given(st.lists(EXPRESSIONS, min_size=1, max_size=3), st.text(alphabet="abc.x]-0\n😀", max_size=8))
@settings(max_examples=300, deadline=None)
def test_random_rules(rules, text):
    """The first piece is the longest prefix that a rule matches as a whole, under its first such rule."""
    found, ends = automaton.Automaton(rules).scan(text)
    if text:
        fits = [(n, -k) for n in range(1, len(text) + 1) for k, r in enumerate(rules) if re.fullmatch(r, text[:n])]
        assert (ends[0], found[0]) == ((max(fits)[0], -max(fits)[1]) if fits else (1, -1))
    assert len(found) == len(ends) and (ends[-1:] or [0])[0] == len(text)


def test_rows_split_and_merge(spark):
    docs = spark.createDataFrame([(1, "run 12km. Now 3 x"), (2, None), (3, ""), (4, "5 km 5km")], "doc_id int, text string")
    found = lexer.pieces(docs, grammar="SPLIT: R([0-9]+) R(km)")
    rows = [(r.doc_id, r.seq_id, r.pos, r.tok) for r in lexer.tokens(found).orderBy("doc_id", "seq_id", "pos").collect()]
    assert rows == [(1, 0, 0, "run"), (1, 0, 1, "12"), (1, 0, 2, "km"), (1, 0, 3, "."), (1, 1, 0, "Now"), (1, 1, 1, "3"), (1, 1, 2, "x"), (4, 0, 0, "5"), (4, 0, 1, "km"), (4, 0, 2, "5"), (4, 0, 3, "km")]
    joined = lexer.tokens(lexer.pieces(docs, grammar='MERGE: R([0-9]+km) "."\n')).orderBy("doc_id", "seq_id", "pos").collect()
    assert [(r.pos, r.tok, r.st, r.en) for r in joined][:3] == [(0, "run", 0, 3), (1, "12km.", 4, 9), (2, "Now", 10, 13)]


def test_ready_made_tokens(spark):
    docs = spark.createDataFrame([(1, "<s>a <lex pos='x'>New York 9</lex> b<lex>.</lex> c <lex>open"), (2, "<lex></lex>x</lex>")], "doc_id int, text string")
    rows = lexer.pieces(docs, lexer.TAGGED, keep_lex=True).where("kind NOT IN ('WHITE', 'TAGSTART', 'TAGEND')").orderBy("doc_id", "n").collect()
    assert [(r.kind, r.tok) for r in rows] == [("TOK", "a"), ("TOK", "New York 9"), ("TOK", "b"), ("ENDPUNCT", "."), ("TOK", "c"), ("TOK", "open"), ("TOK", "x")]
