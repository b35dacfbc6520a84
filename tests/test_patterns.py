"""The token language: reading, splits and merges against searches over all cuts and all joins."""

import itertools
import random

import pytest

from seqwright.operators import patterns

GRAMMAR = r"""
# units behind numbers
Unit := "km"; "kg"
"m" =:
Greet := "hi" =:
SPLIT: R([0-9]+) "km"
SPLIT: Greet R([0-9]+) ;
SPLIT: R(\(a|b\)) ==Recurse==
MERGE: Rep([0-9]) "%"
MERGE: R([A-Z]) "." TOK
MERGE: Unit Unknown
"""


def test_reading():
    g = patterns.parse(GRAMMAR)
    assert [[n for n, _ in p] for p in g.splits] == [["re", "string"], ["category", "re"], ["re", "recurse"]]
    assert [[n for n, _ in p] for p in g.merges] == [["rep", "string"], ["re", "string", "tok"], ["category", "category"]]
    assert g.merges[2][0][1] == {"km", "kg", "m"} and g.merges[2][1][1] == frozenset() and g.splits[2][0][1].pattern == "(a|b)"


@pytest.mark.parametrize("text", ["CUT: R(a)", "SPLIT: R(a", "hello", 'MERGE: "a'])
def test_mistakes(text):
    with pytest.raises(ValueError):
        patterns.parse(text)


def ways(elements, token):
    """Every way to cut a token by a pattern without recursion, from all cuts into parts: (parts of each element)."""
    n = len(elements)
    for cuts in itertools.combinations_with_replacement(range(len(token) + 1), n - 1):
        parts = [token[a:b] for a, b in zip((0, *cuts), (*cuts, len(token)), strict=True)]
        at, k, good = 0, 0, True
        while k < n and good:
            own, rest = elements[k], token[at:]
            if k + 1 < n and elements[k + 1][0] == "string":
                mark = elements[k + 1][1]
                good = parts[k + 1] == mark and rest.find(mark) == len(parts[k]) and patterns.fits(own, parts[k])
                step = 2
            elif own[0] == "category" and k + 1 < n and elements[k + 1][0] == "re":
                m = elements[k + 1][1].search(rest)
                good = bool(m and m[0]) and m.start() == len(parts[k]) and parts[k + 1] == m[0] and parts[k] in own[1]
                step = 2
            else:
                m = own[1].match(rest) if own[0] == "re" else None
                good = bool(m and m[0]) and parts[k] == m[0]
                step = 1
            at += sum(map(len, parts[k : k + step]))
            k += step
        if good:
            yield [p for p in parts if p]


def test_splits_against_all_cuts():
    rng = random.Random(1)
    elements = [("re", patterns._regex(r)) for r in ("a", "[ab]+", "b?", "a*b")] + [("string", s) for s in ("a", "b", "ab")] + [("category", frozenset(x)) for x in (("a",), ("", "ab"), ("b", "ba"))] + [("tok", "TOK")]
    hits = 0
    for _ in range(8000):
        chosen = [tuple(rng.choices(elements, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3))]
        token = "".join(rng.choices("ab", k=rng.randint(1, 6)))
        best = [token]
        for p in chosen:
            for parts in ways(p, token):
                if len(parts) > len(best):
                    best = parts
        assert patterns.split(token, chosen) == best
        hits += len(best) > 1
    assert hits > 100


def test_recursion_keeps_every_character():
    g = patterns.parse('SPLIT: R([ab]) ==Recurse==\nSPLIT: R(c) R(d)\n')
    assert patterns.split("abba", g.splits) == ["a", "b", "b", "a"]
    assert patterns.split("abcd", g.splits) == ["a", "b", "c", "d"]
    assert patterns.split("abx", g.splits) == ["abx"]


def joined(tokens, touching, chosen):
    """Merges by trying, at each place, every number of tokens that a pattern may take."""

    def takes(p, own):
        if not p:
            return not own
        if not own:
            return False
        if p[0][0] == "rep" and len(p) > 1:
            for n in range(1, len(own)):
                if all(patterns.fits(p[0], t) for t in own[:n]) and patterns.fits(p[1], own[n]):
                    return takes(p[2:], own[n + 1 :])  # the first place where the next element fits
            return False
        return patterns.fits(p[0], own[0]) and takes(p[1:], own[1:])

    rows = [[t] for t in tokens]
    out, at, tokens, touching = [], 0, list(tokens), list(touching)
    while at < len(tokens):
        for p in chosen:
            size = next((n for n in range(2, len(tokens) - at + 1) if all(touching[at + 1 : at + n]) and takes(p, tokens[at : at + n])), 0)
            if size:
                tokens[at : at + size] = ["".join(tokens[at : at + size])]
                touching[at + 1 : at + size] = []
                rows[at : at + size] = [sum(rows[at : at + size], [])]
                break
        else:
            out.append(len(rows[at]))
            at += 1
    return out


def test_merges_against_all_joins():
    rng = random.Random(2)
    elements = [("re", patterns._regex(r)) for r in ("a", "b", "a+b")] + [("rep", patterns._regex(r)) for r in ("a", "[ab]$")] + [("string", s) for s in ("a", "b", "ab")] + [("category", frozenset(("b", "aa"))), ("tok", "TOK")]
    hits = 0
    for _ in range(8000):
        chosen = [tuple(rng.choices(elements, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3))]
        tokens = rng.choices(["a", "b", "ab", "aa"], k=rng.randint(1, 7))
        touching = [k > 0 and rng.random() < 0.8 for k in range(len(tokens))]
        got = [b - a for a, b in patterns.merge(tokens, touching, chosen)]
        assert got == joined(tokens, touching, chosen), (chosen, tokens, touching)
        hits += len(got) < len(tokens)
    assert hits > 300
