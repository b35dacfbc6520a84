"""A small language that splits and merges tokens.

    Name := "a"; "b" =:                a category: a set of strings
    SPLIT: Name R([0-9]+) "km"         how one token falls into several
    MERGE: Rep([0-9]) "%"              which neighbours become one token
    # comment

Elements are ``R(re)`` and ``Rep(re)`` (parentheses inside are escaped), strings
in quotes, ``TOK``, names of categories and ``==Recurse==``.

A split reads a token from its start. An element before a string looks ahead to
the string's first occurrence and has to fit what stands before it; a category
before ``R`` looks ahead to the first match. ``R`` alone takes its match at the
place. ``R ==Recurse==`` at the end takes its match as often as it can; what is
left then is split by all patterns anew. A split holds if nothing is left, and
of those that hold the one of most pieces wins, of equal ones the earliest. An
element fits a text as ``R`` and ``Rep`` if they match at its start, as a string
if it is equal, as a category if it is a member, as ``TOK`` always.

A merge joins touching neighbours that its elements fit, one each; ``Rep`` fits
as many as needed, one at least, until the element behind it fits. The joined
token is offered to all patterns again. All elements have to fit, and two tokens
at least are joined. Matches of no character count as none.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

Element = tuple[str, object]

_ELEMENT = re.compile(r"""[ \t]*(?:(?P<recurse>==Recurse==)|Rep\((?P<rep>(?:\\.|[^)\\])+)\)|R\((?P<re>(?:\\.|[^)\\])+)\)|"(?P<string>(?:\\"|[^"])+)"|(?P<tok>TOK)(?![\w.:-])|(?P<name>[\w.:-]+))""")
_CATEGORY = re.compile(r"[ \t]*([A-Za-z_]+)[ \t]*:=(.*?)=:", re.S)
_STRING = re.compile(r'"((?:\\"|[^"])+)"')


@dataclass(frozen=True)
class Grammar:
    """Split and merge patterns, each a tuple of elements."""

    splits: tuple[tuple[Element, ...], ...] = ()
    merges: tuple[tuple[Element, ...], ...] = ()


def _regex(text: str) -> re.Pattern:
    return re.compile(re.sub(r"\\([()])", r"\1", text))


def parse(text: str) -> Grammar:
    """The grammar of a text; a mistake in it is a ValueError."""
    categories: dict[str, frozenset[str]] = {}

    def category(m: re.Match) -> str:
        categories[m[1]] = frozenset(s.replace('\\"', '"') for s in _STRING.findall(m[2]))
        return ""

    splits, merges = [], []
    for line in _CATEGORY.sub(category, text).splitlines():
        line = line.strip().removesuffix(";").rstrip()
        if not line or line.startswith("#"):
            continue
        kind, colon, rest = line.partition(":")
        if not colon or kind not in ("SPLIT", "MERGE"):
            raise ValueError(f"neither SPLIT: nor MERGE: {line!r}")
        found: list[Element] = []
        at, rest = 0, rest.rstrip()
        while at < len(rest):
            m = _ELEMENT.match(rest, at)
            if not m:
                raise ValueError(f"no element at {rest[at:]!r}")
            name = m.lastgroup
            value = m[name]
            if name in ("re", "rep"):
                value = _regex(value)
            elif name == "string":
                value = value.replace('\\"', '"')
            elif name == "name":
                name, value = "category", categories.get(value, frozenset())
            found.append((name, value))
            at = m.end()
        if found:
            (splits if kind == "SPLIT" else merges).append(tuple(found))
    return Grammar(tuple(splits), tuple(merges))


def fits(element: Element, text: str) -> bool:
    name, value = element
    if name in ("re", "rep"):
        return value.match(text) is not None
    if name == "category":
        return text in value
    return name != "string" or text == value


def split(token: str, patterns: Sequence[tuple[Element, ...]]) -> list[str]:
    """The pieces of a token; the token alone if no pattern holds."""
    known: dict[str, list[str] | None] = {}

    def applied(elements: tuple[Element, ...], text: str) -> list[str] | None:
        if not elements:
            return None if text else []
        head, tail = elements[0], elements[1:]
        if tail and tail[0][0] == "string":
            mark = tail[0][1]
            at = text.find(mark)
            if at < 0 or not fits(head, text[:at]):
                return None
            rest = applied(tail[1:], text[at + len(mark) :])
            return None if rest is None else [*([text[:at]] if at else []), mark, *rest]
        if head[0] == "category" and tail and tail[0][0] == "re":
            m = tail[0][1].search(text)
            if not m or not m[0] or text[: m.start()] not in head[1]:
                return None
            rest = applied(tail[1:], text[m.end() :])
            return None if rest is None else [*([text[: m.start()]] if m.start() else []), m[0], *rest]
        if head[0] != "re":
            return None
        m = head[1].match(text)
        if not m or not m[0]:
            return None
        if tail == (("recurse", "==Recurse=="),):
            after = text[m.end() :]
            rest = [] if not after else applied(elements, after)
            if rest is None:
                rest = best(after)
        else:
            rest = applied(tail, text[m.end() :])
        return None if rest is None else [m[0], *rest]

    def best(text: str) -> list[str] | None:
        if text not in known:
            known[text] = None
            for elements in patterns:
                found = applied(elements, text)
                if found is not None and (known[text] is None or len(found) > len(known[text])):
                    known[text] = found
        return known[text]

    found = best(token)
    return found if found and len(found) > 1 else [token]


def merge(tokens: list[str], touching: list[bool], patterns: Sequence[tuple[Element, ...]]) -> list[tuple[int, int]]:
    """(first, one past the last) of the tokens that each resulting token joins; touching[i]: token i starts where i - 1 ends."""

    def length(elements: tuple[Element, ...], offered: str, at: int) -> int:
        """How many tokens from ``at`` on the elements fit, the first read as ``offered``; 0 if they do not."""
        i = at

        def tok(k: int) -> str | None:
            return offered if k == at else tokens[k] if k < len(tokens) and touching[k] else None

        k = 0
        while k < len(elements):
            if elements[k][0] == "rep" and k + 1 < len(elements):
                while True:
                    own, behind = tok(i), tok(i + 1)
                    if own is None or behind is None or not fits(elements[k], own):
                        return 0
                    i += 1
                    if fits(elements[k + 1], behind):
                        break
                i, k = i + 1, k + 2
                continue
            own = tok(i)
            if own is None or not fits(elements[k], own):
                return 0
            i, k = i + 1, k + 1
        return i - at

    found, at = [], 0
    while at < len(tokens):
        first, offered = at, tokens[at]
        while True:
            n = next((n for e in patterns if (n := length(e, offered, at)) > 1), 0)
            if not n:
                break
            offered = offered + "".join(tokens[at + 1 : at + n])
            at += n - 1
        found.append((first, at + 1))
        at += 1
    return found
