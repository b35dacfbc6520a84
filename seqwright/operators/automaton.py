"""One deterministic automaton for a list of rules: longest match in one look at each character.

Rules are regular expressions of characters, classes, groups ``(?:…)``,
alternatives and the repetitions ``? * + {m} {m,} {m,n}``. Characters that no
rule tells apart share a class, so a row of the table has a few dozen columns
whatever the alphabet. Of all rules that match at a place the longest match
wins, of equal ones the earliest rule.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np

_LAST = 0x10FFFF
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v"}


class _Nfa:
    """States with moves by character ranges and empty moves, made by a recursive-descent reader of one expression."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[tuple[tuple[int, int], ...], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def read(self, rule: str) -> tuple[int, int]:
        self.rule, self.at = rule, 0
        found = self.alternatives()
        if self.at < len(rule):
            raise ValueError(f"unexpected {rule[self.at]!r} at {self.at} of {rule!r}")
        return found

    def peek(self) -> str:
        return self.rule[self.at] if self.at < len(self.rule) else ""

    def take(self) -> str:
        self.at += 1
        return self.rule[self.at - 1]

    def alternatives(self) -> tuple[int, int]:
        first, last = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.empty[first].append(a)
            self.empty[b].append(last)
            if self.peek() != "|":
                return first, last
            self.take()

    def sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self.peek() not in ("", "|", ")"):
            a, b = self.repeated()
            self.empty[last].append(a)
            last = b
        return first, last

    def repeated(self) -> tuple[int, int]:
        start = self.at
        found = self.one()
        after, mark = self.at, self.peek()
        if mark not in ("?", "*", "+", "{") or mark == "":
            return found
        self.take()
        if mark == "{":
            end = self.rule.index("}", self.at)
            low, _, high = self.rule[self.at : end].partition(",")
            least, most = int(low), (int(high) if high else None) if "," in self.rule[self.at : end] else int(low)
            self.at = end + 1
        else:
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
        done = self.at

        def copy() -> tuple[int, int]:
            self.at = start
            made = self.one()
            self.at = after
            return made

        first = last = self.state()
        copies = [found] + [copy() for _ in range(max(least, most or 0, 1) - 1)]
        stop = self.state()
        for k, (a, b) in enumerate(copies):
            if k >= least:
                self.empty[last].append(stop)
            self.empty[last].append(a)
            last = b
        if most is None:
            self.empty[last].append(copies[-1][0])
        if least == 0 and most is None:
            self.empty[first].append(stop)
        self.empty[last].append(stop)
        self.at = done
        return first, stop

    def one(self) -> tuple[int, int]:
        mark = self.take()
        if mark == "(":
            if self.rule[self.at : self.at + 2] == "?:":
                self.at += 2
            found = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"an open group in {self.rule!r}")
            return found
        if mark == "[":
            ranges = self.ranges()
        elif mark == "\\":
            ranges = self.point(self.take())
        elif mark == ".":
            ranges = ((0, 9), (11, _LAST))
        else:
            ranges = ((ord(mark), ord(mark)),)
        a, b = self.state(), self.state()
        self.moves[a].append((ranges, b))
        return a, b

    @staticmethod
    def point(mark: str) -> tuple[tuple[int, int], ...]:
        if mark == "d":
            return ((48, 57),)
        c = ord(_ESCAPES.get(mark, mark))
        return ((c, c),)

    def ranges(self) -> tuple[tuple[int, int], ...]:
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: list[tuple[int, int]] = []
        while self.peek() != "]" or not found and self.rule[self.at - 1] in "[^":
            c = self.take()
            low, high = self.point(self.take())[0] if c == "\\" else (ord(c), ord(c))
            if low == high and self.peek() == "-" and self.rule[self.at + 1] != "]":
                self.take()
                c = self.take()
                high = self.point(self.take())[0][1] if c == "\\" else ord(c)
            found.append((low, high))
        self.take()
        if not negated:
            return tuple(found)
        kept, at = [], 0
        for low, high in sorted(found):
            if low > at:
                kept.append((at, low - 1))
            at = max(at, high + 1)
        return (*kept, (at, _LAST))


class Automaton:
    """``starts`` splits code points into classes, ``first`` is the state before any character, ``states`` their number."""

    def __init__(self, rules: Iterable[str]):
        nfa, firsts, ends = _Nfa(), [], {}
        for k, rule in enumerate(rules):
            a, b = nfa.read(rule)
            firsts.append(a)
            ends[b] = k
        borders = {0}
        for moves in nfa.moves:
            for ranges, _ in moves:
                borders |= {x for low, high in ranges for x in (low, high + 1)}
        self.starts = np.array(sorted(x for x in borders if x <= _LAST), np.uint32)

        def closed(states: Iterable[int]) -> frozenset[int]:
            found, waiting = set(states), list(states)
            while waiting:
                for to in nfa.empty[waiting.pop()]:
                    if to not in found:
                        found.add(to)
                        waiting.append(to)
            return frozenset(found)

        classes = self.starts.tolist()
        spans = {ranges: [i for low, high in ranges for i in range(np.searchsorted(self.starts, low), np.searchsorted(self.starts, high, "right"))] for moves in nfa.moves for ranges, _ in moves}
        first = closed(firsts)
        known, table, rule = {first: 0}, [], []
        waiting = [first]
        for own in waiting:
            to_states: list[set[int]] = [set() for _ in classes]
            for s in own:
                for ranges, to in nfa.moves[s]:
                    for c in spans[ranges]:
                        to_states[c].add(to)
            row = []
            for to in to_states:
                if not to:
                    row.append(-1)
                    continue
                whole = closed(to)
                if whole not in known:
                    known[whole] = len(known)
                    waiting.append(whole)
                row.append(known[whole])
            table.append(row)
            rule.append(min((ends[s] for s in own if s in ends), default=-1))
        # a state is its row: the rows that each class leads to or None, None for the end of the text, and its rule
        rows: list[list] = [[] for _ in table]
        for row, moves, own_rule in zip(rows, table, rule, strict=True):
            row += [rows[to] if to >= 0 else None for to in moves] + [None, own_rule]
        self.first, self.states = rows[0], len(rows)

    def classes(self, text: str) -> list[int]:
        """The class of each character."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return (np.searchsorted(self.starts, points, "right") - 1).tolist()

    def scan(self, text: str) -> tuple[list[int], list[int]]:
        """(rule, end) of consecutive pieces that make up the text; rule -1 is a character at which no rule matches."""
        own, first = self.classes(text), self.first
        n, at = len(own), 0
        own.append(-2)  # behind the text no state has a move
        rules, ends = [], []
        while at < n:
            row, i, best, end = first[own[at]], at + 1, -1, at + 1
            while row:
                if row[-1] >= 0:
                    best, end = row[-1], i
                row = row[own[i]]
                i += 1
            rules.append(best)
            ends.append(end)
            at = end
        return rules, ends


@lru_cache(maxsize=16)
def compiled(rules: tuple[str, ...]) -> Automaton:
    """The automaton of the rules, made once a process."""
    return Automaton(rules)
