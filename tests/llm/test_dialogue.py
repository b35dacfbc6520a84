"""Conversation repair against all edit scripts by cost, and segments against whole conversations."""

import hashlib
import itertools
import random
import zlib

import pytest

from seqwright.llm import dialogue
from seqwright.llm.queries import QUERIES

NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WHITE = " \t\n\x0b\f\r"


def cheapest(kinds):
    """(cost, letters) of the least edits, from the end on, by whole letter strings."""

    def inserted(v):
        for _ in range(4):
            for q in range(4):
                for x, to in NEXT[q].items():
                    if x in "ua" and v[to] is not None:
                        c = (v[to][0] + 2, "I" + v[to][1])
                        v[q] = c if v[q] is None or c < v[q] else v[q]
        return v

    behind = inserted([(0, "") if q in (0, 3) else None for q in range(4)])
    for k in reversed(kinds):
        now = []
        for q in range(4):
            found = [(behind[q][0] + 3, "D" + behind[q][1])]
            if k != "d":
                for x, to in NEXT[q].items():
                    if x == k.lower():
                        found.append((behind[to][0] + k.isupper(), "K" + behind[to][1]))
                    if x in "ua":
                        found.append((behind[to][0] + 2 + k.isupper(), "R" + behind[to][1]))
            now.append(min(found))
        behind = inserted(now)
    return behind[0]


def letters(kinds):
    found, _, cost = dialogue.letters_of(kinds, dialogue.FIRST, dialogue.LAST, 1, True)
    return cost, found


def test_all_short_conversations():
    for n in range(4):
        for kinds in itertools.product(dialogue.KINDS, repeat=n):
            assert letters("".join(kinds)) == cheapest("".join(kinds))


def test_random_conversations():
    rng = random.Random(4)
    for _ in range(500):
        kinds = "".join(rng.choices(dialogue.KINDS, k=rng.randint(4, 80)))
        assert letters(kinds) == cheapest(kinds)


def brute(rows):
    """The contract row by row, in plain Python."""
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        dice = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if dice == 0:
            continue
        text = "" if dice == 1 else text.translate(str.maketrans("", "", ".!?")) if dice == 2 else text
        role = "user" if dice == 4 else role
        convs[c] += [(turn, role, text)] * (2 if dice == 3 else 1)
    found = []
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, kinds, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            base = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds += "d" if fault in ("blank", "duplicate") else base.upper() if fault else base
        cost, audit = cheapest(kinds)
        kept, at = [], 0
        for x in audit:
            role, text = ("", "") if x == "I" else own[at][1:]
            at += x != "I"
            if x != "D":
                kept.append((role if x == "K" else "assistant" if kept and kept[-1][0][:1] == "u" else "user", text))
        assert "".join(r[:1] for r, _ in kept).removeprefix("s").replace("ua", "") == ""
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        found.append((c, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return sorted(found, key=repr)


def got(rows):
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return sorted((tuple(r[n] for n in names) for r in rows.collect()), key=repr)


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{path}/conversations.parquet").collect()]
    assert got(QUERIES["op12_conversation_repair"](spark, path)) == brute(rows)


ODD = [(1, 0, "user", "a."), (1, 1, "assistant", None), (1, 1, None, "b!"), (1, None, "system", "c?  \n"), (1, None, "system", "c?  \n"), (2, 5, "", ""), (2, 9, "tool", "x"), (None, None, None, None), (None, 3, "admin", "ok."), (3, 7, "user", " "), (3, 8, "user", "é" * 50000 + ".\x85"), (4, -2, "assistant", "only."), (5, 1, "user", "hi.\t"), (5, 1, "user", "hi.\t")]


def test_odd_rows(spark):
    turns = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    assert got(dialogue.repair(dialogue.damage(turns))) == brute(ODD)
    assert got(dialogue.repair(dialogue.damage(turns.limit(0)))) == []


@pytest.mark.parametrize("segment_rows", [1, 7, 40])
def test_long_conversations_in_segments(spark, segment_rows):
    """One conversation holds most rows, so its segments are joined by their matrices."""
    rng = random.Random(segment_rows)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), rng.choice([*range(150), None]), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", "c!", f"t{rng.random()}."])) for _ in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS kinds", "3 AS copy", "'g' AS gone")
    assert got(dialogue.repair(dialogue.damage(turns), segment_rows=segment_rows)) == brute(rows)


def test_all_rows_gone(spark):
    rows = [(c, t, "user", "x.") for c in range(200) for t in range(1)]
    gone = [r for r in rows if zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 == 0]
    assert gone
    found = {r.conv_id: r for r in dialogue.repair(dialogue.damage(spark.createDataFrame(gone, "conv_id long, turn long, role string, text string"))).collect()}
    assert all(found[c].audit == "" and found[c].cost == 0 and found[c].gaps == 0 and found[c].repaired_sha256 == hashlib.sha256(b"").hexdigest() for c, *_ in gone)
