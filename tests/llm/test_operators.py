"""The training-text operators against brute force, exact round trips and held-out labels."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from seqwright.llm import bpe, chat, fingerprint, jaccard, kernels, language, mixing, packing, quality, repeats, toxicity
from seqwright.scratch import written
from seqwright.llm.language import op2_language_id
from seqwright.llm.queries import ORACLES, QUERIES
from seqwright.llm.toxicity import op9_toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


#: Nulls, empty and blank texts, ties, repeated rows, no id, clashing further columns.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (4, "a b"), (None, "x y z " * 30), (6, "é" * 250), (7, "é" * 250), (8, "one two three four five six seven eight nine"), (9, "word " * 4000)]


def odd(spark, extra=True):
    rows = spark.createDataFrame([(i, t, "en", "s" if i != 6 else None, 0, "q") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, q string")
    return rows.withColumns({"votes": F.lit(1), "spans": F.lit(1), "t": F.lit("t"), "rank": F.lit(0), "key": F.lit("k")}) if extra else rows


def empty(spark):
    return odd(spark).limit(0)


def jaccard_truth(texts, words, percent):
    sets = {}
    for i, x in texts.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                    x, y = find(a), find(b)
                    least[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, docs, texts, words, percent):
    got = jaccard.near_duplicates(docs, words=words, percent=percent).collect()
    assert {tuple(r) for r in got} == jaccard_truth(texts, words, percent)


def test_jaccard_chains_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 5)
    random.seed(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(40):
        texts[i] = " ".join(base)
        for _ in range(random.randint(1, 3)):
            base[random.randrange(120)] = f"n{random.random()}"
        if i % 10 == 9:
            random.shuffle(base)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {tuple(r) for r in jaccard.near_duplicates(rows, words=4, percent=85).collect()} == jaccard_truth(texts, 4, 85)


def test_jaccard_one_id_of_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, a + " x")]
    got = Counter(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(1, 56, 1): 2, (2, 57, 1): 1, (3, 57, 1): 1, (4, 57, 1): 1})


def test_jaccard_codes_that_collide(spark, monkeypatch, docs, texts):
    monkeypatch.setattr(jaccard, "CODE_BITS", 6)
    assert {tuple(r) for r in jaccard.near_duplicates(docs).collect()} == jaccard_truth(texts, 5, 80)


def test_jaccard_odd_rows(spark):
    got = jaccard.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id == 7} == {6} and all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    kept = jaccard.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 8, 9]


def test_language_held_out(spark, texts):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = op2_language_id(spark, DATA).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(texts) and np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95


def test_language_against_the_kernel(spark, docs):
    """Scores are the ridge weights' sums over the kernel with each landmark, and weights solve the regression."""
    few = docs.where("lang IS NOT NULL").limit(60).cache()
    model = language.fit(few, sample=12, landmarks=3)
    marks = [set(np.flatnonzero(c).tolist()) for c in model.landmarks.T]
    assert len(marks) == 3 * len(model.languages)
    rows = few.select("doc_id", "text").collect()
    held = {r.doc_id: {g for _, m in language.presence(pa.array([r.text])) for g in np.flatnonzero(m[0]).tolist()} for r in rows}
    got = {r.doc_id: r for r in language.predict(few.select("doc_id", "text"), model).collect()}
    for r in rows:
        own = held[r.doc_id]
        kernel = np.array([len(own & m) / math.sqrt(len(own) * len(m)) if own else 0.0 for m in marks])
        scores = kernel @ model.weights
        if language.has_letter(pa.array([r.text]))[0]:
            assert got[r.doc_id].lang_pred == model.languages[int(scores.argmax())] and abs(got[r.doc_id].score - min(1, max(0, scores.max()))) < 1e-3


def test_language_odd_rows(spark, docs):
    model = language.fit(odd(spark).unionByName(docs.withColumn("q", F.lit("q")), allowMissingColumns=True))
    got = language.predict(odd(spark).withColumn("score", F.lit("x")), model)
    assert got.count() == len(ODD) and "q" in got.columns and got.where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert {r.doc_id for r in got.where("lang_pred = 'und'").collect()} == {1, 2, 3}
    none = language.fit(empty(spark))
    assert language.predict(empty(spark), model).count() == 0 and {r.lang_pred for r in language.predict(odd(spark), none).collect()} == {"und"}


def test_chat_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, q string")
    assert chat.examples(none).count() == 0 and chat.digests(chat.examples(none)).count() == 0


def test_packing_odd_rows(spark, tmp_path):
    packing.write_packed(odd(spark), str(tmp_path / "packed"), context=64)
    back = Counter()
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        for d, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            back[d] += b - a
    own = library()
    want = Counter()
    for i, x in ODD:
        want[i] += len(own.encode_ordinary(x or ""))
    assert back == +want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


def test_chat(spark):
    found = QUERIES["op3_chat_format"](spark, DATA)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = con.execute(ORACLES["op3_chat_format"])
    names = [d[0] for d in want.description]
    assert {tuple(r) for r in found.select(*names).collect()} == set(want.fetchall())


def test_chat_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n\\<\\|"), (1, 1, "assistant", ""), (1, 2, "us\ner", "x"), (2, 0, None, "only"), (None, None, "assistant", "a"), (3, 0, "assistant", "é<|")]
    got = {r.conv_id: r for r in chat.digests(chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        whole, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    shown = {(r.conv_id, r.example): r for r in chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len([k for k in shown if k[0] == 1]) == 3 and shown[2, 0].loss_length == 0


def quality_truth(x):
    w = WORD.findall(x)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(windows), set()
    for i, z in enumerate(windows):
        if often[z] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [one for one in x.split("\n") if WORD.search(one)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, texts):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for r in QUERIES["op4_quality_rules"](spark, DATA).collect():
        want = quality_truth(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        if labels.get(r.doc_id) == 1 and not r.base_failed:
            assert r.kept


def quality_posteriors(votes):
    """Expectation maximisation text by text."""
    names = range(len(votes[0]))
    p = [0.5 ** (1 + v.count(-1)) if -1 in v else 0.95 for v in votes]
    for _ in range(quality.ROUNDS):
        said = {(k, y, v): quality.PRIOR_RIGHT if v == 2 * y - 1 else quality.PRIOR_WRONG for k in names for y in (0, 1) for v in (-1, 1)}
        for q, own in zip(p, votes, strict=True):
            for k, v in enumerate(own):
                if v:
                    said[k, 1, v] += q
                    said[k, 0, v] += 1 - q
        rate = {(k, y, v): said[k, y, v] / (said[k, y, 1] + said[k, y, -1]) for k, y, v in said}
        bias = math.log((sum(p) + 1) / (len(p) - sum(p) + 1))
        ratio = {(k, v): math.log(rate[k, 1, v] / rate[k, 0, v]) for k in names for v in (-1, 1)}
        odds = [bias + sum(ratio[k, v] for k, v in enumerate(own) if v) for own in votes]
        p = [1 / (1 + math.exp(-x)) for x in odds]
    most = quality.MOST_SAID
    odds = [bias + sum(max(-most, min(most, ratio[k, v])) for k, v in enumerate(own) if v) for own in votes]
    return [1 / (1 + math.exp(-x)) for x in odds]


def test_quality_verdicts(spark):
    """The verdicts against expectation maximisation text by text, and against labels that it never sees."""
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality_rules"](spark, sf).collect()
    p = quality_posteriors([r.votes for r in got])
    assert all(abs(r.p_good - q) < 1e-4 and r.kept == (not r.base_failed and q >= quality.KEEP) for q, r in zip(p, got, strict=True))
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    told = [(label[r.doc_id], r.kept) for r in got if r.doc_id in label and not r.base_failed]
    good, bad = [k for y, k in told if y == 1], [k for y, k in told if y == 0]
    assert np.mean(good) > 0.98 and len(bad) > 10 and np.mean(bad) < 0.1


def test_quality_needs_many_rules(spark):
    """At sf0.1 every rule votes both ways, none equals the verdict, and without any of them the verdict is another."""
    sf = "/root/testdata/sf0.1"
    got = [r for r in QUERIES["op4_quality_rules"](spark, sf).collect() if not r.base_failed]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = [r.kept for r in got if label.get(r.doc_id) == 1], [r.kept for r in got if label.get(r.doc_id) == 0]
    assert np.mean(good) > 0.995 and len(bad) > 250 and not any(bad)
    for k, rule in enumerate(quality.RULES):
        own = [r.votes[k] for r in got]
        assert {-1, 1} <= set(own), rule.name
        assert any((v != -1) != r.kept for v, r in zip(own, got, strict=True)), rule.name
        counts = Counter(tuple(v for j, v in enumerate(r.votes) if j != k) for r in got)
        model = quality.maximise(sorted(counts.items()), len(quality.RULES) - 1)
        sums = {v: model.bias + sum(x[0] if y < 0 else x[2] if y > 0 else 0 for x, y in zip(model.ratios, v, strict=True)) for v in counts}
        assert any((sums[tuple(v for j, v in enumerate(r.votes) if j != k)] >= 0) != r.kept for r in got), rule.name


def test_quality_rejects_bad_texts_without_symbols(spark):
    """Two kinds of bad text that hold none of the symbols, planted among good documents."""
    rng = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lists = [(-1 - i, "\n".join(f"{rng.randrange(10**6)} {rng.randrange(99)} SKU{rng.randrange(10**9)}" for _ in range(120))) for i in range(5)]
    noise = [(-11 - i, " ".join("".join(rng.choice("qxzwkjvbnm") for _ in range(rng.randint(9, 20))) for _ in range(300))) for i in range(5)]
    planted = spark.createDataFrame(lists + noise, "doc_id long, text string")
    kept = {r.doc_id for r in quality.keep_good(docs.unionByName(planted)).select("doc_id").collect()}
    assert not any(i < 0 for i in kept) and len(kept) > 700


def test_quality_odd_rows(spark):
    for (_, x), r in zip(ODD, odd(spark).select(quality.facts(F.col("text")).alias("q")).collect(), strict=True):
        assert (r.q.n_words, r.q.n_chars - r.q.n_spaces, r.q.n_symbols, r.q.n_dup_lines, r.q.n_repeat_words) == quality_truth(x or "")
    assert quality.keep_good(odd(spark)).columns == odd(spark).columns and quality.keep_good(empty(spark)).count() == 0


def test_expectation_maximisation_finds_accuracies():
    random.seed(1)
    rows = Counter()
    for _ in range(4000):
        good = random.random() < 0.8
        rows[tuple((1 if good else -1) * (1 if random.random() < p else -1) if random.random() < 0.9 else 0 for p in (0.95, 0.9, 0.85, 0.8))] += 1
    model = quality.maximise(sorted(rows.items()), 4)
    assert all(abs(a - p) < 0.06 for a, p in zip(model.accuracies, (0.95, 0.9, 0.85, 0.8), strict=True))


def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pretokens():
    random.seed(1)
    alphabet = " '  \n\t 　sStTmdrelvaéßЖ漢9٣½!?.́😀x"
    rows = ["", "'s", "don't we'll 's 'S  x", "a \n b", "  ", "x "] + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(4000)]
    data, offsets = kernels.utf8(pa.array(rows))
    starts, ends = kernels.pretokens(data, offsets)
    raw = data.tobytes()
    assert [raw[i:j].decode() for i, j in zip(starts, ends, strict=True)] == [m for x in rows for m in regex.findall(public_tokenizers.PATTERN, x)]


def test_byte_bpe(spark, docs, texts):
    own = library()
    for r in bpe.encode(docs).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(texts[r.doc_id])
    decoded = bpe.decode(bpe.encode(odd(spark))).collect()
    assert sorted((r.doc_id or 0, r.text) for r in decoded) == sorted((i or 0, t or "") for i, t in ODD)
    assert bpe.encode(empty(spark)).count() == 0
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in QUERIES["op8_byte_bpe"](spark, DATA).collect())


def test_perfect_hash():
    codec = bpe.codec(bpe.rank_file(None))
    keys = list(codec.ranks)
    assert codec.table.find(keys) == list(codec.ranks.values()) and codec.table.size == len(keys) and codec.table.find([b"\xff\xfe\xfd not there"]) == [-1]


def test_packing(spark, docs):
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in bpe.encode(docs).collect()}
    back, used, n = {}, 0, 0
    for r in QUERIES["op5_packed_ids"](spark, DATA).collect():
        row, at = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u2")
        assert len(row) == packing.CONTEXT and r.cu_seqlens[-1] == r.n_tokens <= packing.CONTEXT
        used, n = used + r.n_tokens, n + 1
        for d, s, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            back.setdefault(d, []).append((s, row[a:b]))
            assert (at[a:b] == np.arange(b - a)).all()
    for d, want in ids.items():
        parts = sorted(back.get(d, []), key=lambda p: p[0])
        assert np.array_equal(np.concatenate([p for _, p in parts]) if parts else np.zeros(0), want)
    assert used / n / packing.CONTEXT > 0.95
    assert packing.pack(odd(spark), context=64).count() > 0 and packing.pack(empty(spark)).count() == 0


def test_best_fit_decreasing():
    random.seed(2)
    for _ in range(50):
        lengths = np.array([random.randint(1, 50) for _ in range(random.randint(0, 80))], np.int64)
        free = []
        for x in sorted(lengths.tolist(), reverse=True):
            fits = [s for s in free if s >= x]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - x)
            else:
                free.append(50 - x)
        packed = packing.best_fit_decreasing(lengths, 50)
        assert sorted(i for row in packed for i in row) == list(range(len(lengths)))
        assert sorted(50 - int(lengths[row].sum()) for row in packed) == sorted(free)


def test_fingerprints(spark, texts, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_TOGETHER", 16)  # more stretches than shuffle partitions
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    got = fingerprint.edit_digests(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")).collect()
    assert sorted(r.doc_id for r in got) == sorted(ids)
    for r in got:
        edited = fingerprint.halves(texts[r.doc_id], texts[after[r.doc_id]])
        assert (r.n_chars, r.edited_sha256) == (len(texts[r.doc_id]), hashlib.sha256(edited.encode()).hexdigest())
    assert len({r.fingerprint for r in got}) == len(set(texts.values()))
    assert np.mean([r.near_edited for r in got]) > 0.2 and np.mean([r.near_next for r in got]) < 0.05


def test_fingerprint_likeness_is_that_of_the_strings(spark):
    """near_* can be reproduced from the returned strings, and stay within five standard errors of the exact Jaccard similarity."""

    def shingled(text):
        words = WORD.findall(text)
        return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    def of_strings(a, b):
        (_, mark, x), (_, other, y) = fingerprint.read(a), fingerprint.read(b)
        return len(x & y) / len(x | y) if x | y else float(mark == other)

    rng = random.Random(6)
    own = {d: " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 3, 5, 7, 9, 20, 60, 400]))) for d in range(150)}
    for d in range(0, 150, 3):
        own[d] = own[d + 1] + " x"  # the next row's text, nearly
    after = dict(zip(range(149, -1, -1), [*range(148, -1, -1), 149], strict=True))
    got = {r.doc_id: r for r in fingerprint.edit_digests(spark.createDataFrame(list(own.items()), "doc_id long, text string")).collect()}
    assert len(got) == 150
    for d, r in got.items():
        assert abs(r.near_edited - of_strings(r.fingerprint, r.edited_fingerprint)) < 1e-5
        assert abs(r.near_next - of_strings(r.fingerprint, got[after[d]].fingerprint)) < 1e-5
        for near, text in ((r.near_edited, fingerprint.halves(own[d], own[after[d]])), (r.near_next, own[after[d]])):
            x, y = shingled(own[d]), shingled(text)
            n, exact = len(x | y), len(x & y) / len(x | y) if x | y else float(own[d] == text)
            if n >= 100:
                assert abs(near - exact) < 5 * math.sqrt(fingerprint.SCALE * max(exact * (1 - exact), 1 / n) / n)
            elif own[d] == text:
                assert near == 1
        count, _, codes = fingerprint.read(r.fingerprint)
        assert len(codes) <= len(shingled(own[d])) <= max(count, 1)


def test_fingerprint_error_and_size_on_documents(spark, texts):
    """Over the table: mean error against exact Jaccard, and fingerprints well below half of the texts."""
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    got = QUERIES["op6_fingerprints"](spark, DATA).collect()
    errors = []
    for r in got:
        words = [WORD.findall(t) for t in (texts[r.doc_id], fingerprint.halves(texts[r.doc_id], texts[after[r.doc_id]]))]
        x, y = ({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in words)
        errors.append(abs(r.near_edited - (len(x & y) / len(x | y) if x | y else 1)))
    assert np.mean(errors) < 0.04 and np.percentile(errors, 95) < 0.13
    assert sum(len(r.fingerprint) for r in got) < 0.3 * sum(len(t.encode()) for t in texts.values())


def test_fingerprint_rows_of_one_id(spark, monkeypatch):
    """Rows of an equal id, or of none, are split among tasks and still each meet the next."""
    monkeypatch.setattr(fingerprint, "ROWS_TOGETHER", 5)
    rows = [(None if i % 2 else 7, f"text {i} " * 9) for i in range(80)] + [(9, "last")]
    got = fingerprint.edit_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    fit = {hashlib.sha256(fingerprint.halves(a, b).encode()).hexdigest(): (a, b) for _, a in rows for _, b in rows}
    steps = dict(fit[r.edited_sha256] for r in got if r.edited_sha256 in fit)
    assert len(got) == len(rows) and all(r.edited_sha256 in fit for r in got) and len(steps) >= 70


def test_fingerprint_odd_rows_and_containment(spark):
    got = fingerprint.edit_digests(odd(spark).select("doc_id", "text")).collect()
    assert len(got) == len(ODD) and len({r.fingerprint for r in got if r.doc_id in (6, 7)}) == 1
    assert fingerprint.edit_digests(empty(spark).select("doc_id", "text")).count() == 0
    random.seed(4)
    whole = " ".join(f"w{random.random()}" for _ in range(6000))
    part = " ".join(whole.split()[:1500])
    rows = {r.doc_id: r.codes for r in fingerprint.fingerprints(spark.createDataFrame([(1, part), (2, whole)], "doc_id long, text string")).collect()}
    pair = spark.createDataFrame([(rows[1], rows[2])], "a array<long>, b array<long>")
    inside, back = pair.select(fingerprint.containment(F.col("a"), F.col("b")), fingerprint.containment(F.col("b"), F.col("a"))).first()
    assert inside > 0.99 and abs(back - 0.25) < 0.05


def test_mixing(spark, docs, texts):
    source = {r.doc_id: r.source for r in docs.collect()}
    got = QUERIES["op7_source_mix"](spark, DATA).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(WORD.findall(texts[r.doc_id])) and r.taken <= 2 * r.size
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    names = sorted(size)
    weight, full = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}
    while True:
        rest = [s for s in names if s not in full]
        level = (1.5 * sum(size.values()) - sum(full.values())) / sum(weight[s] for s in rest)
        new = {s: 2.0 * size[s] for s in rest if weight[s] * level > 2 * size[s]}
        if not new:
            break
        full |= new
    for s in names:
        assert abs(target[s] - full.get(s, weight[s] * level)) < 1e-6 * target[s] and abs(taken[s] - target[s]) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["op7_source_mix"](spark, DATA).collect()))


def test_mixed_documents(spark, docs):
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == Counter({r.doc_id: r.taken for r in QUERIES["op7_source_mix"](spark, DATA).collect() if r.taken})
    assert mixing.mixed_documents(odd(spark)).columns == odd(spark).columns and mixing.mixed_documents(empty(spark)).count() == 0
    sized = mixing.sized(odd(spark))
    assert mixing.mix(sized).select("place", "bucket", "number").distinct().count() == len(ODD)


def test_schedule_is_even(spark):
    plan = spark.createDataFrame([(0, 500), (1, 300), (2, 200)], "place int, blocks long")
    slots, total = mixing.schedule(spark, plan)
    spare, seen = mixing.spare_slots(1000), Counter()
    assert total == 1000 + 3 * spare
    for i, r in enumerate(slots.orderBy("slot").collect(), 1):
        assert r["rank"] == seen[r.place]
        seen[r.place] += 1
        assert abs(seen[0] - i * (500 + spare) / total) < 6
    assert seen[0] >= 500 and seen[1] >= 300 and seen[2] >= 200


def test_points_and_intervals_of_many_slots(spark):
    slots = [0, 1, 2, (1 << 21) - 1, 1 << 21, 10**10, (1 << 42) - 1] + [random.Random(1).randrange(1 << 42) for _ in range(200)]
    got = spark.createDataFrame([(s,) for s in slots], "slot long").select("slot", mixing.point(F.col("slot")).alias("p")).collect()
    assert all(r.p == r.slot * mixing._STEP % (1 << 62) for r in got)
    assert abs(mixing._STEP / (1 << 62) - (5**0.5 - 1) / 2) < 1e-15 and mixing._STEP % 2
    shares = [1, (1 << 40) - 7, 3, 1, 2]
    total = sum(shares)
    found = sorted(map(tuple, mixing.intervals(spark.createDataFrame(list(enumerate(shares)), "place long, share long"), total).collect()))
    ends = [sum(shares[:k]) * (1 << 62) // total for k in range(6)]
    assert found == [(k, ends[k], ends[k + 1]) for k in range(5)]


def test_points_stray_less_than_the_spare_slots():
    """Of 2 ** 23 slots every interval holds its share, but for fewer than are spared."""
    n = 1 << 23
    points = np.sort(np.arange(n, dtype=np.uint64) * np.uint64(mixing._STEP) % np.uint64(1 << 62)) / float(1 << 62)
    rng = np.random.default_rng(3)
    low, width = rng.random(20000), 10.0 ** -rng.uniform(0, 7, 20000)
    high = np.minimum(low + width, 1)
    held = np.searchsorted(points, high) - np.searchsorted(points, low)
    assert ((high - low) * n - held).max() < mixing.spare_slots(n)


def test_mixing_loses_no_block_without_a_slot(spark, monkeypatch):
    monkeypatch.setattr(mixing, "spare_slots", lambda blocks: 0)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 2)
    rows = spark.createDataFrame([(i, f"s{i % 7 * (i % 3)}", "w " * (i % 11)) for i in range(300)], "doc_id long, source string, text string")
    got = mixing.mix(mixing.sized(rows)).groupBy("source").agg(F.sum(F.expr("to_word - from_word")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 10 and all(r.taken == int(r.target) for r in got)


@pytest.mark.parametrize("sf, recall, precision", [("0.01", 0.6, 0.9), ("0.1", 0.8, 0.95)])
def test_toxicity(spark, sf, recall, precision):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"/root/testdata/sf{sf}/labels.parquet").collect()}
    got = [r for r in op9_toxicity(spark, f"/root/testdata/sf{sf}").collect() if r.doc_id in toxic]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    found, meant = [r for r in held if r.predicted], [r for r in held if toxic[r.doc_id]]
    both = [r for r in found if toxic[r.doc_id]]
    assert len(meant) >= 5 and len(both) / len(meant) >= recall and len(both) / len(found) >= precision
    assert np.mean([r.score for r in meant]) > np.mean([r.score for r in held if not toxic[r.doc_id]]) + 0.3


def test_toxicity_codes_and_fit(spark, monkeypatch):
    """Counts of code point grams, long texts in pieces, and the fit against one in numpy."""
    monkeypatch.setattr(toxicity, "PIECE", 64)
    rng = random.Random(7)
    texts = ["", "ab", "ÄÖü", "é😀漢字x"] + ["".join(rng.choice("abÀé漢😀 ") for _ in range(rng.randint(0, 300))) for _ in range(30)]
    fold = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    grams = [Counter(fold(x)[i : i + n] for n in (3, 4, 5) for i in range(len(x) - n + 1)) for x in texts]

    def code(g):
        points, ends = kernels.code_points(*kernels.utf8(pa.array([g])))
        return int(next(iter(kernels.gram_codes(points, ends, range(len(g), len(g) + 1), toxicity.GRAM_BITS)))[0][0])

    for i, codes in toxicity.text_codes(pa.array(texts)):
        times = Counter()
        for g, n in grams[i].items():
            times[code(g)] += n
        want = {c ^ (k * toxicity._LEVEL_STEP & (1 << toxicity.GRAM_BITS) - 1) for c, n in times.items() for k, level in enumerate((1, 2, 3)) if n >= level}
        assert set(codes.tolist()) == want and len(codes) == len(want)
    parts = [c for _, c in toxicity.text_codes(pa.array(texts))]
    y = [rng.randrange(2) for _ in parts]
    rows = spark.createDataFrame([(k, p.astype("<u4").tobytes()) for k, p in zip(y, parts, strict=True)], "toxic int, codes binary").repartition(3)
    model = toxicity.fit_codes(rows, 0.0)
    x = np.zeros((len(parts), 1 << toxicity.GRAM_BITS))
    for i, p in enumerate(parts):
        x[i, p] = 1
    t = np.array(y, float)
    s = toxicity.SMOOTHING
    ratio = np.log((t @ x + s) / (t.sum() + 2 * s)) - np.log(((1 - t) @ x + s) / ((1 - t).sum() + 2 * s))
    used = np.flatnonzero(x.any(axis=0))
    scaled, sign = (x * ratio)[:, used], 2 * t - 1

    def loss(w):
        margin = sign * (scaled @ w[:-1] + w[-1])
        pull = -sign / (1 + np.exp(margin))
        return float(np.logaddexp(0, -margin).sum() + toxicity.PENALTY * w[:-1] @ w[:-1] / 2), np.append(pull @ scaled + toxicity.PENALTY * w[:-1], pull.sum())

    w = toxicity.minimise(loss, np.zeros(len(used) + 1), 200)
    shift = -float(np.log(t.sum() / (1 - t).sum()))
    assert np.allclose(model.weights[used], ratio[used] * w[:-1], atol=2e-3) and abs(model.bias - w[-1] - shift) < 2e-3


def test_toxicity_odd_rows(spark):
    rows = [(1, 1), (2, 0), (3, None), (4, 1), (4, 1), (None, 0), (6, 0), (8, 1), (77, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    model = toxicity.fit(odd(spark), labels)
    got = toxicity.score(odd(spark).withColumn("score", F.lit("x")), model)
    assert got.columns == [c for c in odd(spark).columns if c != "text"] + ["score", "predicted"]
    assert got.count() == len(ODD) and got.where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert toxicity.score(empty(spark), model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 1")):  # nothing to tell apart: the share of the classes
        alone = toxicity.score(odd(spark), toxicity.fit(odd(spark), few)).select("score").distinct().collect()
        assert len(alone) == 1 and 0 < alone[0].score < 1
    assert toxicity.score(odd(spark), toxicity.fit(empty(spark), labels)).count() == len(ODD)


def repeat_truth(texts, length):
    raw = [(x or "").encode() for x in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        hit = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                hit[i : i + length] = True
        hit = hit[: len(x)]
        kept = np.frombuffer(x, np.uint8)[~hit].tobytes()
        out.append((len(x), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(spark, docs, texts):
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removal_digests(docs).collect()}
    assert got == dict(zip(texts, repeat_truth(texts.values(), 200), strict=True))


def doubling(n, swap=False):
    """The string a, ab, abba, ... of n characters: sums with powers of odd numbers cannot tell it from its complement."""
    return "".join("ab"[bin(i).count("1") % 2 ^ swap] for i in range(n))


def test_doubling_strings_are_told_apart(spark):
    sizes = (1024, 2048, 4096, 8192)
    rows = [(2 * k + s, doubling(n, bool(s))) for k, n in enumerate(sizes) for s in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = library()
    assert all(np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(dict(rows)[r.doc_id]) for r in bpe.encode(df).collect())
    assert len({r.fingerprint for r in fingerprint.edit_digests(df).collect()}) == len(rows)
    words = [(i, f"one two three {x} five six seven eight nine ten") for i, x in rows]
    assert {tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(words, "doc_id long, text string"), words=4, percent=85).collect()} == jaccard_truth(dict(words), 4, 85)
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removal_digests(df).collect()}
    assert got == dict(zip([i for i, _ in rows], repeat_truth([t for _, t in rows], 200), strict=True))


def test_different_texts_leave_no_name(spark):
    """The table of texts is in buckets, so that joins by t move nothing, and its name is gone from the catalog."""
    own = repeats.different_texts(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "doc_id long, text string"))
    assert not [t.name for t in spark.catalog.listTables() if "repeats" in t.name]
    assert sorted((r.text, r.copies) for r in own.collect()) == [("", 1), ("a", 2), ("b", 1)]
    kept = own.hint("merge").join(own.select("t", F.length("text").alias("n")), "t")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and kept.count() == 3


def test_repeats_small_pieces_and_shards(spark, monkeypatch):
    for name, value in (("PIECE", 700), ("SHARD_BYTES", 400), ("MERGE_BYTES", 2000)):
        monkeypatch.setattr(repeats, name, value)
    random.seed(5)
    parts = ["".join(random.choice("ab\x00é") for _ in range(random.randint(50, 400))) for _ in range(8)]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 9)))) for i in range(25)] + [(99, "ab" * 2000)]
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip([i for i, _ in rows], repeat_truth([t for _, t in rows], 200), strict=True))


def test_repeats_odd_rows(spark):
    got = sorted((tuple(r)[1:] for r in repeats.removal_digests(odd(spark)).collect()))
    assert got == sorted(repeat_truth([t for _, t in ODD], 200))
    left = repeats.without_repeats(odd(spark))
    assert left.columns == odd(spark).columns and left.count() == len(ODD) and repeats.without_repeats(empty(spark)).count() == 0


def test_merged_order_is_the_suffix_order():
    random.seed(6)
    strings = [bytes(random.choice(b"ab") for _ in range(random.randint(1, 60))) for _ in range(12)]
    shards = [repeats.Shard(np.frombuffer(b"".join(strings[i : i + 4]), np.uint8), np.array([len(s) for s in strings[i : i + 4]])) for i in (0, 4, 8)]
    order, common, interval = repeats.merge(shards, 24)
    own = np.concatenate([s.string + 4 * k for k, s in enumerate(shards)])[order]
    at = np.concatenate([s.offset for s in shards])[order]
    heads = [strings[s][o : o + 24] for s, o in zip(own, at, strict=True)]
    assert heads == sorted(heads)
    for k in range(1, len(order)):
        a, b = heads[k - 1], heads[k]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert (interval[order[k]] == interval[order[k - 1]]) == (a == b and len(a) == 24)


def test_repeats_split_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_BYTES", 3000)
    random.seed(8)
    word = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    passages = [word(60), word(180), word(230)]  # shorter than a string, nearly as long, longer
    rows = [(i, word(random.randint(0, 200)) + random.choice(passages) + word(random.randint(0, 200))) for i in range(120)]
    rows += [(i, rows[i % 7][1][:150] + rows[i % 5][1]) for i in range(120, 160)] + [(200, rows[3][1]), (201, rows[3][1])]
    got = {r.doc_id: tuple(r)[1:] for r in repeats.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip([i for i, _ in rows], repeat_truth([t for _, t in rows], 200), strict=True))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            now = {r.doc_id for r in docs.collect()}
            assert now and now <= ids
            ids = now
    assert docs.where("n_tokens * 4 <> octet_length(ids)").count() == 0 and {r.doc_id for r in docs.collect()} == ids
    none = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, DATA)
    assert none.count() == 0
