"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.llm.bpe import op8_byte_bpe
from seqwright.llm.chat import PLANTED, op3_chat_format
from seqwright.llm.common import table
from seqwright.llm.dialogue import op12_conversation_repair
from seqwright.llm.fingerprint import op6_fingerprints
from seqwright.llm.html import op13_page_text
from seqwright.llm.jaccard import op1_ngram_jaccard
from seqwright.llm.language import op2_language_id
from seqwright.llm.mixing import op7_source_mix, sized, targets
from seqwright.llm.packing import op5_packed_ids
from seqwright.llm.quality import base_failed, facts, op4_quality_rules
from seqwright.llm.repeats import op10_suffix_dedup
from seqwright.llm.search import op11_ranked_search
from seqwright.llm.toxicity import op9_toxicity


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base verdict of operator 4, without the rules' votes."""
    found = table(spark, sf_dir, "documents").select("doc_id", facts(F.col("text")).alias("q"))
    names = ("n_words", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", (F.col("q.n_chars") - F.col("q.n_spaces")).cast("long").alias("word_chars"), *[F.col(f"q.{c}") for c in names], base_failed(F.col("q")).alias("base_failed"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size, weight and target of each source in operator 7's mix."""
    sizes = sized(table(spark, sf_dir, "documents")).groupBy("source").agg(F.sum("size").alias("source_size"))
    return targets(sizes).select("source", "source_size", F.col("weight").cast("long").alias("weight"), F.round("target", 3).alias("target"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_language_id": op2_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_quality_rules": op4_quality_rules,
    "op5_packed_ids": op5_packed_ids,
    "op6_fingerprints": op6_fingerprints,
    "op7_source_mix": op7_source_mix,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_page_text": op13_page_text,
    "quality_base": quality_base,
    "mix_targets": mix_targets,
}

_ESCAPED = r"replace(replace({}, '\', '\\'), '<|', '<\|')"

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _edit(state: str, cost: str, letter: str) -> str:
    """A path with its cost in eight digits before its letters, after one more edit at its front."""
    return f"printf('%08d', CAST(left({state}, 8) AS INT) + {cost}) || '{letter}' || substr({state}, 9)"


def _row_step(node: int) -> str:
    """The least path of a node over the edits that read a row; x is the row, s0 to s3 are the paths behind it."""
    to = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})[node]
    found = [_edit(f"s{node}", "3", "D")]
    for initial, n in to.items():
        found.append(f"CASE WHEN NOT x.must AND x.ini = '{initial}' THEN {_edit(f's{n}', 'x.cut', 'K')} END")
        if initial != "s":
            found.append(f"CASE WHEN NOT x.must THEN {_edit(f's{n}', '2 + x.cut', 'R')} END")
    return f"least({', '.join(found)})"


ORACLES: dict[str, str] = {
    "op11_ranked_search": f"""
WITH worded AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
sized AS (SELECT r, doc_id, len(w) AS n FROM worded WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM sized),
counted AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM worded) GROUP BY r, term),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * t.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counted SEMI JOIN asked USING (term), totals t GROUP BY term, t.n),
scored AS (
  SELECT a.item_id, c.r, sum(x.w * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (100 - 50 + (50 * s.n * t.n) // t.l))))::BIGINT AS score
  FROM asked a JOIN weighed x USING (term) JOIN counted c USING (term) JOIN sized s USING (r), totals t GROUP BY a.item_id, c.r
)
SELECT item_id, CAST(row_number() OVER own AS INT) AS rank, doc_id, score FROM scored JOIN sized USING (r) WHERE score > 0
WINDOW own AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER own <= 50
""",
    "op12_conversation_repair": f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS id,
    string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS key FROM conversations
), diced AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(key, lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS dice FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN dice = 4 THEN 'user' ELSE role END AS role, CASE dice WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    id, unnest(CASE dice WHEN 3 THEN [0, 1] WHEN 0 THEN []::INT[] ELSE [0] END) AS copy FROM diced
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), id, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id, copy) AS nth, left(role, 1) AS ini FROM hurt
), faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    coalesce(lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS illegal FROM seen
), convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), grouped AS (
  SELECT c.c, any_value(c.conv_id) AS conv_id, count(f.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal,
    list({{'role': role, 'text': text, 'ini': ini, 'must': fault IN ('blank', 'duplicate'), 'cut': CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END}} ORDER BY i) AS rows
  FROM convs c LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.c
), back AS (
  SELECT c, n AS i, '00000000' AS s0, '00000004II' AS s1, '00000002I' AS s2, '00000000' AS s3 FROM grouped
  UNION ALL
  SELECT c, i - 1, least(r0, {_edit('r2', '2', 'I')}, {_edit('r3', '4', 'II')}), least(r1, {_edit('r2', '2', 'I')}, {_edit('r3', '4', 'II')}), least(r2, {_edit('r3', '2', 'I')}), least(r3, {_edit('r2', '2', 'I')})
  FROM (
    SELECT c, i, {', '.join(f'{_row_step(node)} AS r{node}' for node in range(4))}
    FROM (SELECT b.*, g.rows[b.i] AS x FROM back b JOIN grouped g ON g.c = b.c WHERE b.i > 0)
  )
), edits AS (SELECT c, CAST(left(s0, 8) AS BIGINT) AS cost, substr(s0, 9) AS audit FROM back WHERE i = 0
), placed AS (
  SELECT g.*, e.cost, e.audit, list_transform(list_filter(range(1, len(audit) + 1), lambda j: audit[j] <> 'D'),
    lambda j: {{'letter': audit[j], 'row': rows[len(replace(audit[1:j], 'I', ''))], 'nth': len(replace(audit[1:j], 'D', ''))}}) AS steps
  FROM grouped g JOIN edits e USING (c)
)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, cost, audit,
  sha256(coalesce(array_to_string(list_transform(steps, lambda s: CASE
    WHEN s.letter = 'K' THEN s.row.role || ':' || s.row.text
    ELSE CASE WHEN (s.nth - CASE WHEN steps[1].letter = 'K' AND steps[1].row.ini = 's' THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN s.letter = 'R' THEN s.row.text ELSE '' END END), chr(10)), '')) AS repaired_sha256
FROM placed
""",
    "op13_page_text": r"""
WITH parts AS (
  SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:p|h1)>') AS blocks FROM pages
), bare AS (
  SELECT page_id, url, list_transform(blocks, lambda b: regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')) AS blocks FROM parts
), decoded AS (
  SELECT page_id, url, list_transform(blocks, lambda b: regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) AS blocks FROM bare
), spaced AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(blocks, lambda b: trim(regexp_replace(b, '[\s\x{A0}]+', ' ', 'g'))), lambda b: b <> ''), chr(10) || chr(10)) AS text FROM decoded
)
SELECT page_id, url, text, length(text) AS n_chars FROM spaced
""",
    "op1_ngram_jaccard": f"""
WITH RECURSIVE worded AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM worded WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
""",
    "op10_suffix_dedup": """
WITH t AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
places AS (SELECT r, h, unnest(range(0, n - 199)) AS i FROM t WHERE n >= 200),
strings AS (SELECT r, i, md5_number(substring(h, 2 * i + 1, 400)) AS m FROM places),
often AS (SELECT r, i FROM strings QUALIFY count(*) OVER (PARTITION BY m) > 1),
cut AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM often),
spans AS (SELECT r, min(i) AS low, max(i) + 200 AS high FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM cut) GROUP BY r, k),
parts AS (
  SELECT r, low, substring(h, 2 * b + 1, 2 * (low - b)) AS p, high - low AS gone
  FROM (SELECT s.r, s.low, s.high, t.h, coalesce(lag(s.high) OVER (PARTITION BY s.r ORDER BY s.low), 0) AS b FROM spans s JOIN t ON t.r = s.r)
), kept AS (SELECT r, string_agg(p, '' ORDER BY low) AS p, sum(gone) AS gone, count(*) AS spans FROM parts GROUP BY r),
ends AS (SELECT r, max(high) AS high FROM spans GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN high IS NULL THEN h ELSE p || substring(h, 2 * high + 1) END)) AS kept_sha256
FROM t LEFT JOIN kept USING (r) LEFT JOIN ends USING (r)
""",
    "quality_base": f"""
WITH worded AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, w[i:i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 3)
), often AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM often) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
FROM worded d LEFT JOIN covered c USING (doc_id)
""",
    "mix_targets": f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(len({_WORDS.format("coalesce(text, '')")})) AS BIGINT) AS source_size FROM documents GROUP BY source
), placed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM sizes
), level AS (
  SELECT 0 AS round, 1.5 * sum(source_size)::DOUBLE / sum(weight) AS x FROM placed
  UNION ALL
  SELECT round + 1, (SELECT (1.5 * sum(source_size) - sum(CASE WHEN 2 * source_size < weight * l.x THEN 2 * source_size ELSE 0 END))::DOUBLE
    / nullif(sum(CASE WHEN 2 * source_size < weight * l.x THEN 0 ELSE weight END), 0) FROM placed) FROM level l WHERE round < 100 AND x IS NOT NULL
)
SELECT source, source_size, CAST(weight AS BIGINT) AS weight, round(least(2.0 * source_size, weight * (SELECT max(x) FROM level)), 3) AS target FROM placed
""",
    "op3_chat_format": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}'
), formed AS (
  SELECT *, row_number() OVER own AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length('<|im_start|>') + length(replace({_ESCAPED.format("role")}, chr(10), chr(92) || chr(10))) + 1 + length({_ESCAPED.format("text")}) + length('<|im_end|>') + 1) OVER own AS chars
  FROM turns WINDOW own AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, max(n) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (WHERE role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM formed GROUP BY conv_id
""",
}
