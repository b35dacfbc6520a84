"""Language identification by string kernels.

The kernel of two texts is the blended spectrum of byte n-gram presence: the
number of n-grams (of every length from 1 to 4) that both hold, over the
geometric mean of how many each holds. Grams are hashed to GRAM_BITS bits.
Landmarks give a Nyström approximation, on which one ridge regression a language
(one against the rest) is solved; texts are scored by matrix products, a batch
of presence rows against all landmarks at once.

Null texts and texts without a letter are of language ``und``, with score 0.
Rows without a language are no examples; repeated rows are scored, and learnt
from, each by itself. Empty tables give empty results, and nothing learned makes
every text ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.llm import kernels
from seqwright.llm.common import chosen, held_out, table

GRAM_SIZES = range(1, 5)
GRAM_BITS = 14
#: Labelled texts a language that the model is fitted on, about; and landmarks a language among them.
SAMPLE_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 40
#: Landmarks in all; with more languages each has fewer, one at least.
MOST_LANDMARKS = 1600
RIDGE = 1e-4
#: Presence rows in one matrix product.
ROWS = 64

UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Normalised landmark rows (transposed), ridge weights and the language of each weight column."""

    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]


def presence(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, presence matrix) of consecutive rows of texts."""
    for low, high, data, offsets in kernels.chunks(column):
        for first in range(0, high - low, ROWS):
            own = offsets[first : min(first + ROWS, high - low) + 1]
            part, own = data[own[0] : own[-1]], own - own[0]
            found = np.zeros((len(own) - 1, 1 << GRAM_BITS), np.float32)
            flat = found.ravel()
            base = np.repeat(np.arange(len(own) - 1, dtype=np.int64) << GRAM_BITS, np.diff(own))
            for codes, at in kernels.gram_codes(part, own, GRAM_SIZES, GRAM_BITS):
                flat[base[at] + codes] = 1
            yield low + first, found


def normalised(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def has_letter(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)


def fit(labelled: DataFrame, *, sample: int = SAMPLE_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Fit on about ``sample`` texts a language, picked by a hash of the id and text, from columns doc_id, text, lang.

    Only packed presence rows (2 KB a text) of the sample reach the driver.
    Rows without a language or a letter are no examples.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language; joined by broadcast as far as its size allows
    point = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = rows.join(counts, "lang").where(point < sample / F.col("n")).select(point.alias("point"), "lang", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = has_letter(batch.column("text"))
            packed = [np.packbits(row > 0).tobytes() for _, found in presence(batch.column("text")) for row in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("point").filter(pa.array(letters)), batch.column("lang").filter(pa.array(letters)), pa.array(packed, pa.binary()).filter(pa.array(letters))],
                names=["point", "lang", "row"],
            )

    got = sorted((r["lang"], r["point"], bytes(r["row"])) for r in picked.mapInArrow(pack, "point double, lang string, row binary").collect())
    if not got:
        return Model(np.zeros((1 << GRAM_BITS, 0), np.float32), np.zeros((0, 0), np.float32), [])
    x = normalised(np.unpackbits(np.array([np.frombuffer(r, np.uint8) for _, _, r in got]), axis=1).astype(np.float32))
    names = np.array([lang for lang, _, _ in got])
    languages = sorted(set(names.tolist()))
    landmarks = max(1, min(landmarks, MOST_LANDMARKS // len(languages)))
    marks = np.concatenate([np.flatnonzero(names == lang)[:landmarks] for lang in languages])
    to_marks = (x @ x[marks].T).astype(np.float64)
    among = to_marks[marks]
    target = (names[:, None] == np.array(languages)).astype(np.float64)
    left = to_marks.T @ to_marks + ridge * len(x) * among + 1e-8 * len(x) * np.eye(len(marks))
    return Model(np.ascontiguousarray(x[marks].T), np.linalg.solve(left, to_marks.T @ target).astype(np.float32), languages)


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added, from the text alone.

    Null texts and texts without a letter, and all texts if nothing was
    learned, are ``und`` with score 0. Columns of these two names are replaced;
    ties go to the first language by name.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 64 KB a landmark, of which there are MOST_LANDMARKS or one a language
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column("__text")
            best = np.zeros(len(column), np.int64)
            score = np.zeros(len(column))
            if own.languages:
                for first, found in presence(column):
                    out = (normalised(found) @ own.landmarks) @ own.weights
                    best[first : first + len(out)] = out.argmax(axis=1)
                    score[first : first + len(out)] = np.clip(out.max(axis=1), 0, 1)
            known = has_letter(column) & bool(own.languages)
            names = np.array([*own.languages, UNKNOWN], dtype=object)
            arrays = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(names[np.where(known, best, len(names) - 1)], pa.string()), pa.array(np.round(np.where(known, score, 0.0), 6))],
                names=[*kept, "lang_pred", "score"],
            )

    return source.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = chosen(docs, doc_id="doc_id", text="text", lang="lang")
    model = fit(own.where(~held_out(F.col("doc_id"))))
    scored = predict(own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "lang_pred", "score")
