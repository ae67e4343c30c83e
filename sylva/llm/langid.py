"""Language identification with a blended-spectrum string kernel.

A text's spectrum is the set of its character n-grams, n from 1 to LONGEST, over lower-cased letters with each other run of
characters as one space. The kernel counts shared n-grams and is divided by the geometric mean of the spectra's sizes. A
bounded sample of learning texts gives Nystroem landmarks; kernel ridge regression, one against the rest for each language,
is fitted in the landmarks' feature space. Texts are scored in batches: their sparse presence matrix times the landmarks'
presence, Nystroem and ridge weights, which are multiplied out beforehand, gives the margins.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without a language don't teach; with no
learning row at all every text is ``und``; one language alone is always predicted; a tie goes to the language first in code
point order; repeated rows are predicted each on its own; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import common

#: Learning texts a language and landmarks in all (both bounds hold at any size of input); the ridge; presence columns.
PER_LANGUAGE, LANDMARKS, RIDGE, BITS, LONGEST = 300, 192, 0.05, 17, 4
COLUMNS = 1 << BITS
UND = "und"
_OTHER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")
#: Texts scored in one matrix product; n-grams of a text are hashed in pieces of so many characters.
TEXTS, PIECE = 128, 1 << 18
#: Share of a text's presence columns that some landmark has too, below which it is in no learned language (chance alone
#: gives a tenth on the test tables, their shortest texts 0.7).
KNOWN = 0.5
#: What a text's surety must reach to be in a learned language, from so many presence columns on; texts of fewer need less, by
#: the root of their number, as the kernel of a short text grows.
MARGIN, FULL = 0.3, 1500
#: Characters of a passage, where a text that falls short as a whole is scored in parts.
PASSAGE = 200


def columns_of(text: str) -> np.ndarray:
    """The presence columns of a text's spectrum, ascending: hashes of its distinct n-grams, folded into COLUMNS."""
    x = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), np.uint32)
    seen = np.zeros(COLUMNS, bool)
    for at in range(0, len(x), PIECE):
        piece = x[at : at + PIECE + LONGEST - 1]
        h = np.zeros(len(piece), np.uint32)
        for n in range(1, LONGEST + 1):
            if len(piece) < n:
                break
            h = (h[: len(piece) - n + 1] * np.uint32(0x01000193)) ^ piece[n - 1 :]
            g = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
            seen[g >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(seen).astype(np.int32)


def _sums(rows: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """The product of the rows' sparse presence matrix with ``table`` (COLUMNS x any): sums of its rows."""
    out = np.empty((len(rows), table.shape[1]), table.dtype if table.dtype.kind == "f" else np.int64)
    for k, columns in enumerate(rows):
        out[k] = table[columns].sum(0, dtype=out.dtype)
    return out


def _norms(rows: list[np.ndarray]) -> np.ndarray:
    return np.sqrt(np.maximum([len(r) for r in rows], 1))


@dataclass
class Model:
    """Weights from presence columns to margins (landmarks, Nystroem and ridge weights multiplied out), the landmarks'
    columns, and languages."""

    weights: np.ndarray
    known: np.ndarray
    bias: np.ndarray
    languages: list[str]

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return _sums(rows, self.weights) / _norms(rows)[:, None] + self.bias

    def share_known(self, columns: np.ndarray) -> float:
        return float(self.known[columns].mean())

    def surety(self, rows: list[np.ndarray]) -> np.ndarray:
        """The predicted language's margin on a scale from 0, the mean of all margins, to 1, its own learning texts' target.

        Targets of one language against the rest have the same sum in every text, and so have margins: their mean tells nothing.
        One language alone is always sure.
        """
        mean = (2 - len(self.languages)) / len(self.languages)
        return (self.margins(rows).max(1) - mean) / (1 - mean) if len(self.languages) > 1 else np.ones(len(rows))


def fit(rows: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Nystroem features of a sample's spectra, then one ridge for each language."""
    languages = sorted(set(labels))
    if not languages:
        return None
    # landmarks by turns from each language, in the sample's (hashed) order
    by = {x: [i for i, y in enumerate(labels) if y == x] for x in languages}
    turns = [by[x][k] for k in range(max(map(len, by.values()))) for x in languages if k < len(by[x])][:landmarks]
    chosen = [rows[i] for i in turns]
    presence = np.zeros((COLUMNS, len(chosen)), np.uint8)
    for k, columns in enumerate(chosen):
        presence[columns, k] = 1
    kernel = _sums(rows, presence) / _norms(rows)[:, None] / _norms(chosen)[None, :]
    value, vector = np.linalg.eigh(kernel[turns])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    features = kernel @ root
    targets = np.array([[1.0 if y == x else -1.0 for x in languages] for y in labels])
    weight = 1 / np.array([len(by[y]) for y in labels])  # each language teaches alike
    weight *= len(labels) / weight.sum()
    mean = (weight[:, None] * features).sum(0) / len(labels)
    middle = (weight[:, None] * targets).sum(0) / len(labels)
    f, t = features - mean, targets - middle
    solved = np.linalg.solve((f * weight[:, None]).T @ f + ridge * len(labels) / 100 * np.eye(f.shape[1]), (f * weight[:, None]).T @ t)
    folded = ((root @ solved) / _norms(chosen)[:, None]).astype(np.float32)
    step = 1 << 13  # rows turned to floats at a time
    weights = np.concatenate([presence[lo : lo + step].astype(np.float32) @ folded for lo in range(0, COLUMNS, step)])
    return Model(weights, presence.any(1), middle - mean @ solved, languages)


def _bits(columns: np.ndarray) -> bytes:
    seen = np.zeros(COLUMNS, bool)
    seen[columns] = True
    return np.packbits(seen).tobytes()


def learn(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on a bounded sample of ``docs`` (text, lang): about ``per_language`` texts of each language, chosen by hash."""
    good = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r.n for r in good.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    chance = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 30)) / float(1 << 30)
    # equal texts draw alike: the bound on the sample holds by the limit
    sample = good.filter(draw < chance[F.col("lang")]).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).dropDuplicates(["text", "lang"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in common.column_lists(batches):
            on = [k for k, t in enumerate(texts) if _LETTER.search(t)]
            yield pa.RecordBatch.from_arrays([pa.array([langs[k] for k in on], pa.string()), pa.array([_bits(columns_of(texts[k])) for k in on], pa.binary())], names=["lang", "bits"])

    rows = sample.mapInArrow(run, "lang string, bits binary").orderBy(F.xxhash64(F.lit(12), "bits"), "lang").limit(2 * per_language * len(counts)).collect()
    if not rows:
        return None
    return fit([np.flatnonzero(np.unpackbits(np.frombuffer(r.bits, np.uint8))).astype(np.int32) for r in rows], [r.lang for r in rows])


def predict(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for ids, texts in common.column_lists(batches):
            langs, scores = [UND] * len(texts), [0.0] * len(texts)
            on = [k for k, t in enumerate(texts) if m is not None and t and _LETTER.search(t)]
            for at in range(0, len(on), TEXTS):
                some = on[at : at + TEXTS]
                margins = m.margins([columns_of(texts[k]) for k in some])
                e = np.exp(4 * (margins - margins.max(1, keepdims=True)))
                p = e / e.sum(1, keepdims=True)
                for k, row in zip(some, p, strict=True):
                    best = int(row.argmax())
                    langs[k], scores[k] = m.languages[best], float(min(1.0, row[best]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(spark, common.table(spark, sf_dir, "documents")).select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fifth, predict all."""
    common.small_batches(spark)
    return predict(spark, docs, learn(spark, docs.filter(common.remainder("doc_id", 5) != 0)))


def _sure(model: Model, rows: list[np.ndarray], known: float, margin: float | np.ndarray) -> np.ndarray:
    return (model.surety(rows) >= margin) & np.array([model.share_known(r) >= known for r in rows])


def recognised(model: Model | None, texts: list[str | None], known: float = KNOWN, margin: float = MARGIN) -> list[bool]:
    """Which texts are in a learned language, by the margin of the one predicted. Without a model, those with a letter.

    ``known`` of a text's n-grams must be in the landmarks, or its margins say next to nothing (other scripts, binary junk).
    Margins of several learned languages in one text cancel out: a text that falls short as a whole stays where half of its
    passages with a letter reach ``margin`` in full.
    """
    out = [bool(t and _LETTER.search(t)) for t in texts]
    on = [k for k, letter in enumerate(out) if letter and model is not None]
    for at in range(0, len(on), TEXTS):
        some = on[at : at + TEXTS]
        rows = [columns_of(texts[k]) for k in some]
        least = margin * np.minimum(1, np.sqrt(np.array([len(r) for r in rows]) / FULL))
        for k, row, sure in zip(some, rows, _sure(model, rows, known, least), strict=True):
            out[k] = bool(sure) or (model.share_known(row) >= known and _sure_in_passages(model, texts[k], known, margin))
    return out


def _sure_in_passages(model: Model, text: str, known: float, margin: float) -> bool:
    starts = range(0, max(1, len(text) - PASSAGE // 2), PASSAGE)  # a rest of half a passage or less belongs to the last one
    if len(starts) < 2:
        return False
    sure = n = 0
    for at in range(0, len(starts), TEXTS):
        some = [text[lo : lo + PASSAGE if lo != starts[-1] else len(text)] for lo in starts[at : at + TEXTS]]
        rows = [columns_of(t) for t in some if _LETTER.search(t)]
        if rows:
            sure, n = sure + int(_sure(model, rows, known, margin).sum()), n + len(rows)
    return 2 * sure >= n


def recognised_documents(spark: SparkSession, docs: DataFrame, known: float = KNOWN, margin: float = MARGIN) -> DataFrame:
    """``docs`` without the rows in no learned language: whole rows, all columns.

    Learns as ``identified`` does; the margin of each text's predicted language decides (``recognised``).
    """
    common.small_batches(spark)
    shared = spark.sparkContext.broadcast(learn(spark, docs.filter(common.remainder("doc_id", 5) != 0)))
    return common.kept_rows(docs, "text", lambda texts: recognised(shared.value, texts, known, margin))
