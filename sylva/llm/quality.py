"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded as a vector of surface measurements and hashed
character shapes; a gated attention layer weighs the passages, and the weighted sum is scored. The encoder, the attention
and the score are learned together from labels of whole documents.

Defined cases: a null or empty text is one empty passage and scores as that; a very long text is scored by all its passages,
encoded in turn; without learning rows every score is 0.5; labels are taken once a doc_id, the largest; repeated rows score
alike; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import common, toxicity

#: Words to a passage; bound of the learning sample; hashed shapes; sizes of the hidden and the attention layer.
PASSAGE, SAMPLE, SHAPES, HIDDEN, GATE = 64, 3_000, 32, 24, 12
THRESHOLD = 0.5
#: Passages scored in one go.
PASSAGES = 2_048
_PIECE = re.compile(r"\S+")
_SHAPE = {**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "9" for c in "0123456789"}}
N_MEASURES = 14


class _Shapes(dict):
    """A word's end -> the column of its shape."""

    def __missing__(self, end: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        shape = "".join(_SHAPE.get(c, "a" if c.isalpha() else c) for c in end)
        column = self[end] = zlib.crc32(shape.encode()) % SHAPES
        return column


_COLUMN = _Shapes()


def encode_passage(words: list[str]) -> np.ndarray:
    """Surface measurements and the distribution of word-end shapes."""
    out = np.zeros(N_MEASURES + SHAPES, np.float32)
    n = len(words)
    if not n:
        return out
    text = " ".join(words)
    size = len(text)
    distinct = set(words)
    plain = {w.lower().strip(".,;:!?\"'()") for w in distinct}
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(text) - len(_NON_LETTERS.findall(text))
    out[0] = 1
    out[1] = n / PASSAGE
    out[2] = len(distinct) / n
    out[3] = len(plain) / n
    out[4] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    out[5] = letters / size
    out[6] = sum(map(str.isupper, words)) / n
    out[7] = sum(map(str.isupper, (w[0] for w in words))) / n
    out[8] = (size - n + 1) / n / 10
    out[9] = max(map(words.count, distinct)) / n if len(distinct) < n else 1 / n
    out[10] = sum(text.count(c) for c in "|#$%&*<>{}[]=~^\\") / n
    out[11] = sum(text.count(c) for c in ".,;:") / n
    out[12] = sum(text.count(c) for c in "!?") / n
    out[13] = sum(len(w) <= 3 for w in words) / n
    np.add.at(out, [N_MEASURES + _COLUMN[w[-3:]] for w in words], 1 / n)
    return out


_NON_LETTERS = re.compile(r"[^A-Za-z]")


def encode(text: str | None) -> np.ndarray:
    """Every passage's vector, in order."""
    words = _PIECE.findall(text or "")
    return np.array([encode_passage(words[k : k + PASSAGE]) for k in range(0, max(len(words), 1), PASSAGE)])


@dataclass
class Model:
    """Standardisation, encoder, gated attention, score."""

    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """``bag``: the document of each passage, ascending. Attention is normalised within each document."""
        p = self.w
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["e"] + p["eb"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        a = (t * g) @ p["a"]
        starts = np.searchsorted(bag, np.arange(n))
        a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        m = np.add.reduceat(a[:, None] * h, starts)
        return {"z": z, "h": h, "t": t, "g": g, "attention": a, "m": m, "starts": starts, "out": 1 / (1 + np.exp(-np.clip(m @ p["s"] + p["sb"], -30, 30)))}

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
        """Of the log loss, each document's times its ``cost``, by every weight."""
        f, p = self.forward(x, bag, len(y)), self.w
        e = cost * (f["out"] - y)
        dm = e[:, None] * p["s"]
        dh = f["attention"][:, None] * dm[bag]
        da = (f["h"] * dm[bag]).sum(1)
        da = f["attention"] * (da - np.add.reduceat(f["attention"] * da, f["starts"])[bag])
        gated = da[:, None] * p["a"]
        dt, dg = gated * f["g"] * (1 - f["t"] ** 2), gated * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        return {"e": f["z"].T @ dh, "eb": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ da, "s": f["m"].T @ e, "sb": np.array([e.sum()])}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts; bags go through the network together, as many as hold PASSAGES passages or so."""
        out, bags, held = [], [], 0
        for text in texts:
            bags.append(encode(text))
            held += len(bags[-1])
            if held >= PASSAGES:
                out.append(self._of(bags))
                bags, held = [], 0
        if bags:
            out.append(self._of(bags))
        return np.concatenate(out) if out else np.zeros(0)

    def _of(self, bags: list[np.ndarray]) -> np.ndarray:
        return self.forward(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags))["out"]

    def attention(self, text: str | None) -> np.ndarray:
        x = encode(text)
        return self.forward(x, np.zeros(len(x), np.int64), 1)["attention"]


class Undecided:
    """What is learned from no rows."""

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), 0.5)


def train(bags: list[np.ndarray], y: np.ndarray, rounds: int = 60, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Model | Undecided:
    """Adam on the log loss, classes weighed alike."""
    if not len(bags):
        return Undecided()
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    d = every.shape[1]
    model = Model(every.mean(0), every.std(0) + 0.05, {"e": rng.normal(0, d**-0.5, (d, HIDDEN)), "eb": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, GATE)), "u": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "s": rng.normal(0, 0.3, HIDDEN), "sb": np.zeros(1)})
    share = np.clip(y.mean(), 0.02, 0.98)
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            x = np.concatenate([bags[k] for k in some])
            bag = np.repeat(np.arange(len(some)), [len(bags[k]) for k in some])
            p, grads = model.w, model.gradients(x, bag, y[some], cost[some] / len(some))
            step += 1
            for k, g in grads.items():
                g = g + 1e-4 * p[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | Undecided:
    """Fit on at most ``sample`` labelled documents, half of each label where there are as many, chosen by hash."""
    draw = F.xxhash64(F.lit(9), "doc_id")
    chosen = None
    for y in (0, 1):
        part = labels.filter(F.col("y") == y).orderBy(draw, "doc_id").limit(sample // 2)
        chosen = part if chosen is None else chosen.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ys, texts in common.column_lists(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array([sampled(encode(t)).astype("<f4").tobytes() for t in texts], pa.binary())], names=["doc_id", "y", "x"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x binary").orderBy("doc_id", "x").limit(2 * sample).collect()
    bags = [np.frombuffer(r.x, "<f4").reshape(-1, N_MEASURES + SHAPES) for r in rows]
    return train(bags, np.array([r.y for r in rows], np.float64))


def sampled(x: np.ndarray, most: int = 64) -> np.ndarray:
    """A learning bag of at most ``most`` passages, evenly spread; scoring takes all."""
    return x if len(x) <= most else x[np.linspace(0, len(x) - 1, most).astype(int)]


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = learn(spark, docs, toxicity.known(common.table(spark, sf_dir, "labels"), "quality"))
    return toxicity.scored(spark, docs, model.scores, THRESHOLD)
