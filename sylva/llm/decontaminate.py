"""Benchmark decontamination by spaced-seed hashing.

Windows of SPAN tokens are hashed under fixed masks that ignore some positions, so a window whose substitutions fall on
ignored positions still hits. Test-side hashes form an index; each document's windows are looked up, and around every hit
the overlap is verified along its diagonal: the longest stretch in which at least SIMILAR of the tokens agree. What agrees
on diagonals near each other, as after a word left out or put in, is counted together. A document is contaminated by an
item where the agreeing tokens make up COVER of the item, or LONG tokens.

The index joins as a broadcast whose size is checked: the benchmark is split by hash into shards of a bounded number of
tokens, and the documents are scanned once a shard. Neither hashes nor documents are shuffled, so a passage that a third of
all documents share costs as much as any other.

Defined cases: null and empty texts and items overlap nothing; items shorter than SPAN are sought by masks of their own
length, each of which ignores a third of it (below six tokens: unchanged); equal items are each reported; rows that repeat a
doc_id are each reported; an empty benchmark leaves all clean; a null item_id is reported as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import common

#: Positions that count, of SPAN consecutive tokens. Every position is ignored by some mask, so a window with any one
#: substitution still hits.
MASKS = ("1100101000111", "0111001101001", "0111111010000", "1100001101110", "1011001010011", "1101100100110")
SPAN = len(MASKS[0])
#: Share of agreeing tokens within an overlap; share of an item that must agree; agreeing tokens that always suffice.
SIMILAR, COVER, LONG = 0.8, 0.6, 25
#: Diagonals this far apart still belong to one overlap; cells of the agreement table worked at once.
GAP, CELLS = 8, 1 << 20
#: Benchmark tokens in an index shard, which bounds the broadcast (16 bytes a token and mask).
SHARD_TOKENS = 500_000

_FACTOR = common.mix(np.arange(1, SPAN + 1, dtype=np.uint64) * common._GOLD) | np.uint64(1)


def masks_for(length: int) -> tuple[str, ...]:
    """The masks under which an item of so many tokens is sought."""
    if length >= SPAN:
        return MASKS
    if length < 6:
        return ("1" * length,) if length else ()
    third = -(-length // 3)
    return tuple("".join("0" if k // third == part else "1" for k in range(length)) for part in range(3))


def window_hashes(words: np.ndarray, masks: list[str]) -> list[np.ndarray]:
    """Per mask, the hash of each window: a sum of the words that count, each times its position's factor."""
    if not masks:
        return []
    with np.errstate(over="ignore"):
        longest = min(max(map(len, masks)), len(words))
        turned = [words * _FACTOR[k] for k in range(longest)]
        out = []
        for mask in masks:
            n = len(words) - len(mask) + 1
            h = np.full(max(n, 0), hash_seed(mask), np.uint64)
            if n > 0:
                for k, used in enumerate(mask):
                    if used == "1":
                        h += turned[k][k : k + n]
                h *= common._GOLD
            out.append(h)
    return out


def hash_seed(mask: str) -> np.uint64:
    return np.uint64(int(mask, 2) * 0x9E3779B1 + len(mask))


class Index:
    """Sorted window hashes of some items, with the item and position of each."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        hashes = common.WordHashes()
        self.ids = [i for i, _ in items]
        self.words = [hashes.of(t) for _, t in items]
        self.masks = sorted({m for w in self.words for m in masks_for(len(w))})
        found = []
        for k, words in enumerate(self.words):
            for h in window_hashes(words, list(masks_for(len(words)))):
                found.append((h, np.full(len(h), k, np.int32), np.arange(len(h), dtype=np.int32)))
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
        order = np.argsort(cols[0], kind="stable")
        self.hash, self.item, self.at = (c[order] for c in cols)
        bits = max(16, int(len(self.hash) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.hash >> self.shift] = True

    def hits(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """By item, the diagonals of every window that hits, ascending; diagonal: document position less item position."""
        items, diagonals = [], []
        for h in window_hashes(words, self.masks):
            some = np.flatnonzero(self.filter[h >> self.shift])
            if not len(some):
                continue
            lo, hi = np.searchsorted(self.hash, h[some], "left"), np.searchsorted(self.hash, h[some], "right")
            n = hi - lo
            if not n.any():
                continue
            entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            items.append(self.item[entry].astype(np.int64))
            diagonals.append(np.repeat(some, n) - self.at[entry])
        if not items:
            return {}
        item, diagonal = np.concatenate(items), np.concatenate(diagonals)
        pairs = np.unique(item << 32 | diagonal + (1 << 31))
        item, diagonal = pairs >> 32, (pairs & 0xFFFFFFFF) - (1 << 31)
        starts = np.flatnonzero(np.diff(item, prepend=-1))
        return {int(item[a]): diagonal[a:b] for a, b in zip(starts, [*starts[1:], len(item)], strict=True)}


def stretches(words: np.ndarray, item: np.ndarray, diagonals: np.ndarray, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per diagonal: which item positions agree within its best stretch (a table), and where the stretch starts and ends.

    Best is the stretch with the most agreeing tokens of those where at least ``similar`` of the tokens agree.
    """
    at = diagonals[:, None] + np.arange(len(item))
    inside = (at >= 0) & (at < len(words))
    same = (words[np.clip(at, 0, len(words) - 1)] == item) & inside
    # an agreeing token counts 1 and another takes off what keeps the share; a stretch of sum 0 or more has the share
    cost = np.where(same, 1.0, np.where(inside, -similar / (1 - similar), -1e9))
    total = np.concatenate([np.zeros((len(at), 1)), np.cumsum(cost, axis=1)], axis=1)
    agree = np.concatenate([np.zeros((len(at), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
    least = np.minimum.accumulate(total, axis=1)
    start, end = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for k in range(len(at)):
        # the earliest place whose sum isn't above the one at the end: least falls, so it is found by bisection
        first = np.searchsorted(-least[k], -(total[k] + 1e-9), "left")
        n = agree[k] - agree[k][np.minimum(first, np.arange(len(first)))]
        end[k] = n.argmax()
        start[k] = min(first[end[k]], end[k])
    on = (np.arange(len(item)) >= start[:, None]) & (np.arange(len(item)) < end[:, None])
    return same & on, diagonals + start, diagonals + end


def overlaps(words: np.ndarray, index: Index, similar: float, cover: float, long: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(item, agreeing, item length, start, end) of each item that contaminates the document; its fullest overlap, the first of equals."""
    for i, diagonals in index.hits(words).items():
        item = index.words[i]
        best = (0, 0, 0)
        step = max(1, CELLS // max(1, len(item)))
        held, last, span = None, None, (0, 0)
        for lo in range(0, len(diagonals), step):
            some = diagonals[lo : lo + step]
            for diagonal, on, a, b in zip(some.tolist(), *stretches(words, item, some, similar), strict=True):
                if last is None or diagonal - last > GAP:  # an overlap of its own
                    held, span = on.copy(), (a, b)
                else:
                    held |= on
                    span = (min(span[0], a), max(span[1], b)) if on.any() else span
                last = diagonal
                n = int(held.sum())
                if n > best[0]:
                    best = (n, int(span[0]), int(span[1]))
        if best[0] >= min(long, cover * len(item)) and best[0]:
            yield i, best[0], len(item), best[1], best[2]


def shards(spark: SparkSession, benchmark: DataFrame, tokens: int = SHARD_TOKENS) -> list:
    """Broadcast indexes, each over ``tokens`` tokens or so; one item is never split."""
    text = F.col("text").cast("string")
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).filter("text IS NOT NULL")
    size = bench.agg(F.sum(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))))).first()[0] or 0
    n = max(1, -(-int(size) // tokens))
    for k in range(n):
        part = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else bench
        rows = part.orderBy("item_id", "text").collect()
        if rows:
            yield spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in rows]))


_FOUND = "doc_id long, item_id long, n_agree int, n_item int, start int, end int"


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, cover: float = COVER, long: int = LONG) -> DataFrame:
    """A row for each document and item that overlap: agreeing tokens, item length, token range in the document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    out = None
    for shared in shards(spark, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hashes = shared.value, common.WordHashes()
            for ids, texts in common.column_lists(batches):
                found = [(doc, index.ids[i], *rest) for doc, text in zip(ids, texts, strict=True) for i, *rest in overlaps(hashes.of(text), index, similar, cover, long)]
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
                cols = list(zip(*found, strict=True)) if found else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "n_agree", "n_item", "start", "end"])

        part = rows.mapInArrow(run, _FOUND)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], _FOUND)


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, cover: float = COVER, long: int = LONG) -> DataFrame:
    """``docs`` without the contaminated rows: whole rows, all columns."""
    common.small_batches(spark)
    for shared in shards(spark, benchmark):

        def keep(texts: list[str | None], shared=shared) -> list[bool]:
            index, hashes = shared.value, _WORDS
            return [next(overlaps(hashes.of(t), index, similar, cover, long), None) is None for t in texts]

        docs = common.kept_rows(docs, "text", keep)
    return docs


#: Hashes of words, kept by a worker between batches.
_WORDS = common.WordHashes()


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return contaminated(spark, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
