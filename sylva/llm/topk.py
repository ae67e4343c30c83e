"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks; each pair of a query block and a candidate block is one unit of work. A pass scores every
pair of vectors and counts the scores of each query in the bins of the range still open to it; the counts are added up, the
bin that holds the k-th highest score becomes the new range, and passes repeat until a bin is one score wide. A last pass
keeps the scores above the k-th and, of those equal to it, the smallest ids of each block, at most k a query and block;
one ranking a query breaks the ties.

Scores are never stored, histograms are BINS numbers a query and block. Arithmetic is exact: integers in doubles where the
products stay under 2**53, else in 64-bit integers. Vectors whose products may leave those are set apart: every pair with
one of them is scored in integers of any size, and the results are ranked together.

Defined cases: null vectors and vectors with a null or non-finite component take no part, as query or candidate; vectors of
different lengths are not comparable and give no score; of rows that share a vec_id all are candidates, except the query's
own id; a query with fewer than k candidates returns them all; scores are ranked exactly, and shown as the nearest 64-bit
integer where they lie beyond; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm import common

K, SCALE, EVERY = 20, 64.0, 20
#: Vectors to a query and to a candidate block at most; bins of a pass.
QUERY_BLOCK, BLOCK, BINS = 512, 4096, 128
#: Query blocks whose counts a task adds up before it gives them on (half a megabyte each at most).
HELD = 64


def quantised(df: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, x, v (floor(scale * x) of each component), wide (products with it may leave 64 bits), of vectors that take part."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    good = F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & good).select("vec_id", "x", F.transform("x", lambda c: F.floor(c * F.lit(scale))).alias("v"), _wide(scale).alias("wide"))


def _wide(scale: float):
    most = F.array_max(F.transform("x", lambda c: F.abs(c))) * F.lit(scale) + 1
    return most * most * F.size("x") >= float(1 << 62)


def blocks(df: DataFrame, size: int, kind: str = "<i4") -> DataFrame:
    """Rows of (block, dim, ids, values): up to ``size`` vectors (vec_id, array) of one length, packed as numbers of ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held = TaskContext.get().partitionId(), 0, {}

        def packed(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, values = held.pop(dim)
            made += 1
            v = np.concatenate(values)
            return pa.RecordBatch.from_arrays([pa.array([part * 1_000_000 + made], pa.int64()), pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()), pa.array([v.astype(kind).tobytes()], pa.binary())], names=["block", "dim", "ids", "vals"])

        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            lengths, flat, at = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(), v.offsets.to_numpy() - v.offsets[0].as_py()
            for dim in np.unique(lengths).tolist():
                on = np.flatnonzero(lengths == dim)
                rows = flat[(at[on][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                while len(on):
                    have = held.setdefault(dim, ([], []))
                    room = size - sum(map(len, have[0]))
                    have[0].append(ids[on[:room]])
                    have[1].append(rows[:room])
                    on, rows = on[room:], rows[room:]
                    if sum(map(len, have[0])) == size:
                        yield packed(dim)
        for dim in list(held):
            yield packed(dim)

    return df.mapInArrow(run, "block long, dim int, ids binary, vals binary")


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as int64 (from doubles where those are exact)."""
    if q.size and c.size and int(np.abs(q).max()) * int(np.abs(c).max()) * q.shape[1] < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _unpacked(ids: bytes, vals: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vals, "<i4").reshape(-1, dim)


def search(spark: SparkSession, df: DataFrame, queries: DataFrame, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the vectors of ``queries`` against those of ``df``; both have vec_id, embedding."""
    common.small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    lanes = max(8, spark.sparkContext.defaultParallelism)
    asked, given_ = quantised(queries, scale), quantised(df, scale)
    narrow = lambda rows, n, size: blocks(rows.filter("NOT wide").select("vec_id", "v").coalesce(n), size)
    q = common.stage(spark, narrow(asked, lanes, QUERY_BLOCK), "queries")
    c = common.stage(spark, narrow(given_, 4 * lanes, BLOCK), "vectors")
    # every query block meets every candidate block: a stated query set, in blocks. Candidate blocks are dealt to lanes,
    # query blocks go to every lane; the ranges of a pass travel with the query blocks.
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane")
    c = c.select(lane, "dim", F.col("ids").alias("cids"), F.col("vals").alias("cvals"))

    def paired(state: DataFrame | None) -> DataFrame:
        left = q if state is None else q.join(state, "block")
        return left.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).join(c, ["lane", "dim"])

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for b, (lo, hi, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), b)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(lo), pa.array(hi), pa.array(n)], names=["block", "at", "lo", "hi", "n"])
            held.clear()

        for block, dim, ids, vals, cids, cvals in common.column_lists(batches):
            for b, d, i, v, ci, cv in zip(block, dim, ids, vals, cids, cvals, strict=True):
                qi, qv = _unpacked(i, v, d)
                cj, cw = _unpacked(ci, cv, d)
                s = scores(qv, cw)
                found = [s.min(1), s.max(1), (qi[:, None] != cj[None, :]).sum(1)]
                old = held.get(b)
                held[b] = found if old is None else [np.minimum(old[0], found[0]), np.maximum(old[1], found[1]), old[2] + found[2]]
                if len(held) > HELD:
                    yield from given()
        yield from given()

    cols = ["block", "dim", "ids", "vals", "cids", "cvals"]
    ends = paired(None).select(*cols).mapInArrow(extremes, "block long, at int, lo long, hi long, n long")
    per_query = ends.groupBy("block", "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    # need: how many of the k highest are still to be found within lo..hi, both ends included
    state = common.stage(spark, per_query.select("block", "at", "lo", "hi", F.least(F.lit(k).cast("long"), "n").alias("need")).filter("need > 0"), "range")

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for b, (at, counts) in held.items():
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), b)), pa.array(at[some // BINS].astype(np.int32)), pa.array((some % BINS).astype(np.int32)), pa.array(counts[some])], names=["block", "at", "bin", "n"])
            held.clear()

        for block, dim, ids, vals, cids, cvals, ranges in common.column_lists(batches):
            for b, d, i, v, ci, cv, r in zip(block, dim, ids, vals, cids, cvals, ranges, strict=True):
                r.sort(key=lambda x: x["at"])
                at, lo, hi = (np.array([x[n] for x in r], np.int64) for n in ("at", "lo", "hi"))
                qi, qv = _unpacked(i, v, d)
                cj, cw = _unpacked(ci, cv, d)
                s = scores(qv[at], cw)
                width = -(-(hi - lo + 1) // BINS)
                bin_ = (s - lo[:, None]) // width[:, None]
                on = (s >= lo[:, None]) & (s <= hi[:, None]) & (qi[at][:, None] != cj[None, :])
                flat = (np.arange(len(at))[:, None] * BINS + bin_)[on]
                counts = np.bincount(flat, minlength=len(at) * BINS)
                held[b] = [at, counts + held[b][1] if b in held else counts]
                if len(held) > HELD:
                    yield from given()
        yield from given()

    while state.filter("hi > lo").limit(1).count():
        ranges = state.filter("hi > lo").groupBy("block").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("ranges"))
        counts = paired(ranges).select(*cols, "ranges").mapInArrow(histogram, "block long, at int, bin int, n long").groupBy("block", "at", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("block", "at").orderBy(F.desc("bin")))
        open_ = counts.withColumn("upto", above).join(state.filter("hi > lo"), ["block", "at"]).filter("upto >= need AND upto - n < need")
        width = F.expr(f"(hi - lo + {BINS}) DIV {BINS}")
        narrowed = open_.select("block", "at", (F.col("lo") + F.col("bin") * width).alias("lo"), F.least("hi", F.col("lo") + (F.col("bin") + 1) * width - 1).alias("hi"), (F.col("need") - F.col("upto") + F.col("n")).alias("need"))
        state = common.stage(spark, narrowed.unionByName(state.filter("hi = lo")), "range")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, dim, ids, vals, cids, cvals, found in common.column_lists(batches):
            for d, i, v, ci, cv, r in zip(dim, ids, vals, cids, cvals, found, strict=True):
                at, kth = np.array([x["at"] for x in r]), np.array([x["lo"] for x in r], np.int64)
                qi, qv = _unpacked(i, v, d)
                cj, cw = _unpacked(ci, cv, d)
                s = scores(qv[at], cw)
                rows, columns = np.nonzero((s >= kth[:, None]) & (qi[at][:, None] != cj[None, :]))
                sc, cid = s[rows, columns], cj[columns]
                order = np.lexsort((cid, -sc, rows))
                rows, sc, cid = rows[order], sc[order], cid[order]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                on = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(qi[at][rows[on]]), pa.array(cid[on]), pa.array(sc[on]), pa.array(np.full(int(on.sum()), 0)), pa.array(at[rows[on]])], names=["query_id", "vec_id", "score", "pad", "at"])

    kth = state.groupBy("block").agg(F.collect_list(F.struct("at", "lo")).alias("found"))
    best = paired(kth).select(*cols, "found").mapInArrow(keep, "query_id long, vec_id long, score long, pad long, at long")
    order = "score"
    if given_.filter("wide").limit(1).count() or asked.filter("wide").limit(1).count():
        best, order = with_wide(best, asked, given_, k, scale, lanes), "key"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(order), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def order_key(n: int) -> bytes:
    """Bytes in the order of integers of any size."""
    size = (abs(n).bit_length() + 7) // 8
    if n >= 0:
        return b"\x01" + size.to_bytes(4, "big") + n.to_bytes(size, "big")
    return b"\x00" + (0xFFFFFFFF - size).to_bytes(4, "big") + bytes(255 - b for b in (-n).to_bytes(size, "big"))


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers of any size."""
    return np.array([math.floor(Fraction(v) * Fraction(scale)) for v in x.ravel().tolist()], object).reshape(x.shape)


def with_wide(best: DataFrame, asked: DataFrame, given_: DataFrame, k: int, scale: float, lanes: int) -> DataFrame:
    """``best`` with the pairs that it lacks: wide queries and all candidates, other queries and wide candidates; by exact key."""
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane")
    packed = lambda rows, n, size: blocks(rows.select("vec_id", "x").coalesce(n), size, "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, ids, vals, cids, cvals in common.column_lists(batches):
            for d, i, v, ci, cv in zip(dims, ids, vals, cids, cvals, strict=True):
                qi, cj = np.frombuffer(i, "<i8").tolist(), np.frombuffer(ci, "<i8").tolist()
                s = scaled(np.frombuffer(v, "<f8").reshape(-1, d), scale) @ scaled(np.frombuffer(cv, "<f8").reshape(-1, d), scale).T
                found = [(a, b, x) for a, row in zip(qi, s.tolist(), strict=True) for x, b in heapq.nsmallest(k, ((x, b) for x, b in zip(row, cj, strict=True) if b != a), key=lambda p: (-p[0], p[1]))]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([max(-(1 << 63), min((1 << 63) - 1, f[2])) for f in found], pa.int64()), pa.array([order_key(f[2]) for f in found], pa.binary())], names=["query_id", "vec_id", "score", "key"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([order_key(n) for n in batch.column(2).to_pylist()], pa.binary())], names=["query_id", "vec_id", "score", "key"])

    columns = "query_id long, vec_id long, score long, key binary"
    out = best.select("query_id", "vec_id", "score").mapInArrow(keyed, columns)
    for left, right in ((asked.filter("wide"), given_), (asked.filter("NOT wide"), given_.filter("wide"))):
        q = packed(left, lanes, 64).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        c = packed(right, 4 * lanes, 512).select(lane, "dim", F.col("ids").alias("cids"), F.col("vals").alias("cvals"))
        out = out.unionByName(q.join(c, ["lane", "dim"]).select("dim", "ids", "vals", "cids", "cvals").mapInArrow(run, columns))
    return out


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(spark, vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
