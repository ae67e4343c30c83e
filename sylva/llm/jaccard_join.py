"""N-gram Jaccard self-join by chosen paths.

Texts become sets of hashed word shingles; equal sets are one class. Each class is embedded as T min-wise tokens (i, value).
A run is a random tree: a node draws one or two of the T coordinates, 1 / THRESHOLD of them on average, and each class goes
down to the child named by its token there, so similar sets keep meeting while others part. Nodes of few classes are leaves;
larger ones are split again, level by level. Leaves are compared by brute force on the embeddings, and runs are repeated
until a pair at the threshold is missed with probability less than 1 - RECALL, given that all runs draw from the same T. What a leaf puts out is a spanning forest of
its candidate pairs, never the pairs themselves.

Every candidate component is then verified exactly: all its sets, dealt in pairs of blocks, are intersected by matrix
products, which counts each class's links (other classes at the threshold or above) and joins linked classes into groups.
A leaf or component of any size is worked in pairs of bounded blocks, so none is cut off and none meets in one task.

Defined cases: a text without words (null, empty, signs only) is linked to nothing and is a class of its own row; a text of
fewer words than a shingle has one shingle of all its words; equal texts are one class, represented by its smallest doc_id
(null last); rows that repeat a doc_id are members by their own texts; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import common

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.995
#: Coordinates of the embedding; levels to a step and in all; classes in a leaf block; sets and shingles in a block.
T, STEP, DEPTH, LEAF, BLOCK_SETS, BLOCK_SHINGLES = 64, 3, 9, 800, 500, 400_000
#: Agreeing coordinates that make a candidate: about four deviations below the threshold.
CANDIDATE = int(T * (THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / T)))
#: Recall kept in hand for coordinates drawn twice in one tree, which ``reached`` leaves out (0.0003 by simulation).
SPARE = 0.001

_A = common.mix(np.arange(1, T + 1, dtype=np.uint64) * common._GOLD) | np.uint64(1)


def embedding(sets: np.ndarray) -> np.ndarray:
    """T min-wise values of a set of hashes."""
    out = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(sets), 2048):
            np.minimum(out, (sets[None, k : k + 2048] * _A[:, None]).min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def survival(levels: int, similarity: float = THRESHOLD) -> float:
    """Chance that a pair of the given similarity still shares a node after so many levels of one run."""
    more, gone = 1 / THRESHOLD - 1, 0.0
    for _ in range(levels):
        child = 1 - similarity + similarity * gone  # a drawn coordinate parts them, or its subtree does
        gone = child * (1 - more + more * child)
    return 1 - gone


def reached(runs: int, levels: int = DEPTH, similarity: float = THRESHOLD) -> float:
    """Chance that a pair becomes a candidate: runs share one signature, so they only differ given how many coordinates agree."""
    chance = [math.comb(T, k) * similarity**k * (1 - similarity) ** (T - k) for k in range(T + 1)]
    return sum(chance[k] * (1 - (1 - survival(levels, k / T)) ** runs) for k in range(CANDIDATE, T + 1))


def runs_needed(recall: float = RECALL, levels: int = DEPTH) -> int:
    for runs in range(1, 1000):
        if reached(runs, levels) >= recall + SPARE:
            return runs
    raise ValueError(f"no number of runs over {T} coordinates reaches a recall of {recall} + {SPARE}")


def descend(owner: np.ndarray, node: np.ndarray, signature: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, node) after ``levels`` more levels; ``owner`` indexes the rows of ``signature``."""
    with np.errstate(over="ignore"):
        for _ in range(levels):
            drawn = common.mix(node + common._GOLD)
            first = (drawn % np.uint64(T)).astype(np.int64)
            second = (first + 1 + ((drawn >> np.uint64(8)) % np.uint64(T - 1)).astype(np.int64)) % T
            both = (drawn >> np.uint64(32)) % np.uint64(1 << 16) < np.uint64((1 / THRESHOLD - 1) * (1 << 16))
            child = lambda o, n, at: common.mix((n * np.uint64(0x2545F4914F6CDD1D)) ^ (signature[o, at].astype(np.uint64) << np.uint64(8)) ^ at.astype(np.uint64))
            owner, node = np.concatenate([owner, owner[both]]), np.concatenate([child(owner, node, first), child(owner[both], node[both], second[both])])
    return owner, node


def sets_of(df: DataFrame, width: int, wanted: str) -> DataFrame:
    """doc_id, th (hash of the text), key (16 bytes, null without words), and ``wanted``: sig and n, or the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for ids, ths, texts in common.column_lists(batches):
            keys, data, sizes = [], [], []
            for text in texts:
                s = common.shingles(hashes.of(text), width)
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                data.append((embedding(s) if wanted == "sig" else s).tobytes() if len(s) else None)
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(keys, pa.binary()), pa.array(data, pa.binary()), pa.array(sizes, pa.int32())], names=["doc_id", "th", "key", wanted, "n"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, th long, key binary, {wanted} binary, n int")


def leaf_pairs(spark: SparkSession, classes: DataFrame, runs: int) -> DataFrame:
    """(a, b): spanning edges of the candidate pairs of every leaf of every run."""

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = common.mix(np.arange(1, runs + 1, dtype=np.uint64))
        for keys, sigs in common.column_lists(batches):
            for lo in range(0, len(keys), 512):
                some, s = keys[lo : lo + 512], np.array([np.frombuffer(x, np.uint32) for x in sigs[lo : lo + 512]])
                owner, node = descend(np.tile(np.arange(len(s)), runs), np.repeat(seeds, len(s)), s, STEP)
                yield pa.RecordBatch.from_arrays([pa.array([some[i] for i in owner.tolist()], pa.binary()), pa.array(node.view(np.int64))], names=["key", "node"])

    def continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, sigs in common.column_lists(batches):
            if not keys:
                continue
            owner, node = descend(np.arange(len(keys)), np.array(nodes, np.int64).view(np.uint64), np.array([np.frombuffer(x, np.uint32) for x in sigs]), STEP)
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in owner.tolist()], pa.binary()), pa.array(node.view(np.int64))], names=["key", "node"])

    sigs = classes.select("key", "sig")
    level, leaves = sigs.mapInArrow(started, "key binary, node long"), None
    for depth in range(STEP, DEPTH + 1, STEP):
        level = common.stage(spark, level, "level")
        shared = common.stage(spark, level.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
        members = common.stage(spark, common.joined_on(level, shared, "node", "n", level.count()), "members")
        common.remove(spark, level)
        common.remove(spark, shared)
        last = depth >= DEPTH
        done = members if last else members.filter(F.col("n") <= LEAF)
        leaves = done if leaves is None else leaves.unionByName(done)
        if last or not members.filter(F.col("n") > LEAF).limit(1).count():
            break
        level = members.filter(F.col("n") > LEAF).select("key", "node").join(sigs, "key").select("key", "node", "sig").mapInArrow(continued, "key binary, node long")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (groups,) in common.column_lists(batches):
            edges: set[tuple[bytes, bytes]] = set()
            for group in groups:
                group.sort(key=lambda g: g["key"])  # the root is the smallest key: most components are stars at once
                keys = [g["key"] for g in group]
                s = np.array([np.frombuffer(g["sig"], np.uint32) for g in group])
                forest = common.Forest(len(keys))
                for k in range(len(keys) - 1):
                    near = np.flatnonzero((s[k + 1 :] == s[k]).sum(1) >= CANDIDATE)
                    for j in near.tolist():
                        forest.join(k, k + 1 + j)
                edges.update((keys[k], keys[r]) for k in range(len(keys)) if (r := forest.root(k)) != k)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.binary()), pa.array([e[1] for e in edges], pa.binary())], names=["a", "b"])

    dealt = common.in_block_pairs(leaves, "node", F.ceil(F.col("n") / LEAF))
    groups = dealt.join(sigs, "key").groupBy("node", "__lo", "__hi").agg(F.collect_list(F.struct("key", "sig")).alias("g")).filter(F.size("g") > 1).select("g")
    return groups.mapInArrow(compared, "a binary, b binary").distinct()


def verified(spark: SparkSession, sets: DataFrame, threshold: float) -> DataFrame:
    """(key, links, other): links counted exactly within each candidate component, with edges that span linked groups.

    ``sets``: key, comp, hashes, n.
    """
    size = sets.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    nb = F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES))
    dealt = common.in_block_pairs(sets.join(size.select("comp", nb.alias("nb")), "comp"), "comp", F.col("nb"))
    groups = dealt.groupBy("comp", "__lo", "__hi").agg(F.collect_list(F.struct("key", "__own", "hashes")).alias("g")).filter(F.size("g") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lows, highs, groups in common.column_lists(batches):
            out: list[tuple[bytes, int, bytes]] = []
            for lo, hi, group in zip(lows, highs, groups, strict=True):
                group.sort(key=lambda g: g["key"])
                linked = links_within([np.frombuffer(g["hashes"], np.uint64) for g in group], threshold)
                if lo != hi:  # pairs within one block belong to the pair of that block with itself
                    own = np.array([g["__own"] for g in group])
                    linked &= own[:, None] != own[None, :]
                forest = common.Forest(len(group))
                for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(linked))), strict=True):
                    forest.join(a, b)
                out += [(group[k]["key"], n, group[forest.root(k)]["key"]) for k, n in enumerate(linked.sum(1).tolist()) if n]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.binary()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.binary())], names=["key", "links", "other"])

    return groups.select("__lo", "__hi", "g").mapInArrow(run, "key binary, links long, other binary")


def links_within(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of ``threshold`` or more; the intersections by matrix products."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    if n == 2:
        common_ = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        shared = np.array([[sizes[0], common_], [common_, sizes[1]]], np.float64)
    else:
        owner = np.repeat(np.arange(n), sizes)
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        on = count[column] > 1  # a shingle of one set alone is in no intersection
        renumber = np.cumsum(count > 1) - 1
        owner, column, width = owner[on], renumber[column[on]], int((count > 1).sum())
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((n, n), np.float32)
        step = max(256, (8 << 20) // max(n, 1))
        for lo in range(0, width, step):
            a, b = np.searchsorted(column, [lo, lo + step])
            m = np.zeros((n, min(step, width - lo)), np.float32)
            m[owner[a:b], column[a:b] - lo] = 1
            shared += m @ m.T
        shared = shared.astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - shared
    linked = shared >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def joined(spark: SparkSession, docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, th, class_id, rep_id, n_links, n_copies, stays: a row for each row of ``docs`` (doc_id, text).

    class_id: smallest doc_id of the documents reached over links; rep_id: smallest doc_id with an equal set; stays: whether
    the row's id and text (by its hash ``th``) are the first of its group.
    """
    common.small_batches(spark)
    before = common.staged()
    rows = common.stage(spark, sets_of(docs, width, "sig"), "sets")
    classes = common.stage(spark, rows.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("n").alias("n")).select("key", F.col("first.doc_id").alias("rep"), F.col("first.th").alias("rep_th"), "copies", "sig", "n"), "classes")
    pairs = common.stage(spark, leaf_pairs(spark, classes, runs_needed(recall)), "pairs")
    candidates = common.stage(spark, common.components(spark, pairs, "a", "b").select(F.col("node").alias("key"), F.col("root").alias("comp")), "candidates")

    # the sets of candidates alone are made again from their texts; ids may be null, so the texts' hashes go with them
    ids = classes.join(candidates, "key").select(F.col("rep").alias("__rep"), F.col("rep_th").alias("__th"))
    few = ids.count() <= 1_000_000  # 16 MB are broadcast at most; beyond, texts are shuffled
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__rep")) & (F.xxhash64("text") == F.col("__th"))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, same, "left_semi")
    hashes = sets_of(texts, width, "hashes").filter("key IS NOT NULL").dropDuplicates(["key"]).select("key", "hashes", "n")
    checked = common.stage(spark, verified(spark, candidates.join(hashes, "key"), threshold), "verified")

    links = checked.groupBy("key").agg(F.sum("links").alias("n_links"))
    first = F.struct(F.col("rep").isNull().alias("last"), F.col("rep").alias("id"), F.col("rep_th").alias("th"))
    groups = common.stage(spark, components(spark, checked).join(classes.select("key", first.alias("first")), "key"), "groups")
    least = groups.groupBy("group").agg(F.min("first").alias("stay"), F.count("*").alias("n"))
    named = common.joined_on(groups.select("key", "group"), least, "group", "n", groups.count()).select("key", "stay")
    facts = classes.withColumn("first", first).join(links, "key", "left").join(named, "key", "left")
    facts = facts.select("key", F.col("rep").alias("rep_id"), F.col("copies").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("stay", "first").alias("stay"))
    facts = common.stage(spark, facts.select("*", F.col("stay.id").alias("class_id")), "facts")
    common.remove_staged(spark, before, rows, facts)
    plain = rows.filter("key IS NULL").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("stays"))
    keyed = common.joined_on(rows.filter("key IS NOT NULL").select("doc_id", "th", "key"), facts, "key", "n_copies", rows.count())
    stays = F.col("doc_id").eqNullSafe(F.col("stay.id")) & (F.col("th") == F.col("stay.th"))
    return keyed.select("doc_id", "th", "class_id", "rep_id", "n_links", "n_copies", stays.alias("stays")).unionByName(plain)


def components(spark: SparkSession, checked: DataFrame) -> DataFrame:
    found = common.components(spark, checked.select("key", "other"), "key", "other")
    return found.select(F.col("node").alias("key"), F.col("root").alias("group"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "rep_id", "n_links", "n_copies")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of linked or equal texts: the one that names the group.

    Rows without words all stay. Rows are found by (doc_id, hash of the text); only where such a pair repeats are rows
    compared among each other.
    """
    before = common.staged()
    decided = joined(spark, docs).filter("n_copies > 1 OR n_links > 0").groupBy("doc_id", "th").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("rows"))
    marked = common.stage(spark, decided, "marked")
    common.remove_staged(spark, before, marked)
    dropped = marked.filter("NOT stays").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    few = dropped.count() <= 1_000_000  # 16 MB are broadcast at most; beyond, the texts are shuffled
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th"))
    kept = docs.join(F.broadcast(dropped) if few else dropped, same, "left_anti")
    again = marked.filter("stays AND rows > 1").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    if not again.limit(1).count():
        return kept
    once = kept.join(again, same, "left_anti")
    many = kept.join(again, same).dropDuplicates(["__id", "__th"]).select(*docs.columns)
    return once.unionByName(many)
