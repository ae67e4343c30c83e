"""Shared plumbing of the training-data operators: staging, hashing of words, grouping helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sylva-shared-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base.rstrip("/")


#: Folders of staged tables that still stand.
_STAGED: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/sylva-{name}-{uuid.uuid4().hex[:12]}"
    _STAGED.append(path)
    return path


def staged() -> list[str]:
    """Folders made so far and not removed."""
    return list(_STAGED)


def remove_staged(spark: SparkSession, before: list[str], *keep: DataFrame) -> None:
    """Delete the folders made since ``staged()`` gave ``before``, but for those that ``keep`` read."""
    files = [f for df in keep for f in df.inputFiles()]
    for path in [p for p in _STAGED if p not in set(before)]:
        if not any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in files):
            _delete(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def _delete(spark: SparkSession, folder) -> None:
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    name = folder.getName()
    _STAGED[:] = [p for p in _STAGED if not p.endswith(f"/{name}")]


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, read again."""
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    files = df.inputFiles()
    if not files:
        return
    _delete(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent())


def small_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bound what a Python worker holds at once by bytes, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{megabytes}m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words; fewer words make one shingle of all of them."""
    n = len(words)
    if not n:
        return words
    if n < width:
        width = n
    out = np.zeros(n - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _GOLD + words[k : n - width + 1 + k]
        out = mix(out + np.uint64(width))
    return np.unique(out)


def column_lists(batches: Iterator) -> Iterator[list[list]]:
    """Arrow batches as lists of Python values, a column each. Memory freed on the way goes back to the machine at the end."""
    for batch in batches:
        yield [column.to_pylist() for column in batch.columns]
    give_back()


def give_back() -> None:
    """Return what this worker has freed, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = None


def kept_rows(df: DataFrame, column: str, keep) -> DataFrame:
    """The rows whose text ``keep`` (a list of texts -> a list of booleans) keeps. Only that column goes through Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(keep(batch.to_pylist()), pa.bool_())
        give_back()

    return df.filter(F.arrow_udf(run, "boolean")(F.col(f"`{column}`").cast("string")))


class Forest:
    """Union-find over 0..n-1; roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def in_block_pairs(df: DataFrame, group: str, blocks) -> DataFrame:
    """Deal each group's rows so that any two of them meet in a pair of blocks (__lo, __hi).

    ``blocks``: a column with the group's number of blocks. A group of one block is dealt once; of b blocks, each row
    goes to b pairs. Within a pair of two blocks ``__own`` tells the blocks apart. No group meets in one task whole.
    """
    own = F.pmod(F.xxhash64(F.lit(7), F.col("key")), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))
    return (
        df.withColumn("__own", own).withColumn("__other", other)
        .withColumn("__lo", F.least("__own", "__other")).withColumn("__hi", F.greatest("__own", "__other"))
        .drop("__other")
    )


def joined_on(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, one row a key, where ``n`` counts the rows that have the key, ``total`` all rows.

    Keys of very many rows are too few to shuffle by: their facts are broadcast (at most MOST_HOT, as each has more than
    a MOST_HOT-th of all rows), and their rows stay where they are. All others meet by key.
    """
    hot = max(HOT_ROWS, total // MOST_HOT)
    if not facts.filter(F.col(n) > hot).limit(1).count():
        return rows.join(facts, key)
    many = F.broadcast(facts.filter(F.col(n) > hot))
    return rows.join(many, key).unionByName(rows.join(many.select(key), key, "left_anti").join(facts.filter(F.col(n) <= hot), key))


#: A key of more rows than this may be hot; hot keys at most.
HOT_ROWS, MOST_HOT = 1_000, 100_000


def components(spark: SparkSession, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by alternating large-star and small-star steps: (node, root), root the smallest node.

    Nodes without edges aren't listed. Each round is two joins on aggregated minima, so a node with very many edges is
    pre-aggregated and its join can be split; edges are staged after each round. Rounds end when the edges are stars, which
    one aggregate tells: no node has two parents, or both a parent and children.
    """
    e = stage(spark, edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = stage(spark, small, "edges")
        remove(spark, e)
        e = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").limit(1).count() == 0
