"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the budget by weight; a source whose share exceeds ``epochs`` times its size is held there and
the excess goes to the others by weight, until none is above. A document is taken whole as often as its source's target
holds the source's size, and once more if its seeded hash lies below the source's border. That border is found exactly, by
refining histograms of sizes over the hash: no source is sorted as a whole.

Defined cases: a null text has size 0; a null source is a source of its own, weighed last; a source without words has
target 0 and is never taken; documents of size 0 are taken 0 words; rows that share id, text and source share their hash
and are taken together; an empty table gives an empty mix. Only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm import common

WEIGHTS, SHARE, EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 20240607
#: Each refinement splits the hash range of a source's border into 2**STEP_BITS parts; STEPS of them leave single hashes.
STEP_BITS, STEPS = 12, 5


def sizes(df: DataFrame) -> DataFrame:
    """doc_id, source, size (words between ASCII white space) and the seeded hash, 60 bits."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return df.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words).cast("long").alias("size"), _hash().alias("h"))


def _hash():
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")), 4)


def water_fill(size: dict, weight: dict, budget: float, epochs: float) -> dict:
    """Targets by source: shares of the budget by weight, none above ``epochs`` times its size."""
    left, open_, out = budget, dict(weight), {}
    while open_:
        total = sum(open_.values())
        full = [s for s in open_ if left * open_[s] / total > epochs * size[s]]
        if not full:
            out |= {s: left * w / total for s, w in open_.items()}
            break
        for s in full:
            out[s] = epochs * size[s]
        left -= sum(out[s] for s in full)
        for s in full:
            del open_[s]
    return out


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> dict:
    """source -> (size, target). One row a source reaches the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    order = sorted((r.source for r in rows), key=lambda s: (s is None, s or ""))
    size = {r.source: int(r.n) for r in rows}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target = water_fill(size, weight, share * sum(size.values()), epochs)
    return {s: (size[s], max(0.0, target.get(s, 0.0))) for s in order}


def mixed(spark: SparkSession, df: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """doc_id, source, size, h, source_size, target, copies (times the whole document is taken)."""
    sized = common.stage(spark, sizes(df), "sizes")
    known = decided(spark, sized, weights, share, epochs)
    return sized.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "h", "source_size", "target", _copies(F.col("h")).alias("copies"))


def _copies(h):
    return F.col("whole") + F.when(h < F.col("border"), 1).otherwise(0)


def decided(spark: SparkSession, sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """A row a source: s (its name), source_size, target, whole (times every document is taken), border (hash below which once more)."""
    plan = targets(sized, weights, share, epochs)
    rows = []
    for k, (source, (size, target)) in enumerate(plan.items()):
        whole = int(target // size) if size else 0
        rows.append((k, source, size, float(target), whole, float(target - whole * size)))
    # a row a source: as many as targets() has brought here already
    facts = spark.createDataFrame(rows, "sid int, source string, source_size long, target double, whole int, rest double")
    keyed = sized.join(F.broadcast(facts.select("sid", F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    border = borders(spark, keyed.filter("size > 0"), {r[0]: r[5] for r in rows if r[5] > 0})
    marks = spark.createDataFrame([(k, v) for k, v in border.items()] or [(-1, 0)], "sid int, border long")
    return facts.join(marks, "sid", "left").withColumnRenamed("source", "s")


def borders(spark: SparkSession, keyed: DataFrame, rest: dict[int, float]) -> dict[int, int]:
    """Per source id, the hash below which its documents hold nearest to ``rest`` words.

    A round sums sizes over 2**STEP_BITS parts of the range still open, running sums are taken over those parts, and the
    part where the sum passes ``rest`` stays open. What reaches the driver is one row a source and round.
    """
    low = dict.fromkeys(rest, 0)
    before = dict.fromkeys(rest, 0.0)
    out: dict[int, int] = {}
    for step in range(1, STEPS + 1):
        still = [s for s in rest if s not in out]
        if not still:
            break
        shift = 60 - STEP_BITS * step
        now = spark.createDataFrame([(s, low[s], before[s], rest[s]) for s in still], "sid int, low long, held double, rest double")
        open_ = keyed.join(F.broadcast(now), "sid").filter((F.col("h") >= F.col("low")) & (F.shiftright(F.col("h") - F.col("low"), shift) < 1 << STEP_BITS))
        parts = open_.groupBy("sid", "low", "held", "rest", F.shiftright(F.col("h") - F.col("low"), shift).alias("part")).agg(F.sum("size").cast("double").alias("n"))
        upto = F.col("held") + F.sum("n").over(Window.partitionBy("sid").orderBy("part"))
        passed = parts.withColumn("upto", upto).filter("upto >= rest").groupBy("sid").agg(F.min(F.struct("part", "upto", "n")).alias("x")).collect()
        found = {r.sid: r.x for r in passed}
        for s in still:
            if s not in found:  # rounding: all of it
                out[s] = 1 << 60
                continue
            x, at = found[s], low[s] + (found[s].part << shift)
            under, over = x.upto - x.n, x.upto
            if over == rest[s] or step == STEPS:
                out[s] = at + (1 << shift) if over - rest[s] <= rest[s] - under else at
            low[s], before[s] = at, under
    return out


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed(spark, common.table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix itself: each document's row as many times as it is taken, told from its source and hash where it lies."""
    sized = common.stage(spark, sizes(docs), "sizes")
    known = decided(spark, sized).select(F.col("s").alias("__s"), "whole", "border")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    mine = docs.select(row, F.col("source").cast("string").alias("__source"), _hash().alias("__h"))
    taken = mine.join(F.broadcast(known), F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__copies", _copies(F.col("__h")))
    return taken.filter("__copies > 0").select("__row", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select("__row.*")
