"""Operator 5, mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / source size times, a fraction. The whole part is taken; for the rest,
pairs of documents pass words between their probabilities until one of them is 0 or 1, at random and without bias.
A pair's expected words stay the same, so the words of a source come out at its target but for the last document.
Groups of documents are paired inside their task; what is left of each (at most one document) goes on to the next
level of a tree, so no task ever holds more than `chunk` documents of a source.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import freeze

FANIN = 64
ROW = "doc_id long, source string, size long, source_size long, target double, whole long, part double, chunk long"
NAMES = ["doc_id", "source", "size", "source_size", "target", "whole", "part", "chunk"]


def targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above `most` times its size.

    The windows are over one row per source. With sources in the order of size per weight, those that reach the limit come
    first, and the level of the others is the largest that any prefix of them gives.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    pick = (F.row_number().over(by_name) - 1) % len(weights)
    limit = (most * F.col("source_size")).cast("double")
    base = sizes.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), pick)).withColumn("limit", limit)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (total - before) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    return base.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy(F.lit(0)))) \
        .select("source", "source_size", F.least("limit", F.col("level") * F.col("w")).alias("target"))


def _pivot(seed: int, level: int):
    """Rounds one group; at most one document keeps a fraction."""
    def run(table):
        table = table.select(NAMES)
        ids = table["doc_id"].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        size = table["size"].to_numpy().astype(float)
        with np.errstate(over="ignore"):
            mixed = (ids.astype(np.uint64) + np.uint64(seed * 1000 + level + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
        draw = (mixed >> np.uint64(11)).astype(float) / float(1 << 53)
        order = np.lexsort((size, ids, draw))
        part = table["part"].to_numpy().copy()
        held = -1
        for j in order.tolist():
            if not 0.0 < part[j] < 1.0:
                continue
            if held < 0:
                held = j
                continue
            p, q, s, t = part[held], part[j], size[held], size[j]
            up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
            move = up if draw[j] * (up + down) < down else -down
            p, q = p + move / s, q - move / t
            # of the two limits one is met exactly; rounding errors must not leave a crumb
            p, q = (0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p), (0.0 if q < 1e-12 else 1.0 if q > 1 - 1e-12 else q)
            part[held], part[j] = p, q
            held = held if 0.0 < p < 1.0 else j if 0.0 < q < 1.0 else -1
        return table.set_column(NAMES.index("part"), "part", pa.array(part))
    return run


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 0, chunk: int = 20_000,
                doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: size in words, source_size, target, copies and taken words.

    Sources in code-point order, NULL (a source of its own) last, weigh `weights` again and again and share all words; a
    target stops at `most` times its source's size and the excess is shared by the others. NULL and empty texts have
    size 0 and take nothing; a source without words has target 0; equal rows are documents of their own; the result
    depends on ids, sizes and `seed` only; other columns are not looked at.
    """
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    sized = freeze(sized)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = freeze(targets(per.select("source", "source_size"), weights, float(most)).join(
        per.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    chunks = max(1, -(-(goal.agg(F.max("n")).first()[0] or 0) // chunk))
    small = goal.select(F.col("source").alias("s"), "source_size", "target")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rows = (sized.join(small, F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumn("whole", F.least(F.floor(rate + 1e-12), F.lit(most)).cast("long"))
            .withColumn("part", F.when(F.col("size") > 0, F.greatest(rate - F.col("whole"), F.lit(0.0))).otherwise(F.lit(0.0)))
            .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks))).select(*NAMES))
    open_ = (F.col("part") > 0) & (F.col("part") < 1)
    level, decided = 0, None
    while True:
        rows = freeze(rows.groupBy("source", "chunk").applyInArrow(_pivot(seed, level), ROW))
        last = chunks == 1
        done = rows if last else rows.where(~open_)
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        level, chunks = level + 1, -(-chunks // FANIN)
        rows = rows.where(open_).withColumn("chunk", F.floor(F.col("chunk") / FANIN))
    # one document a source may still hold a fraction: it is taken with that probability
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.col("whole") + F.when(F.col("part") >= 1, 1).when((F.col("part") > 0) & (chance < F.col("part")), 1).otherwise(0)
    return decided.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), (5, 2, 1), 3).select("doc_id", "size", "source_size", "target", "taken")
