"""Operator 9, embedding near-dedup with a pivot-permutation index.

Every vector is described by its nearest reference points in order of nearness. Inverted lists per (label, pivot) hold the
vectors that name the pivot; two vectors of a list are a candidate pair if they share enough pivots, and each pair is
looked at in the list of its first shared pivot only. Pivots lie apart from each other, so a dense cluster has about one, the
nearest of all its members, and its pairs are compared in full in that list. Lists are dealt in chunks, compared two at a time with one
matrix product, and give counts and one edge per vector, never pairs.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import freeze
from .links import components

CHUNK = 512
APART, DRAWN = .7, 4  # pivots have cosines below APART, and are taken from DRAWN times as many vectors
POSTING = "label string, dim int, pivot int, id long, copies long, pivots binary, vec binary"
LINKS = "a long, b long, n long"


def _apart(x: np.ndarray, pivots: int) -> np.ndarray:
    """The first `pivots` rows of x, in order, that are not near an earlier one taken."""
    taken = []
    for i in range(len(x)):
        if len(taken) < pivots and (not taken or (x[taken] @ x[i]).max() < APART):
            taken.append(i)
    return x[taken]


def _postings(sent, near: int, threshold: float | None):
    """One row per vector and pivot it names. With a threshold, a pivot is left out if no vector within the threshold can have
    it as its nearest: the border between it and the vector's own nearest pivot is further away (-1 in `pivots`)."""

    def run(batches):
        pivots = sent.value
        for batch in batches:
            label, ids, copies = batch.column("label").to_pylist(), batch.column("id").to_numpy(), batch.column("copies").to_numpy()
            values, edge = batch.column("vec").flatten().to_numpy(zero_copy_only=False), batch.column("vec").offsets.to_numpy()
            dims = np.diff(edge)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = values[(edge[own] - edge[0])[:, None] + np.arange(dim)]
                p = pivots.get(dim, np.zeros((1, dim)))
                score = (x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)) @ p.T
                k = min(near, len(p))
                first = np.argpartition(-score, k - 1, axis=1)[:, :k]
                first = np.take_along_axis(first, np.argsort(-np.take_along_axis(score, first, 1), axis=1, kind="stable"), 1).astype(np.int32)
                if threshold is not None:
                    least = np.take_along_axis(score, first.astype(np.int64), 1)
                    border = np.sqrt(np.maximum(2 - 2 * (p @ p.T)[first[:, :1], first], 0))
                    first[least[:, :1] - least > (1 - threshold ** 2) ** .5 * border + 1e-6] = -1
                rows, at = np.nonzero(first >= 0)
                vec, named = [v.tobytes() for v in x], [v.tobytes() for v in first]
                yield pa.RecordBatch.from_arrays([
                    pa.array([label[own[r]] for r in rows], pa.string()), pa.array(np.full(len(rows), dim, np.int32)), pa.array(first[rows, at]), pa.array(ids[own][rows]),
                    pa.array(copies[own][rows]), pa.array([named[r] for r in rows], pa.binary()), pa.array([vec[r] for r in rows], pa.binary())],
                    ["label", "dim", "pivot", "id", "copies", "pivots", "vec"])
    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(threshold: float, shared: int, kind):
    def run(table):
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        ids, copies, own = (table[c].to_numpy() for c in ("id", "copies", "own"))
        x = np.frombuffer(b"".join(table["vec"].to_pylist()), kind).reshape(len(ids), -1).astype(float)
        named = np.frombuffer(b"".join(table["pivots"].to_pylist()), np.int32).reshape(len(ids), -1)
        p, q, pivot = table["p"][0].as_py(), table["q"][0].as_py(), table["pivot"][0].as_py()
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        length = np.sqrt((x * x).sum(1))
        unit = x / length[:, None]
        i, j = np.nonzero(unit[left] @ unit[right].T >= threshold - 1e-9)
        i, j = left[i], right[j]
        if p == q:
            i, j = i[i < j], j[i < j]
        hits = []
        for a in range(0, len(i), 1 << 16):
            s, t = i[a:a + (1 << 16)], j[a:a + (1 << 16)]
            good = (x[s] * x[t]).sum(1) / (length[s] * length[t]) >= threshold
            s, t = s[good], t[good]
            both = (named[s][:, :, None] == named[t][:, None, :]).any(2) & (named[s] >= 0)
            first = np.where(both, named[s], np.iinfo(np.int32).max).min(1)
            good = (both.sum(1) >= min(shared, named.shape[1])) & (first == pivot)
            hits.append(np.stack([s[good], t[good]]))
        i, j = np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), np.int64)
        count = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root, live = _roots(len(ids), i, j), np.flatnonzero(count)
        return pa.table({"a": pa.array(ids[live]), "b": pa.array(ids[root[live]]), "n": pa.array(count[live].astype(np.int64))})
    return run


def similar_vectors(vectors: DataFrame, threshold: float = 0.93, pivots: int = 512, near: int = 8, shared: int = 1,
                    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: n_links, component_id, kept.

    Vectors are compared if their labels are equal and not NULL and their lengths are equal, by cosine in double precision. Vectors that
    are NULL or zero or hold NULL or non-finite components link with nothing, nor do rows without id, whose
    component_id is NULL; they all stay. Equal vectors are one class from the start and link with each other. Pivots are
    at most `pivots` vectors that lie apart, taken from DRAWN times as many chosen by a hash of their id (the documented bound of the sample, per
    vector length); every vector is indexed. Pairs with fewer than `shared` common pivots among their `near` nearest are not found. Other columns are not looked at.
    """
    kind = np.float64 if vectors.schema[embedding].dataType.elementType.typeName() == "double" else np.float32
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
                         F.col(embedding).cast("array<double>" if kind is np.float64 else "array<float>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & fine, F.lit(False))
    own = own.withColumn("usable", usable)
    same = Window.partitionBy("label", "vec")
    # each row with the smallest id of its equals, and their number
    classed = freeze(own.where("usable").withColumn("id", F.min("vec_id").over(same)).withColumn("copies", F.count("*").over(same)))
    distinct = classed.where("vec_id = id").dropDuplicates(["vec_id", "label", "vec"]).select("id", "copies", "label", "vec")
    sizes = [r[0] for r in distinct.select(F.size("vec")).distinct().limit(64).collect()]
    chosen = {}
    for dim in sizes:
        rows = distinct.where(F.size("vec") == dim).orderBy(F.xxhash64("id"), "id").limit(pivots * DRAWN).select("vec").collect()
        x = np.array([r["vec"] for r in rows], float)
        chosen[dim] = _apart(x / np.linalg.norm(x, axis=1, keepdims=True), pivots)
    sent = vectors.sparkSession.sparkContext.broadcast(chosen)
    posted = distinct.mapInArrow(_postings(sent, near, threshold if shared == 1 and 0 < threshold <= 1 else None), POSTING)
    listed = ["label", "dim", "pivot"]
    chunks = F.ceil(F.count("*").over(Window.partitionBy(*listed)) / CHUNK).cast("long")
    dealt = posted.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks"))) \
        .withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)"))) \
        .withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")).drop("other", "chunks")
    links = freeze(dealt.groupBy(*listed, "p", "q").applyInArrow(_compare(threshold, shared, kind), LINKS))
    count = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    found = classed.join(count, "id", "left").join(components(links.select("a", "b")), "id", "left")
    good = found.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    rest = own.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)
