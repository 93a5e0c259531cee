"""Operator 4, MinHash near-dedup by fast similarity sketching.

A sketch has `bins` coordinates, filled in rounds: in round i < bins every element is thrown into one hashed bin, and
in round bins + j all elements are thrown into bin j. A bin takes the smallest element of the first round that
reaches it, so after 2 * bins rounds every bin is full even for one element, two sketches agree in a bin with the
probability of their similarity, and the agreements concentrate as for independent coordinates. Bands of `rows` bins
are the buckets; links are confirmed on full shingle sets.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import freeze
from . import blocks as B
from . import textbytes as T
from .links import join_small, linked_groups

CHUNK = 512  # members of a bucket that are compared in one task with as many others
BANDS, ROWS = 40, 8  # at similarity .85 a pair misses all bands with probability 3e-6


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingles of all documents, ascending within each, and the borders between documents."""
    data = T.lower(data)
    start, end, first = T.words(data, offsets, T.SPACED)
    hashed, many = T.fingerprints(data, start, end), np.diff(first)
    at, before = T.window_starts(first, size)
    values = [T.rolling(hashed, size)[at] if len(at) else np.zeros(0, T.U)]
    owner = [np.repeat(np.arange(len(many)), np.diff(before))]
    for n in range(1, size):  # shorter documents: all their words as one shingle
        short = np.flatnonzero(many == n)
        if len(short):
            values.append(T.mix(T.rolling(hashed, n)[first[:-1][short]] + T.U(n)))
            owner.append(short)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(many) + 1))


def sketches(values: np.ndarray, borders: np.ndarray, bins: int) -> np.ndarray:
    """(documents, bins); documents without elements get zeros."""
    n = len(borders) - 1
    out, full = np.zeros((n, bins), T.U), np.zeros((n, bins), bool)
    owner = np.repeat(np.arange(n), np.diff(borders))
    for i in range(2 * bins):
        if not len(values):
            break
        thrown = T.mix(values + T.U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        bin_ = (thrown % T.U(bins)).astype(np.int64) if i < bins else np.full(len(values), i - bins)
        slot = owner * bins + bin_
        wanted = ~full.reshape(-1)[slot]
        slot, own = slot[wanted], thrown[wanted]
        order = np.argsort(own, kind="stable")[::-1]
        flat = out.reshape(-1)
        flat[slot[order]] = own[order]  # of several assignments the last one, the smallest, stays
        full.reshape(-1)[slot] = True
        if i < 8 or i % 16 == 15:
            open_ = ~full.all(1)
            live = open_[owner]
            values, owner = values[live], owner[live]
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sign(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            data, offsets = T.batch_of(batch.column("text"))
            for a, b in T.slices(offsets, B.SLICE):
                values, borders = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                total = np.zeros((2, len(values) + 1), T.U)
                np.cumsum(T.mix(values + T.U(1)), out=total[0, 1:])
                np.cumsum(T.mix(values ^ T.U(0x5555555555555555)), out=total[1, 1:])
                marks = total[:, borders[1:]] - total[:, borders[:-1]]
                sketch = sketches(values, borders, bands * rows).reshape(b - a, bands, rows)
                band = np.broadcast_to(np.arange(bands, dtype=T.U), (b - a, bands)).copy()
                for r in range(rows):
                    band = T.mix(band ^ sketch[:, :, r]) + T.U(r)
                low = (sketch.reshape(b - a, -1) >> T.U(40)).astype(np.uint8)  # eight bits of every bin, to compare sketches with
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(_signed(band.reshape(-1))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(borders)), pa.array(_signed(marks[0])), pa.array(_signed(marks[1])), lists,
                                                  pa.array([x.tobytes() for x in low], pa.binary())], ["doc_id", "n", "f1", "f2", "bands", "sketch"])
    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            data, offsets = T.batch_of(batch.column("text"))
            for a, b in T.slices(offsets, B.SLICE):
                values, borders = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], size)
                raw = [values[x:y].tobytes() for x, y in zip(borders[:-1], borders[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(raw, pa.binary())], ["id", "items"])
    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), T.U), np.frombuffer(y.as_buffer(), T.U)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))
    return run


def _alike(percent: int, bands: int, least: int):
    """Pairs of a bucket (or of two chunks of one) whose sketches agree in at least `least` bins, each pair in the first
    bucket that it shares only. Rows come sorted by bucket and chunks; a bucket never has more than 2 * CHUNK rows."""
    def pairs(table: pa.Table):
        n = table.num_rows
        key = np.stack([table[k].to_numpy() for k in ("bucket", "p", "q")])
        new = np.ones(n, bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
        own, c, size, ids = (table[k].to_numpy() for k in ("own", "c", "trait", "id"))
        band = table["bands"].combine_chunks().flatten().to_numpy().reshape(n, bands)
        sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(n, -1)
        many = end - np.arange(n) - 1
        upto = np.concatenate([[0], np.cumsum(many)])
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + (1 << 18), "right")) - 1)
            i = np.repeat(np.arange(a, b), many[a:b])
            j = i + 1 + np.arange(len(i)) - (upto[i] - upto[a])
            x, y = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            good = (c[i] != c[j]) & ((own[i] != own[j]) | (key[1][i] == key[2][i])) & (100 * x >= percent * y)
            i, j = i[good], j[good]
            good = (sketch[i] == sketch[j]).sum(1) >= least
            i, j = i[good], j[good]
            equal = band[i] == band[j]
            first = band[i, equal.argmax(1)] == key[0][i]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[i], ids[j])[first]), pa.array(np.minimum(ids[i], ids[j])[first])], ["a", "b"])
            a = b

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            # the last bucket may go on in the next batch
            tail = [held[k][-1].as_py() for k in ("bucket", "p", "q")]
            same = np.ones(held.num_rows, bool)
            for k, v in zip(("bucket", "p", "q"), tail):
                same &= held[k].to_numpy() == v
            cut = held.num_rows - int(same.sum())
            if cut:
                yield from pairs(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from pairs(held)
    return run


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_shingles, component_id (smallest id that links reach), kept.

    A-Z is lower-cased; words are runs without space and U+0009-U+000D; a document's set holds its distinct shingles of
    `size` words, or its whole word sequence where it has fewer; 100 * shared >= `percent` * union is a link.
    Documents with one set are one class from the start. NULL and empty texts and texts without words have no set and
    no link; rows without id get component_id NULL and stay; rows of one id are one document; other columns are not
    looked at.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = freeze(own.mapInArrow(_sign(size, bands, rows), "doc_id long, n long, f1 long, f2 long, bands array<long>, sketch binary"))
    same = ["f1", "f2", "n"]
    classes = signed.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min_by(F.struct("bands", "sketch"), "doc_id").alias("m"), F.min("doc_id").alias("id")) \
        .select("id", "n", "m.bands", "m.sketch")
    dealt = classes.select("id", F.col("n").alias("trait"), F.explode("bands").alias("bucket"))
    members = freeze(dealt.withColumn("k", F.count("*").over(Window.partitionBy("bucket"))).where("k > 1").drop("k"))
    wanted = freeze(members.select(F.col("id").alias("doc_id")).distinct())
    sets = freeze(join_small(own.where("doc_id is not null"), wanted, ["doc_id"], "left_semi", 16).mapInArrow(_sets(size), "id long, items binary"))

    def verify(pairs: DataFrame) -> DataFrame:
        x, y = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        return pairs.join(x, "a").join(y, "b").mapInArrow(_confirm(percent), "a long, b long").distinct()

    marks = classes.join(wanted.withColumnRenamed("doc_id", "id"), "id", "left_semi").select("id", "bands", "sketch")
    expected = bands * rows * percent / 100
    least = int(expected - 5 * (expected * (1 - percent / 100)) ** .5)  # five standard deviations below a link's expectation

    def across(now: DataFrame) -> DataFrame:
        chunks = F.ceil(F.count("*").over(Window.partitionBy("bucket")) / CHUNK).cast("long")
        dealt = now.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks"))) \
            .withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)"))) \
            .select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "trait", "c").join(marks, "id")
        return dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(_alike(percent, bands, least), "a long, b long")

    # a link needs the smaller set to have at least `percent` of the larger
    groups = linked_groups(members, lambda p, q: (100 * F.least(p, q) >= percent * F.greatest(p, q)), verify, across)
    ids = signed.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("id"))
    of = ids.join(groups, "id", "left").select(*same, F.coalesce("component", "id").alias("component"))
    # rows of one id but different texts count as one document
    found = signed.drop("bands", "sketch").join(of, same, "left").withColumn("component", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85, 5)
