"""Documents in blocks, and questions that blocks ask each other about fingerprints.

A block is a set of documents chosen by hash; all work on texts is done a block at a time, so memory is bounded by
the block and not by the table. Texts cross the network once: every step over the same blocked frame reuses that
exchange. What blocks ask (is this fingerprint also elsewhere?) travels as sorted arrays of bare numbers, one row per
(block, bucket), and the answers come back as one bit each.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as T

ASK = "block long, bucket long, keys binary"
ANSWER = "block long, bucket long, bits binary"
SLICE = 2 << 20  # bytes of text handled at once inside a task


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one aggregate, used to size blocks and buckets only."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("n")).first()["n"]


def blocks_for(total: int, least: int = 4 << 20, most: int = 64 << 20) -> int:
    """How many blocks: they start at `least` bytes and grow with the square root of the data, so that the number of
    (block, bucket) rows stays in proportion to it, up to `most` bytes of text that a task holds at a time."""
    size = min(most, max(least, int((total * 16) ** 0.5)))
    return max(1, -(-total // size))


def blocked(docs: DataFrame, blocks: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, doc_id, text) dealt by block. Copies and NULL ids spread too, as the hash covers id and text."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text").repartition("block")


def with_carried(docs: DataFrame, doc_id: str, text: str, carry: list[str] | None) -> tuple[DataFrame, str]:
    """(doc_id, text) and, if asked for, the columns in `carry` as a struct that goes along; and how a schema text names it."""
    own = [F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")]
    if not carry:
        return docs.select(*own), ""
    out = docs.select(*own, F.struct(*carry).alias("carried"))
    return out, f", carried {out.schema['carried'].dataType.simpleString()}"


def in_order(table: pa.Table) -> pa.Table:
    """The block's rows in one fixed order, whatever order the network brought them in. Rows that tie are equal."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def pieces(table: pa.Table, most: int = SLICE):
    """(first row, last row + 1, bytes, borders) of runs of rows with about `most` bytes of text."""
    data, offsets = T.batch_of(table["text"])
    for a, b in T.slices(offsets, most):
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def bucketed(block: int, keys: np.ndarray, buckets: np.ndarray, count: int, dtype) -> dict:
    """Rows to ask with: the distinct keys of each bucket, ascending."""
    order = np.lexsort((keys, buckets))
    keys, buckets = keys[order], buckets[order]
    edge = np.searchsorted(buckets, np.arange(count + 1, dtype=buckets.dtype))
    used = np.flatnonzero(np.diff(edge))
    return {"block": np.full(len(used), block, np.int64), "bucket": used.astype(np.int64),
            "keys": [keys[edge[i]:edge[i + 1]].astype(dtype).tobytes() for i in used]}


def _answer(width: int):
    dtype = {4: np.uint32, 8: np.uint64}[width]

    def run(table):
        raw = [np.frombuffer(x.as_buffer(), dtype) for x in table["keys"].combine_chunks()]
        lengths = np.array([len(x) for x in raw])
        keys = np.concatenate(raw)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(keys), bool)
        twice[1:] |= same
        twice[:-1] |= same
        seen = np.empty(len(keys), bool)
        seen[order] = twice
        bits = [np.packbits(x).tobytes() for x in np.split(seen, np.cumsum(lengths)[:-1])]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})
    return run


def in_other_blocks(asked: DataFrame, width: int) -> DataFrame:
    """For each asked key of `width` bytes, whether another block asks for it too. A block asks once for a key, so a
    key of a third of all documents costs its bucket one entry per block."""
    return asked.groupBy("bucket").applyInArrow(_answer(width), ANSWER)


def answers(table: pa.Table, count: int, edge: np.ndarray) -> np.ndarray:
    """The answer bits of a block put back behind its keys sorted by (bucket, key); edge: where each bucket begins."""
    seen = np.zeros(edge[-1], bool)
    for bucket, bits in zip(table["bucket"].to_pylist(), table["bits"].combine_chunks()):
        a, b = edge[bucket], edge[bucket + 1]
        seen[a:b] = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=b - a).astype(bool)
    return seen


def seen_keys(keys: np.ndarray, buckets: np.ndarray, count: int, found: pa.Table) -> np.ndarray:
    """For each key of the block, repeats included: is it also in another block, or more than once in this one?"""
    order = np.lexsort((keys, buckets))
    k, b = keys[order], buckets[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    edge = np.searchsorted(b[new], np.arange(count + 1, dtype=b.dtype))
    hit = answers(found, count, edge) | (np.bincount(group, minlength=int(new.sum())) > 1)
    out = np.empty(len(keys), bool)
    out[order] = hit[group]
    return out


def distinct(keys: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, buckets))
    k, b = keys[order], buckets[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
    return k[new], b[new]


def cut_out(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept bytes and the new borders."""
    before = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], before[offsets]


def runs(mask: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True inside each document: (start, end, number of runs before each document)."""
    start, end = mask.copy(), mask.copy()
    start[1:] &= ~mask[:-1]
    end[:-1] &= ~mask[1:]
    full = borders[:-1] < borders[1:]
    at, last = borders[:-1][full], borders[1:][full] - 1
    start[at], end[last] = mask[at], mask[last]
    a = np.flatnonzero(start)
    return a, np.flatnonzero(end) + 1, np.searchsorted(a, borders)


def span_lists(start: np.ndarray, end: np.ndarray, before: np.ndarray, base: np.ndarray) -> pa.Array:
    """Runs as a list of (start, end) per document, counted from the document's own beginning."""
    shift = np.repeat(base, np.diff(before))
    spans = pa.StructArray.from_arrays([pa.array((start - shift).astype(np.int64)), pa.array((end - shift).astype(np.int64))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), spans)


def binaries(data: np.ndarray, offsets: np.ndarray, kind=pa.binary()) -> pa.Array:
    raw = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1,
                                [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return raw.cast(kind)
