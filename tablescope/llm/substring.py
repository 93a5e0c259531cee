"""Operator 1, substring dedup: Rabin-Karp fingerprints of every window of `width` words, counted over all documents;
repeated windows merge into maximal intervals of words to remove."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textbytes as T

RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def _windows(table: pa.Table, width: int, buckets: int):
    """All windows of the block: fingerprint and bucket. The bucket comes from a second polynomial, over words hashed once more, so a match
    means 64 equal bits and an equal bucket of another hash. Buckets grow with the data: the chance that any two different windows match rises
    in proportion to it (2e-4 at 30 GB), not with its square."""
    found, second = [], []
    for a, b, data, offsets in B.pieces(table):
        start, end, first = T.words(data, offsets, T.SPACED)
        at, before = T.window_starts(first, width)
        words = T.fingerprints(data, start, end)
        value, other = (T.rolling(w, width)[at] if len(at) else np.zeros(0, T.U) for w in (words, T.mix(words ^ T.U(0xA5A5A5A5A5A5A5A5))))
        second.append(other % T.U(buckets))
        found.append((value, a, b, data, offsets, start, end, first, at))
    if not found:
        return found, np.zeros(0, T.U), np.zeros(0, np.int64)
    return found, np.concatenate([f[0] for f in found]), np.concatenate(second).astype(np.int64)


def remove_repeats(docs: DataFrame, width: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, removed words, removed word intervals and the kept words joined by one space.

    Words are maximal runs without space or U+0009-U+000D, unchanged. A word goes if it lies in a window of `width`
    words of one document whose word sequence starts anywhere else too, in the same document or another; windows are
    judged on the input. NULL and empty texts have no words (kept is ''); a document with fewer words than `width` is
    kept whole; very long texts are read whole; an empty table gives no rows; equal rows count as repeats of each other; a NULL id stays NULL; other columns are not looked at.
    """
    total = B.text_bytes(docs, text)
    n = B.blocks_for(total)
    buckets = max(1, -(-total // (16 << 20)) * 2)  # about 1.5 bytes of fingerprints per byte of text: 12 MB a bucket
    spread = B.blocked(docs, n, doc_id, text)

    def ask(key, table):
        _, keys, of = _windows(B.in_order(table), width, buckets)
        keys, of = B.distinct(keys, of)
        return pa.table(B.bucketed(key[0].as_py(), keys, of, buckets, np.uint64), pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary())]))

    def apply(key, table, found):
        table = B.in_order(table)
        parts, keys, of = _windows(table, width, buckets)
        hit = B.seen_keys(keys, of, buckets, found)
        out, done = [], 0
        for value, a, b, data, offsets, start, end, first, at in parts:
            gone = T.covered(at[hit[done:done + len(value)]], width, len(start))
            done += len(value)
            kept = ~gone
            # each kept word with one more byte behind it, which becomes the space
            s, length = start[kept], (end - start)[kept] + 1
            stop = np.cumsum(length)
            pick = np.arange(stop[-1] if len(stop) else 0) + np.repeat(s - (stop - length), length)
            padded = np.append(data, np.uint8(32))
            joined = padded[pick]
            joined[stop - 1] = 32
            count = np.concatenate([[0], np.cumsum(kept)])[first]  # kept words before each document
            border = np.concatenate([[0], stop])[count]
            last = np.zeros(len(joined), bool)
            last[border[1:][np.diff(border) > 0] - 1] = True  # the space behind a document's last word
            text_out, cut = B.cut_out(joined, border, ~last)
            ra, rb, runs = B.runs(gone, first)
            out.append(pa.table({
                "doc_id": table["doc_id"].slice(a, b - a), "n_words": pa.array(np.diff(first).astype(np.int64)),
                "n_removed": pa.array(np.diff(first) - np.diff(count)), "spans": B.span_lists(ra, rb, runs, first[:-1]),
                "kept": B.binaries(text_out, cut, pa.string())}))
        return pa.concat_tables(out)

    seen = B.in_other_blocks(spread.groupBy("block").applyInArrow(ask, B.ASK), 8)
    return spread.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(apply, RESULT)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
