"""Operator 3, suffix-array dedup by depth-limited radix sort.

Suffixes are ordered only through `depth` bytes, most significant digit first, and equal groups are the repeated
windows. The first digit is a gram of `gram` bytes: each window of `depth` bytes owns the smallest-hashed gram inside
it, so equal windows own equal grams at equal places, and only about one position in twenty is an anchor. Pass one
deals the anchors' first digits over the cluster and drops the groups of one. Pass two deals what is left with the
bytes around it; each bucket sorts suffixes right and reversed prefixes left of the anchors by digits of eight bytes.
Two windows of one anchor are equal exactly if their left and right parts fall into the same groups at the depths
they need. These comparisons are on the bytes themselves.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textbytes as T

RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
CONTEXT = "block long, bucket long, payload binary"
CONTEXTS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary())])
NULL_ID = np.iinfo(np.int64).max  # a document without id counts as the last one


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of values[i : i + span] for every i."""
    have = 1
    while have < span:
        step = min(have, span - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


class Anchors:
    """The anchors of one block: for each, its place, the range of window starts it owns, and its document."""

    def __init__(self, table: pa.Table, depth: int, gram: int, buckets: int):
        self.data, self.offsets = T.batch_of(table["text"])
        self.ids = table["doc_id"].combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        span = depth - gram + 1
        at, first, last, keys = [], [], [], []
        for a, b in T.slices(self.offsets, B.SLICE):
            base = self.offsets[a]
            data, offsets = self.data[base:self.offsets[b]], self.offsets[a:b + 1] - base
            starts, _ = T.window_starts(offsets, depth)
            if not len(starts):
                continue
            # the low bits tell the place: of equal grams in a window the leftmost counts, which is the same in all equal windows
            hashed = T.rolling(data.astype(T.U), gram)
            low = T.U(0xFFFFFF)
            least = _least((hashed & ~low) | (np.arange(len(hashed), dtype=T.U) & low), span)[starts]
            place = (least & low).astype(np.int64)
            place += (starts >> 24) << 24  # a single text may be longer than 16 MB
            place[place < starts] += 1 << 24
            new = np.ones(len(starts), bool)
            new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
            cut = np.flatnonzero(new)
            at.append(place[cut] + base)
            first.append(starts[cut] + base)
            last.append(starts[np.append(cut[1:], len(starts)) - 1] + base)
            keys.append(hashed[place[cut]])
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.at, self.first, self.last, self.hash = join(at, np.int64), join(first, np.int64), join(last, np.int64), join(keys, T.U)
        self.bucket = (T.mix(self.hash) % T.U(buckets)).astype(np.int64)
        self.digit = (self.hash >> T.U(32)).astype(np.uint32)  # pass one only drops, so 32 bits and the bucket will do
        self.doc = np.searchsorted(self.offsets, self.at, "right") - 1
        self.wide = 2 * depth - gram
        self.reach = depth - gram  # bytes wanted left and right of the gram

    def context(self, pick: np.ndarray) -> np.ndarray:
        """The bytes around the picked anchors, one row each; bytes that none of the anchor's windows needs are zero."""
        place = self.at[pick, None] + np.arange(-self.reach, self.wide - self.reach)
        inside = (place >= self.first[pick, None]) & (place < (self.last[pick] + self.wide - self.reach)[:, None])
        return np.where(inside, self.data[np.clip(place, 0, len(self.data) - 1)], 0).astype(np.uint8)


def _digits(rows: np.ndarray) -> list[np.ndarray]:
    wide = -rows.shape[1] % 8
    padded = np.pad(rows, ((0, 0), (0, wide)))
    return list(np.ascontiguousarray(padded).view(">u8").astype(T.U).T)


def _radix(group: np.ndarray, digits: list[np.ndarray]) -> np.ndarray:
    """Most-significant-digit order: every pass sorts only the groups that are still undecided."""
    order = np.argsort(group, kind="stable")
    now = group[order].astype(np.int64)
    for digit in digits:
        same = now[1:] == now[:-1]
        open_ = np.zeros(len(now), bool)
        open_[1:] |= same
        open_[:-1] |= same
        live = np.flatnonzero(open_)
        if not len(live):
            break
        own = digit[order[live]]
        again = np.lexsort((own, now[live]))
        order[live] = order[live][again]
        own, kept = own[again], now[live][again]
        new = np.ones(len(live), bool)
        new[1:] = (own[1:] != own[:-1]) | (kept[1:] != kept[:-1])
        # a group's number is the position of its first suffix, so numbers stay in order
        now[live] = live[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return order


def _classes(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The radix order and, for each suffix but the first, how many leading bytes it shares with the one before (-1 in another group)."""
    order = _radix(group, _digits(rows))
    ranked, g = rows[order], group[order]
    shared = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        differ = ranked[1:] != ranked[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        shared[1:][g[1:] != g[:-1]] = -1
    return order, shared


def _number(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def _earlier(context: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, depth: int, gram: int) -> np.ndarray:
    """(n, reach + 1) flags: the window that starts `o` bytes before the anchor also starts in a document with a smaller id."""
    reach = depth - gram
    grams = _classes(context[:, reach:reach + gram], np.zeros(len(context), np.int64))
    group = _number(*grams, gram)
    right = _classes(context[:, reach + gram:], group)
    left = _classes(context[:, :reach][:, ::-1], group)
    out = np.zeros((len(context), reach + 1), bool)
    for o in range(reach + 1):
        own = np.flatnonzero((low <= o) & (o <= high))
        if len(own) < 2:
            continue
        key = _number(*left, o)[own] * np.int64(len(context) + 1) + _number(*right, reach - o)[own]
        order = np.lexsort((doc[own], key))
        k, d = key[order], doc[own][order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        out[own[order], o] = d > d[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


def _packed(a: Anchors, pick: np.ndarray, depth: int) -> bytes:
    head = np.array([len(pick)], np.int64).tobytes()
    span = np.stack([a.at[pick] - a.last[pick], a.at[pick] - a.first[pick]]).astype(np.uint8)
    return zstandard.ZstdCompressor(1).compress(head + a.ids[a.doc[pick]].tobytes() + span.tobytes() + a.context(pick).tobytes())


def _unpacked(raw: bytes, wide: int):
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    span = np.frombuffer(raw, np.uint8, 2 * n, 8 + 8 * n).reshape(2, n)
    return np.frombuffer(raw, np.int64, n, 8), span[0], span[1], np.frombuffer(raw, np.uint8, n * wide, 8 + 10 * n).reshape(n, wide)


def _asked(a: Anchors, seen: np.ndarray):
    """Anchors to ask for, by bucket. Of equal ones of the block only that of the smallest document asks: `same` has for each
    anchor the one that asks in its place. Equality is checked on the bytes."""
    live = np.flatnonzero(seen)
    mark = T.mix(a.hash[live] ^ T.mix((a.at - a.first)[live].astype(T.U) * T.U(257) + (a.at - a.last)[live].astype(T.U)))
    wide = np.zeros(len(live), T.U)
    step = 1 << 16
    for i in range(0, len(live), step):
        for k, digit in enumerate(_digits(a.context(live[i:i + step]))):
            wide[i:i + step] = T.mix(wide[i:i + step] ^ digit) + T.U(k)
    mark = T.mix(mark ^ wide)
    order = np.lexsort((a.ids[a.doc[live]], mark))
    m = mark[order]
    new = np.ones(len(m), bool)
    new[1:] = m[1:] != m[:-1]
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    for i in range(0, len(order), step):
        o, l = live[order[i:i + step]], live[lead[i:i + step]]
        equal = (a.context(o) == a.context(l)).all(1) & (a.at[o] - a.first[o] == a.at[l] - a.first[l]) & (a.at[o] - a.last[o] == a.at[l] - a.last[l])
        lead[i:i + step] = np.where(equal, lead[i:i + step], order[i:i + step])
    same = np.empty(len(live), np.int64)
    same[order] = lead
    asks = np.flatnonzero(same == np.arange(len(live)))
    asks = asks[np.argsort(a.bucket[live[asks]], kind="stable")]
    slot = np.full(len(live), -1, np.int64)
    slot[asks] = np.arange(len(asks))
    return live, live[asks], slot[same], asks[slot[same]]


def remove_copied_bytes(docs: DataFrame, depth: int = 50, gram: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: bytes, removed bytes, removed byte intervals and the remaining bytes.

    A byte of the UTF-8 text goes if it is covered by a string of `depth` bytes that also starts in a document with a
    smaller id; matches never cross documents and are judged on the input. NULL and empty texts have no bytes, shorter
    texts than `depth` stay whole, rows with one id never remove from each other (so equal rows stay), a NULL id comes
    last, other columns are not looked at.
    """
    total = B.text_bytes(docs, text)
    n = B.blocks_for(total)
    buckets = max(1, -(-total // (4 << 20)))  # about 1 byte of contexts per byte of text
    wide = 2 * depth - gram
    spread = B.blocked(docs, n, doc_id, text)

    def ask(key, table):
        a = Anchors(B.in_order(table), depth, gram, buckets)
        keys, of = B.distinct(a.digit, a.bucket)
        return pa.table(B.bucketed(key[0].as_py(), keys, of, buckets, np.uint32), pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary())]))

    def show(key, table, found):
        a = Anchors(B.in_order(table), depth, gram, buckets)
        seen = B.seen_keys(a.digit, a.bucket, buckets, found)
        _, asks, _, _ = _asked(a, seen)
        edge = np.searchsorted(a.bucket[asks], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(edge))
        # `seen` goes along, so that the last step need not ask again
        rows = [_packed(a, asks[edge[i]:edge[i + 1]], depth) for i in used]
        return pa.table({"block": [key[0].as_py()] * (len(used) + 1), "bucket": [*used.tolist(), -1 - key[0].as_py()],
                         "payload": [*rows, np.packbits(seen).tobytes()]}, CONTEXTS)

    def sort(key, table):
        if key[0].as_py() < 0:
            return table.select(CONTEXTS.names)
        parts = [_unpacked(x.as_py(), wide) for x in table["payload"].combine_chunks()]
        doc, low, high, context = (np.concatenate(x) for x in zip(*parts))
        hit = _earlier(context, low, high, doc, depth, gram)
        cut = np.cumsum([len(p[0]) for p in parts])[:-1]
        return pa.table({"block": table["block"], "bucket": table["bucket"],
                         "payload": [zstandard.ZstdCompressor(1).compress(np.packbits(x, axis=1).tobytes()) for x in np.split(hit, cut)]}, CONTEXTS)

    def apply(key, table, found):
        table = B.in_order(table)
        a = Anchors(table, depth, gram, buckets)
        reach = depth - gram
        row = (reach + 8) // 8
        got = dict(zip(found["bucket"].to_pylist(), found["payload"].to_pylist()))
        seen = np.unpackbits(np.frombuffer(got.pop(-1 - key[0].as_py()), np.uint8), count=len(a.at)).astype(bool)
        live, asks, slot, leader = _asked(a, seen)
        bits = np.zeros((len(asks), row), np.uint8)
        edge = np.searchsorted(a.bucket[asks], np.arange(buckets + 1))
        for bucket, raw in got.items():
            x, y = edge[bucket], edge[bucket + 1]
            bits[x:y] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(-1, row)
        edges = np.zeros(len(a.data) + 1, np.int32)
        step = 1 << 16
        for i in range(0, len(live), step):
            own, lead = live[i:i + step], live[leader[i:i + step]]
            hit = np.unpackbits(bits[slot[i:i + step]], axis=1, count=reach + 1).astype(bool)
            hit |= (a.ids[a.doc[own]] > a.ids[a.doc[lead]])[:, None]
            o = np.arange(reach + 1)
            hit &= (o >= (a.at - a.last)[own, None]) & (o <= (a.at - a.first)[own, None])
            r, o = np.nonzero(hit)
            begin = a.at[own[r]] - o
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + depth, -1)
        gone = np.cumsum(edges[:-1]) > 0
        kept, border = B.cut_out(a.data, a.offsets, ~gone)
        ra, rb, runs = B.runs(gone, a.offsets)
        return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(np.diff(a.offsets)), "n_removed": pa.array(np.diff(a.offsets) - np.diff(border)),
                         "spans": B.span_lists(ra, rb, runs, a.offsets[:-1]), "kept": B.binaries(kept, border)})

    seen = B.in_other_blocks(spread.groupBy("block").applyInArrow(ask, B.ASK), 4)
    shown = spread.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(show, CONTEXT)
    sorted_ = shown.groupBy("bucket").applyInArrow(sort, CONTEXT)
    return spread.groupBy("block").cogroup(sorted_.groupBy("block")).applyInArrow(apply, RESULT)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_copied_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))
