"""Operator 6, benchmark decontamination with training suffix arrays.

Each shard of training text gets a suffix array over its words, ordered through the window's words. Every suffix of
every test item is looked up in it by binary search, all at once; what is found is checked on full word fingerprints,
and matches that go on are joined to the longest verbatim ones. The test items are the stated query set: they travel to
the shards in chunks of bounded size, so the training text itself is never shuffled.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textbytes as T

MATCH = "array<struct<item_id:string,item_start:long,start:long,length:long>>"
FOUND = f"doc_id long, text string, n_words long, hits array<struct<start:long,end:long>>, items array<string>, matches {MATCH}"
SHARD = 3 << 20  # bytes of text of one suffix array
TESTS = 8 << 20  # bytes of test items that travel together
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ITEMS = pa.list_(pa.string())
MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
PARTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("hits", SPANS), ("items", ITEMS), ("matches", MATCHES)])


def _codes(words: np.ndarray) -> np.ndarray:
    """16 bits a word for ordering, never 0 (0 stands behind the last word)."""
    return np.maximum(words >> T.U(48), T.U(1))


def _digits(codes: np.ndarray, last: np.ndarray, width: int) -> list[np.ndarray]:
    """The first `width` codes from every position, four to a digit, with zeros behind the document's (item's) last word."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(width, T.U)])
    place = np.arange(n)
    out = []
    for k in range(0, width, 4):
        digit = np.zeros(n, T.U)
        for j in range(k, k + 4):
            digit <<= T.U(16)
            if j < width:
                digit |= np.where(place + j < last, padded[j:j + n], T.U(0))
        out.append(digit)
    return out


class TestItems:
    """Words of the items and the distinct windows to look up: all windows of `width` words, whole items where shorter."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int):
        data, offsets = T.batch_of(pa.array(texts, pa.string()))
        data = T.lower(data)
        start, end, first = T.words(data, offsets, T.LETTERS_AND_DIGITS)
        self.ids, self.width = ids, width
        self.words = T.fingerprints(data, start, end)
        many = np.diff(first)
        at, _ = T.window_starts(first, width)
        short = np.flatnonzero((many > 0) & (many < width))
        self.at = np.concatenate([at, first[:-1][short]])
        self.length = np.concatenate([np.full(len(at), width), many[short]])
        self.item = np.searchsorted(first, self.at, "right") - 1
        self.begin = first[:-1][self.item]
        self.full = np.concatenate([np.full(len(at), True), np.full(len(short), False)])
        # one lookup for equal windows, however many items have them
        same = T.mix(self.length.astype(T.U))
        wide = np.concatenate([self.words, np.zeros(width, T.U)])
        for j in range(width):
            same = np.where(j < self.length, T.mix(same ^ wide[self.at + j]) + T.U(j), same)
        _, lead, self.group = np.unique(same, return_index=True, return_inverse=True)
        self.lead = lead
        order = np.argsort(self.group, kind="stable")
        self.members, self.edge = order, np.searchsorted(self.group[order], np.arange(len(lead) + 1))
        codes = _digits(_codes(self.words), np.full(len(self.words), len(self.words)), width)
        low, high = [], []
        for k, digit in enumerate(codes):
            left = np.clip(self.length[lead] - 4 * k, 0, 4)  # codes of this digit that the window has
            mask = np.where(left == 0, T.U(0), ~T.U(0) << ((4 - np.maximum(left, 1)) * 16).astype(T.U))
            low.append(digit[self.at[lead]] & mask)
            high.append(digit[self.at[lead]] & mask | ~mask)
        self.low, self.high = low, high


def _search(ordered: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of all wanted keys at once in suffixes ordered by several digits."""
    n = len(ordered[0])
    lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n)
    for _ in range(int(n).bit_length()):
        mid = np.minimum((lo + hi) >> 1, n - 1)
        less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for o, w in zip(ordered, wanted):
            have = o[mid]
            less |= equal & (have < w)
            equal &= have == w
        go = (less | equal if right else less) & (lo < hi)
        lo, hi = np.where(go, mid + 1, lo), np.where(go, hi, np.minimum(hi, np.maximum(mid, lo)))
    return lo


def _shard(tests: TestItems, earlier: pa.Array | None, data: np.ndarray, offsets: np.ndarray):
    """n_words, hits (those of earlier passes included), items and matches of each document of a shard."""
    data = T.lower(data)
    start, end, first = T.words(data, offsets, T.LETTERS_AND_DIGITS)
    words, n = T.fingerprints(data, start, end), len(offsets) - 1
    many = np.diff(first)
    found = [np.zeros(0, np.int64)] * 2
    if len(words) and len(tests.lead):
        digits = _digits(_codes(words), np.repeat(first[1:], many), tests.width)
        order = np.argsort(digits[0], kind="stable")
        tie = digits[0][order]
        same = tie[1:] == tie[:-1]
        open_ = np.zeros(len(order), bool)
        open_[1:] |= same
        open_[:-1] |= same
        live = np.flatnonzero(open_)  # suffixes that the first digit leaves undecided
        order[live] = order[live][np.lexsort([d[order[live]] for d in reversed(digits)])]
        ordered = [d[order] for d in digits]
        a, b = _search(ordered, tests.low, False), _search(ordered, tests.high, True)
        count = np.maximum(b - a, 0)
        window = np.repeat(np.arange(len(count)), count)
        place = order[np.arange(count.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count)]
        right = np.ones(len(window), bool)
        at, length = tests.at[tests.lead[window]], tests.length[tests.lead[window]]
        doc_end = np.repeat(first[1:], many)[place]
        for j in range(tests.width):
            need = np.flatnonzero((j < length) & right)
            inside = place[need] + j < doc_end[need]
            right[need] &= inside & (words[np.minimum(place[need] + j, len(words) - 1)] == tests.words[np.minimum(at[need] + j, len(tests.words) - 1)])
        found = [window[right], place[right]]
    window, place = found
    length = tests.length[tests.lead[window]]
    edges = np.zeros(len(words) + 1, np.int32)
    np.add.at(edges, place, 1)
    np.add.at(edges, place + length, -1)
    if earlier is not None:
        spans = earlier.flatten()
        shift = np.repeat(first[:-1], np.diff(earlier.offsets.to_numpy()))
        np.add.at(edges, spans.field("start").to_numpy() + shift, 1)
        np.add.at(edges, spans.field("end").to_numpy() + shift, -1)
    ra, rb, runs = B.runs(np.cumsum(edges[:-1]) > 0, first)
    # every item with this window
    size = np.diff(tests.edge)[window]
    member = tests.members[np.arange(size.sum()) + np.repeat(tests.edge[:-1][window] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)]
    place = np.repeat(place, size)
    item, own = tests.item[member], tests.at[member] - tests.begin[member]
    doc = np.searchsorted(first, place, "right") - 1
    # windows that follow each other on one diagonal are one longer match
    order = np.lexsort((place, place - own, item, doc))
    item, own, place, doc, full, last = item[order], own[order], place[order], doc[order], tests.full[member[order]], tests.length[member[order]]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(place - own) != 0) | (np.diff(place) != 1) | ~full[1:]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(order)) - 1 if len(head) else head
    total = place[tail] - place[head] + last[tail] if len(head) else head
    pairs = np.unique(np.stack([doc, item]), axis=1) if len(doc) else np.zeros((2, 0), np.int64)
    names = np.array(tests.ids, object)
    matches = pa.StructArray.from_arrays([pa.array(names[item[head]].tolist(), pa.string()), pa.array(own[head]), pa.array(place[head] - first[doc[head]]), pa.array(total)],
                                         ["item_id", "item_start", "start", "length"])
    return [pa.array(many.astype(np.int64)), B.span_lists(ra, rb, runs, first[:-1]),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[0], np.arange(n + 1)).astype(np.int32)), pa.array(names[pairs[1]].tolist(), pa.string())),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[head], np.arange(n + 1)).astype(np.int32)), matches)]


def _chunks(tests: DataFrame):
    """Test items in runs of at most TESTS bytes (or one longer item), read from Spark one partition at a time."""
    ids, texts, size = [], [], 0
    for row in tests.toLocalIterator():
        new = len(row.text.encode()) if row.text else 0
        if ids and size + new > TESTS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += new
    yield ids, texts


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: n_words, n_hit, hit word intervals, items found (as strings), longest verbatim matches.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased. A window is `width`
    consecutive words of an item, or the whole item where it has fewer (not none). Words of a document inside an
    occurrence of a window are hit. A match has the item, where it begins in item and document, and its length in words.
    NULL and empty texts have no words; items without id are skipped, rows of one id are one item; an empty table gives no rows; equal rows give equal results, in one row each;
    other columns are not looked at; those in `carry` come back as a struct `carried`. One pass over the documents for each TESTS bytes of items.
    """
    own, along = B.with_carried(docs, doc_id, text, carry)
    asked = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null")
    chunks = _chunks(asked)
    found, chunk = own, next(chunks)
    while chunk is not None:
        after = next(chunks, None)
        sent = docs.sparkSession.sparkContext.broadcast(chunk)  # at most TESTS bytes and one item

        def look(batches, sent=sent, keep=after is not None):
            tests = TestItems(*sent.value, width)
            for batch in batches:
                data, offsets = T.batch_of(batch.column("text"))
                hits = batch.column("hits") if "hits" in batch.schema.names else None
                for a, b in T.slices(offsets, SHARD):
                    got = _shard(tests, None if hits is None else hits.slice(a, b - a), data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                    text_column = batch.column("text").slice(a, b - a) if keep else pa.nulls(b - a, pa.string())
                    more = [c for c in ("items_before", "matches_before", "carried") if c in batch.schema.names]
                    columns = [batch.column("doc_id").slice(a, b - a), text_column, *got, *(batch.column(c).slice(a, b - a) for c in more)]
                    yield pa.RecordBatch.from_arrays(columns, [*PARTS.names, *more])

        again = "hits" in found.columns
        before = found.withColumnsRenamed({"items": "items_before", "matches": "matches_before"})
        found = before.mapInArrow(look, FOUND + (f", items_before array<string>, matches_before {MATCH}" if again else "") + along)
        if again:
            found = found.select("doc_id", "text", "n_words", "hits", F.array_union("items_before", "items").alias("items"),
                                 F.concat("matches_before", "matches").alias("matches"), *(["carried"] if along else []))
        chunk = after
    spans = F.aggregate("hits", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select("doc_id", "n_words", spans.alias("n_hit"), "hits", F.array_distinct("items").alias("items"), F.array_distinct("matches").alias("matches"), (F.size("hits") > 0).alias("contaminated"), *(["carried"] if along else []))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "contaminated")
