"""Operator 12, tokens of two tokenizers aligned by pointer jumping, and how often each pair of ids is linked in the corpus.

Both tokenizers cut the same bytes. Every token points to the farthest-right token that overlaps it, a last one to itself; doubling all
pointers of a slice of texts until none moves leads each token to the last one of its component, which names its group. Texts go in slices cut at
places that no token of either side can span, so a long text is never held as tokens. The words between such places are encoded once and
remembered by a Python worker, for its later tasks as well; so are pre-tokens.

A block of documents (some 16 MB) keeps its links and counts its own distinct pairs; pairs are then counted over all blocks, and every block
gets back the counts of its own pairs. So a pair that is in every text crosses the network once a block.
"""
from __future__ import annotations

import json
import re
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import freeze
from .blocks import with_carried
from .tokencount import ASCII_PATTERN, WIDEST, Counter, Vocabulary, byte_letters

SEGMENT, SLICE, BLOCK = 1 << 16, 1 << 19, 16 << 20  # characters, characters and bytes
WORDS = 200_000  # words of the sentencepiece side kept for the next text
#: A blank behind a sign that is none, with something after it: byte-level pre-tokens end there, and no piece goes on over it.
CUT = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
FOUND = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups string, links binary, pairs array<long>, times array<long>"
SCHEMA = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
                    ("groups", pa.string()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


class Ids(Counter):
    """The token ids of a pre-token, merged once and remembered."""

    def __init__(self, vocabulary: Vocabulary, spelled: list[bytes]) -> None:
        super().__init__(vocabulary)
        self.clear()
        self.ascii = re.compile(ASCII_PATTERN)
        self.spelled, self.exact = spelled, True  # bytes of each id; did every pre-token so far come back as it was?

    def made(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        ids = tuple([t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.letters))])
        self.exact = self.exact and b"".join(map(self.spelled.__getitem__, ids)) == raw
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a text in which special strings are plain text; none if their bytes are not those of the text."""
        if not text.isascii() and not self.unsure.isdisjoint(text):  # the library's own split
            ids, checked = [t.id for piece, _ in self.splitter.pre_tokenize_str(text) for t in self.model.tokenize(piece)], False
        else:
            ids = list(chain.from_iterable(map(self.__getitem__, (self.ascii if text.isascii() else self.pattern).findall(text))))
            checked = self.exact
        return ids if checked or b"".join(map(self.spelled.__getitem__, ids)) == text.encode() else []


class Pieces(dict):
    """The token ids of a word between two places where a sentencepiece model can be cut, found once and remembered."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, spelled: list[bytes], cuts: bool) -> None:
        super().__init__()
        self.model, self.spelled, self.cuts = model, spelled, cuts
        self.odd: set[str] = set()  # words whose tokens spell something else

    def spell(self, ids) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; none if their bytes are not those of space + text."""
        words = [CUT.split(t) if self.cuts else [t] for t in texts]
        new = list(set(chain.from_iterable(words)).difference(self))
        for word, ids in zip(new, self.model.encode(new, num_threads=1)):
            self[word] = tuple(ids)
            if self.spell(ids) != b" " + word.encode():
                self.odd.add(word)
        out = []
        for text, own in zip(texts, words):
            ids = list(chain.from_iterable(map(self.__getitem__, own)))
            out.append(ids if self.odd.isdisjoint(own) or self.spell(ids) == b" " + text.encode() else [])
        for word in reversed(new):
            if len(word) > WIDEST or len(self) > WORDS:
                del self[word]
                self.odd.discard(word)
        return out


class Tokenizers:
    """A byte-level BPE file (A) and a sentencepiece model (B), with the bytes of each of their tokens."""

    def __init__(self, vocabulary: Vocabulary, b: bytes) -> None:
        a = vocabulary.definition
        whole = Tokenizer.from_str(a)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of = {c: i for i, c in enumerate(byte_letters())}
        added = {t["content"] for t in json.loads(a).get("added_tokens") or []}
        vocab = whole.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, number in vocab.items():
            self.bytes_a[number] = entry.encode() if entry in added else bytes(of[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.width = len(pieces)
        self.ids_a, self.ids_b = Ids(vocabulary, self.bytes_a), Pieces(self.b, self.bytes_b, self.cuts)

    def segments(self, text: str) -> list[str]:
        """Space + text in pieces that begin with a space, at which both tokenizations can be cut."""
        spaced, at, out = " " + text, 0, []
        while self.cuts and len(spaced) - at > SEGMENT:
            m = CUT.search(spaced, at + SEGMENT)
            if not m:
                break
            out.append(spaced[at:m.start()])
            at = m.start()
        return [*out, spaced[at:]]

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides; empty ones where either side's bytes are not those of the segment."""
        a, b = [self.ids_a.encode(s) for s in segments], self.ids_b.encode([s[1:] for s in segments])
        for i in range(len(segments)):
            if not a[i] or not b[i]:
                a[i], b[i] = [], []
        return a, b


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """For each token, A before B, the last token of its component. Ends ascend and both sides end together."""
    n = len(end_a)
    over_a = np.searchsorted(end_b, end_a)  # the B token that holds the last byte of an A token
    over_b = np.searchsorted(end_a, end_b)
    farther = end_b[over_a] > end_a
    jump = np.concatenate([np.where(farther, n + over_a, np.arange(n)), over_b])
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


class Digits:
    """Ids as decimal text with one byte after each, many at a time."""

    def __init__(self, size: int) -> None:
        text = [str(i).encode() for i in range(size)]
        self.room = len(text[-1]) + 1
        self.table = np.frombuffer(b"".join(t.ljust(self.room) for t in text), np.uint8).reshape(size, self.room)
        self.length = np.array([len(t) for t in text])

    def write(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and where each id begins (one more at the end)."""
        size = self.length[ids]
        out = self.table[ids]
        out[np.arange(len(ids)), size] = after
        keep = np.arange(self.room) <= size[:, None]
        return out[keep], np.concatenate([[0], np.cumsum(size + 1)])


def align(t: Tokenizers, digits: Digits, a: list[list[int]], b: list[list[int]]):
    """For each segment: number of groups, their text, and its links as A id * width of B + B id."""
    n = len(a)
    ids = [np.array([*chain.from_iterable(side)], np.int64) for side in (a, b)]
    first = [np.concatenate([[0], np.cumsum([len(s) for s in side])]) for side in (a, b)]
    ends = [np.cumsum(length[x]) for length, x in zip((t.length_a, t.length_b), ids)]
    if not len(ids[0]):
        return [0] * n, [b""] * n, [np.zeros(0, np.int64)] * n
    last = terminals(*ends)
    ending = np.zeros(len(ids[0]), bool)
    ending[last] = True  # A tokens, as those come before a B token that ends with them
    names, group = np.flatnonzero(ending), (np.cumsum(ending) - 1)[last]
    side = np.repeat([0, 1], [len(x) for x in ids])
    order = np.argsort(group * 2 + side, kind="stable")
    g, s = group[order], side[order]
    stop = np.append(g[1:] != g[:-1], True)
    turn = np.append(s[1:] != s[:-1], True)
    text, begin = digits.write(np.concatenate(ids)[order], np.where(stop, ord(";"), np.where(turn, ord("|"), ord(","))))
    border = first[0] + first[1]  # tokens of both sides before each segment
    raw, at = text.tobytes(), begin[border]
    upto = np.searchsorted(names, first[0])  # groups before each segment
    links = ids[0][names] * t.width + ids[1][np.searchsorted(ends[1], ends[0][names])]
    return np.diff(upto).tolist(), [raw[x:max(x, y - 1)] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], np.split(links, upto[1:-1])


_KEPT: dict[str, tuple[Tokenizers, Digits]] = {}


def kit(key: str, sent) -> tuple[Tokenizers, Digits]:
    """The tools for the files `sent`, named by `key`, kept by the Python worker for its next task with all merges it remembers."""
    if key not in _KEPT:
        _KEPT.clear()
        t = Tokenizers(*sent.value)
        _KEPT[key] = t, Digits(max(len(t.bytes_a), len(t.bytes_b)))
    return _KEPT[key]


def _look(sent, key: str, texts: bool, block: int):
    def run(batches):
        task = TaskContext.get().partitionId() << 32
        size, seq, tally = 0, 0, []

        def close():
            keys = np.concatenate([k for k, _ in tally])
            times = np.concatenate([c for _, c in tally])
            keys, back = np.unique(keys, return_inverse=True)
            return keys, np.bincount(back, times).astype(np.int64)

        for batch in batches:
            t, digits = kit(key, sent)
            kind = np.uint32 if len(t.bytes_a) * t.width < 1 << 32 else np.uint64
            ids, column, at = batch.column("doc_id").to_pylist(), batch.column("text"), 0
            while at < len(ids):
                cuts, room = [], 0  # segments of each document of a slice
                while at + len(cuts) < len(ids) and room < SLICE:
                    text = column[at + len(cuts)].as_py()
                    cuts.append(t.segments(text) if text else [])
                    room += len(text or "")
                done = []  # per segment
                flat = [s for c in cuts for s in c]
                low = 0
                while low < len(flat):
                    high, chars = low, 0
                    while high < len(flat) and chars < SLICE:
                        chars += len(flat[high])
                        high += 1
                    a, b = t.encode(flat[low:high])
                    done += zip(map(len, a), map(len, b), *align(t, digits, a, b))
                    low = high
                rows, next_ = [], 0
                for k, c in enumerate(cuts):
                    mine = done[next_:next_ + len(c)]
                    next_ += len(c)
                    if not all(x[0] for x in mine):  # the bytes of one segment differ, so those of the text do
                        mine = []
                    words = b";".join(x[3] for x in mine)
                    links = np.concatenate([x[4] for x in mine]) if mine else np.zeros(0, np.int64)
                    if len(links):
                        tally.append(np.unique(links, return_counts=True))
                    rows.append((task + seq, ids[at + k], sum(x[0] for x in mine), sum(x[1] for x in mine), sum(x[2] for x in mine), sha256(words).hexdigest() if mine else "",
                                 words.decode() if texts else None, links.astype(kind).tobytes(), None, None))
                if len(tally) > 1:
                    tally[:] = [close()]
                at += len(cuts)
                size += sum(len(s) for s in flat)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)
                if size >= block and tally:
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((task + seq, *[None] * 7, *tally[0]), SCHEMA)], schema=SCHEMA)
                    size, seq, tally = 0, seq + 1, []
        if tally:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((task + seq, *[None] * 7, *tally[0]), SCHEMA)], schema=SCHEMA)
    return run


def align_tokenizers(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", texts: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with `texts`, groups (`a1,a2|b1;a3|b2`).

    `a` is the file of a byte-level BPE, which gets space + text, `b` a sentencepiece model that adds that space itself; special
    strings are plain text. Offsets at which tokens of both sides end cut the tokens into groups; the two tokens that end there are a link. The
    count of an id pair is how many links of the corpus hold it; n_best is the number of a document's links whose count is the highest of
    their B id, ties included, count_sum the sum of the counts.

    NULL and empty texts, and texts whose tokens on either side do not spell space + text, have no tokens: zeros and ''. Very long texts are
    tokenized whole, a segment at a time; a stretch without blanks is one segment. Equal rows give equal results, in one row each, and each of them
    counts; an empty table gives no rows; other columns are not looked at.
    """
    with open(a, encoding="utf-8") as f, open(b, "rb") as g:
        files = Vocabulary(f.read()), g.read()
    own, _ = with_carried(docs, doc_id, text, None)
    sent = docs.sparkSession.sparkContext.broadcast(files)  # two vocabulary files, whatever the table
    key = sha256(files[0].definition.encode() + files[1]).hexdigest()
    own_kit = Tokenizers(*files)
    width, kind = own_kit.width, np.uint32 if len(own_kit.bytes_a) * own_kit.width < 1 << 32 else np.uint64
    found = freeze(own.mapInArrow(_look(sent, key, texts, block), FOUND))
    asked = found.where("pairs is not null").select(F.col("block").alias("of"), F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("of", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = asked.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair") % width)
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    known = counts.join(best, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.select("of", "pair").join(known, "pair")
    keep = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *(["groups"] if texts else [])]

    def weigh(rows: pa.Table, answer: pa.Table) -> pa.Table:
        pair, n, top = (answer[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        pair, n, top = pair[order], n[order], top[order]
        out = []
        for raw in rows["links"]:
            at = np.searchsorted(pair, np.frombuffer(raw.as_buffer(), kind).astype(np.int64))
            out.append((len(at), int(top[at].sum()), int(n[at].sum())))
        more = [pa.array(x, pa.int64()) for x in zip(*out)]
        return pa.table([*(rows[c] for c in keep), *more], [*keep, "n_links", "n_best", "count_sum"])

    plain = found.where("pairs is null").select("block", "links", *keep)
    schema = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string" + (", groups string" if texts else "") + ", n_links long, n_best long, count_sum long"
    return plain.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(weigh, schema)


def op12_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
