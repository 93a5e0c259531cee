"""Operator 11, token counts of a byte-level BPE, with a shortcut for pre-tokens that are one token.

A text is split into pre-tokens, which are merged each on their own. Most pre-tokens are vocabulary entries, but an entry need not come
out as one token: its merges may have been taken by others. So it is proved once, before any text is read, which entries do; those count
one without a merge, and only the other pre-tokens are merged. Counting is a map over whole texts, nothing is shuffled.
"""
from __future__ import annotations

import json
import sys
import unicodedata
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .blocks import with_carried

# Fixed value: the pre-tokens of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for texts of ASCII alone, in classes that need no Unicode tables.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
LONG = 1 << 20  # characters from which pre-tokens are not listed but read one by one
ROWS = 256  # texts held as Python strings at a time
REMEMBERED, WIDEST = 400_000, 64  # merged pre-tokens kept for the next text, and the longest of them


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself where it is printable, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    letters = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


def unsure_characters() -> str:
    """The code points whose kind (letter, number, other) has changed since Unicode 3.2: libraries with other tables may split there otherwise."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    now = dict.fromkeys(regex.findall(r"\p{L}", every), "L") | dict.fromkeys(regex.findall(r"\p{N}", every), "N")
    before = unicodedata.ucd_3_2_0.category
    return "".join(c for c in every if now.get(c, "") != (kind if (kind := before(c)[0]) in "LN" else ""))


class Vocabulary:
    """A byte-level BPE file, its special strings, and the pre-tokens proved to be one token."""

    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        splitter, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = spec["model"]["type"] == "BPE" and splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        if not plain or spec.get("normalizer") or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only byte-level BPE without a normaliser, a prefix space or special strings that take blanks")
        self.definition = definition
        self.specials = sorted((t["content"] for t in added), key=len, reverse=True)
        self.unsure = unsure_characters()
        self.whole = self._prove(spec["model"]["vocab"])

    def _prove(self, vocab: dict[str, int]) -> list[str]:
        """The entries that are texts and that the merges turn into themselves alone."""
        model, of = Tokenizer.from_str(self.definition).model, {c: b for b, c in enumerate(byte_letters())}
        proved = []
        for entry, number in vocab.items():
            if entry in self.specials or not all(c in of for c in entry):
                continue
            try:
                text = bytes(of[c] for c in entry).decode()
            except UnicodeDecodeError:
                continue  # a part of a character is never a whole pre-token
            if [t.id for t in model.tokenize(entry)] == [number]:
                proved.append(text)
        return proved


class Counter(dict):
    """Number of tokens of a pre-token: 1 for the proved ones, else by merging."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        tokenizer = Tokenizer.from_str(vocabulary.definition)
        self.model, self.splitter = tokenizer.model, tokenizer.pre_tokenizer
        self.most = len(self) + REMEMBERED
        self.letters = dict(enumerate(byte_letters()))
        self.pattern, self.unsure = regex.compile(PATTERN), frozenset(vocabulary.unsure)
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.specials))) if vocabulary.specials else None

    def made(self, piece: str) -> int:
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def __missing__(self, piece: str) -> int:
        made = self.made(piece)
        if len(piece) <= WIDEST and len(self) < self.most:
            self[piece] = made
        return made

    def _plain(self, text: str) -> int:
        if not text.isascii() and not self.unsure.isdisjoint(text):  # the library's own split
            return sum(len(self.model.tokenize(piece)) for piece, _ in self.splitter.pre_tokenize_str(text))
        if len(text) < LONG:
            return sum(map(self.__getitem__, self.pattern.findall(text)))
        return sum(self[m.group()] for m in self.pattern.finditer(text))

    def tokens(self, text: str) -> int:
        """Tokens of a whole text. A special string is one token and ends the text before it."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8) and n_tokens under the byte-level BPE in the file `tokenizer`, read on the driver.

    Tokens are those that the `tokenizers` library gives without added special tokens; special strings inside a text are one token. NULL
    and empty texts have none. Very long texts are counted whole, pre-token by pre-token; a single pre-token (a run of letters, of digits or of
    signs) is merged in one piece. Equal rows give equal results, in one row each; an empty table gives no rows; other columns are
    not looked at, those in `carry` come back as a struct `carried`.
    """
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = Vocabulary(f.read())
    own, along = with_carried(docs, doc_id, text, carry)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the size of the vocabulary, whatever the table

    def count(batches):
        counter = None
        for batch in batches:
            counter = counter or Counter(sent.value)
            texts, n = iter(batch.column("text")), []
            while some := list(islice(texts, ROWS)):
                n += [counter.tokens(t) if t else 0 for t in (x.as_py() for x in some)]
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            more = [c for c in batch.schema.names if c == "carried"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64()), *map(batch.column, more)], ["doc_id", "n_bytes", "n_tokens", *more])

    return own.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long" + along)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    found = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)
