"""Operators 11 and 12 against the tokenizer libraries and the definitions."""
import hashlib
import random
import re
import sys
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import regex
import sentencepiece
from tokenizers import Tokenizer

from tablescope.llm import alignment, tokencount

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n\n", " a", "a ", "it's  we'll\t\tend", "<|endoftext|>", "x <|endoftext|>  <|endoftext|>y", "naïve Ünïcode 日本語 ١٢٣ ½", "a b　c\x1cd\x00e", "🙂🙃 👩‍👩‍👧", "\U0001d4b3\U00010940 \U000323b0",
       "<s> </s> <unk> <0x41> ▁", "a▁b", "ﬁ Å é", "\r\n x\r", "a" * 300 + "1" * 50 + "!" * 70, "ꟑ Ꟶ ᲀ"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(BYTES, encoding="utf-8") as f:
        return tokencount.Vocabulary(f.read())


def sample():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    r = random.Random(3)
    letters = [chr(c) for c in [*range(9, 14), *range(32, 127), 0xA0, 0xE9, 0x3B1, 0x4E2D, 0x660, 0x2028, 0x1F600, 0x10940]]
    return [*texts, *ODD, *("".join(r.choices(letters, k=r.randrange(60))) for _ in range(400))]


def test_proof_of_whole_tokens(vocabulary):
    """The proved strings are those that the library gives one token for, whatever its pre-tokens."""
    library, of = Tokenizer.from_file(BYTES), {c: b for b, c in enumerate(tokencount.byte_letters())}
    proved = set(vocabulary.whole)
    assert len(proved) > 49_000
    for entry, number in random.Random(1).sample(sorted(library.get_vocab().items()), 3000):
        try:
            text = bytes(of[c] for c in entry).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        ids = library.encode(text, add_special_tokens=False).ids
        if len(library.pre_tokenizer.pre_tokenize_str(text)) == 1:
            assert (text in proved) == (ids == [number])


def test_splits_like_the_library_for_every_sure_character(vocabulary):
    library, counter, letters = Tokenizer.from_file(BYTES).pre_tokenizer, tokencount.Counter(vocabulary), tokencount.byte_letters()
    sure = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x30000, 3), *range(0xE0000, 0xE0200)] if chr(c) not in counter.unsure]
    assert len(sure) > 80_000 and {"՘", "\U00010940"} <= counter.unsure
    for i in range(0, len(sure), 4000):
        text = "\n".join(f"a{c}a 1{c}1 .{c}. {c}" for c in sure[i:i + 4000])
        ours = ["".join(letters[b] for b in p.encode()) for p in counter.pattern.findall(text)]
        same = [p for p, _ in library.pre_tokenize_str(text)] == ours
        assert same  # pytest would compare the lists at length


def test_token_counts(spark, monkeypatch):
    library = Tokenizer.from_file(BYTES)
    texts = [*sample(), None, "word " * 300_000, "x1" * 30_000]
    rows = [(i, t, "n", 1) for i, t in enumerate(texts)] + [(None, "a b", "n", 1), (3, texts[3], "n", 1), (3, texts[3], "n", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int").repartition(3)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert Counter(map(tuple, tokencount.count_tokens(d, BYTES).collect())) == want
    assert tokencount.count_tokens(d.limit(0), BYTES).count() == 0
    carried = tokencount.count_tokens(d.limit(3), BYTES, carry=["n_tokens", "n_bytes"]).collect()
    assert all(tuple(x.carried) == ("n", 1) for x in carried)


def test_pieces_read_one_by_one(vocabulary, monkeypatch):
    counter = tokencount.Counter(vocabulary)
    text = " ".join(sample()[:20])
    listed = counter.tokens(text)
    monkeypatch.setattr(tokencount, "LONG", 10)
    monkeypatch.setattr(tokencount, "REMEMBERED", 0)
    assert tokencount.Counter(vocabulary).tokens(text) == listed


def test_other_tokenizers_are_refused():
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        tokencount.Vocabulary(f.read())


def aligned(text, a, b, of):
    """Tokens, groups and links of a text by the definition."""
    if not text:
        return [], []
    x = a.encode(" " + text, add_special_tokens=False)
    y = b.encode(text)
    one = [bytes(of[c] for c in t) for t in x.tokens]
    two = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
    if b"".join(one) != (" " + text).encode() or b"".join(two) != (" " + text).encode():
        return [], []
    ends_a, ends_b = np.cumsum([len(t) for t in one]).tolist(), np.cumsum([len(t) for t in two]).tolist()
    groups, links, low = [], [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        groups.append(([i for i, e in zip(x.ids, ends_a) if low < e <= end], [i for i, e in zip(y, ends_b) if low < e <= end]))
        links.append((groups[-1][0][-1], groups[-1][1][-1]))
        low = end
    return groups, links


@pytest.mark.parametrize("block, segment, slice_", [(16 << 20, 1 << 16, 1 << 19), (3000, 40, 200)])
def test_alignment(spark, monkeypatch, block, segment, slice_):
    monkeypatch.setattr(alignment, "SEGMENT", segment)
    monkeypatch.setattr(alignment, "SLICE", slice_)
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    of = {c: i for i, c in enumerate(tokencount.byte_letters())}
    texts = [t if t is None or len(t) < 6000 else t[:6000] for t in sample()] + [None, "many words " * 1000, "x1" * 3000]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "a b", "n"), (3, texts[3], "n"), (3, texts[3], "n")]
    found = [aligned(t, a, b, of) for _, t, _ in rows]
    count = Counter(x for _, links in found for x in links)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    want = Counter()
    for (i, _, _), (groups, links) in zip(rows, found):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), hashlib.sha256(text.encode()).hexdigest() if groups else "", text, len(links),
             sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links)] += 1
    d = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3)
    got = alignment.align_tokenizers(d, BYTES, PIECES, texts=True, block=block)
    assert Counter(map(tuple, got.collect())) == want
    assert any(not g for (_, t, _), (g, _) in zip(rows, found) if t) and max(len(x) for g, _ in found for x, _ in g) > 2
    assert alignment.align_tokenizers(d.limit(0), BYTES, PIECES).count() == 0


def test_words_are_encoded_once_and_like_whole_texts(vocabulary, monkeypatch):
    """Pieces of remembered words against the whole text; the kit of a worker serves its next task."""
    class Sent:
        with open(PIECES, "rb") as f:
            value = vocabulary, f.read()

    monkeypatch.setattr(alignment, "_KEPT", {})
    t, _ = alignment.kit("files", Sent)
    assert alignment.kit("files", None)[0] is t and alignment.kit("others", Sent)[0] is not t
    odd = [" ", "a  b", " a b ", "a\u200b b", "a ▁b", "ﬁ x", "x\u3000y z", "a \u0308b", "<s> a </s> b", "a\tb c\n d", "漢字 かな x", "a▁b c", "x <unk> y", "ａ ｂ", "w " * 90, "q" * 100 + " q"]
    texts = [x + y for x in odd for y in ("", " w ", *odd)]
    for _ in range(2):
        for text, ids in zip(texts, t.ids_b.encode(texts)):
            whole = t.b.encode(text)
            assert ids == (whole if t.ids_b.spell(whole) == b" " + text.encode() else [])
    assert "w" in t.ids_b and "q" * 100 not in t.ids_b

    class Model:
        calls = []

        def encode(self, words, num_threads):
            self.calls += words
            return t.b.encode(words, num_threads=num_threads)

    words = alignment.Pieces(Model(), t.bytes_b, t.cuts)
    words.encode(["one two one", "two three"])
    words.encode(["three two"])
    assert sorted(Model.calls) == ["one", "three", "two"]


def test_ascii_texts_are_split_like_others():
    two = ["".join(x) for x in product(map(chr, range(128)), repeat=2)]
    plain, whole = re.compile(tokencount.ASCII_PATTERN), regex.compile(tokencount.PATTERN)
    assert all(plain.findall(x) == whole.findall(x) for t in two for x in (t, f"a{t}b", f" {t} x"))


def test_pointers_follow_whole_chains():
    """Components by pointer jumping against offsets that both sides share."""
    r = np.random.default_rng(2)
    for _ in range(200):
        size = int(r.integers(1, 300))
        a, b = (np.unique(np.append(r.integers(1, size + 1, r.integers(0, size + 1)), size)) for _ in range(2))
        last = alignment.terminals(a, b)
        shared = np.intersect1d(a, b)
        assert (a[last] == shared[np.searchsorted(shared, np.concatenate([a, b]))]).all()
    assert sys.maxunicode == 0x10FFFF
