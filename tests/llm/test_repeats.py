"""Operators 1 and 3 against brute force."""
import hashlib
import random
import re
from collections import Counter

import pytest

from tablescope.llm import blocks, substring, suffixes

WORD = re.compile("[^\x20\x09-\x0D]+")


def corpus(n=60, seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}" if i % 3 else f"é{i}ß" for i in range(400)]
    passage = " ".join(r.choices(vocab, k=50))
    rows = []
    for i in range(n):
        t = " ".join(r.choices(vocab, k=r.choice([0, 1, 5, 34, 35, 60, 200])))
        if i % 3 == 0:
            t += "\n" + passage + "\t" + " ".join(r.choices(vocab, k=7))
        if i % 10 == 5 and rows:
            t = rows[-1][1]
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, "ä" * 300), (n + 3, "x y " * 200), (None, passage), (3, rows[3][1]), (3, rows[3][1]), (n + 4, "\x00" * 70),
             (n + 5, " ".join(r.choices(vocab, k=30000)))]
    return rows


def words_left(rows, width):
    lists = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + width]) for w in lists for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, lists):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def bytes_left(rows, depth):
    raw = [(float("inf") if d is None else d, d, (t or "").encode()) for d, t in rows]
    first = {}
    for k, _, b in raw:
        for i in range(len(b) - depth + 1):
            s = b[i:i + depth]
            first[s] = min(first.get(s, k), k)
    out = []
    for k, d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if first[b[i:i + depth]] < k:
                gone[i:i + depth] = b"\1" * depth
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(params=[1, 7])
def spread(request, monkeypatch):
    monkeypatch.setattr(blocks, "blocks_for", lambda total, **k: request.param)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, block string, kept int")


@pytest.mark.parametrize("width", [1, 35])
def test_words(spark, spread, width):
    rows = corpus()
    got = substring.remove_repeats(frame(spark, rows), width).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str) == words_left(rows, width)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize("depth", [50, 24])
def test_bytes(spark, spread, depth):
    rows = corpus()
    got = suffixes.remove_copied_bytes(frame(spark, rows), depth).collect()
    have = sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got], key=str)
    assert have == bytes_left(rows, depth)


def test_no_rows(spark):
    empty = frame(spark, [])
    assert substring.remove_repeats(empty).count() == 0 and suffixes.remove_copied_bytes(empty).count() == 0
