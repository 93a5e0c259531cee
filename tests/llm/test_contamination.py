"""Operator 6 against brute force, with the items in one chunk and in several."""
import random
import re

import pytest

from tablescope.llm import contamination

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    wanted = [(i, fold(t)) for i, t in items]
    out = []
    for d, t in docs:
        w, hit, names, longest = fold(t), set(), set(), 0
        for i, v in wanted:
            n = min(width, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[a:a + n]:
                        hit.update(range(p, p + n))
                        names.add(i)
                        m = n
                        while a + m < len(v) and p + m < len(w) and v[a + m] == w[p + m]:
                            m += 1
                        longest = max(longest, m)
        out.append((d, len(w), len(hit), sorted(names), longest))
    return sorted(out, key=str)


def corpus():
    r = random.Random(4)
    vocab = [f"w{i}" if i % 3 else f"É{i}" for i in range(60)]
    items = [(f"i{i}", " ".join(r.choices(vocab, k=r.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(25)]
    items += [("none", None), ("copy", items[-1][1]), ("caps", (items[-1][1] or "").upper()), ("zz", "a-b a-b " * 8)]
    docs = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 20, 200])))) for i in range(30)]
    docs = [(d, t + ". " + (r.choice(items)[1] or "") + "! " + (r.choice(items)[1] or "")[5:60]) for d, t in docs]
    return docs + [(90, None), (91, ""), (None, items[9][1]), (3, docs[3][1]), (92, "a,b;" * 5000)], items


@pytest.mark.parametrize("bytes_at_once", [8 << 20, 100])
@pytest.mark.parametrize("width", [10, 3])
def test_against_brute_force(spark, monkeypatch, bytes_at_once, width):
    monkeypatch.setattr(contamination, "TESTS", bytes_at_once)
    monkeypatch.setattr(contamination, "SHARD", 4000)
    docs, items = corpus()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, items int").repartition(2)
    b = spark.createDataFrame([(*x, "x") for x in items], "item_id string, text string, doc_id string")
    got = contamination.find_contamination(d, b, width).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), max([m.length for m in r.matches], default=0)) for r in got], key=str) == brute(docs, items, width)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_no_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination.find_contamination(d.limit(0), b).count() == 0
    assert contamination.find_contamination(d, b.limit(0)).first().n_hit == 0


@pytest.mark.parametrize("chunk", [8 << 20, 1])
def test_repeated_items_are_one(spark, monkeypatch, chunk):
    monkeypatch.setattr(contamination, "TESTS", chunk)
    text = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([("x", text), ("x", text), ("y", text), ("x", "another text of item x")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"so {text} it is"), (2, "nothing")], "doc_id long, text string")
    got = {r.doc_id: (sorted(r.items), sorted(map(tuple, r.matches))) for r in contamination.find_contamination(docs, items, 10).collect()}
    assert got == {1: (["x", "y"], [("x", 0, 1, 11), ("y", 0, 1, 11)]), 2: ([], [])}
