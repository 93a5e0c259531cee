"""Operator 4 and the connected groups under it, against brute force."""
import random
import re

import numpy as np

from tablescope.llm import links, minhash

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(nodes, linked):
    of = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(of[a], of[b])
            if of[a] != m or of[b] != m:
                of[a] = of[b] = m
                changed = True
    return of


def corpus():
    r = random.Random(2)
    vocab = [f"W{i}" for i in range(300)]
    docs = []
    for g in range(12):
        base = r.choices(vocab, k=r.choice([3, 40, 120, 400]))
        for _ in range(r.choice([1, 2, 6])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(vocab)
            docs.append((len(docs) * 3 + 5, " ".join(t)))
    chain = r.choices(vocab, k=200)  # neighbours link, the ends do not
    for i in range(8):
        chain = [*chain[4:], *r.choices(vocab, k=4)]
        docs.append((500 - i, " \n".join(chain)))
    return docs + [(900, None), (901, " \t"), (902, "a b"), (903, "A B"), (904, "a b c"), (905, "x " * 50000), (906, "x " * 70), (None, docs[0][1]), docs[7], docs[7]]


def test_near_duplicates(spark):
    docs = corpus()
    got = minhash.near_duplicates(spark.createDataFrame([(d, t, 0, "k") for d, t in docs], "doc_id long, text string, n int, bands string")).collect()
    named = [(d, shingles(t)) for d, t in docs if d is not None]
    linked = [(a, b) for a, x in named for b, y in named if a != b and x and y and 100 * len(x & y) >= 85 * len(x | y)]
    of = groups([d for d, _ in named], linked)
    want = sorted([(d, len(shingles(t)), of.get(d), d is None or of[d] == d) for d, t in docs], key=str)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=str) == want
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_estimate_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(1, 1 << 62, 3000).astype(np.uint64)
    for a, b, want in [(pool[:1000], pool[100:1100], 900 / 1100), (pool[:3], pool[1:4], .5), (pool[:1], pool[:1], 1.0), (pool[:40], pool[50:90], 0.0)]:
        sketch = minhash.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 320)
        assert abs((sketch[0] == sketch[1]).mean() - want) < .09 and (sketch != 0).all()


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7)]
    of = groups({n for p in pairs for n in p}, pairs)
    got = {row.id: row.component for row in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: c for n, c in of.items() if n in got} and {n for p in pairs if p[0] != p[1] for n in p} == set(got)


def test_pipeline_stage_at_80(spark):
    """Copies with similarity in [.80, .85) go in the pipeline's stage, those below .80 stay."""
    import random

    import corpus_pipeline
    r = random.Random(2)
    vocab, docs, want = [f"w{i}" for i in range(3000)], [], set()
    for i in range(40):
        words = r.choices(vocab, k=200)
        for j, changed in enumerate((0, 4) if i % 2 else (0, 5)):
            other = [*words]
            for k in range(changed):
                other[20 + 30 * k] = f"new{i}_{j}_{k}"
            docs.append((2 * i + j, " ".join(other)))
        a, b = ({tuple(t.split(" ")[k:k + 5]) for k in range(196)} for _, t in docs[-2:])
        if 100 * len(a & b) >= 80 * len(a | b):
            assert 100 * len(a & b) < 85 * len(a | b)
            want.add(2 * i + 1)
    assert len(want) == 20
    kept = {x.doc_id for x in corpus_pipeline.minhash_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()}
    assert kept == {d for d, _ in docs} - want
