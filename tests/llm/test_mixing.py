"""Operator 5: targets against the iterated rule, and what the rounding promises."""
import random

import pytest

from tablescope.llm import mixing


def goals(sizes, weights, most):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(w[s] for s in names if s not in full)
        share = {s: most * sizes[s] if s in full else left * w[s] / free for s in names}
        over = {s for s in names if s not in full and share[s] > most * sizes[s] + 1e-9}
        if not over:
            return share
        full |= over


@pytest.mark.parametrize("chunk", [20_000, 10])
def test_mix(spark, chunk):
    r = random.Random(3)
    docs = []
    for i in range(900):
        source = r.choice(["a", "a", "a", "b", "é", "C", "tiny" if r.random() < .02 else "d", None, ""])
        docs.append((i, " ".join(["w"] * r.choice([0, 1, 5, 50, 300])), source))
    docs += [(2000, None, "a"), (2001, "", "empty"), (None, "x y", "a"), docs[3], docs[3], (2002, "v " * 3000, "b")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, source string, size int, part int")
    got = mixing.mix_sources(d, chunk=chunk).collect()
    assert len(got) == len(docs)
    sizes, largest, taken = {}, {}, {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        largest[x.source] = max(largest.get(x.source, 0), x.size)
        taken[x.source] = taken.get(x.source, 0) + x.taken
        assert x.taken == x.copies * x.size and 0 <= x.taken <= 3 * x.size
    want = goals(sizes, (5, 2, 1), 3)
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6  # at most the last document is off
    again = mixing.mix_sources(d.repartition(5), chunk=chunk).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_no_bias(spark):
    docs = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    runs = [mixing.mix_sources(d, seed=s).where("source = 'a'").collect() for s in range(12)]
    rate = sum(x.taken for r in runs for x in r) / sum(x.target * x.size / x.source_size for r in runs for x in r)
    assert abs(rate - 1) < .05
    assert mixing.mix_sources(d.limit(0)).count() == 0
