"""Operator 13 against the definition: a tree per source built in plain Python."""
import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablescope.llm import manifest as M

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fan):
    """The levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def siblings(levels, i, fan):
    out = []
    for level in levels[:-1]:
        first = i // fan * fan
        out.append((level[first:i], level[i + 1:first + fan]))
        i //= fan
    return out


def by_definition(rows, fan):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]], fan)
    top = climb([trees[s][-1][0] for s in order], fan)
    out = Counter()
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            around = siblings(trees[s], i, fan) + siblings(top, k, fan)
            marked = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf((*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if marked else leaf(r)
            for a, b in around:
                now = h(*a, now, *b)
            out[r[0], r[1], i, leaf(r), trees[s][-1][0], top[-1][0], "".join("".join(a + b) for a, b in around), marked, now] += 1
    return out


@pytest.mark.parametrize("fan, depth, sources", [(2, 1, 5), (2, 2, 9), (3, 2, 1), (16, 2, 40)])
def test_manifest(spark, fan, depth, sources):
    r = random.Random(fan * depth)
    names = [None, "", "é", "Z", "a", "日本", *(f"s{i}" for i in range(40))][:sources]
    ids = r.sample(range(-50, 5000), 300)
    rows = [(i, names[0] if r.random() < .4 else r.choice(names), r.choice([None, "en", ""]), r.choice([None, 5, -7]), r.choice([None, "", "Ünï TEXT", f"Words {i} A", "low"])) for i in ids]
    rows += [rows[0], rows[0], (rows[1][0], rows[1][1], "x", 1, "Other text"), (None, names[0], None, None, None), (None, names[-1], None, 3, "NO id"), (7777, names[-1], "en", 1, "Z" * 300_000)]
    d = spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(5)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.pmod(F.crc32(d["doc_id"].cast("string").cast("binary")), F.lit(5)) == 0
    found = M.manifest(d, COLUMNS, changed={"text": F.translate("text", capitals, capitals.lower())}, where=tampered, fan=fan, depth=depth)
    got = found.collect()
    assert Counter((x.doc_id, x.source, x.at, x.leaf, x.subroot, x.root, x.proof, x.versioned, x.folded_root) for x in got) == by_definition(rows, fan)
    changed = [x for x in got if x.folded_root != x.root]
    assert changed and all(x.versioned and x.path[-1] == x.folded_root for x in changed)


def test_small_tables(spark):
    d = spark.createDataFrame([(5, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    x, = M.manifest(d, COLUMNS).collect()
    assert x.leaf == x.subroot == x.root == x.folded_root == leaf((5, None, None, None, None)) and x.proof == "" and x.path == [] and not x.versioned
    assert M.manifest(d.limit(0), COLUMNS).count() == 0


def test_versions_share_what_they_do_not_copy():
    tree = M.Tree([h(str(i)) for i in range(20)], 3, 4)
    before = [list(x) for x in tree.levels]
    path = M.Tree.version(h("new"), tree.aside(13))
    assert tree.levels == before and len(path) == 3
    changed = climb([h("new") if i == 13 else h(str(i)) for i in range(20)], 4)
    assert path == [changed[1][3], changed[2][0], changed[3][0]]
    assert [b != a for b, a in zip(changed[1], before[1])] == [False, False, False, True, False]
