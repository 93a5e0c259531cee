"""Operators 7, 9 and 10 against brute force."""
import math
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tablescope.llm import lines, urls, vectors
from tablescope.session import store

from .test_minhash import groups


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def norm(line):
    return re.sub(r"[ \t\r\f\x0b]+", " ", line.lower()).strip(" ")


def parts_of(line):
    words = line.split(" ")
    padded = f"  {line}  "
    return words if len(words) >= 12 else [padded[i:i + 4] for i in range(len(padded) - 3)]


def blocks_by_definition(spark, norms):
    """SimHash and block keys of each line, from Spark's hashes of single parts."""
    every = sorted({p for n in norms for p in parts_of(n)})
    hashed = {r.p: r.x & (2**64 - 1) for r in spark.createDataFrame([(p,) for p in every], "p string").select("p", F.xxhash64("p").alias("x")).collect()}
    sims, keys = {}, {}
    for n in norms:
        hs, words = [hashed[p] for p in parts_of(n)], n.split(" ")
        if len(hs) >= 8192:
            sims[n], keys[n] = None, set()
            continue
        sims[n] = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))
        pieces = [sims[n] >> 16 * i & 0xFFFF for i in range(4)]
        keys[n] = {("sim", i, j, pieces[i], pieces[j]) for i in range(4) for j in range(i)}
        if len(n) <= 9:
            keys[n] |= {("part", n[:i] + n[i + 1:]) for i in range(len(n))} | {("part", n)}
        elif len(n) > 12 and len(words) < 12:
            keys[n] |= {("first", n[:12]), ("last", n[-12:]), ("part", n[(len(n) - 12) // 2:][:12])}
        elif len(words) >= 12:
            keys[n] |= {(k, *words[:8 * k][-8:]) for k in (1, 2, 3)} | {(-k, *words[-8 * k:][:8]) for k in (1, 2, 3)}
    return sims, keys


def test_simhash_by_definition(spark):
    r = random.Random(1)
    norms = sorted({" ".join(f"w{r.randrange(50)}" for _ in range(k)) for k in (1, 3, 11, 12, 13, 31, 32, 33, 63, 64, 200, 8191, 8192, 9000)} | {"w1 " * 8190 + "w1", "w2 " * 30 + "w2", "a"})
    d = spark.createDataFrame(list(enumerate(norms)), "doc_id long, text string").withColumn("mark", F.lit(0))
    got = {norms[x.doc_id]: x.sim for x in lines._read(d).collect()}
    want, _ = blocks_by_definition(spark, norms)
    assert {n: None if x is None else x & (2**64 - 1) for n, x in got.items()} == want and None in want.values()


def edits(a, b):
    """Edit distance as the operator counts it, and the length to compare it with."""
    x, y = a.split(" "), b.split(" ")
    x, y = (x, y) if min(len(x), len(y)) >= 32 else (a, b)
    return distance(x, y), max(len(x), len(y))


def test_lines(spark):
    r = random.Random(9)
    vocab = [f"wört{i}" for i in range(200)]
    bases = [" ".join(r.choices(vocab, k=k)) for k in (4, 8, 30, 60, 60, 90)]
    docs = []
    for i in range(40):
        text = []
        for _ in range(r.randrange(6)):
            b = r.choice(bases).split(" ")
            for _ in range(r.randrange(3)):
                b[r.randrange(len(b))] = r.choice(vocab)
            text.append(r.choice(["", "  ", "\t"]) + " ".join(b).upper() if r.random() < .3 else " ".join(b))
        docs.append((i, "\n".join([*text, "", f"only {i} {r.random()}"])))
    docs += [(70, None), (71, ""), (72, "\n \n"), (None, bases[0]), docs[5], docs[5], (73, "x " * 30000), (74, "x " * 30001 + "\nü ü ü\nü ü ü ü ü"), (75, "anou.\nenou.\nenow\na\nb")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, pos int, h int")
    got = sorted([(x.doc_id, x.n_lines, x.n_removed, x.kept) for x in lines.dedup_lines(d).collect()], key=str)
    norms = sorted({norm(l) for _, t in docs if t for l in t.split("\n")} - {""})
    (sim, keys), links, linked = blocks_by_definition(spark, norms), [], 0
    for i, a in enumerate(norms):
        for b in norms[:i]:
            n = max(len(a), len(b))
            if None in (sim[a], sim[b]) or min(len(a), len(b)) < .8 * n:
                continue
            away, size = edits(a, b)
            if 5 * away <= size:
                linked += 1
                if keys[a] & keys[b] and (n <= 50 or (sim[a] ^ sim[b]).bit_count() <= 18):
                    links.append((norms.index(a), norms.index(b)))
    of = groups(range(len(norms)), links)
    group = {n: of[i] for i, n in enumerate(norms)}
    first = {}
    for doc, t in docs:
        for p, l in enumerate((t or "").split("\n")):
            if norm(l):
                at = (doc is None, doc or 0, p)
                first[group[norm(l)]] = min(first.get(group[norm(l)], at), at)
    want = []
    for doc, t in docs:
        parts = t.split("\n") if t is not None else []
        keep = [l for p, l in enumerate(parts) if not norm(l) or first[group[norm(l)]] == (doc is None, doc or 0, p)]
        want.append((doc, len(parts), len(parts) - len(keep), "\n".join(keep) if t is not None else None))
    assert len(links) > .75 * linked > 50 and got == sorted(want, key=str)
    assert lines.dedup_lines(d.limit(0)).count() == 0
    carried = lines.dedup_lines(d, carry=["pos", "h"]).collect()
    assert len(carried) == len(docs) and all(tuple(x.carried) == (1, 2) for x in carried)


def test_lines_in_crowded_blocks(spark):
    """Near copies of one line, and lines that share a passage and nothing else, more than a block compares in pairs."""
    r = random.Random(3)
    vocab = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9))) for _ in range(3000)]
    base, passage = r.choices(vocab, k=60), r.choices(vocab, k=20)
    docs = [(0, " ".join(base))]
    for i in range(1, 150):
        w = [*base]
        w[r.randrange(60)] = r.choice(vocab)
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join([*r.choices(vocab, k=30), *passage, *r.choices(vocab, k=30)])) for i in range(150)]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).where("n_removed > 0").collect()
    assert {x.doc_id for x in got} == set(range(1, 150))


def test_lines_of_crowded_blocks_meet_all(spark):
    """A passage shared by 300 lines is the only block of each line and its copy with four other words: no link of them is lost."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("bcdfghklmnprstvz", k=7))
    head, texts = " ".join(word() for _ in range(8)), []
    for _ in range(150):
        rest = [word() for _ in range(32)]
        copy = [word() if i % 8 == 4 else w for i, w in enumerate(rest)]
        texts += [f"{head} {' '.join(x)}" for x in (rest, copy)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("mark", F.xxhash64("text"))
    sim = {x.doc_id: x.sim & (2 ** 64 - 1) for x in lines._read(d).collect()}
    near = {i for i in range(1, 300, 2) if (sim[i] ^ sim[i - 1]).bit_count() <= lines.NEAR}
    assert len(near) > 100
    assert {x.doc_id for x in lines.dedup_lines(d).where("n_removed > 0").collect()} == near


def test_lines_recall(spark):
    """Links against edit similarity alone, with no rule of the index: copies with a replaced word in ten, and typing errors in short lines."""
    r = random.Random(4)
    vocab = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9))) for _ in range(3000)]
    pairs = []
    for k in (10, 20, 40, 80):
        for _ in range(40):
            words = r.choices(vocab, k=k)
            other = [*words]
            for i in r.sample(range(k), k // 10):
                other[i] = r.choice(vocab)
            pairs.append((" ".join(words), " ".join(other)))
    for k in (5, 7, 9, 30, 48):
        for _ in range(20):
            line = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=k))
            i = r.randrange(k)
            pairs.append((line, r.choice([line[:i] + line[i + 1:], line[:i] + "ü" + line[i + 1:], line[:i] + "ü" + line[i:]])))
    pairs = [(a, b) for a, b in pairs if a != b and 5 * distance(a, b) <= max(len(a), len(b))]
    docs = [(2 * i + j, x) for i, pair in enumerate(pairs) for j, x in enumerate(pair)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = {x.doc_id for x in lines.dedup_lines(d).where("n_removed > 0").collect()}
    copies = {2 * i + 1 for i in range(len(pairs))}
    assert len(pairs) > 200 and len(found & copies) >= .9 * len(copies)
    tiny = {2 * i + 1 for i, (a, b) in enumerate(pairs) if max(len(a), len(b)) <= 9}
    assert tiny and tiny <= found and len(found - copies) <= 1


def test_long_lines_are_compared(spark, tmp_path):
    """Lines of 8,192 words or runs of characters and more have a SimHash in the queries, and near copies of them go."""
    r = random.Random(6)
    words = [f"w{r.randrange(5000)}" for _ in range(9000)]
    copy = ["new" if i in (100, 4000, 8000) else w for i, w in enumerate(words)]
    blob = "".join(r.choices("abcdefghij", k=8500))
    giant = [f"v{r.randrange(50)}" for _ in range(40000)]
    texts = [" ".join(words), " ".join(copy), " ".join(f"z{r.randrange(5000)}" for _ in range(9000)), blob, f"{blob[:50]}x{blob[51:]}", "a short line"]
    docs = [(i, t, None, None, len(t)) for i, t in enumerate(texts)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.n_removed for x in lines.op10_line_dedup(spark, str(tmp_path)).collect()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1, 5: 0}
    assert sorted(x.doc_id for x in corpus_pipeline.line_dedup(spark, d, str(tmp_path)).collect()) == [0, 2, 3, 5]
    long = [" ".join(giant[:n]) for n in (8192, 32767, 32768, 40000)]
    of = {x.p: x.x & (2**64 - 1) for x in spark.createDataFrame([(p,) for p in sorted({*giant})], "p string").select("p", F.xxhash64("p").alias("x")).collect()}
    own = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").withColumn("mark", F.lit(0))
    for x in lines._read(own, None).collect():
        hs = [of[p] for p in long[x.doc_id].split(" ")]
        assert x.sim & (2**64 - 1) == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def test_rows_of_a_table_meet_all(spark, monkeypatch):
    """Lines of one SimHash and others in their blocks: all links by definition are found, also where the lines are sent in several slices."""
    monkeypatch.setattr(lines, "SMALL", 20_000)
    r = random.Random(8)
    word = lambda: "".join(r.choices(["th", "er", "on", "an", "re", "in", "tion"], k=r.randrange(1, 4)))
    texts = []
    for i in range(60):
        row = [word() for _ in range(r.randrange(8, 17))] + [word() * 60] * (i % 20 == 7)
        copy = [w[1:] if r.random() < .3 else w for w in row]
        texts += [" | ".join(row), " | ".join(x or "o" for x in copy)]
    norms = sorted({*texts})
    (sim, keys), links = blocks_by_definition(spark, norms), []
    for i, a in enumerate(norms):
        for j, b in enumerate(norms[:i]):
            n = max(len(a), len(b))
            if keys[a] & keys[b] and 5 * min(len(a), len(b)) >= 4 * n and (n <= 50 or (sim[a] ^ sim[b]).bit_count() <= 18) and 5 * edits(a, b)[0] <= edits(a, b)[1]:
                links.append((i, j))
    of, first = groups(range(len(norms)), links), {}
    for i, t in enumerate(texts):
        first.setdefault(of[norms.index(t)], i)
    want = {i for i, t in enumerate(texts) if first[of[norms.index(t)]] != i}
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), most_parts=None)
    assert len(links) > 40 and max(Counter(sim.values()).values()) > lines.CROWD and {x.doc_id for x in got.where("n_removed > 0").collect()} == want


def test_stored_frames_leave_no_shuffle_files(spark):
    """What was shuffled for a stored frame does not stay on disk until the driver collects its garbage."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    count = lambda: sum("shuffle_" in x for x in disk.getAllFiles().mkString(" ").split(" "))
    before = count()
    kept = store(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count().join(spark.range(600).withColumnRenamed("id", "k").groupBy("k").count().withColumnRenamed("count", "n"), "k"))
    assert kept.count() == 600 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    for _ in range(50):
        if count() <= before:
            break
        time.sleep(.1)
    assert count() <= before


def test_lines_blanks(spark):
    """Runs of blanks are one space; texts that stay keep theirs."""
    docs = [(1, "one  two\tthree\nx = 1"), (2, "ONE two \t three\r\nx\t=  1"), (3, "one\x0btwo\f three\nonetwo three"), (4, "a\t\tb")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: (x.removed, x.kept) for x in lines.dedup_lines(d).collect()}
    assert got == {1: ([], docs[0][1]), 2: ([0, 1], ""), 3: ([0], "onetwo three"), 4: ([], docs[3][1])}


def test_urls(spark):
    pages = [(1, "https://WWW.A.net/x"), (2, "http://a.EXAMPLE.net/en/1?q=/de/"), (3, "x://example.com/de/"), (4, "x://notexample.com/de/"), (5, "x://example.com"),
             (6, "y://q.org/fr/#z"), (7, None), (8, "no scheme"), (9, ""), (10, "http://casino.example.org/a/"), (11, "ftp://CASINO.example.org/a?x"), (12, "x://net"),
             (13, "x://anet/"), (14, "x://a.net?b://c/"), (None, "x://b.net/"), (10, "http://casino.example.org/a/"), (15, "x://É.net/É")]
    d = spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("casino.example.org/a",), (None,), ("",), ("other.org/x",)] + [(f"l{i}.org/",) for i in range(300)], "url string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(d, listed).collect()}
    assert got == {(1, "www.a.net", "/x", "net/", "block"), (2, "a.example.net", "/en/1", "example.net/en/", "allow"), (3, "example.com", "/de/", "example.com/de/", "block"),
                   (4, "notexample.com", "/de/", None, "allow"), (5, "example.com", "", None, "allow"), (6, "q.org", "/fr/", "org/fr/", "allow"), (7, "", "", None, "allow"),
                   (8, "", "", None, "allow"), (9, "", "", None, "allow"), (10, "casino.example.org", "/a/", None, "block"), (11, "casino.example.org", "/a", None, "block"),
                   (12, "net", "", None, "allow"), (13, "anet", "/", None, "allow"), (14, "a.net", "", None, "allow"), (None, "b.net", "/", "net/", "block"),
                   (15, "É.net", "/É", "net/", "block")}
    assert urls.judge_urls(d.limit(0), listed).count() == 0 and urls.judge_urls(d, listed.limit(0)).where("listed").count() == 0


def test_filter_never_misses(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("url"))
    pages = spark.range(6000).select("id", F.concat(F.lit("x://h"), "id").alias("url"))
    found = urls.judge_urls(pages, listed, page_id="id").groupBy("listed", "possible").count().collect()
    counts = {(r.listed, r.possible): r["count"] for r in found}
    assert counts[(True, True)] == 3000 and (True, False) not in counts and counts.get((False, True), 0) < 300


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 40)
    r = np.random.default_rng(5)
    rows, centre = [], r.normal(size=(30, 16))
    for i in range(500):
        v = centre[i % 30] + r.normal(size=16) * r.choice([.05, .3, .6])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(900 + i, rows[7][1], rows[7][2]) for i in range(50)] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] + [1.0] * 15, 1),
             (1004, rows[0][1], None), (1005, [float("inf")] * 16, 1), (None, rows[0][1], 0), (1006, [1.0, 2.0], 1), (1007, [2.0, 4.0], 1), (1008, [], 1), (1009, [2 * x for x in rows[8][1]], rows[8][2])]
    r2 = random.Random(1)
    r2.shuffle(rows)
    d = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<float>, label int, id int")
    ok = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and v and l is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    linked = [(a, b) for k, (a, x, l) in enumerate(ok) for b, y, m in ok[:k] if l == m and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= .93]
    n = {}
    for a, b in linked:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    of = groups([i for i, _, _ in rows if i is not None], linked)
    got = {(x.vec_id, x.n_links, x.component_id, x.kept) for x in vectors.similar_vectors(d, pivots=64).collect()}
    want = {(i, n.get(i, 0), of.get(i), i is None or of[i] == i) for i, _, _ in rows}
    assert len(got & want) >= .98 * len(want)  # the index may miss a few; measured recall is in the README
    exact = {(x.vec_id, x.n_links, x.component_id, x.kept) for x in vectors.similar_vectors(d, pivots=4, near=4, shared=1).collect()}
    assert exact == want  # every vector names all pivots, so every pair is looked at
    assert vectors.similar_vectors(d.limit(0)).count() == 0


def test_vectors_in_dense_clusters(spark):
    """Recall of pairs by cluster size, against brute force: a third, a tenth and a fiftieth of the rows."""
    r = np.random.default_rng(8)
    n, x, cluster = 1500, [], []
    for k, (size, noise) in enumerate(((n // 3, .27), (n // 10, .25), (n // 50, .22))):
        c = r.normal(size=64)
        c /= np.linalg.norm(c)
        x.append(c + r.normal(size=(size, 64)) * noise / 8)
        cluster += [k] * size
    x = np.concatenate([*x, r.normal(size=(n - len(cluster), 64))]).astype(np.float32)
    cluster = np.array(cluster + [3] * (n - len(cluster)))
    d = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<float>, label string")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= .93).sum(1) - 1
    got = np.zeros(n, np.int64)
    for row in vectors.similar_vectors(d, pivots=128).collect():
        got[row.vec_id] = row.n_links
    for k in range(3):
        assert want[cluster == k].sum() > 100 and got[cluster == k].sum() >= .9 * want[cluster == k].sum()
    assert (got <= want).all()
