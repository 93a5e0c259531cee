import datetime as dt

import pytest
import random

from pyspark.sql import functions as F

from tablescope.operators import concentration as C
from tablescope.operators import findings, grounding, grouping, profile, quality, relational, segment, text
from tablescope.plans.analyze import analyze
from tablescope.plans.spec import QuerySpec, run_spec
from tablescope.sources import samples, tokens


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("North", 100.0, 10), ("North", 250.0, 12), ("North", 250.0, 18), ("South", 100.0, 20), ("South", 150.0, 22), ("South", 200.0, 30)]
    return spark.createDataFrame([(dt.date(2023 + i % 2, 1 + i, 1), *r) for i, r in enumerate(rows)], "Date date, Region string, Revenue double, Units long")


def value(df):
    return df.first()["value"]


def test_structured_questions(sales):
    assert value(run_spec(sales, QuerySpec("aggregate", metric="Revenue"))) == 1050
    assert value(run_spec(sales, QuerySpec("aggregate", metric="Revenue", agg="median"))) == 175
    assert value(run_spec(sales, QuerySpec("count", filter=("Revenue", "gt", 150)))) == 3
    assert value(run_spec(sales, QuerySpec("aggregate", metric="Revenue", filter=("Revenue", "gt", 150)))) == 700
    top = run_spec(sales, QuerySpec("groupRank", metric="Revenue", dimension="Region")).collect()
    assert [(r["Region"], r["value"]) for r in top] == [("North", 600), ("South", 450)]
    mean = run_spec(sales, QuerySpec("groupRank", metric="Revenue", dimension="Region", additive=False)).collect()
    assert [r["value"] for r in mean] == [200, 150]
    assert grouping.share_of_total(sales, F.col("Region") == "North", "Revenue").first()["share"] == pytest.approx(0.5714, abs=1e-4)
    assert value(run_spec(sales, QuerySpec("aggregate", metric="Region", agg="distinct"))) == 2
    diff = run_spec(sales, QuerySpec("compare", metric="Revenue", dimension="Region", compare=("North", "South"))).first()
    assert diff["total_diff"] == -150
    with pytest.raises(ValueError):
        run_spec(sales, QuerySpec("describe"))
    with pytest.raises(ValueError):
        run_spec(sales, QuerySpec("aggregate", metric="Nope"))


def test_percentile(sales):
    from tablescope.functions.ranking import quantiles
    assert quantiles(sales, "Units", {"p90": 0.9}).first()["p90"] == 26


def test_pareto_and_gini(spark):
    values = {"A": 50, "B": 20, "C": 15, "D": 10, "E": 5}
    df = spark.createDataFrame([(k, v / 4) for k, v in values.items() for _ in range(4)], "Product string, Revenue double")
    ranked = C.ranked_totals(C.dimension_totals(df, ["Product"], ["Revenue"]))
    p = C.profile(ranked).first()
    assert (p["total"], p["top_share"], p["pareto_count"], p["pareto_share"]) == (100, 0.5, 3, pytest.approx(0.85))
    assert p["gini"] == pytest.approx(0.4) and p["hhi"] == pytest.approx(0.325)
    assert {r["key"] for r in C.members(ranked).collect()} == {"A", "B", "C"}
    assert C.gini(df.where("Product = 'A'"), "Revenue").first()["gini"] == 0
    seg = C.segments(ranked, top=4).where("is_other").first()
    assert seg["key"] == "Other (1 category)" and seg["cum_share"] == pytest.approx(1.0)


def test_best_sellers(spark):
    rows = [("Corolla", 20_000.0)] * 60 + [("Civic", 22_000.0)] * 40 + [("S-Class", 95_000.0)] * 33
    df = spark.createDataFrame([(m, p, "red" if i % 2 else "blue") for i, (m, p) in enumerate(rows)], "Model string, Price double, Color string")
    out = C.best_sellers(df, ["Model", "Color"], "Price").collect()
    assert {r["dimension"] for r in out} == {"Model"}
    assert next(r["key"] for r in out if r["units_rank"] == 1) == "Corolla"
    assert next(r["key"] for r in out if r["revenue_rank"] == 1) == "S-Class"


def test_count_by(spark):
    rows = ["Price too high"] * 10 + ["No need"] * 6 + ["Other"] * 4 + [None, ""]
    first = grouping.count_by(spark.createDataFrame([(r,) for r in rows], "Reason string"), "Reason").first()
    assert (first["key"], first["n"], first["share"]) == ("Price too high", 10, 0.5)


def test_lookup_join(spark):
    orders = spark.createDataFrame([(1, "c1", 10.0), (2, "C2 ", 20.0), (3, "c1", 30.0), (4, "c9", 40.0)], "OrderID long, CustomerID string, Total double")
    customers = spark.createDataFrame([("C1", "North", 1.0, 1), ("c2", "South", 2.0, 2), ("c1", "East", 3.0, 3)],
                                      "CustomerID string, Region string, Total double, row long")
    left = relational.lookup_join(orders, customers, "CustomerID", "CustomerID", "row")
    assert left.columns == ["OrderID", "CustomerID", "Total", "Region", "Total (2)", "row"]
    assert [r["Region"] for r in left.orderBy("OrderID").collect()] == ["North", "South", "North", None]
    assert relational.lookup_join(orders, customers, "CustomerID", "CustomerID", "row", "inner").count() == 3
    keys = relational.suggest_join_keys(orders.where("OrderID < 4"), customers.select("CustomerID", "Region")).collect()
    assert (keys[0]["left_key"], keys[0]["right_key"], keys[0]["name_match"]) == ("CustomerID", "CustomerID", True)


def test_compare_datasets(spark):
    a = spark.createDataFrame([(100.0,)] * 4, "Revenue double")
    b = spark.createDataFrame([(150.0,)] * 4, "Revenue double")
    r = relational.compare_datasets(a, b, ["Revenue"]).first()
    assert (r["sum_a"], r["sum_b"], r["sum_change"], r["mean_change"]) == (400, 600, 0.5, 0.5)


def test_rfm(spark):
    rows = [(f"c{i:02d}", dt.date(2024, 6, 1) - dt.timedelta(days=k), 100.0) for i in range(4) for k in range(6)]
    rows += [(f"z{i:02d}", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0) for i in range(8)]
    df = spark.createDataFrame(rows, "CustomerID string, Date date, Amount double")
    members = segment.rfm_members(df, "CustomerID", "Date", "Amount")
    assert members.count() == 12
    assert {r["f"]: r["n"] for r in members.groupBy("f").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 2, 3: 3, 4: 2, 5: 2}
    segs = {r["segment"]: r for r in segment.rfm_segments(members).collect()}
    assert sum(r["share"] for r in segs.values()) == pytest.approx(1.0)
    assert segment.rfm_members(df.where("CustomerID like 'c%'"), "CustomerID", "Date", "Amount").count() == 0


def test_quintile_is_not_ntile(spark):
    got = [r[0] for r in spark.range(1, 8).select(segment.quintile(F.col("id"), F.lit(7))).collect()]
    assert got == [1, 1, 2, 3, 3, 4, 5]


def test_cohorts(spark):
    rows = [(c, dt.date(2024, m, 5)) for c in ("a", "b", "c") for m in (1, 2, 3)] + [(c, dt.date(2024, m, 6)) for c in ("d", "e") for m in (2, 3)]
    df = spark.createDataFrame(rows, "CustomerID string, Month date")
    got = {(r["cohort_label"], r["offset"]): r["retention"] for r in segment.cohorts(df, "CustomerID", "Month", "monthly").collect()}
    assert got == {("2024-01", 0): 100, ("2024-01", 1): 100, ("2024-01", 2): 100, ("2024-02", 0): 100, ("2024-02", 1): 100}
    once = spark.createDataFrame([(str(i), dt.date(2024, 1 + i % 3, 1)) for i in range(20)], "CustomerID string, Month date")
    assert segment.cohorts(once, "CustomerID", "Month", "monthly").count() == 0


def test_clusters(spark):
    rows = [(10.0 + i % 3, 1.0 + i % 2) for i in range(30)] + [(200.0 + i % 3, 40.0 + i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "Spend double, Visits double")
    found = segment.fit_clusters(df, ["Spend", "Visits"])
    out = segment.cluster_summary(df, found).collect()
    assert sum(r["size"] for r in out) == 60 and 2 <= found.k <= 4
    mixed = segment.cluster_members(df, found).groupBy("cluster").agg(F.min("Spend").alias("lo"), F.max("Spend").alias("hi"))
    assert all(r["hi"] - r["lo"] < 10 for r in mixed.collect())
    assert segment.fit_clusters(df.limit(10), ["Spend", "Visits"]) is None


def test_clusters_do_not_depend_on_partitions(spark):
    r = random.Random(3)
    rows = [(i, *(r.gauss(c, 1.0) for c in centre)) for i in range(600) for centre in [r.choice([(0, 0, 0), (6, 1, 0), (0, 7, 3)])]]
    df = spark.createDataFrame([(i, a, b, c if i % 50 else None) for i, a, b, c in rows], "id int, a double, b double, c double")
    fits = []
    for parts in (4, 13):
        found = segment.fit_clusters(df.repartition(parts, "id"), ["a", "b", "c"])
        fits.append((found, sorted(map(tuple, segment.cluster_members(df.repartition(parts, "b"), found).select("id", "cluster").collect()))))
    assert fits[0] == fits[1] and fits[0][0].k == 3
    sizes = [sum(c == k for _, c in fits[0][1]) for k in range(3)]
    assert sizes == sorted(sizes, reverse=True)
    truth = {}
    for (_, k), (_, a, b, _) in zip(fits[0][1], rows):
        truth.setdefault((a > 3, b > 4), []).append(k)
    assert sum(max(map(v.count, set(v))) for v in truth.values()) >= 590


FEEDBACK = ["Great customer service and fast delivery", "Customer service was terrible", "Not good, customer service slow", "Love the app", "The app crashes",
            "Delivery was fast", "It is fine", "Customer service team was helpful"]


def test_text(spark):
    df = spark.createDataFrame(list(enumerate(FEEDBACK)), "id int, c string")
    resp = text.responses(df, "id", "c")
    terms = {r["term"]: r for r in text.themes(resp).collect()}
    assert terms["customer service"]["n"] == 4 and "service" not in terms and terms["customer service"]["sample"] == FEEDBACK[0]
    got = {r["row_id"]: r["sentiment"] for r in text.sentiment_rows(resp).collect()}
    assert got[0] == "positive" and got[1] == "negative" and got[2] == "negative" and got[6] == "neutral"


def test_grounding(spark):
    answers = spark.createDataFrame([("k", 1, "Total was $1,050.00, North 600 (57.1%), about 1.1k; 3 regions in 2024, but 777 lost")], "key string, answer_id int, text string")
    ev = spark.createDataFrame([("k", 1, 1050.0), ("k", 2, 600.0), ("k", 3, 450.0)], "key string, pos int, value double")
    got = {r["raw"]: r["grounded"] for r in grounding.verify(answers, ev).collect()}
    assert got == {"$1,050.00": True, "600": True, "57.1%": True, "1.1k": True, "777": False}
    s = grounding.grounding_summary(grounding.verify(answers, ev), answers).first()
    assert (s["salient"], s["grounded"], s["unverified"]) == (5, 4, 1)
    facts = spark.createDataFrame([("k", 1, "Total: 1,050; North 600")], "key string, pos int, text string")
    strict = {r["figure"]: r["grounded"] for r in grounding.check(spark.createDataFrame(
        [("k", 1, "1. Total 1050\n2. North is 57% in 2024, fell -600, or 88")], "key string, answer_id int, text string"), facts).collect()}
    assert strict == {1050.0: True, 57.0: True, 600.0: True, 88.0: False}


def test_grounding_by_definition(spark):
    """Bands and searches against the rule over all pairs."""
    import math
    r = random.Random(5)

    def rounded(x, d):
        if x == 0:
            return 0.0
        f = 10.0 ** (d - math.ceil(math.log10(abs(x))))
        return math.floor(x * f + .5) / f

    def close(x, e):
        away = abs(x - e)
        return away <= max(.5, abs(e) * .03) or rounded(x, 3) == x and away <= abs(e) * .06 and x in (rounded(e, 2), rounded(e, 3))

    def derived(x, a, b):
        if a == b:
            return False
        out = [a - b, a + b]
        if b:
            out += [a / b * 100, a / b, (a / b - 1) * 100]
        if a + b:
            out.append(a / (a + b) * 100)
        return any(close(x, e) for e in out)

    ev, said, want = [], [], {}
    for k in range(40):
        numbers = [round(r.choice([1, -1]) * 10 ** r.uniform(-2, 6), r.choice([0, 1, 2])) for _ in range(r.choice([0, 1, 2, 5, 9]))]
        numbers += [0.0] if k % 7 == 0 else []
        ev += [(f"k{k}", i, v) for i, v in enumerate(numbers)]
        tokens = sorted({f"{r.choice([1, -1]) * 10 ** r.uniform(-1, 6):.{r.choice([1, 2, 3])}f}" for _ in range(6)} | {f"{abs(r.choice(numbers or [1]) * r.choice([1.02, .96, 2, .5])):.1f}" for _ in range(3)})
        said.append((f"k{k}", 1, " and ".join(tokens)))
        for t in tokens:
            x = float(t)
            if not (x == math.floor(x) and (abs(x) <= 12 or 1900 <= x <= 2099)):
                want[f"k{k}", t] = any(close(x, e) for e in numbers) or any(derived(x, a, b) for a in numbers for b in numbers)
    answers = spark.createDataFrame(said, "key string, answer_id int, text string")
    evidence = spark.createDataFrame([*ev, ("k1", 99, None), ("k1", 98, float("inf"))], "key string, pos int, value double")
    got = {(x["key"], x["raw"]): x["grounded"] for x in grounding.verify(answers, evidence).collect()}
    assert got == want and 30 < sum(want.values()) < len(want) - 30


def test_grounding_of_a_key_with_much_evidence(spark):
    ev = spark.range(100_000).select(F.lit("k").alias("key"), F.col("id").alias("pos"), (F.lit(1e6) + F.col("id") * 1000).alias("value"))
    said = spark.createDataFrame([("k", 1, "it was 57000000 and -98000000.5 and 7.77e0 or 0.004%")], "key string, answer_id int, text string")
    got = {x["raw"]: x["grounded"] for x in grounding.verify(said, ev).collect()}
    assert got["57000000"] and got["-98000000.5"]


def test_deep_pages(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    for number, size in ((0, 10), (31, 100), (499, 10), (600, 10)):
        got = relational.deep_page(df, [F.desc("v")], number, size, rows=600).collect()
        want = sorted(((i * 7919 % 5003, i) for i in range(5000)), reverse=True)[number * size:(number + 1) * size]
        assert [(x.v, x.k) for x in got] == want
    assert relational.deep_page(df.limit(0), [F.desc("v")], 0).count() == 0


def test_lines_of_a_tall_block():
    """Pointer doubling against the step-by-step rule, and a page of 100,000 heights."""
    import numpy as np
    import pandas as pd
    from tablescope.sources.tokens import _line_starts
    r = np.random.default_rng(2)
    for _ in range(60):
        y = np.unique(r.choice(200, r.integers(1, 80)) / 2.0)
        home, start = {}, None
        for v in sorted(y, reverse=True):
            start = v if start is None or start - v > 3.0 else start
            home[v] = start
        got = _line_starts(pd.DataFrame({"doc_id": 1, "y": y, "tolerance": 3.0}))
        assert dict(zip(got["y"], got["line"])) == home
    tall = _line_starts(pd.DataFrame({"doc_id": 1, "y": np.arange(100_000.0), "tolerance": 0.5}))
    assert (tall["y"] == tall["line"]).all()


def test_token_grid(spark):
    def line(y, cells):
        return [("d", float(x), float(y), s, 5.0 * len(s)) for x, s in cells]
    rows = line(100, [(0, "Region"), (80, "Sales"), (150, "Sales")]) + line(88, [(0, "North"), (80, "1200"), (150, "30")])
    rows += line(76.5, [(0, "South")]) + line(76, [(26, "East"), (80, "900")]) + line(64, [(0, "West"), (80, "1"), (150, "2"), (250, "x")])
    rows += line(40, [(0, "page 1")])
    df = spark.createDataFrame(rows, "doc_id string, x double, y double, str string, width double")
    grid = {}
    for r in tokens.tokens_to_grid(df).orderBy("row", "col").collect():
        grid.setdefault(r["row"], []).append(r["text"])
    assert grid == {0: ["Region", "Sales", "Sales 2"], 1: ["North", "1200", "30"], 2: ["South East", "900", ""], 3: ["West", "1", "2 x"]}


def test_tokens_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(tokens, "TOKENS", 20, raising=False)
    page = [(d, float(x), 100.0 - 12 * y, f"{d}-{x}-{y}", 20.0) for d in [*range(60), None] for y in range(2) for x in (0, 100, 200)]
    df = spark.createDataFrame(page, "doc_id long, x double, y double, str string, width double")
    out = tokens.tokens_to_grid(df)
    assert out.rdd.getNumPartitions() == 18  # 360 tokens with a document
    assert {tuple(r) for r in out.collect()} == {(d, y, x // 100, s) for d, x, h, s, _ in page if d is not None for y in [int((100 - h) // 12)]}


def test_quantiles_of_groups_that_lie_together(spark):
    from tablescope.functions import ranking
    rows = [(i % 7, None if i % 11 == 0 else float(i * i % 13)) for i in range(300)] + [(9, None)]
    df, probs = spark.createDataFrame(rows, "g long, v double"), {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    want, got = (sorted(map(tuple, f(df, "v", probs, ["g"]).collect())) for f in (ranking.quantiles, ranking.group_quantiles))
    assert got == want and len(got) == 7


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from tablescope.sources import readers
    table = pa.table({"i": list(range(4000)), "s": [f"{i * 7919 % 4001:0100d}" for i in range(4000)]})
    for name, size in (("one", 4000), ("many", 50)):
        pq.write_table(table, tmp_path / f"{name}.parquet", row_group_size=size, compression="none", use_dictionary=False)
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        one, many = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("one", "many"))
        assert one.rdd.getNumPartitions() >= 4
        got = readers.spread_rows(one)
        assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 2000
        assert got.count() == 4000 and readers.spread_rows(many) is many
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)


def test_token_lines_follow_the_first_token(spark):
    # heights 100, 96, 92: the third is too far from the first token, although near the second
    rows = [("d", x, y, s, 10.0) for y, a, b in ((100.0, "A", "B"), (96.0, "c", "d"), (92.0, "E", "F")) for x, s in ((0.0 + (y == 96.0) * 30, a), (100.0 + (y == 96.0) * 30, b))]
    df = spark.createDataFrame([(d, x, y, s, 5.0) for d, x, y, s, _ in rows], "doc_id string, x double, y double, str string, width double")
    out = tokens.tokens_to_grid(df).orderBy("row", "col").collect()
    assert {r["row"] for r in out} == {0, 1} and [r["text"] for r in out if r["row"] == 1] == ["E", "F"] + [""] * 2


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    kept = [r["k"] for r in samples.systematic_sample(df, ["k"], 7).orderBy("k").collect()]
    assert kept == [int(i * 1000 / 7) for i in range(7)]
    a = samples.exact_sample(df, 50, ["k"])
    assert a.count() == 50 and a.first()["sampled_from"] == 1000
    assert {r["k"] for r in a.collect()} == {r["k"] for r in samples.exact_sample(df.repartition(9), 50, ["k"]).collect()}


def test_profile_and_quality(spark):
    rows = [(f"o{i}", float(i), "x" if i % 3 else None, "EU", dt.date(2024, 1, 1 + i % 28)) for i in range(60)] * 2
    df = spark.createDataFrame(rows, "order_id string, amount double, status string, market string, order_date date")
    p = {r["column"]: r for r in profile.profile(df, "t").collect()}
    assert p["amount"]["type"] == "currency" and p["order_date"]["role"] == "time" and p["status"]["fill"] == pytest.approx(2 / 3)
    dup = quality.duplicate_rows(df)
    assert dup.first()["duplicates"] == 60
    prof = profile.profile(df, "t")
    assert quality.rating(prof, dup).first()["constants"] == 2
    assert [r["column"] for r in profile.caveats(prof).collect()] == ["status", "market"]


def test_domain(spark):
    def table(name, cols):
        return [(name, c, i, 100, 100, 50, 1.0, 0.5, "number" if r == "metric" else "date" if r == "time" else "category", r, 1.0, 1.0)
                for i, (c, r) in enumerate(cols)]
    rows = (table("shop", [("Order Date", "time"), ("Region", "dimension"), ("Revenue", "metric")])
            + table("stock", [("Date", "time"), ("Open", "metric"), ("Close", "metric"), ("Volume", "metric")])
            + table("ads", [("Campaign", "other"), ("Clicks", "metric"), ("Impressions", "metric")])
            + table("log", [("Date", "time"), ("Activity", "dimension"), ("Calories", "metric")]))
    df = spark.createDataFrame(rows, "table_name string, column string, position int, rows long, non_null long, distinct long, fill double, cardinality double, "
                                     "type string, role string, sum double, sd double")
    got = {r["table_name"]: r["domain"] for r in profile.detect_domain(df).collect()}
    assert got == {"shop": "sales-operational", "stock": "financial-timeseries", "ads": "marketing", "log": "generic"}
    assert {r["table_name"]: r["industry"] for r in profile.detect_industry(df).collect()}["log"] == "Health / fitness"


def test_actions_keep_the_best(spark):
    best = spark.createDataFrame([("d", "A", 1, 10.0)], "dataset_key string, key string, revenue_rank int, revenue double")
    gaps = spark.createDataFrame([("d", "Sales", "Region", True, False, 0.2, "N", 9.0, "S", 4.0, 10)],
                                 "dataset_key string, metric string, dimension string, significant boolean, tautology boolean, eta_sq double, top string, "
                                 "top_mean double, bottom string, bottom_mean double, bottom_n long")
    out = findings.build_actions({"best_sellers": best, "gaps": gaps}).orderBy("rank").collect()
    assert [(r["action"], r["rank"]) for r in out] == [("grow best seller", 1), ("close gap", 2)] and out[1]["size"] == 50


def test_analyze_raw_text(spark):
    rows = []
    for i in range(240):
        day = dt.date(2022, 1, 1) + dt.timedelta(days=3 * i)
        rows.append((day.isoformat(), f"C{i % 20:02d}", ["North", "South", "West"][i % 3], f"${1000 + 7 * (i % 50)}.00", str(1 + i % 5)))
    rows += [(None, None, None, None, None), ("", "Total", "", "$99,999", "")]
    df = spark.createDataFrame(rows, "`Order Date` string, CustomerID string, Region string, Revenue string, Units string")
    found = analyze(df, "shop", type_overrides={"CustomerID": "id"})
    assert found["data"].count() == 240
    kpis = {r["id"]: r["value"] for r in found["kpis"].collect()}
    assert kpis["total"] == sum(1000 + 7 * (i % 50) for i in range(240)) and kpis["volume"] == sum(1 + i % 5 for i in range(240))
    assert found["domain"].first()["domain"] == "sales-operational"
    for name in ("rfm", "cohorts", "forecast", "trend", "best_sellers", "facts", "actions", "quality", "clusters"):
        assert found[name].count() >= (0 if name in ("cohorts", "facts") else 1), name
    found["data"].unpersist()


def test_plans(spark, sales, tmp_path):
    """Filters and columns reach the scan, and small operators keep their plan."""
    path = str(tmp_path / "p")
    sales.write.parquet(path)
    plan = relational.where(spark.read.parquet(path), "Revenue", "gt", 150).select("Units")._jdf.queryExecution().toString()
    assert "GreaterThan(Revenue,150.0)" in plan and "ReadSchema: struct<Revenue:double,Units:bigint>" in plan
    year = relational.where(spark.read.parquet(path).withColumn("Date", F.col("Date").cast("timestamp_ntz")), "Date", "year", 2023)
    assert "Cartesian" not in year._jdf.queryExecution().toString()


def test_no_cap_on_facts(spark):
    facts = spark.createDataFrame([("k", i, f"figure {1000 + 137 * i}") for i in range(300)], "key string, pos int, text string")
    said = spark.createDataFrame([("k", 1, f"it was {1000 + 137 * 290} and not 987654")], "key string, answer_id int, text string")
    assert {r["figure"]: r["grounded"] for r in grounding.check(said, facts).collect()} == {1000.0 + 137 * 290: True, 987654.0: False}
    ev = facts.select("key", "pos", (1000.0 + 137 * facts.pos).alias("value"))
    assert {r["raw"]: r["grounded"] for r in grounding.verify(said, ev.where("pos > 250 or pos < 5")).collect()}[str(1000 + 137 * 290)]


def test_most_frequent_glyph_and_table_of_a_caveat(spark):
    cells = spark.createDataFrame([("$5",)] * 9 + [("€5",), (None,)], "price string")
    assert tuple(profile.detect_currency(cells, ["price"]).first()) == ("USD", "$", "cells")
    notes = spark.createDataFrame([("a", "status", "bad")], "table_name string, column string, severity string")
    kpis = spark.createDataFrame([("a", "1", "Status", ""), ("b", "1", "Status", "")], "table_name string, id string, name string, how_computed string")
    assert {r["table_name"]: r["severity"] for r in profile.caveat_for_kpi(kpis, notes).collect()} == {"a": "bad", "b": None}
