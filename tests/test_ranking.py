import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablescope.functions import ranking as R
from tablescope.sources.samples import exact_sample


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    v = np.where(rng.random(12_000) < 0.35, 7.0, rng.normal(50, 20, 12_000).round(2))  # one value holds a third of the rows
    g = np.where(rng.random(12_000) < 0.6, "hot", rng.choice(["a", "b", "c"], 12_000))
    pdf = pd.DataFrame({"id": range(12_000), "v": v, "g": g})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_ordered_matches_global_window(skewed):
    pdf, df = skewed
    out = R.ordered(df, ["v", "id"], {"cum": "v"}).toPandas().sort_values("id").reset_index(drop=True)
    want = pdf.sort_values(["v", "id"])
    want["rank"], want["cum"] = range(1, len(want) + 1), want["v"].cumsum()
    want = want.sort_values("id").reset_index(drop=True)
    assert (out["rank"] == want["rank"]).all() and np.allclose(out["cum"], want["cum"])


def test_ordered_within_groups(skewed):
    pdf, df = skewed
    out = R.ordered(df, ["v", "id"], {"cum": "v"}, ["g"]).toPandas().sort_values("id").reset_index(drop=True)
    want = pdf.sort_values(["v", "id"])
    want["rank"] = want.groupby("g").cumcount() + 1
    assert (out["rank"] == want.sort_values("id").reset_index(drop=True)["rank"]).all()


def test_ordered_cuts_the_hot_value(skewed, monkeypatch):
    _, df = skewed
    monkeypatch.setattr(R, "ROWS", 400)
    sizes = [r["count"] for r in R._in_order(df, ["v", "id"]).groupBy("__part").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 1_200


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in R.quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == {None: 2.0, "a": 5.0}
    ranks = {(r["g"], r["v"]): r["rank"] for r in R.ordered(df, ["v"], within=["g"]).collect()}
    assert ranks == {(None, 1.0): 1, (None, 3.0): 2, ("a", 5.0): 1}


@pytest.mark.parametrize("within", [[], ["g"]])
def test_quantiles_match_pandas(skewed, within):
    pdf, df = skewed
    probs = {"q1": 0.25, "median": 0.5, "p90": 0.9}
    out = R.quantiles(df, "v", probs, within).toPandas()
    for _, row in out.iterrows():
        x = pdf[pdf["g"] == row["g"]]["v"] if within else pdf["v"]
        for n, p in probs.items():
            assert row[n] == pytest.approx(x.quantile(p), abs=1e-9)
    assert len(out) == (4 if within else 1)


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_column_quantiles_are_exact(skewed, accuracy, monkeypatch):
    """With a fine sketch, with a coarse one, and where the ends of the sketch miss the position; no range exchange but in the last case."""
    pdf, df = skewed
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "p90": 0.9, "high": 1.0}
    monkeypatch.setattr(R, "SKETCH", accuracy)
    whole = R.quantiles
    monkeypatch.setattr(R, "quantiles", lambda *a: pytest.fail("all values put in order"))
    out = R.column_quantiles(df, "v", probs, ["g"]).toPandas()
    assert len(out) == 4
    for _, row in out.iterrows():
        for n, p in probs.items():
            assert row[n] == pytest.approx(pdf[pdf["g"] == row["g"]]["v"].quantile(p), abs=1e-9)
    monkeypatch.setattr(R, "quantiles", whole)
    monkeypatch.setattr(R, "SKETCH", 20)
    monkeypatch.setattr(F, "percentile_approx", lambda *a: F.array(*[F.max("__v")] * 10))
    again = R.column_quantiles(df, "v", probs, ["g"]).toPandas()
    assert np.allclose(again.sort_values("g")[[*probs]], out.sort_values("g")[[*probs]])


def test_profile_puts_no_column_in_order(spark, monkeypatch):
    from tablescope.operators import anomaly, profile
    monkeypatch.setattr(R, "ordered", lambda *a, **k: pytest.fail("all values put in order"))
    df = spark.createDataFrame([(float(i % 7), i, None) for i in range(50)], "a double, b long, c double")
    got = {r["column"]: (r["median"], r["distinct"]) for r in profile.profile(df, "t").collect()}
    assert got == {"a": (3.0, 7), "b": (24.5, 50), "c": (None, 0)}
    assert {r["metric"]: (r["median"], r["mad"]) for r in anomaly.metric_scale(df, ["a", "b"]).collect()} == {"a": (3.0, 2.0), "b": (24.5, 12.5)}


def test_average_ranks(skewed):
    pdf, df = skewed
    got = R.average_ranks(df, "v").toPandas().set_index("v")["avg_rank"]
    want = pdf.assign(r=pdf["v"].rank()).groupby("v")["r"].first()
    assert np.allclose(got.sort_index(), want.sort_index())


def test_exact_sample_takes_the_smallest_hashes(skewed):
    _, df = skewed
    got = exact_sample(df, 500, ["id"])
    lottery = F.md5(F.concat_ws("|", F.lit("7"), F.col("id").cast("string")))
    assert {r["id"] for r in got.collect()} == {r["id"] for r in df.orderBy(lottery).limit(500).collect()}
    assert exact_sample(df, 20_000, ["id"]).count() == 12_000 and got.first()["sampled_from"] == 12_000


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(3.0, 1), (1.0, 2)], "v double, id int")
    assert [r["rank"] for r in R.ordered(df, ["v", "id"]).orderBy("id").collect()] == [2, 1]
    assert R.ordered(df.where("v > 99"), ["v", "id"]).count() == 0


def test_distinct_by_fingerprints(spark):
    """With real fingerprints, and with weak ones that put different rows under one key."""
    from tablescope.functions import distinct
    rows = [(i % 3, ["a", "b", None, "", "bb", "cc"][i % 6], [None, 1.0, 2.0, 0.0, -0.0][i % 5]) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, s string, x double").repartition(4)
    want = {g: len({r for r in rows if r[0] == g}) for g in range(3)}
    weak = lambda values: [F.length("s").cast("long"), F.lit(0).cast("long"), F.xxhash64(F.lit(3), *values, *[F.col(c).isNotNull() for c in values])]
    for marked in (distinct.marks, weak):
        got = {r["g"]: (r["rows"], r["distinct"]) for r in distinct.count_distinct(df, ["s", "x"], ["g"], marked).collect()}
        assert got == {g: (sum(r[0] == g for r in rows), n) for g, n in want.items()}
        assert tuple(distinct.count_distinct(df, ["g", "s", "x"], marked=marked).first()) == (200, sum(want.values()))
    assert tuple(distinct.count_distinct(df.limit(0), ["s"]).first()) == (0, 0)
