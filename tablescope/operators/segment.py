"""Groups of rows and entities: k-means, RFM, retention cohorts."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import col, finite, ratio
from ..functions.ranking import ordered
from ..session import freeze
from .timeseries import period_label, period_start


SAMPLE, STARTS = 4096, 8  # rows that the first centres are sought on, and tries


@dataclass
class Clusters:
    """Centres of the standardised features, largest cluster first, and (mean, deviation) of each feature."""

    centres: list[list[float]]
    features: list[str]
    scale: dict[str, tuple[float, float]]

    @property
    def k(self) -> int:
        return len(self.centres)

    def scored(self, df: DataFrame) -> DataFrame:
        """Rows with their standardised features `__z0`, `__z1`, … and the number of the nearest centre, `cluster`."""
        return _standardised(df, self.scale).withColumn("cluster", _nearest(len(self.features), self.centres)[0])


def _standardised(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows with their standardised features; a missing value counts as the mean."""
    z = [F.coalesce((finite(c) - F.lit(m)) / F.lit(s), F.lit(0.0)).alias(f"__z{i}") for i, (c, (m, s)) in enumerate(scale.items())]
    return df.select("*", *z)


def _nearest(features: int, centres: list[list[float]]) -> tuple[Column, Column]:
    """The number of the nearest centre, the first of several, and the squared distance to it."""
    away = F.array(*[reduce(lambda a, b: a + b, [(F.col(f"__z{i}") - c[i]) * (F.col(f"__z{i}") - c[i]) for i in range(features)]) for c in centres])
    return (F.array_position(away, F.array_min(away)) - 1).cast("int"), F.array_min(away)


def _first_centres(points: np.ndarray, k: int) -> np.ndarray:
    """Centres of a sample: farthest points from several first ones, moved to the means of their groups; the tightest of them."""
    best, least = points[:1], np.inf
    for start in range(min(STARTS, len(points))):
        chosen = [points[start]]
        while len(chosen) < k:
            chosen.append(points[np.argmax(np.min([((points - c) ** 2).sum(1) for c in chosen], axis=0))])
        centres = np.array(chosen)
        for _ in range(50):
            away = ((points[:, None] - centres[None]) ** 2).sum(2)
            home = away.argmin(1)
            moved = np.array([points[home == j].mean(0) if (home == j).any() else centres[j] for j in range(k)])
            if np.abs(moved - centres).max() < 1e-9:
                break
            centres = moved
        cost = away.min(1).sum()
        if cost < least * (1 - 1e-9):
            best, least = centres, cost
    return best


def fit_clusters(df: DataFrame, metrics: list[str], min_rows: int = 24, steps: int = 30, tolerance: float = 1e-4) -> Clusters | None:
    """k-means on the standardised metrics with spread; 2 groups, or 3 or 4 where each step cuts the cost by 20%.

    First centres come from the `SAMPLE` rows with the smallest hash of their values; from there all rows decide, with one aggregate a step for
    the three numbers of groups together. Nothing depends on the partitioning: centres are rounded to 9 digits, clusters numbered by size.
    None with fewer than `min_rows` rows or 2 metrics.
    """
    one = df.agg(F.count("*").alias("n"), *[F.struct(F.avg(finite(m)), F.stddev_samp(finite(m))).alias(f"s{i}")
                                            for i, m in enumerate(metrics)]).first()
    scale = {m: (float(f"{one[f's{i}'][0]:.12g}"), float(f"{one[f's{i}'][1]:.12g}")) for i, m in enumerate(metrics) if one[f"s{i}"][1]}
    if one["n"] < min_rows or len(scale) < 2:
        return None
    m, names = len(scale), [f"__z{i}" for i in range(len(scale))]
    data = freeze(_standardised(df, scale).select(*names))
    some = data.orderBy(F.xxhash64(*names), *names).limit(SAMPLE).collect()
    centres = {k: np.round(_first_centres(np.array(some), k), 9) for k in (2, 3, 4)}
    cost, size, moving = {}, {}, [2, 3, 4]
    for _ in range(steps):
        sums = []
        for k in moving:
            home, away = _nearest(m, centres[k].tolist())
            sums.append(F.sum(away).alias(f"cost{k}"))
            for j in range(k):
                sums += [F.count_if(home == j).alias(f"n{k}_{j}"), *[F.sum(F.when(home == j, F.col(z))).alias(f"s{k}_{j}_{i}") for i, z in enumerate(names)]]
        row, still = data.agg(*sums).first(), []
        for k in moving:
            cost[k], size[k] = row[f"cost{k}"], [row[f"n{k}_{j}"] for j in range(k)]
            moved = np.round([[row[f"s{k}_{j}_{i}"] / size[k][j] for i in range(m)] if size[k][j] else centres[k][j] for j in range(k)], 9)
            if np.abs(moved - centres[k]).max() > tolerance:
                centres[k] = moved
                still.append(k)
        moving = still
        if not moving:
            break
    k = 2
    while k < 4 and cost[k + 1] < 0.8 * cost[k]:
        k += 1
    order = sorted(range(k), key=lambda j: (-size[k][j], centres[k][j].tolist()))
    return Clusters([centres[k][j].tolist() for j in order], list(scale), scale)


def cluster_members(df: DataFrame, clusters: Clusters) -> DataFrame:
    """Every row with its cluster."""
    return clusters.scored(df).drop(*[f"__z{i}" for i in range(len(clusters.features))])


def cluster_summary(df: DataFrame, clusters: Clusters) -> DataFrame:
    """(cluster, size, share, traits): traits are the up to 3 features furthest from the mean (over .25 deviations)."""
    by = clusters.scored(df).groupBy("cluster").agg(F.count("*").alias("size"), *[F.avg(f"__z{i}").alias(f"z{i}") for i in range(len(clusters.features))])
    traits = F.array(*[F.struct((-F.abs(f"z{i}")).alias("o"), F.lit(c).alias("feature"), F.col(f"z{i}").alias("z"))
                       for i, c in enumerate(clusters.features)])
    strong = F.slice(F.array_sort(F.filter(traits, lambda x: F.abs(x.z) > 0.25)), 1, 3)
    total = by.agg(F.sum("size")).scalar()
    words = F.array_join(F.slice(F.transform("traits", lambda x: F.concat(F.when(x.z >= 0, "high ").otherwise("low "), x.feature)), 1, 2), ", ")
    label = F.when(F.size("traits") == 0, "Balanced / average").otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 10_000)))
    return (by.withColumn("traits", strong).withColumn("share", ratio(F.col("size"), total))
            .select("cluster", "size", "share", label.alias("label"),
                    F.transform("traits", lambda x: F.struct(x.feature.alias("feature"), x.z.alias("z"))).alias("traits"))
            .orderBy(F.desc("size"), "cluster"))


def entity_facts(df: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """(entity, recency, frequency, monetary): days since the entity's last day, rows, and amount (not under 0)."""
    kept = df.where(col(entity).isNotNull() & col(time).isNotNull())
    by = kept.groupBy(col(entity).alias("entity")).agg(
        F.max(F.to_date(col(time))).alias("last_day"), F.count("*").alias("frequency"),
        F.sum(F.greatest(F.coalesce(finite(value), F.lit(0.0)), F.lit(0.0))).alias("monetary"))
    latest = kept.agg(F.max(F.to_date(col(time)))).scalar()
    return by.select("entity", F.datediff(latest, F.col("last_day")).cast("long").alias("recency"), "frequency", "monetary")


def quintile(rank: Column, n: Column) -> Column:
    """1 to 5 by position: min(5, floor((rank - 1) / n · 5) + 1). Not ntile, which fills the first groups first."""
    return F.least(F.lit(5), F.floor((rank - 1) * 5 / n) + 1).cast("long")


def rfm_segment(r: Column, f: Column) -> Column:
    return (F.when((r >= 4) & (f >= 4), "champions").when((f >= 4) & (r >= 2), "loyal").when(r >= 4, "potential")
            .when((r <= 2) & (f >= 3), "at-risk").when(r <= 2, "hibernating").otherwise("attention"))


def rfm_members(df: DataFrame, entity: str, time: str, value: str, min_entities: int = 8) -> DataFrame:
    """Each entity with its quintile scores for recency and frequency and segment; ties are broken by entity."""
    base = freeze(entity_facts(df, entity, time, value))
    n = base.agg(F.count("*")).scalar()
    ranked = ordered(base, ["recency", "entity"], rank="__r")
    ranked = ordered(ranked, ["frequency", "entity"], rank="__f")
    scored = ranked.withColumn("__n", n).where(F.col("__n") >= min_entities).select(
        "entity", "recency", "frequency", "monetary", (6 - quintile(F.col("__r"), F.col("__n"))).alias("r"),
        quintile(F.col("__f"), F.col("__n")).alias("f"))
    return scored.withColumn("segment", rfm_segment(F.col("r"), F.col("f")))


def rfm_segments(members: DataFrame) -> DataFrame:
    """(segment, size, share, averages, monetary share), largest amount first."""
    by = members.groupBy("segment").agg(F.count("*").alias("size"), F.avg("recency").alias("avg_recency"),
                                        F.avg("frequency").alias("avg_frequency"), F.avg("monetary").alias("avg_monetary"),
                                        F.sum("monetary").alias("monetary"))
    w = Window.partitionBy(F.lit(0))  # six rows at most
    return (by.withColumn("share", F.col("size") / F.sum("size").over(w))
            .withColumn("monetary_share", F.coalesce(ratio(F.col("monetary"), F.sum("monetary").over(w)), F.lit(0.0)))
            .orderBy(F.desc("monetary"), "segment"))


def cohorts(df: DataFrame, entity: str, time: str, cadence: str, last_cohorts: int = 12, offsets: int = 12) -> DataFrame:
    """(cohort, cohort_label, size, offset, active, retention): percent of each cohort active k observed periods later.

    A cohort is the first active period. Offsets with nobody active are listed with 0. Nothing comes out with fewer
    than 10 rows, fewer than 2 periods, or under 1.2 periods per entity.
    """
    kept = df.where((col(entity).cast("string") != "") & col(time).isNotNull())
    pairs = kept.groupBy(col(entity).alias("e"), period_start(time, cadence).alias("p")).agg(F.count("*").alias("rows"))
    by_time = Window.partitionBy(F.lit(0)).orderBy("p")
    periods = pairs.select("p").distinct().withColumn("idx", F.row_number().over(by_time).cast("long") - 1)  # calendar-sized
    placed = pairs.join(F.broadcast(periods), "p")
    own = Window.partitionBy("e")
    first = placed.withColumn("cohort", F.min("idx").over(own))
    counts = first.groupBy("cohort", (F.col("idx") - F.col("cohort")).alias("offset")).agg(
        F.count("*").alias("active"), F.sum("rows").alias("rows"))
    totals = counts.agg(F.struct(F.sum("rows").alias("rows"), F.sum("active").alias("pairs"),
                                 F.sum(F.when(F.col("offset") == 0, F.col("active"))).alias("entities"))).scalar()
    ok = (totals.rows >= 10) & (totals.pairs >= 1.2 * totals.entities)
    newest = Window.partitionBy(F.lit(0)).orderBy(F.desc("cohort"))
    sizes = counts.where(F.col("offset") == 0).select("cohort", F.col("active").alias("size"))
    shown = sizes.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= last_cohorts).drop("__r")
    n_periods = periods.agg(F.count("*")).scalar()
    grid = (shown.withColumn("__n", n_periods).where((F.col("__n") >= 2) & ok)
            .withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.least(
                F.lit(offsets - 1).cast("long"), F.col("__n") - 1 - F.col("cohort"))))).drop("__n"))
    out = grid.join(counts.select("cohort", "offset", "active"), ["cohort", "offset"], "left").join(
        periods.select(F.col("idx").alias("cohort"), period_label(F.col("p"), cadence).alias("cohort_label")), "cohort")
    active = F.coalesce("active", F.lit(0))
    return out.select("cohort", "cohort_label", "size", "offset", active.alias("active"),
                      F.floor(active * 100.0 / F.col("size") + 0.5).cast("long").alias("retention"))
