"""Structured questions: a small record of what to compute, run with the operators of this package."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite, label, long_dims, ratio
from ..operators import anomaly, concentration, grouping, relational, segment, stats, timeseries


@dataclass
class QuerySpec:
    """What to compute. `filter` is (column, op, value[, value2]); `compare` two values of the dimension or two years."""
    intent: str
    metric: str | None = None
    metric2: str | None = None
    dimension: str | None = None
    dimension2: str | None = None
    agg: str | None = None
    additive: bool = True
    direction: str = "top"
    top: int = 10
    time: str | None = None
    entity: str | None = None
    metrics: list[str] = field(default_factory=list)
    filter: tuple | None = None
    compare: tuple | None = None


def _agg(s: QuerySpec) -> str:
    return s.agg or ("sum" if s.additive else "mean")


def _trend(df: DataFrame, s: QuerySpec) -> DataFrame:
    months = timeseries.period_sums(df, s.time, s.metric, "monthly")
    return timeseries.changes(months, "monthly").select("label", "value", "change")


def _compare(df: DataFrame, s: QuerySpec) -> DataFrame:
    a, b = s.compare
    if s.time and s.dimension is None:
        return grouping.compare_years(df, s.time, int(a), int(b), s.metric)
    return grouping.compare_groups(df, s.dimension, a, b, s.metric)


INTENTS = {
    "metric": lambda df, s: grouping.aggregate(df, s.metric, _agg(s)),
    "aggregate": lambda df, s: grouping.aggregate(df, s.metric, _agg(s)),
    "count": lambda df, s: grouping.aggregate(df, None, "count"),
    "groupRank": lambda df, s: grouping.rank_groups(df, s.dimension, s.metric, s.agg, s.additive, s.top, s.direction == "top"),
    "groupAggregate": lambda df, s: grouping.group_aggregate(
        df, [d for d in (s.dimension, s.dimension2) if d], s.metric, _agg(s) if s.metric else "count"),
    "distribution": lambda df, s: grouping.histogram(df, s.metric) if s.metric else grouping.count_by(df, s.dimension),
    "correlation": lambda df, s: (stats.correlations(df, [s.metric, s.metric2], p_value=False) if s.metric2
                                  else stats.strongest_pair(df, s.metrics, of=s.metric)),
    "trend": _trend,
    "compare": _compare,
    "significance": lambda df, s: stats.welch(df, s.dimension, *s.compare, s.metric),
    "drivers": lambda df, s: stats.drivers(df, s.metric, s.metrics),
    "outliers": lambda df, s: anomaly.outlier_summary(df, [s.metric], "z"),
    "concentration": lambda df, s: concentration.profile(concentration.ranked_totals(
        concentration.dimension_totals(df, [s.dimension], [s.metric]))),
    "bestCustomers": lambda df, s: segment.rfm_members(df, s.entity, s.time, s.metric).where(
        F.col("segment") == "champions").orderBy(F.desc("monetary"), "entity").limit(s.top),
}


def run_spec(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """The answer of one structured question. Unknown intents and columns raise."""
    if spec.intent not in INTENTS:
        raise ValueError(f"unsupported intent {spec.intent!r}")
    for c in (spec.metric, spec.metric2, spec.dimension, spec.dimension2, spec.time, spec.entity, *spec.metrics):
        if c is not None and c not in df.columns:
            raise ValueError(f"unknown column {c!r}")
    rows = relational.where(df, *spec.filter) if spec.filter else df
    return INTENTS[spec.intent](rows, spec)


def focal_facts(df: DataFrame, metric: str, dims: list[str], agg: str = "sum") -> DataFrame:
    """(dimension, key, value, share) of one metric by several dimensions, in one shuffle."""
    base = df.select(*[label(d).alias(d) for d in dims], finite(metric).alias("__v"))
    how = F.sum("__v") if agg == "sum" else F.avg("__v")
    by = long_dims(base, dims, ["__v"]).groupBy("dimension", "key").agg(how.alias("value"), F.sum("__v").alias("__s"))
    totals = by.groupBy("dimension").agg(F.sum("__s").alias("__t"))
    return by.join(F.broadcast(totals), "dimension").select("dimension", "key", "value", ratio("__s", "__t").alias("share"))  # one row per dimension
