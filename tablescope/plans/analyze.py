"""The whole analysis of one table: from raw cells to a bundle of named result frames."""
from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col, finite
from ..operators import (anomaly, concentration, findings, forecast, grouping, kpi, profile, quality, segment, stats, text, timeseries)
from ..operators.clean import clean, drop_empty_columns
from ..operators.headers import is_cost
from ..session import localize
from . import charts


def analyze(df: DataFrame, name: str = "table", type_overrides: dict[str, str] | None = None, role_overrides: dict[str, str] | None = None,
            currency: str | None = None, row_id: str | None = None, cleaned: bool = False, limits: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """Named result frames of a table. Only the column profile reaches the driver; everything else stays lazy.

    Only additive metrics are summed; rates, ages and the like are averaged. All columns that fit a view are in it, or as many as `limits` says: of
    `metrics`, `concentration`, `categories`, `segments`, `root_cause` and `texts`. `cleaned=True` takes the table as it is, typed by its schema. The caller may unpersist `result["data"]`.
    """
    def first(what: str, names: list[str]) -> list[str]:
        return names[:(limits or {}).get(what)]

    df = drop_empty_columns(df)
    out: dict[str, DataFrame] = {}
    types = dict(type_overrides or {})
    if not cleaned:
        done = clean(df, type_overrides, row_id)
        df, types = done.df, done.types
        out["cleaning"] = done.report
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    out["data"] = df
    prof = localize(profile.override_roles(profile.profile(df, name, types), role_overrides or {}))
    out["profile"], out["caveats"] = prof, profile.caveats(prof)
    out["domain"] = profile.detect_domain(prof)
    out["industry"] = profile.detect_industry(prof)
    metrics_frame = profile.key_metrics(prof, out["domain"])
    out["metric_kinds"] = profile.metric_kinds(prof, metrics_frame)
    kinds = localize(out["metric_kinds"])
    rows, additive = prof.orderBy("position").collect(), {r["column"] for r in kinds.where("additive").collect()}
    key = metrics_frame.first()
    facts = profile.table_facts(prof).first()
    entity_row = profile.pick_entity(prof, 8).first()
    time, revenue, quantity = facts["time_column"], key["revenue"], key["quantity"]
    main = key["primary_metric"]
    entity = entity_row["entity"] if entity_row else None
    metrics = [r["column"] for r in rows if r["role"] == "metric" and (r["sd"] or 0) > 0]
    if main in metrics:
        metrics = [main] + [m for m in metrics if m != main]
    metrics = first("metrics", metrics)
    summed = [m for m in metrics if m in additive]
    dims = [r["column"] for r in rows if r["role"] == "dimension" and r["distinct"] >= 2]
    groups = [r["column"] for r in sorted(rows, key=lambda r: r["distinct"]) if r["role"] == "dimension" and 2 <= r["distinct"] <= 60]
    money = [r["column"] for r in rows if r["type"] == "currency"]
    if currency:
        out["currency"] = df.sparkSession.range(1).select(F.lit(currency).alias("code"), F.lit("caller").alias("source"))
    else:
        out["currency"] = profile.detect_currency(df, money)
    dup = quality.duplicate_rows(df)
    out["quality"] = quality.rating(prof, dup)
    out["quality_issues"] = quality.issues(prof, dup)
    if "cleaning" in out and metrics:
        out["quality_checks"] = quality.scorecard(prof, out["cleaning"], anomaly.outlier_share(df, metrics))
    per_metric = prof.where("role = 'metric'").select(F.col("column").alias("metric"), "sum", "mean", (F.col("type") == "currency").alias("money")).join(
        kinds.select(F.col("column").alias("metric"), "additive", "rate_like"), "metric")
    out["metric_kpis"] = kpi.metric_kpis(per_metric.where(~F.col("metric").isin(*[c for c in (revenue, quantity) if c])), revenue is not None)
    if revenue:
        named = prof.where((F.col("role") == "metric") & (F.col("column") != revenue) & is_cost(F.col("column"))).orderBy("position").first()
        out["kpis"] = kpi.sales_kpis(df, revenue, quantity, named["column"] if named else None, time)
        identifiers = [r["column"] for r in rows if r["role"] == "identifier"]
        candidates = [r["column"] for r in rows if r["role"] in ("dimension", "identifier") and r["type"] != "date" and r["column"] not in (revenue, quantity)]
        if candidates:
            out["best_sellers"] = concentration.best_sellers(df, candidates, revenue, quantity, identifiers=identifiers)
            out["top_performer"] = kpi.top_performer(out["best_sellers"])
    if time and main and out["domain"].where("domain = 'financial-timeseries'").first():
        levels = df.where(col(time).isNotNull()).select(F.lit(main).alias("series"), col(time).alias("period"), finite(main).alias("value")).where("value is not null")
        out["financial_kpis"] = kpi.financial_kpis(levels, ["series"])
    uneven = first("concentration", [r["column"] for r in concentration.dimensions(prof).collect()])
    if uneven:
        out["concentration"] = concentration.analyze(df, [r["column"] for r in concentration.measures(prof, kinds).collect() if r["column"] in summed], uneven)
    if dims:
        out["categories"] = grouping.category_facts(df, first("categories", groups or dims))
    if time and main:
        cadence = timeseries.detect_cadence(df, time)
        frame = timeseries.trim_partial_tail(timeseries.metric_period_sums(df, time, metrics, cadence, [m for m in metrics if m not in additive]), ["metric"])
        out["periods"] = frame
        out["trend"] = timeseries.trend_summary(frame, cadence, ["metric"])
        out["swing"] = timeseries.biggest_swing(frame, ["metric"])
        if cadence in ("daily", "monthly", "quarterly"):
            out["seasonality"] = timeseries.seasonality(frame, cadence, ["metric"])
        out["forecast"] = forecast.forecast(frame, ["metric"])
        out["backtest"] = forecast.backtest(frame, ["metric"], "auto")
        segments = first("segments", [c for c in groups if c != time])
        if segments and main in additive:
            out["contributions"] = timeseries.contributions(df, time, main, segments, cadence, keep_dims=2)
        if entity:
            out["cohorts"] = segment.cohorts(df, entity, time, cadence)
    if entity and time and (revenue or main):
        members = segment.rfm_members(df, entity, time, revenue or main)
        out["rfm_members"], out["rfm"] = members, segment.rfm_segments(members)
    if len(metrics) > 1:
        out["correlations"] = stats.correlations(df, metrics, ranks=True)
        out["relationships"] = stats.relationships(df, metrics)
        if main in metrics and len(metrics) > 2:
            out["drivers"] = stats.drivers(df, main, metrics)
        found = segment.fit_clusters(df, metrics)
        if found:
            out["clusters"] = segment.cluster_summary(df, found)
            out["cluster_members"] = segment.cluster_members(df, found)
    if metrics and groups:
        out["gaps"] = stats.group_comparisons(df, groups, metrics)
    pairs = [r["column"] for r in rows if r["role"] == "dimension" and 2 <= r["distinct"] <= 15]
    if len(pairs) > 1:
        out["associations"] = stats.associations(df, pairs)
    if metrics:
        out["distributions"] = stats.distributions(df, metrics)
        out["outliers"] = anomaly.outlier_summary(df, metrics)
        if groups:
            out["root_cause"] = anomaly.breakdown(df, metrics[0], first("root_cause", groups))
    words = first("texts", [r["column"] for r in profile.text_columns(df, prof).collect()])
    for c in words:
        numbered = df.select(F.monotonically_increasing_id().alias("__id"), col(c)) if not row_id else df.select(col(row_id).alias("__id"), col(c))
        resp = text.responses(numbered, "__id", c)
        out[f"themes_{c}"], out[f"sentiment_{c}"] = text.themes(resp), text.sentiment_summary(resp)
    pair = out["correlations"].where("not redundant").first() if len(metrics) > 1 else None
    shown = [r["column"] for r in rows if r["role"] == "dimension" and 2 <= r["distinct"] <= 25]
    for kind, frame in charts.recommend(df, metrics, shown, time, revenue, (pair["a"], pair["b"]) if pair else None).items():
        out[f"chart_{kind}"] = frame
    keyed = {k: v.withColumn("dataset_key", F.lit(name)) for k, v in out.items()}
    fact_frames = {k: keyed[k] for k in ("kpis", "best_sellers", "trend", "swing", "forecast", "drivers", "gaps", "correlations", "associations",
                                         "rfm", "clusters", "outliers", "distributions", "quality") if k in keyed}
    if fact_frames:
        out["facts"] = findings.build_facts(fact_frames)
    action_frames = {k: keyed[k] for k in ("best_sellers", "gaps", "drivers", "trend", "forecast", "concentration", "categories", "quality_checks") if k in keyed}
    if action_frames:
        out["actions"] = findings.build_actions(action_frames)
    return out
