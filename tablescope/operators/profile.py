"""Column profiles, and the rules that read roles, metrics, grain, domain and caveats from them.

A profile frame has one row per (table_name, column). Everything after `profile` works on such frames, so one
job classifies a whole catalog of tables.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distinct import count_distinct
from ..functions import cells, fixed
from ..functions.expr import col, finite, ratio
from ..functions.ranking import column_quantiles
from .headers import is_price_like, is_quantity, is_rate_like, is_revenue, metric_kind, readable

_STATS = ["min", "max", "mean", "sd", "sum", "median"]


def _class_of(field: T.StructField, types: dict[str, str]) -> str:
    if types.get(field.name) in cells.NUMERIC_TYPES or (field.name not in types and isinstance(field.dataType, T.NumericType)):
        return "numeric"
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return "text"


def _long(df: DataFrame, names: list[str], to) -> DataFrame:
    return df.select(*[to(col(c)).alias(c) for c in names]).unpivot([], names, "column", "v")


def _count_values(df: DataFrame, names: list[str], to) -> DataFrame:
    """(column, distinct) of columns of eight bytes: the value itself is shuffled with the number of its column."""
    values = df.select(F.posexplode(F.array(*[to(col(c)) for c in names])).alias("c", "v")).where(F.col("v").isNotNull())
    name = F.array(*[F.lit(c) for c in names])
    return values.distinct().groupBy("c").agg(F.count("*").alias("distinct")).select(name[F.col("c")].alias("column"), "distinct")


_EMPTY = {"min": "double", "max": "double", "mean": "double", "sd": "double", "sum": "double", "median": "double",
          "all_integer": "boolean", "date_min": "timestamp_ntz", "date_max": "timestamp_ntz"}


def profile(df: DataFrame, table_name: str, types: dict[str, str] | None = None, exact: bool = True) -> DataFrame:
    """One row per column: fill, distinct, cardinality, numeric summary, date range, type and role.

    Columns of one kind are turned into rows and summed up in one aggregate, which Spark combines map-side.
    With `exact=False` distinct values are estimated by HyperLogLog and medians by a quantile sketch, so that
    only sketches are shuffled. `types` pins semantic types; others follow from the schema.
    """
    types = types or {}
    kinds = {"numeric": lambda c: finite(c), "date": lambda c: c.cast("timestamp_ntz"), "text": lambda c: F.when(
        ~cells.is_missing(c.cast("string"), False), c.cast("string"))}
    parts = []
    for kind, to in kinds.items():
        names = [f.name for f in df.schema if _class_of(f, types) == kind]
        if not names:
            continue
        long = _long(df, names, to)
        extra = []
        if kind == "numeric":
            extra = [F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"),
                     F.when(F.count("v") > 0, F.coalesce(F.stddev_samp("v"), F.lit(0.0))).alias("sd"), F.sum("v").alias("sum"),
                     F.min(F.col("v") == F.floor("v")).alias("all_integer")]
            if not exact:
                extra.append(F.percentile_approx("v", 0.5, 10_000).alias("median"))
        elif kind == "date":
            extra = [F.min("v").alias("date_min"), F.max("v").alias("date_max")]
        if not exact:
            extra.append(F.approx_count_distinct("v", 0.02).alias("distinct"))
        out = long.groupBy("column").agg(F.count("*").alias("rows"), F.count("v").alias("non_null"), *extra)
        if exact:
            if kind == "text":
                sizes = count_distinct(long.where(F.col("v").isNotNull()), ["v"], ["column"]).drop("rows")
            else:
                sizes = _count_values(df, names, to)
            out = out.join(sizes, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
            if kind == "numeric":
                out = out.join(column_quantiles(long, "v", {"median": 0.5}, ["column"]), "column", "left")
        missing = {c: t for c, t in _EMPTY.items() if c not in out.columns}
        out = out.select("*", *[F.lit(None).cast(t).alias(c) for c, t in missing.items()])
        parts.append(out.select("column", F.lit(kind).alias("kind"), "rows", "non_null", "distinct", *_EMPTY))
    found = reduce(DataFrame.unionByName, parts)
    place = F.create_map(*[F.lit(x) for i, c in enumerate(df.columns) for x in (c, i)])
    pinned = F.create_map(*[F.lit(x) for kv in types.items() for x in kv]) if types else None
    boolean = [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]
    full = found.select(
        F.lit(table_name).alias("table_name"), "column", place[F.col("column")].alias("position"), "kind",
        F.col("column").isin(boolean).alias("is_boolean"), "rows", "non_null", "distinct", *_EMPTY,
        F.coalesce(ratio("non_null", "rows"), F.lit(0.0)).alias("fill"),
        F.coalesce(ratio("distinct", "non_null"), F.lit(0.0)).alias("cardinality"))
    inferred = _semantic_type()
    full = full.withColumn("type", inferred if pinned is None else F.coalesce(F.try_element_at(pinned, F.col("column")), inferred))
    return full.withColumn("role", pick_role(F.col("type"), F.col("cardinality"))).drop("is_boolean", "kind")


def samples(df: DataFrame, k: int = 5) -> DataFrame:
    """(column, samples): the first k distinct values of every column as text."""
    long = _long(df, df.columns, lambda c: c.cast("string")).where(F.col("v").isNotNull()).distinct()
    first = Window.partitionBy("column").orderBy("v")
    return (long.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k).groupBy("column")
            .agg(F.sort_array(F.collect_list("v")).alias("samples")))


def _semantic_type() -> Column:
    """Semantic type of a typed column from its kind, header and counts."""
    words = F.lower(readable(F.col("column")))
    raw = F.lower("column")
    whole, share = F.col("all_integer"), F.col("cardinality")
    return (F.when(F.col("non_null") == 0, "text")
            .when(F.col("is_boolean"), "boolean").when(F.col("kind") == "date", "date")
            .when(F.col("kind") == "numeric",
                  F.when(words.rlike(fixed.MONEY_HEADER), "currency")
                  .when(whole & (words.rlike(fixed.ID_NUMBER_HEADER) | raw.rlike(fixed.ID_NUMBER_HEADER)) & (share > 0.8), "id")
                  .when(whole, "integer").otherwise("number"))
            .when((share < 0.5) & (F.col("distinct") <= 50), "category")
            .when(raw.rlike(fixed.ID_TEXT_HEADER), "id").otherwise("text"))


def pick_role(semantic_type: Column, cardinality: Column) -> Column:
    return (F.when(semantic_type == "date", "time").when(semantic_type == "id", "identifier")
            .when(semantic_type.isin(*cells.NUMERIC_TYPES), "metric").when(semantic_type.isin("category", "boolean"), "dimension")
            .when((semantic_type == "text") & (cardinality < 0.5), "dimension").otherwise("other"))


def override_roles(profiles: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Roles given by the caller replace the inferred ones."""
    given = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]) if roles else None
    return profiles if given is None else profiles.withColumn("role", F.coalesce(F.try_element_at(given, F.col("column")), F.col("role")))


def is_datelike(df: DataFrame) -> DataFrame:
    """(column, numeric_share, date_share, datelike) of text columns; mostly numeric ones are never dates."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    long = _long(df, names, lambda c: F.when(~cells.is_missing(c, True), c)).where(F.col("v").isNotNull())
    out = long.groupBy("column").agg(
        F.avg(F.col("v").rlike(fixed.NUMERIC_CELL).cast("int")).alias("numeric_share"),
        F.avg(cells.canonical_date(F.col("v")).isNotNull().cast("int")).alias("date_share"))
    return out.withColumn("datelike", (F.col("numeric_share") <= 0.8) & (F.col("date_share") > 0.8))


def _is_metric() -> Column:
    return (F.col("role") == "metric") & F.col("sum").isNotNull()


def _largest(test: Column) -> Column:
    """Name of the column with the largest sum among those that pass, earlier columns first on ties."""
    return F.max_by("column", F.when(test, F.struct(F.col("sum"), -F.col("position"))))


def table_facts(profiles: DataFrame) -> DataFrame:
    """(table_name, rows, time_column, transaction_grain, has_metric) per table."""
    n = F.first("rows")
    repeats = F.col("role").isin("dimension", "identifier") & (F.col("distinct") >= 2) & (
        F.col("distinct") <= F.greatest(F.lit(2.0), F.col("rows") * 0.7))
    is_time = F.col("role") == "time"
    return profiles.groupBy("table_name").agg(
        n.alias("rows"),
        F.max_by("column", F.when(is_time, F.struct("distinct", -F.col("position")))).alias("time_column"),
        ((n >= 12) & F.max(is_time) & F.max(repeats)).alias("transaction_grain"), F.max(_is_metric()).alias("has_metric"))


def key_metrics(profiles: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """(table_name, revenue, quantity, primary_metric): what to sum, count and follow in each table.

    Revenue: a revenue-named metric with the largest sum, else at transaction grain a money or price column;
    none in financial series.
    """
    facts = table_facts(profiles)
    financial = F.lit(False)
    if domains is not None:
        facts = facts.join(domains.select("table_name", "domain"), "table_name", "left")
        financial = F.col("domain") == "financial-timeseries"
    name, metric = F.col("column"), _is_metric()
    picked = profiles.groupBy("table_name").agg(
        _largest(metric & is_revenue(name)).alias("named"), _largest(metric & is_price_like(name, F.col("type"))).alias("priced"))
    rev = facts.join(picked, "table_name").select(
        "table_name", F.when(~F.coalesce(financial, F.lit(False)), F.coalesce("named", F.when(F.col("transaction_grain"), F.col("priced")))).alias("revenue"))
    with_rev = profiles.join(rev, "table_name")
    other = F.coalesce(name != F.col("revenue"), F.lit(True))
    spread = F.max_by("column", F.when(metric, F.struct("sd", -F.col("position"))))
    return with_rev.groupBy("table_name").agg(
        F.first("revenue").alias("revenue"), _largest(metric & other & is_quantity(name)).alias("quantity"),
        F.coalesce(F.first("revenue"), _largest(metric & (F.col("type") == "currency")), spread).alias("primary_metric"))


def metric_kinds(profiles: DataFrame, metrics: DataFrame) -> DataFrame:
    """(table_name, column, kind, additive, rate_like, agg_kind): may a metric be summed, or only averaged."""
    x = profiles.where(_is_metric()).join(metrics.select("table_name", "revenue"), "table_name")
    kind = metric_kind(F.col("column"), F.col("revenue"))
    out = x.select("table_name", "column", kind.alias("kind"), is_rate_like(F.col("column")).alias("rate_like"))
    additive = F.col("kind") != "attribute"
    return out.withColumn("additive", additive).withColumn("agg_kind", F.when(additive, "sum").otherwise("mean"))


def detect_domain(profiles: DataFrame, context: str = "") -> DataFrame:
    """(table_name, domain, score, confidence) by keywords in the headers and by structure."""
    facts = table_facts(profiles)
    words = readable(F.col("column"))

    def hits(pattern: str) -> Column:
        return F.sum((words.rlike(pattern) | F.col("column").rlike(pattern)).cast("long"))

    def said(pattern: str) -> Column:
        return F.when(F.lit(context.lower()).rlike(pattern), 2).otherwise(0)

    counted = profiles.groupBy("table_name").agg(
        hits(fixed.STRONG_FINANCIAL).alias("strong"), hits(fixed.WEAK_FINANCIAL).alias("weak"), hits(fixed.SALES_WORDS).alias("sales"),
        hits(fixed.MARKETING_WORDS).alias("marketing"), hits(fixed.SURVEY_WORDS).alias("survey")).join(facts, "table_name")
    grain, has_time = F.col("transaction_grain"), F.col("time_column").isNotNull()
    timed = (has_time & (F.col("strong") + F.col("weak") > 0)).cast("long")
    financial = F.col("strong") * 2 + F.when(grain, 0).otherwise(F.col("weak") + timed) + said(fixed.STRONG_FINANCIAL)
    sales_hits = F.col("sales") + said(fixed.SALES_WORDS)
    sales = F.when(sales_hits > 0, sales_hits + grain.cast("long")).otherwise(0)
    scores = F.array(*[F.struct(s.cast("long").alias("score"), F.lit(-i).alias("order"), F.lit(d).alias("domain")) for i, (d, s) in enumerate([
        ("sales-operational", sales), ("financial-timeseries", financial),
        ("marketing", F.col("marketing") + said(fixed.MARKETING_WORDS)), ("survey", F.col("survey") + said(fixed.SURVEY_WORDS))])])
    top = counted.withColumn("top", F.array_max(scores))
    hit = F.col("top.score") > 0
    return top.select("table_name", F.when(hit, F.col("top.domain")).otherwise("generic").alias("domain"), F.col("top.score").alias("score"),
                      F.when(hit, F.least(F.lit(0.95), 0.4 + F.col("top.score") * 0.16))
                      .when(has_time & F.col("has_metric"), 0.5).otherwise(0.3).alias("confidence"))


def detect_industry(profiles: DataFrame) -> DataFrame:
    """(table_name, industry, hits): the industry with most of its keywords found in the column names."""
    spark = profiles.sparkSession
    keys = spark.createDataFrame([(name, k, -i) for i, (name, ks) in enumerate(fixed.INDUSTRY_KEYS.items()) for k in ks],
                                 "industry string, keyword string, place int")
    names = profiles.groupBy("table_name").agg(F.concat_ws(" | ", F.transform(F.sort_array(F.collect_list(
        F.struct("position", F.lower(readable(F.col("column"))).alias("c")))), lambda s: s.c)).alias("headers"))
    # the keyword list is a fixed table of under a hundred rows
    found = names.join(F.broadcast(keys), F.contains(F.col("headers"), F.col("keyword")))
    counts = found.groupBy("table_name", "industry").agg(F.count("*").alias("hits"), F.first("place").alias("place"))
    return counts.groupBy("table_name").agg(F.max_by(F.struct("industry", "hits"), F.struct("hits", "place")).alias("m")).select(
        "table_name", "m.industry", "m.hits")


_ISO = "|".join(sorted(fixed.CODE_SYMBOL))
_WORDS = "|".join(sorted(fixed.WORD_CODE, key=len, reverse=True))


def _code_in(text: Column) -> Column:
    """Currency code in a header: an ISO code, then a currency name, then a glyph."""
    spaced = F.upper(F.regexp_replace(text, r"[_\-]+", " "))
    iso = F.regexp_extract(spaced, rf"\b({_ISO})\b", 1)
    word = F.lower(F.regexp_extract(spaced, rf"(?i)\b({_WORDS})\b", 1))
    words = F.create_map(*[F.lit(x) for kv in fixed.WORD_CODE.items() for x in kv])
    return F.coalesce(F.when(iso != "", iso), F.when(word != "", F.try_element_at(words, word)), _glyph_in(text))


def _glyph_in(text: Column) -> Column:
    return reduce(lambda acc, g: acc.when(F.contains(text, F.lit(g)), fixed.GLYPH_CODE[g]), list(fixed.GLYPH_CODE)[1:],
                  F.when(F.contains(text, F.lit("R$")), "BRL"))


def detect_currency(df: DataFrame, money_columns: list[str]) -> DataFrame:
    """One row (code, symbol, source): from the headers, else the glyph most frequent in the cells, else US dollars.

    The list of glyphs settles which one a cell has, and ties between glyphs.
    """
    headers = " ".join(money_columns)
    shown = [col(c).cast("string") for c in money_columns]
    glyphs = list(fixed.GLYPH_CODE.values())
    seen = df.select(*[_glyph_in(s).alias(f"g{i}") for i, s in enumerate(shown)]) if shown else df
    votes = lambda c: F.array_max(F.array(*[F.struct(F.count_if(F.col(c) == g).alias("n"), F.lit(-i).alias("o"), F.lit(g).alias("g")) for i, g in enumerate(glyphs)]))
    counted = seen.agg(*[votes(f"g{i}").alias(f"g{i}") for i in range(len(shown))]) if shown else None
    one = counted.select(*[F.when(F.col(f"g{i}.n") > 0, F.col(f"g{i}.g")).alias(f"g{i}") for i in range(len(shown))]) if shown else df.sparkSession.range(1).select(F.lit(None).cast("string").alias("g0"))
    head = _code_in(F.lit(headers))
    alias = F.create_map(*[F.lit(x) for kv in fixed.CODE_ALIAS.items() for x in kv])
    symbol = F.create_map(*[F.lit(x) for kv in fixed.CODE_SYMBOL.items() for x in kv])
    in_cells = F.coalesce(*[F.col(c) for c in one.columns], F.lit(None).cast("string"))
    code = F.coalesce(head, in_cells, F.lit("USD"))
    out = one.select(F.coalesce(F.try_element_at(alias, code), code).alias("code"),
                     F.when(head.isNotNull(), "header").when(in_cells.isNotNull(), "cells").otherwise("default").alias("source"))
    return out.select("code", F.coalesce(F.try_element_at(symbol, F.col("code")), F.lit("$")).alias("symbol"), "source")


def caveats(profiles: DataFrame, top: int = 6) -> DataFrame:
    """(table_name, column, severity, reason): sparse columns and columns with a single value, worst first."""
    fill = F.col("fill")
    severity = F.when(fill < 0.7, "bad").when((fill < 0.9) | (F.col("distinct") <= 1), "warn")
    reason = F.when(fill < 0.9, "sparse").otherwise("single value")
    w = Window.partitionBy("table_name").orderBy((F.col("severity") != "bad").cast("int"), "position")
    return (profiles.where(F.col("role") != "identifier").withColumn("severity", severity).where(F.col("severity").isNotNull())
            .withColumn("reason", reason).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
            .select("table_name", "column", "severity", "reason", "fill", "rank"))


def caveat_for_kpi(kpis: DataFrame, notes: DataFrame) -> DataFrame:
    """Each KPI (table_name, id, …) with the caveat of a column of its table that its text mentions: bad ones first, then the longest name."""
    hit = notes.join(kpis.select("table_name", "id", F.lower(F.concat_ws(" ", "name", "how_computed")).alias("text")),
                     "table_name").where(F.contains(F.col("text"), F.lower(F.col("column"))))
    w = Window.partitionBy("table_name", "id").orderBy((F.col("severity") != "bad").cast("int"), F.desc(F.length("column")), "column")
    best = hit.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("table_name", "id", F.col("column").alias("caveat_column"), "severity")
    return kpis.join(best, ["table_name", "id"], "left")


def text_columns(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """(column, mean_words): free-text candidates with 30% distinct values or more and 3 words or more on average."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    long = _long(df, names, lambda c: F.trim(c)).where(F.col("v") != "")
    words = long.groupBy("column").agg(F.avg(F.size(F.split("v", r"\s+"))).alias("mean_words"), F.count("*").alias("filled"))
    fit = profiles.where((F.col("type") == "text") & (F.col("cardinality") >= 0.3)).select("column")
    return words.join(F.broadcast(fit), "column").where("mean_words >= 3 and filled >= 5").select("column", "mean_words")


ENTITY_NAME = r"(customer|user|account|member|client|subscriber|email|uuid|guid|person|patient|player|device|session|id$)"


def looks_like_entity(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[\s_-]", "").rlike(ENTITY_NAME)


def pick_entity(profiles: DataFrame, least: int = 2) -> DataFrame:
    """(table_name, entity): the first identifier that recurs, else the first column with an entity's name that does."""
    recurs = (F.col("distinct") >= least) & (F.col("distinct") < F.col("rows"))
    first = -F.col("position")
    return profiles.groupBy("table_name").agg(F.coalesce(
        F.max_by("column", F.when(recurs & (F.col("role") == "identifier"), first)),
        F.max_by("column", F.when(recurs & looks_like_entity(F.col("column")), first))).alias("entity"))
