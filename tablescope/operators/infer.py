"""Semantic types of text columns, from header and value patterns, in one aggregate over the table."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells, fixed
from ..functions.expr import col


def pattern_shares(df: DataFrame) -> DataFrame:
    """One row per column: shares of the non-missing cells that match each value pattern.

    The columns are turned into rows first, so the generated code does not grow with their number, and
    the map-side aggregate leaves one row per column and task. Distinct counts use the HyperLogLog
    sketch, exact enough at the small sizes the rules ask about.
    """
    names = df.columns
    long = df.select(*[col(c).cast("string").alias(c) for c in names]).unpivot([], names, "column", "raw")
    cell = long.select("column", F.when(~cells.is_missing(F.col("raw"), True), F.trim("raw")).alias("cell"))
    c = F.col("cell")
    parsed = cell.select("column", "cell", F.lower("cell").alias("low"), cells.parse_number(c).alias("number"),
                         c.rlike(fixed.NUMERIC_CELL).alias("plain"))
    whole = F.col("number").isNotNull() & (F.col("number") == F.floor("number"))
    return parsed.groupBy("column").agg(
        F.count("cell").cast("double").alias("non_missing"),
        F.avg(F.col("low").isin(fixed.TRUE_WORDS + fixed.FALSE_WORDS).cast("int")).alias("boolean_share"),
        F.avg(c.rlike(fixed.PERCENT_CELL).cast("int")).alias("percent_share"),
        F.avg(c.rlike(fixed.CURRENCY_CELL).cast("int")).alias("currency_share"),
        F.avg(F.col("plain").cast("int")).alias("numeric_share"),
        F.avg((F.col("plain") | c.rlike(fixed.NUMERIC_EU_CELL)).cast("int")).alias("any_numeric_share"),
        F.avg(((F.length(c) >= 6) & c.rlike(fixed.DATE_CELL)).cast("int")).alias("date_share"),
        F.min(F.when(c.isNotNull(), whole.cast("int"))).alias("all_integer"),
        F.approx_count_distinct("low", 0.02).cast("double").alias("distinct_lower"))


def _type_of(name: str, s) -> str:
    if not s.non_missing:
        return "text"
    low = name.lower()
    distinct_share = s.distinct_lower / s.non_missing
    if s.boolean_share > 0.95 and s.distinct_lower <= 3:
        return "boolean"
    if s.percent_share > 0.7:
        return "percent"
    if s.currency_share > 0.7 or (re.search(fixed.MONEY_HEADER, low) and s.numeric_share > 0.7):
        return "currency"
    if s.date_share > 0.7 or (re.search(fixed.DATE_HEADER, low) and s.date_share > 0.4):
        return "date"
    if s.any_numeric_share > 0.8:
        if s.all_integer and re.search(fixed.ID_NUMBER_HEADER, low) and distinct_share > 0.8:
            return "id"
        return "integer" if s.all_integer else "number"
    if distinct_share < 0.5 and s.distinct_lower <= 50:
        return "category"
    return "id" if re.search(fixed.ID_TEXT_HEADER, low) else "text"


_TYPED = {"boolean": "boolean", "date": "date", "timestamp": "date", "timestamp_ntz": "date"}


def infer_types(df: DataFrame) -> dict[str, str]:
    """Semantic type per column. Columns that already have a date or boolean type keep it."""
    known = {f.name: _TYPED[f.dataType.simpleString()] for f in df.schema if f.dataType.simpleString() in _TYPED}
    rest = [c for c in df.columns if c not in known]
    if not rest:
        return known
    found = types_from_shares(pattern_shares(df.select(*[col(c) for c in rest])))
    return {c: known.get(c) or found[c] for c in df.columns}


def types_from_shares(shares: DataFrame) -> dict[str, str]:
    """Semantic type per column from the one-row-per-column frame of `pattern_shares`."""
    return {r["column"]: _type_of(r["column"], r) for r in shares.collect()}
