"""Cleaning: markers to NULL, typed cells, empty, total and duplicate rows dropped, one report."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distinct import count_distinct
from ..functions import cells, fixed
from ..functions.expr import col
from .infer import infer_types


@dataclass
class Cleaned:
    df: DataFrame
    report: DataFrame
    types: dict[str, str]


def null_markers(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Missing markers turned into NULL; nothing else is changed."""
    out = []
    for c in df.columns:
        text = col(c).cast("string")
        out.append(F.when(~cells.is_missing(text, types.get(c) in cells.STRICT_TYPES), col(c)).alias(c))
    return df.select(*out)


def normalize_raw(df: DataFrame) -> DataFrame:
    """Strong markers to NULL, text trimmed, and text columns that are over 80% European numbers parsed as such."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    trimmed = df.select(*[
        (F.when(~cells.is_missing(col(c), False), F.trim(col(c))) if c in text else col(c)).alias(c) for c in df.columns])
    if not text:
        return trimmed
    gate = trimmed.agg(*[
        F.avg(col(c).rlike(fixed.NUMERIC_EU_CELL).cast("int")).alias(f"g{i}") for i, c in enumerate(text)]).first()
    european = {c for i, c in enumerate(text) if (gate[f"g{i}"] or 0) > 0.8}
    return trimmed.select(*[
        (cells.parse_number(col(c)) if c in european else col(c)).alias(c) for c in df.columns])


def day_first_columns(df: DataFrame, columns: list[str], row_id: str | None = None) -> dict[str, bool]:
    """Whether each date column is day-first.

    With `row_id` the first cell that can be read only one way decides. Without a row order the majority
    of such cells decides.
    """
    if not columns:
        return {}
    votes = [cells.day_first_vote(col(c).cast("string")) for c in columns]
    if row_id:
        aggs = [F.min_by(v, F.when(v.isNotNull(), col(row_id))) for v in votes]
    else:
        aggs = [(F.avg(v) > 0.5).cast("int") for v in votes]
    row = df.agg(*[a.alias(f"v{i}") for i, a in enumerate(aggs)]).first()
    return {c: bool(row[f"v{i}"]) for i, c in enumerate(columns)}


def is_empty_row(columns: list[str], types: dict[str, str]) -> Column:
    """Every cell missing, by the markers of its type."""
    test = F.lit(True)
    for c in columns:
        test = test & cells.is_missing(col(c).cast("string"), types.get(c) in cells.STRICT_TYPES)
    return test


def is_total_row(columns: list[str], types: dict[str, str]) -> Column:
    """A label cell reads Total, Subtotal, Grand total or Sum."""
    test = F.lit(False)
    for c in columns:
        if types.get(c) != "date" and types.get(c) not in cells.NUMERIC_TYPES:
            test = test | F.coalesce(col(c).cast("string").rlike(fixed.TOTAL_ROW), F.lit(False))
    return test


def side_by_side(df: DataFrame, types: dict[str, str], day_first: dict[str, bool]) -> DataFrame:
    """Raw and cleaned cell of every column next to each other (raw_i, new_i), with the row flags."""
    cols = list(types)
    return df.select(
        is_empty_row(cols, types).alias("is_empty"), is_total_row(cols, types).alias("is_total"),
        *[col(c).cast("string").alias(f"raw_{i}") for i, c in enumerate(cols)],
        *[cells.normalize(col(c).cast("string"), types[c], day_first.get(c, False)).alias(f"new_{i}")
          for i, c in enumerate(cols)])


def _as_text(new: Column, semantic_type: str) -> Column:
    """The cleaned cell as the text it would have had, to tell whether cleaning changed it."""
    if semantic_type in cells.NUMERIC_TYPES:
        whole = new == F.floor(new)
        return F.when(whole, F.floor(new).cast("string")).otherwise(new.cast("string"))
    return new.cast("string")


def _base_text(raw: Column, semantic_type: str) -> Column:
    """The raw text a cleaned cell is compared with: blanks around it do not count for typed cells."""
    return F.trim(raw) if semantic_type in cells.STRICT_TYPES else raw


def report(pairs: DataFrame, types: dict[str, str]) -> DataFrame:
    """(scope, metric, n): rows removed by cause and cells changed, overall and per column.

    Cell counts include rows later dropped as duplicates, but not empty or total rows. All is counted in one pass: each row becomes one line for
    itself and one for each of its cells, so that the generated code stays small for wide tables.
    """
    cols = list(types)
    kept, none = ~F.col("is_empty") & ~F.col("is_total"), F.lit(0).cast("long")
    names = [f"new_{i}" for i in range(len(cols))]
    nulls = [F.lit(None).cast(pairs.schema[n].dataType).alias(n) for n in names]
    own = F.struct(F.lit(-1).alias("column"), none.alias("missing"), none.alias("normalized"), none.alias("trimmed"), *[F.col(n) for n in names])
    lines = []
    for i, c in enumerate(cols):
        raw, missing = F.col(f"raw_{i}"), cells.is_missing(F.col(f"raw_{i}"), types[c] in cells.STRICT_TYPES)
        changed = F.coalesce(_as_text(F.col(f"new_{i}"), types[c]) != _base_text(raw, types[c]), F.lit(False))
        lines.append(F.struct(F.lit(i).alias("column"), missing.cast("long").alias("missing"), changed.cast("long").alias("normalized"),
                              F.coalesce(~missing & (F.trim(raw) != raw), F.lit(False)).cast("long").alias("trimmed"), *nulls))
    each = F.when(kept, F.array(own, *lines)).otherwise(F.array(own))
    counted = count_distinct(pairs.select("is_empty", "is_total", F.inline(each)), names, ["is_empty", "is_total", "column"], sums=["missing", "normalized", "trimmed"])

    def line(scope: Column | str, metric: str, n: Column) -> Column:
        return F.struct((F.lit(scope) if isinstance(scope, str) else scope).alias("scope"), F.lit(metric).alias("metric"), n.cast("long").alias("n"))

    empty, total = F.col("is_empty"), ~F.col("is_empty") & F.col("is_total")
    whole = {"rows_before": F.col("rows"), "empty_rows": F.when(empty, F.col("rows")).otherwise(none), "total_rows": F.when(total, F.col("rows")).otherwise(none),
             "rows_after": F.when(kept, F.col("distinct")).otherwise(none), "duplicates": F.when(kept, F.col("rows") - F.col("distinct")).otherwise(none)}
    per_cell = ["missing", "normalized", "trimmed"]
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("column") + 1)
    of_rows = F.array(*[line("table", m, n) for m, n in whole.items()])
    of_cells = F.array(*[line(name, m, F.col(m)) for m in per_cell], *[line("table", f"cells_{m}", F.col(m)) for m in per_cell[1:]])
    found = counted.select(F.inline(F.when(F.col("column") < 0, of_rows).otherwise(of_cells)))
    always = F.array(*[line("table", m, none) for m in whole], *[line("table", f"cells_{m}", F.lit(None)) for m in per_cell[1:]])
    seed = pairs.sparkSession.range(1).select(F.inline(always))  # the metrics of a table without rows
    return found.unionByName(seed).groupBy("scope", "metric").agg(F.sum("n").alias("n"))


def preview(df: DataFrame, types: dict[str, str], day_first: dict[str, bool], row_id: str, rows: int = 8) -> DataFrame:
    """The first surviving rows, one line per cell: before, after, changed."""
    cols = list(types)
    dated = df.select(col(row_id).alias("row_id"), *[col(c) for c in cols if c != row_id])
    base = dated if row_id not in cols else dated.withColumn(row_id, F.col("row_id"))
    flagged = base.where(~is_empty_row(cols, types) & ~is_total_row(cols, types))
    cleaned = [cells.normalize(col(c).cast("string"), types[c], day_first.get(c, False)) for c in cols]
    head = (flagged.select("row_id", *[col(c).cast("string").alias(f"raw_{i}") for i, c in enumerate(cols)],
                           *[n.alias(f"new_{i}") for i, n in enumerate(cleaned)])
            .withColumn("__key", F.struct(*[f"new_{i}" for i in range(len(cols))]))
            .groupBy("__key").agg(F.min(F.struct("row_id", *[f"raw_{i}" for i in range(len(cols))])).alias("__first"))
            .orderBy("__first.row_id").limit(rows))
    lines = [F.struct(F.lit(c).alias("column"), F.col(f"__first.raw_{i}").alias("before"),
                      _as_text(F.col(f"__key.new_{i}"), types[c]).alias("after")) for i, c in enumerate(cols)]
    out = head.select(F.col("__first.row_id").alias("row_id"), F.inline(F.array(*lines)))
    return out.withColumn("changed", ~F.coalesce(F.col("before"), F.lit("-")).eqNullSafe(F.coalesce(F.col("after"), F.lit("-"))))


def clean(df: DataFrame, type_overrides: dict[str, str] | None = None, row_id: str | None = None) -> Cleaned:
    """The whole cleaning pass; types are sniffed in one aggregate unless given."""
    overrides = type_overrides or {}
    cols = [c for c in df.columns if c != row_id]
    unknown = [c for c in cols if c not in overrides]
    sniffed = infer_types(df.select(*[col(c) for c in unknown])) if unknown else {}
    types = {c: overrides.get(c) or sniffed[c] for c in cols}
    order = day_first_columns(df, [c for c, t in types.items() if t == "date"], row_id)
    pairs = side_by_side(df, types, order)
    kept = pairs.where(~F.col("is_empty") & ~F.col("is_total"))
    result = kept.select(*[F.col(f"new_{i}").alias(c) for i, c in enumerate(cols)]).dropDuplicates()
    result = result.select(*[cells.typed(col(c), t).alias(c) for c, t in types.items()])
    return Cleaned(result, report(pairs, types), types)


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns without a single value removed."""
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[col(c) for i, c in enumerate(df.columns) if row[f"n{i}"] > 0])
