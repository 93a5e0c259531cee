"""Small column helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI mode raises on a plain division)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def rnd(c: str | Column, digits: int) -> Column:
    """Half-up rounding; adding 0.0 turns -0.0 into 0.0."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def finite(c: str | Column) -> Column:
    """The value as double, with NaN and infinities turned into NULL (missing)."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def label(c: str | Column) -> Column:
    """Group label: a missing key is shown as '-'."""
    return F.coalesce(col(c).cast("string"), F.lit("-"))


def long_dims(df: DataFrame, dims: list[str], keep: list[str] = (), name: str = "dimension",
              value: str = "key") -> DataFrame:
    """One row per (row, dimension), so that trying every dimension is one shuffle and not one job each."""
    kept = [c for c in keep if c not in dims]
    wide = df.select(*[col(c) for c in kept], *[col(d).cast("string").alias(d) for d in dims],
                     *[col(c).alias(f"__{c}") for c in keep if c in dims])
    out = wide.unpivot([*kept, *[f"__{c}" for c in keep if c in dims]], dims, name, value)
    for c in keep:
        if c in dims:
            out = out.withColumnRenamed(f"__{c}", c)
    return out


def long_metrics(df: DataFrame, metrics: list[str], keep: list[str] = (), name: str = "metric",
                 value: str = "value") -> DataFrame:
    """One row per (row, metric) with the metric as a finite double."""
    wide = df.select(*[col(c) for c in keep], *[finite(m).alias(f"__m{i}") for i, m in enumerate(metrics)])
    long = wide.unpivot(list(keep), [f"__m{i}" for i in range(len(metrics))], "__which", value)
    names = F.create_map(*[F.lit(x) for i, m in enumerate(metrics) for x in (f"__m{i}", m)])
    return long.select(*[col(c) for c in keep], names[F.col("__which")].alias(name), F.col(value))
