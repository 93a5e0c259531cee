"""Exact numbers of distinct values or rows with fingerprints as the only thing that is shuffled."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def marks(values: list[str]) -> list[Column]:
    """128 bits as the key of a row of values and 64 more that tell whether two rows of one key are the same. NULLs count as values."""
    known = [F.col(c).isNotNull() for c in values]
    return [F.xxhash64(F.lit(seed), *[F.col(c) for c in values], *known) for seed in (1, 2, 3)]


def count_distinct(df: DataFrame, values: list[str], within: list[str] = (), marked=marks, sums: list[str] = ()) -> DataFrame:
    """(*within, rows, distinct, *sums): rows, distinct combinations of `values` and totals of the columns `sums`, in each group of `within`.

    Rows are counted by key; a key whose rows differ in the check bits holds several values, and only rows of such keys are compared as they are.
    These keys are sent to all tasks, so where there is none, Spark drops the second pass over the rows before it begins. Both parts use all that
    is counted by key, so that they share one exchange.
    """
    within, sums, key = list(within), list(sums), ["__a", "__b"]
    a, b, check = marked(values)
    totals = [f"__s{i}" for i in range(len(sums))]
    rows = df.select(*within, *[F.col(c) for c in values if c not in within], a.alias("__a"), b.alias("__b"), check.alias("__c"), *[F.col(c).alias(t) for c, t in zip(sums, totals)])
    keys = rows.groupBy(*within, *key).agg(F.count("*").alias("__n"), F.min("__c").alias("__lo"), F.max("__c").alias("__hi"), *[F.sum(t).alias(t) for t in totals])
    mixed = keys.where("__lo <> __hi").select(*[F.col(c).alias(f"__m{c}") for c in [*within, *key]], "__n", *[F.col(t).alias(f"__m{t}") for t in totals])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__m{c}")) for c in [*within, *key]])
    several = rows.join(F.broadcast(mixed), same).select(*within, *key, "__n", *[F.col(f"__m{t}").alias(t) for t in totals], *[c for c in values if c not in within]).distinct()
    more = several.groupBy(*within, *key, "__n", *totals).agg(F.count("*").alias("__d"))
    parts = keys.where("__lo = __hi").withColumn("__d", F.lit(1).cast("long")).select(*within, "__n", *totals, "__d").unionByName(more.select(*within, "__n", *totals, "__d"))
    zero = F.lit(0).cast("long")
    return parts.groupBy(*within).agg(F.coalesce(F.sum("__n"), zero).alias("rows"), F.coalesce(F.sum("__d"), zero).alias("distinct"), *[F.sum(t).alias(c) for c, t in zip(sums, totals)])
