"""Filters, sorting, paging, lookup joins, join-key discovery and column matching."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import col, finite, ratio
from ..session import new_path
from ..functions.tails import p_t


def condition(df: DataFrame, column: str, op: str, value, value2=None) -> Column:
    """Predicate on one column: eq, gt, lt, gte, lte, between, year, contains. Comparisons reach the scan."""
    if column not in df.columns:
        raise ValueError(f"unknown column {column!r}")
    c = col(column)
    plain = {"eq": lambda: c == value, "gt": lambda: c > value, "lt": lambda: c < value,
             "gte": lambda: c >= value, "lte": lambda: c <= value, "between": lambda: c.between(value, value2),
             "contains": lambda: F.contains(F.lower(c), F.lit(str(value).lower()))}
    if op == "year":
        # a range instead of year(c) = value, so that the scan can skip row groups
        y = int(value)
        return (c >= F.lit(f"{y}-01-01").cast("timestamp_ntz")) & (c < F.lit(f"{y + 1}-01-01").cast("timestamp_ntz"))
    if op not in plain:
        raise ValueError(f"unknown operation {op!r}")
    return plain[op]()


def where(df: DataFrame, column: str, op: str, value, value2=None) -> DataFrame:
    return df.where(condition(df, column, op, value, value2))


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows where any column contains the text, case-insensitive."""
    shown = F.concat_ws("\u0001", *[col(c).cast("string") for c in df.columns])
    return df.where(F.instr(F.lower(shown), text.lower()) > 0)


def page(df: DataFrame, order: list[Column], number: int, size: int = 10) -> DataFrame:
    """One of the first pages of a sorted table: a task gathers all rows up to its end. For later ones see `deep_page`."""
    return df.orderBy(*order).offset(number * size).limit(size)


def deep_page(df: DataFrame, order: list[Column], number: int, size: int = 10, rows: int = 1_000_000) -> DataFrame:
    """A page far down a sorted table, for an order that ties no two rows.

    The range exchange deals the rows to numbered partitions of about `rows` rows, which are written sorted, one folder each. Their sizes tell
    which of them hold the page; only those are read, and no task gathers what lies before it.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, "pages")
    parts = max(1, df.count() // rows, spark.sparkContext.defaultParallelism)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = sorted_.withColumns({"__part": F.spark_partition_id(), "__at": place})
    numbered.write.partitionBy("__part").parquet(path)
    written = spark.read.schema(numbered.schema).parquet(path)
    before, held, start = 0, {}, number * size
    for r in written.groupBy("__part").count().orderBy("__part").collect():  # one row a partition
        if before < start + size and before + r["count"] > start:
            held[r["__part"]] = before
        before += r["count"]
    if not held:
        return df.limit(0)
    offset = F.create_map(*[F.lit(x) for pair in held.items() for x in pair])
    found = written.where(F.col("__part").isin(*held)).withColumn("__row", F.col("__at") + offset[F.col("__part")])
    return found.where(F.col("__row").between(start, start + size - 1)).orderBy("__row").select(*df.columns)


def by_time(df: DataFrame, time: str, tiebreak: str) -> DataFrame:
    """Chronological order, rows without a time last."""
    return df.orderBy(col(time).asc_nulls_last(), col(tiebreak))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank.

    Spark keeps k rows per group and task before the shuffle (WindowGroupLimit), so a hot group stays small.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def join_key(c: str) -> Column:
    return F.lower(F.trim(col(c).cast("string")))


def lookup_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, row_order: str,
                how: str = "left") -> DataFrame:
    """Left lookup join on the normalised key; the first right row per key by `row_order` is used.

    The right key is dropped and repeated column names (in any case) get " (2)". Spark broadcasts the right
    side only when its measured size allows it; larger sides are shuffled, with skew handling by AQE.
    """
    taken = {c.lower() for c in left.columns}
    carried = [c for c in right.columns if c != right_key]
    names = {c: f"{c} (2)" if c.lower() in taken else c for c in carried}
    one = (right.select(join_key(right_key).alias("__k"), *[col(c).alias(names[c]) for c in carried],
                        col(row_order).alias("__order"))
           .where(F.col("__k") != "")
           .groupBy("__k").agg(F.min_by(F.struct(*[col(n) for n in names.values()]), "__order").alias("__r")))
    joined = left.withColumn("__k", F.when(join_key(left_key) != "", join_key(left_key))).join(one, "__k", how)
    return joined.select(*[col(c) for c in left.columns],
                         *[F.col("__r").getField(n).alias(n) for n in names.values()])


def _squash(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[\s_-]", "")


def _key_counts(df: DataFrame, prefix: str) -> DataFrame:
    """(column, key, n): how often each normalised value occurs in each column."""
    long = df.select(*[join_key(c).alias(c) for c in df.columns]).unpivot([], df.columns, f"{prefix}_key", "key")
    return long.where(F.col("key") != "").groupBy(f"{prefix}_key", "key").agg(F.count("*").alias(f"{prefix}_n"))


def suggest_join_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """Column pairs that could join the tables, best first.

    Values are counted per column on both sides before the join, so a hot value crosses the network once
    per column whatever its number of rows.
    """
    lk, rk = _key_counts(left, "left"), _key_counts(right, "right")
    filled = lk.groupBy("left_key").agg(F.sum("left_n").alias("filled"))
    unique = rk.groupBy("right_key").agg((F.max("right_n") == 1).alias("right_unique"))
    hits = lk.join(rk, "key").groupBy("left_key", "right_key").agg(F.sum("left_n").alias("matched"))
    scored = (hits.join(F.broadcast(filled), "left_key").join(F.broadcast(unique), "right_key")  # one row per column
              .select("left_key", "right_key", ratio("matched", "filled").alias("overlap"), "right_unique",
                      (_squash(F.col("left_key")) == _squash(F.col("right_key"))).alias("name_match")))
    return (scored.where((F.col("name_match") & (F.col("overlap") >= 0.5)) | (F.col("overlap") >= 0.9))
            .orderBy(F.desc("right_unique"), F.desc("name_match"), F.desc("overlap"), "left_key", "right_key"))


def columns_frame(df: DataFrame) -> DataFrame:
    """(name, numeric) of a table's columns."""
    spark = df.sparkSession
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    rows = [(f.name, f.dataType.simpleString() in numeric or f.dataType.simpleString().startswith("decimal"))
            for f in df.schema]
    return spark.createDataFrame(rows, "name string, numeric boolean")


def match_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, status): numeric columns in both tables by case-insensitive name, and names found on one side only."""
    ca = columns_frame(a).select(F.lower("name").alias("k"), F.col("name").alias("a"), F.col("numeric").alias("an"))
    cb = columns_frame(b).select(F.lower("name").alias("k"), F.col("name").alias("b"), F.col("numeric").alias("bn"))
    both = ca.join(cb, "k", "full_outer")
    status = (F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a")
              .when(F.col("an") & F.col("bn"), "shared_numeric").otherwise("shared_other"))
    return both.select(F.coalesce("a", "b").alias("name"), status.alias("status"))


def compare_datasets(a: DataFrame, b: DataFrame, metrics: list[str], p_value: bool = True) -> DataFrame:
    """Sum and mean of each shared metric in A and B, changes, and Welch's test; biggest change of the sum first."""
    from ..functions.expr import long_metrics
    tagged = (a.select(*[col(m) for m in metrics], F.lit("a").alias("src"))
              .unionByName(b.select(*[col(m) for m in metrics], F.lit("b").alias("src"))))
    long = long_metrics(tagged, metrics, ["src"])
    wide = long.groupBy("metric").agg(*[
        f(F.when(F.col("src") == s, F.col("value"))).alias(f"{n}_{s}")
        for s in "ab" for n, f in (("n", F.count), ("sum", F.sum), ("mean", F.avg), ("var", F.var_samp))])
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(va + vb), F.lit(0.0))
    df_ = (va + vb) ** 2 / F.nullif(va ** 2 / (F.col("n_a") - 1) + vb ** 2 / (F.col("n_b") - 1), F.lit(0.0))
    out = wide.select(
        "metric", "n_a", "n_b", "sum_a", "sum_b", "mean_a", "mean_b",
        ratio(F.col("sum_b") - F.col("sum_a"), F.abs("sum_a")).alias("sum_change"),
        ratio(F.col("mean_b") - F.col("mean_a"), F.abs("mean_a")).alias("mean_change"),
        ratio(F.col("n_b") - F.col("n_a"), F.col("n_a")).alias("rows_change"),
        t.alias("welch_t"), df_.alias("welch_df"))
    if p_value:
        out = out.withColumn("p", p_t(F.col("welch_t"), F.col("welch_df")))
    return out.orderBy(F.desc(F.abs("sum_change")), "metric")


def finite_column(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, finite(c))
