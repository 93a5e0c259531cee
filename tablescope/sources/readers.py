"""Readers: delimited text kept as text, JSON, Parquet, and the choice of the main table of several."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import col


def read_delimited(spark: SparkSession, path: str, sep: str = ",", infer: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV, TSV or TXT with a header row; cells stay text unless `infer`. Headers are trimmed, blank rows dropped.

    `multi_line` reads line breaks inside quotes, at the price of one task per file; without it large files are split.
    """
    df = (spark.read.option("header", True).option("inferSchema", infer).option("sep", sep).option("quote", '"')
          .option("escape", '"').option("multiLine", multi_line).csv(path))
    df = df.toDF(*[c.strip() for c in df.columns])
    filled = reduce(lambda a, b: a | b, [F.coalesce(F.trim(col(c).cast("string")) != "", F.lit(False)) for c in df.columns])
    return df.where(filled)


def flatten_nested(df: DataFrame) -> DataFrame:
    """Struct, array and map columns as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[(F.to_json(col(f.name)) if isinstance(f.dataType, nested) else col(f.name)).alias(f.name)
                       for f in df.schema])


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON lines, split over tasks; with `multi_line`, one task a file, also an array of records or an object whose first array-of-objects
    property holds the records."""
    df = spark.read.option("multiLine", multi_line).json(path)
    wrapped = [f.name for f in df.schema
               if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if wrapped and not any(f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType))):
        df = df.select(F.inline(col(wrapped[0])))
    elif wrapped and len(df.columns) == 1:
        df = df.select(F.inline(col(wrapped[0])))
    return flatten_nested(df)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return flatten_nested(spark.read.parquet(path))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; give partitionColumn, lowerBound, upperBound and numPartitions for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def spread(df: DataFrame) -> DataFrame:
    """A frame just read, over all cores when its input has fewer splits than that (one compressed or one-row-group file).

    Inputs of many files are left as they are, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_rows(df: DataFrame) -> DataFrame:
    """`spread` for files that know their numbers of rows: also where one split holds more than twice its share of the rows.

    A row group is read by one task, however many splits its file has, so a few large ones leave the other tasks without rows.
    """
    even = spread(df)
    if even is not df:
        return even
    splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"))
    most = splits.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if (most["most"] or 0) * cores > 2 * (most["n"] or 0) else df


def choose_source(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, chosen): row count of each table; the largest is the main one."""
    counts = reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, df in tables.items()])
    return counts.withColumn("chosen", F.col("n_rows") == F.max("n_rows").over(Window.partitionBy(F.lit(0))))


def catalog_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of the current database, by name."""
    return {t.name: spark.table(t.name) for t in spark.catalog.listTables()}
