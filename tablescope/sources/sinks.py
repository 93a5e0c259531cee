"""Writers: spreadsheet-safe CSV and partitioned worklists."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import cells
from ..functions.expr import col


def spreadsheet_safe(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would run as formulas are turned into literal text."""
    text = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    return df.select(*[(cells.spreadsheet_safe(col(c)) if c in text else col(c)).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",") -> None:
    """CSV part files with a header, quotes doubled inside quoted cells, and nulls as empty cells."""
    (spreadsheet_safe(df).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("sep", sep).option("lineSep", "\n").option("nullValue", "").option("emptyValue", "").csv(path))


def write_members(df: DataFrame, path: str, key: str, mode: str = "errorifexists") -> None:
    """Worklist of the members of each segment, one folder per segment key."""
    df.write.mode(mode).partitionBy(key).parquet(path)
