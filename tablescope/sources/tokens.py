"""Tables rebuilt from positioned text tokens (x, y, width) of many documents."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ranking import group_quantiles
from ..session import freeze

#: Tokens that one task places.
TOKENS = 100_000


def _line_starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tokens with the height of the line each belongs to: the last line start above it, if within the tolerance, else a new line.

    The next line after one that starts at a height begins at the first height further below than the tolerance, found by binary search
    for all heights at once. Which heights are starts follows by pointer doubling from the top.
    """
    heights = pdf.sort_values("y", ascending=False)
    y, n = heights["y"].to_numpy(float), len(heights)
    reach = np.searchsorted(-y, heights["tolerance"].iloc[0] - y, "right")
    jump, start = np.append(reach, n), np.zeros(n + 1, bool)
    start[0] = True
    while (jump[:n] < n).any():
        start[jump[start]] = True
        jump = jump[jump]
    start[jump[start]] = True
    return heights.assign(line=y[np.maximum.accumulate(np.where(start[:n], np.arange(n), 0))])


def tokens_to_grid(tokens: DataFrame) -> DataFrame:
    """(doc_id, row, col, text) from tokens (doc_id, x, y, str, width); row 0 is the header.

    Heights further apart than the line tolerance never share a line, so a document is cut there into blocks. A block
    no taller than the tolerance is one line; only the tokens of taller blocks need the step-by-step rule. Documents
    with fewer than 4 tokens or without a grid (2 columns, 2 rows) give nothing.

    Tokens are dealt by document to a number of tasks that grows with them, and all that follows stays there.
    """
    clean = tokens.where((F.trim("str") != "") & F.col("doc_id").isNotNull()).withColumn("__w", F.col("width") / F.greatest(F.lit(1), F.length(F.trim("str"))))
    clean = freeze(clean)
    tasks = max(clean.sparkSession.sparkContext.defaultParallelism, clean.count() // TOKENS)
    clean = clean.repartition(tasks, "doc_id")
    enough = clean.groupBy("doc_id").agg(F.count("*").alias("n")).where("n >= 4").select("doc_id")
    wide = group_quantiles(clean, "__w", {"char_w": 0.5}, ["doc_id"]).withColumn("char_w", F.when(F.col("char_w") > 0, F.col("char_w")).otherwise(4.0))
    sized = clean.join(enough, "doc_id").join(wide, "doc_id").select(
        "doc_id", "x", "y", F.trim("str").alias("str"), "width", F.greatest(F.col("char_w") * 1.6, F.lit(6.0)).alias("gap"),
        F.greatest("char_w", F.lit(3.0)).alias("tolerance"))
    down = Window.partitionBy("doc_id").orderBy(F.desc("y"))
    starts = sized.where("y is not null").withColumn("new", F.coalesce(F.lag("y").over(down) - F.col("y") > F.col("tolerance"), F.lit(True)))
    blocks = starts.withColumn("block", F.sum(F.col("new").cast("long")).over(down))
    own = Window.partitionBy("doc_id", "block")
    blocks = blocks.withColumn("line", F.max("y").over(own)).withColumn("tall", F.col("line") - F.min("y").over(own) > F.col("tolerance")).drop("new")
    blocks = blocks.withColumn("y", F.col("y").cast("double")).withColumn("line", F.col("line").cast("double"))
    stepped = blocks.where("tall").groupBy("doc_id", "block").applyInPandas(_line_starts, blocks.schema)
    lined = blocks.where("not tall").unionByName(stepped).repartition(tasks, "doc_id")
    across = Window.partitionBy("doc_id", "line").orderBy("x", F.desc("y"))
    placed = lined.withColumn("end", F.lag(F.col("x") + F.col("width")).over(across))
    cut = placed.withColumn("cell", F.sum(F.coalesce(F.col("x") - F.col("end") > F.col("gap"), F.lit(True)).cast("long")).over(across))
    texts = cut.groupBy("doc_id", "line", "cell").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("x", (-F.col("y")).alias("o"), "str"))), lambda k: k.str), " ").alias("text"))
    lines = texts.groupBy("doc_id", F.col("line").alias("y")).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("cell", "text"))), lambda k: k.text).alias("cells"))
    whole = Window.partitionBy("doc_id")
    sizes = lines.withColumn("c", F.size("cells")).where("c >= 2").withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "c")))
    kept = sizes.withColumn("target", F.max(F.struct("n", "c")).over(whole).c).withColumn("rows", F.count("*").over(whole)).where("rows >= 2")
    placed = kept.withColumn("row", F.row_number().over(down).cast("long") - 1)
    head = F.slice("cells", 1, F.col("target") - 1)
    last = F.array_join(F.slice("cells", F.col("target"), F.size("cells")), " ")
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("target") - F.size("cells")))
    cells = F.when(F.size("cells") > F.col("target"), F.concat(head, F.array(last))).when(
        F.size("cells") < F.col("target"), padded).otherwise(F.col("cells"))
    long = placed.select("doc_id", "row", F.posexplode(cells).alias("col", "text"))
    again = Window.partitionBy("doc_id", "row", "text").orderBy("col")
    times = F.row_number().over(again)
    name = F.when(F.col("text") == "", F.concat(F.lit("Column "), (F.col("col") + 1).cast("string"))).otherwise(F.col("text"))
    header = F.when((times > 1) & (F.col("text") != ""), F.concat(name, F.lit(" "), times.cast("string"))).otherwise(name)
    return long.select("doc_id", "row", F.col("col").cast("long").alias("col"), F.when(F.col("row") == 0, header).otherwise(F.col("text")).alias("text"))
