"""Themes and sentiment of free text, with array expressions and grouped counts only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import col, ratio
from ..session import freeze


def tokens(text: Column) -> Column:
    """Lower-case words of letters a-z, digits and apostrophes."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9']+"), lambda w: w != "")


def responses(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, text, words) of the non-blank texts."""
    trimmed = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    base = df.select(col(row_id).alias("row_id"), trimmed.alias("text")).where(F.col("text") != "")
    return base.withColumn("words", tokens(F.col("text")))


def term_counts(resp: DataFrame) -> DataFrame:
    """(term, size, n): in how many responses each content word and each adjacent pair of content words occurs.

    Content words are longer than two letters and no stop words. Each response gives each term once, and the
    counts are combined map-side, so a word found everywhere is no hot key.
    """
    # one flag per word: a stop word becomes NULL, and a pair with a NULL side is dropped
    flagged = resp.select("row_id", F.transform("words", lambda w: F.when(
        (F.length(w) > 2) & ~w.isin(fixed.STOP_WORDS), w)).alias("c"))
    single = F.filter("c", lambda w: w.isNotNull())
    size = F.size("c")
    pairs = F.zip_with(F.slice("c", 1, F.greatest(size - 1, F.lit(0))), F.slice("c", 2, F.greatest(size - 1, F.lit(0))),
                       lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" "), b)))
    double = F.when(size >= 2, F.filter(pairs, lambda p: p.isNotNull())).otherwise(F.array().cast("array<string>"))
    terms = flagged.select(F.explode(F.concat(F.array_distinct(single), F.array_distinct(double))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).withColumn(
        "size", F.when(F.contains("term", F.lit(" ")), 2).otherwise(1))


def themes(resp: DataFrame, with_quote: bool = True) -> DataFrame:
    """(term, n, share, rank, sample): the leading phrases of all responses.

    The 6 most frequent pairs (twice or more), the 8 most frequent words outside those pairs, and of both the first 8.
    Ties are broken by term. The sample is the first response of 160 letters or less that has all words of the
    term, else the first such response cut at 157.
    """
    counts = freeze(term_counts(resp))  # the vocabulary is used three times below, the texts are read once for it
    top_pairs = counts.where("size = 2 and n >= 2").orderBy(F.desc("n"), "term").limit(6)
    inside = top_pairs.select(F.explode(F.split("term", " ")).alias("term")).distinct()
    top_words = counts.where("size = 1").join(F.broadcast(inside), "term", "left_anti").orderBy(F.desc("n"), "term").limit(8)
    merged = top_pairs.unionByName(top_words).orderBy(F.desc("n"), F.desc("size"), "term").limit(8)
    total = resp.agg(F.count("*")).scalar()
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), F.desc("size"), "term")  # 8 rows
    out = merged.select("term", "n", ratio(F.col("n"), total).alias("share"), F.row_number().over(w).cast("long").alias("rank"))
    if not with_quote:
        return out
    # the 8 terms are looked for inside each response, and one quote per term is kept map-side
    wanted = out.agg(F.collect_list(F.struct("term", F.split("term", " ").alias("parts")))).scalar()
    inside_row = F.filter(F.col("wanted"), lambda t: F.forall(t.parts, lambda p: F.array_contains(F.col("words"), p)))
    short = F.when(F.length("text") <= 160, F.col("text"))  # only what can be quoted goes along
    cut = F.concat(F.substring("text", 1, 157), F.lit("…"))
    hits = resp.withColumn("wanted", wanted).select("row_id", short.alias("short"), cut.alias("cut"), F.explode(inside_row).alias("t"))
    quotes = hits.groupBy(F.col("t.term").alias("term")).agg(
        F.min_by("short", F.when(F.col("short").isNotNull(), F.col("row_id"))).alias("short"), F.min_by("cut", "row_id").alias("cut"))
    return out.join(quotes.select("term", F.coalesce("short", "cut").alias("sample")), "term", "left")


def sentiment_score(words: Column) -> Column:
    """Mean polarity of the lexicon words, each flipped by a negator among the two words before it; 0 without any."""
    def signed(w: Column, i: Column) -> Column:
        p = F.when(w.isin(fixed.POSITIVE_WORDS), 1).when(w.isin(fixed.NEGATIVE_WORDS), -1)
        before = F.coalesce(F.when(i >= 1, F.get(words, i - 1)).isin(fixed.NEGATORS), F.lit(False)) | F.coalesce(
            F.when(i >= 2, F.get(words, i - 2)).isin(fixed.NEGATORS), F.lit(False))
        return F.when(before, -p).otherwise(p)

    hits = F.filter(F.transform(words, signed), lambda p: p.isNotNull())
    total = F.aggregate(hits, F.lit(0), lambda a, p: a + p)
    return F.when(F.size(hits) == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total.cast("double") / F.nullif(F.size(hits), F.lit(0)))))


def sentiment_rows(resp: DataFrame) -> DataFrame:
    """Each response with its score and class."""
    out = resp.withColumn("score", sentiment_score(F.col("words")))
    return out.withColumn("sentiment", F.when(F.col("score") > 0.15, "positive").when(F.col("score") < -0.15, "negative")
                          .otherwise("neutral"))


def sentiment_summary(resp: DataFrame, by: list[str] = ()) -> DataFrame:
    """Responses, words per response, shares of positive, neutral and negative, and mean score."""
    rows = sentiment_rows(resp)
    return rows.groupBy(*by).agg(
        F.count("*").alias("responses"), F.avg(F.size("words")).alias("mean_words"),
        *[F.avg((F.col("sentiment") == s).cast("int")).alias(s) for s in ("positive", "neutral", "negative")],
        F.avg("score").alias("score"))
