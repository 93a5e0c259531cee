"""Statistical tests: sufficient statistics by one Spark aggregate, the closed form on the small result."""
from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.expr import col, finite, long_dims, long_metrics, ratio
from ..functions.ranking import average_ranks, quantiles
from ..functions.tails import f_upper, p_chi2, p_f, p_t, t_crit, t_two_sided
from ..session import freeze
from .headers import readable


class Moments:
    """Means, squares and cross products of every pair of k columns over the rows where both are known, which can be merged.

    At [i, j]: n rows with both; mean and square: mean and centred sum of squares of column i over them; cross: centred cross product.
    """

    def __init__(self, n: np.ndarray, mean: np.ndarray, square: np.ndarray, cross: np.ndarray) -> None:
        self.n, self.mean, self.square, self.cross = n, mean, square, cross

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of a batch of rows, NaN where unknown: four matrix products around the columns' own means, so that large ones do not cancel."""
        known = ~np.isnan(x)
        origin = np.where(known, x, 0).sum(0) / np.maximum(known.sum(0), 1)
        z, m = np.where(known, x - origin, 0), known.astype(float)
        n = m.T @ m
        some = np.maximum(n, 1)
        total = z.T @ m
        return cls(n, np.where(n > 0, origin[:, None] + total / some, 0), (z * z).T @ m - total * total / some, z.T @ z - total * total.T / some)

    def merge(self, o: Moments) -> Moments:
        """Both sets of rows together, by the distance of their means."""
        n = self.n + o.n
        some = np.maximum(n, 1)
        away = np.where((self.n > 0) & (o.n > 0), o.mean - self.mean, 0)
        weight = self.n * o.n / some
        mean = np.where(self.n > 0, self.mean, o.mean) + away * o.n / some
        return Moments(n, mean, self.square + o.square + away * away * weight, self.cross + o.cross + away * away.T * weight)

    def pack(self) -> bytes:
        return np.stack([self.n, self.mean, self.square, self.cross]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, k: int) -> Moments:
        return cls(*np.frombuffer(raw).reshape(4, k, k))


def pair_moments(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(a, b, n, mean_a, mean_b, sxx, syy, sxy) of every metric pair over the rows where both are known.

    One scan: each task gathers its rows in one matrix of moments and sends it as one row, whatever the number of pairs; the rows are
    merged in groups of tasks and then together.
    """
    k, i_j = len(metrics), list(combinations(range(len(metrics)), 2))
    slim = df.select(*[finite(m).alias(f"m{i}") for i, m in enumerate(metrics)])

    def gather(batches):
        seen = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            if len(x):
                seen = Moments.of(x) if seen is None else seen.merge(Moments.of(x))
        if seen is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "moments": [seen.pack()]}, schema=pa.schema([("part", pa.int64()), ("moments", pa.binary())]))

    def together(table: pa.Table) -> Moments:
        rows = table.sort_by("part")["moments"].to_pylist()  # in one order, so that sums do not depend on arrival
        return reduce(Moments.merge, (Moments.unpack(r, k) for r in rows))

    def join(table: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([table.sort_by("part")["part"][0].as_py()], pa.int64()), "moments": pa.array([together(table).pack()], pa.binary())})

    def finish(table: pa.Table) -> pa.Table:
        m = together(table)
        rows = [(metrics[i], metrics[j], int(m.n[i, j]), m.mean[i, j], m.mean[j, i], max(m.square[i, j], 0.0), max(m.square[j, i], 0.0), m.cross[i, j]) for i, j in i_j if m.n[i, j] > 0]
        names = ["a", "b", "n", "mean_a", "mean_b", "sxx", "syy", "sxy"]
        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 5]
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

    parts = slim.mapInArrow(gather, "part long, moments binary")
    joined = parts.groupBy(F.floor(F.col("part") / 256)).applyInArrow(join, "part long, moments binary")
    return joined.groupBy().applyInArrow(finish, "a string, b string, n long, mean_a double, mean_b double, sxx double, syy double, sxy double")


def alike_names(a: str, b: str) -> bool:
    """One name, squashed to letters and digits, contains the other."""
    x, y = ("".join(ch for ch in n.lower() if ch.isascii() and ch.isalnum()) for n in (a, b))
    return x in y or y in x


def is_redundant(metrics: list[str]) -> Column:
    """Practically the same measure: |r| >= .98, or alike names.

    The names are compared here and not in the plan, where Spark would push the comparison down to every row.
    """
    test = F.abs("r") >= 0.98
    for a, b in combinations(metrics, 2):
        if alike_names(a, b):
            test = test | ((F.col("a") == a) & (F.col("b") == b))
    return test


def benjamini_hochberg(tests: DataFrame, p: str, q: float = 0.05, within: list[str] = ()) -> DataFrame:
    """`significant` by false discovery control: every p up to the largest rank k with p(k) <= k/m · q.

    `tests` is a small frame of test results.
    """
    keys = [col(c) for c in within] or [F.lit(0)]
    w = Window.partitionBy(*keys)
    k = F.row_number().over(w.orderBy(F.col(p).asc_nulls_last()))
    placed = tests.withColumn("__k", k).withColumn("__m", F.count(p).over(w))
    cut = F.max(F.when(F.col(p) <= F.col("__k") / F.col("__m") * q, F.col("__k"))).over(w)
    return (placed.withColumn("__cut", cut)
            .withColumn("significant", F.coalesce((F.col("__k") <= F.col("__cut")) & F.col(p).isNotNull(), F.lit(False)))
            .drop("__k", "__m", "__cut"))


def correlations(df: DataFrame, metrics: list[str], bands: tuple[float, float] = (0.7, 0.4),
                 p_value: bool = True, ranks: bool = False) -> DataFrame:
    """Pearson r of every pair with interval (Fisher z), strength and redundancy; 4 rows or more, no constants.

    `bands` are the limits of strong and moderate. With `ranks` also spearman, the correlation of the ranks, and nonlinear: it is much the stronger.
    """
    every = pair_moments(df, metrics)
    every = freeze(every) if ranks else every
    m = every.where((F.col("n") >= 4) & (F.col("sxx") > 0) & (F.col("syy") > 0))
    raw = F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))
    x = m.withColumn("r", F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), raw)))
    z, se = F.atanh("r"), 1.96 / F.sqrt(F.col("n") - 3)
    size = F.abs("r")
    out = x.select("a", "b", "n", "r", F.tanh(z - se).alias("ci_low"), F.tanh(z + se).alias("ci_high"),
                   (F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).alias("t"),
                   F.when(size > bands[0], "strong").when(size > bands[1], "moderate").otherwise("weak").alias("strength"),
                   is_redundant(metrics).alias("redundant"))
    if ranks:
        rho = rank_correlations(df, metrics, every).withColumnRenamed("rho", "spearman")
        out = out.join(rho, ["a", "b"], "left").withColumn("nonlinear", is_nonlinear("spearman", "r"))
    if p_value:
        out = benjamini_hochberg(out.withColumn("p", p_t(F.col("t"), F.col("n") - 2)), "p")
    return out.orderBy(F.desc(F.abs("r")), "a", "b")


#: Distinct values of a view whose ranks are sent to all tasks, and views of more values for which whole rows are shuffled.
HELD, WIDE = 50_000, 3


def rank_correlations(df: DataFrame, metrics: list[str], moments: DataFrame | None = None) -> DataFrame:
    """(a, b, rho): Pearson of average ranks, ties sharing the mean rank, for every pair over the rows where both are known.

    The values of all columns are ranked in one range exchange over (column, value). A column that is known in other rows than its partner
    is ranked once more for that pair, over the common rows.
    """
    base = freeze(df.select(*[finite(m).alias(f"m{i}") for i, m in enumerate(metrics)]).withColumn("id", F.monotonically_increasing_id()))
    at = {m: i for i, m in enumerate(metrics)}
    known = base.agg(*[F.count(f"m{i}").alias(f"m{i}") for i in range(len(metrics))]).first()
    common = (moments if moments is not None else pair_moments(df, metrics)).select("a", "b", "n").collect()  # one row a pair
    views, pairs = [(i, None) for i in range(len(metrics))], []
    for r in common:
        i, j = at[r["a"]], at[r["b"]]
        sides = []
        for x, y in ((i, j), (j, i)):
            if known[f"m{x}"] != r["n"]:
                views.append((x, y))
            sides.append(x if known[f"m{x}"] == r["n"] else len(views) - 1)
        pairs.append((r["a"], r["b"], *sides))
    value = [F.col(f"m{x}") if y is None else F.when(F.col(f"m{y}").isNotNull(), F.col(f"m{x}")) for x, y in views]
    long = base.select("id", F.inline(F.array(*[F.struct(F.lit(v).alias("view"), x.alias("value")) for v, x in enumerate(value)]))).where(F.col("value").isNotNull())
    ranks = freeze(average_ranks(long, "value", ["view"]))
    sizes = {r["view"]: r["count"] for r in ranks.groupBy("view").count().collect()}  # one row a view
    if sum(n > HELD for n in sizes.values()) <= WIDE:
        # ranks of few values are sent to all tasks; for each other view the rows, a number a view, are shuffled once
        wide = base.select(*[x.alias(f"v{v}") for v, x in enumerate(value)])
        for v in range(len(views)):
            own = ranks.where(F.col("view") == v).select(F.col("value").alias(f"k{v}"), F.col("avg_rank").alias(f"r{v}"))
            small = sizes.get(v, 0) <= HELD
            wide = wide.join(F.broadcast(own) if small else own, F.col(f"v{v}") == F.col(f"k{v}"), "left").drop(f"v{v}", f"k{v}")
    else:
        wide = long.join(ranks, ["view", "value"]).groupBy("id").agg(*[F.max(F.when(F.col("view") == v, F.col("avg_rank"))).alias(f"r{v}") for v in range(len(views))])
    names = {f"r{x}": f"r{x}" for _, _, *s in pairs for x in s}
    m = pair_moments(wide, sorted(names, key=lambda c: int(c[1:])))
    rho = m.select("a", "b", (F.col("sxy") / F.nullif(F.sqrt(F.col("sxx") * F.col("syy")), F.lit(0.0))).alias("rho"))
    asked = df.sparkSession.createDataFrame([(a, b, f"r{min(x, y)}", f"r{max(x, y)}") for a, b, x, y in pairs], "a string, b string, x string, y string")
    return asked.join(rho.withColumnsRenamed({"a": "x", "b": "y"}), ["x", "y"]).select("a", "b", "rho")


def spearman(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(a, b, n, rho, r, nonlinear) of every pair; nonlinear: the ranks agree far better than a straight line fits."""
    m = freeze(pair_moments(df, metrics))
    r = m.select("a", "b", "n", (F.col("sxy") / F.nullif(F.sqrt(F.col("sxx") * F.col("syy")), F.lit(0.0))).alias("r"))
    out = r.join(rank_correlations(df, metrics, m), ["a", "b"], "left")
    return out.select("a", "b", "n", "rho", "r", is_nonlinear("rho", "r").alias("nonlinear"))


def is_nonlinear(rho: str, r: str) -> Column:
    return (F.abs(rho) - F.abs(r) >= 0.15) & (F.abs(rho) > 0.5)


def simple_regression(df: DataFrame, x: str, y: str, p_value: bool = True) -> DataFrame:
    """One row: slope, intercept, R², adjusted R², standard error, t, F and the 95% interval of the slope."""
    one = df.select(finite(x).alias("x"), finite(y).alias("y")).where("x is not null and y is not null").agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    b = one.where((F.col("sxx") > 0) & (F.col("n") > 2)).withColumn("slope", F.col("sxy") / F.col("sxx"))
    b = b.withColumn("r2", F.coalesce(ratio(F.col("slope") * F.col("sxy"), F.col("syy")), F.lit(0.0)))
    b = b.withColumn("sse", F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)))
    b = b.withColumn("se", F.sqrt(F.col("sse") / (F.col("n") - 2) / F.col("sxx")))
    out = b.select("n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "r2",
                   (1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2)).alias("adj_r2"), "se",
                   ratio("slope", "se").alias("t"), (ratio("slope", "se") * ratio("slope", "se")).alias("f"))
    if p_value:
        half = t_crit(F.col("n") - 2) * F.col("se")
        out = (out.withColumn("p", p_t(F.col("t"), F.col("n") - 2)).withColumn("ci_low", F.col("slope") - half)
               .withColumn("ci_high", F.col("slope") + half))
    return out


def _moment_matrix(df: DataFrame, names: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred cross products) over complete rows, collected as one small frame."""
    complete = df.select(*[finite(c).alias(c) for c in names]).dropna()
    rows = pair_moments(complete, names).collect()
    k = len(names)
    at = {c: i for i, c in enumerate(names)}
    means, s, n = np.zeros(k), np.zeros((k, k)), 0
    for r in rows:
        i, j, n = at[r["a"]], at[r["b"]], r["n"]
        means[i], means[j] = r["mean_a"], r["mean_b"]
        s[i, i], s[j, j] = r["sxx"], r["syy"]
        s[i, j] = s[j, i] = r["sxy"]
    return n, means, s


_COEF = ("target string, term string, coef double, se double, t double, p double, beta double, n long, r2 double, "
         "adj_r2 double, f double, f_p double")


def _solve(n: int, means: np.ndarray, s: np.ndarray, names: list[str], extra: int) -> list[tuple]:
    """OLS of names[0] on the rest from centred cross products; [] when too few rows or singular."""
    k = len(names) - 1
    xx, xy, yy = s[1:, 1:], s[1:, 0], s[0, 0]
    scale = np.sqrt(np.diag(xx))
    if n < k + extra or yy <= 0 or k == 0 or (scale == 0).any():
        return []
    corr = xx / np.outer(scale, scale)
    if np.linalg.cond(corr) > 1e12:
        return []
    inv = np.linalg.inv(corr) / np.outer(scale, scale)
    coef = inv @ xy
    dof = n - k - 1
    sse = max(float(yy - coef @ xy), 0.0)
    r2 = 1.0 - sse / yy
    se = np.sqrt(sse / dof * np.diag(inv))
    adj = 1.0 - (1.0 - r2) * (n - 1) / dof
    f = (r2 / k) / ((1.0 - r2) / dof) if r2 < 1 else float("inf")
    f_p = f_upper(f, k, dof) if np.isfinite(f) else 0.0
    a0 = float(means[0] - coef @ means[1:])
    se0 = float(np.sqrt(sse / dof * (1.0 / n + means[1:] @ inv @ means[1:])))
    rows = [("intercept", a0, se0, None)] + [
        (names[i + 1], float(coef[i]), float(se[i]), float(coef[i] * np.sqrt(s[i + 1, i + 1] / yy))) for i in range(k)]
    out = []
    for term, c, e, beta in rows:
        t = float(c / e) if e > 0 else None
        out.append((names[0], term, c, e, t, t_two_sided(t, dof) if t is not None else None, beta, int(n), float(r2), float(adj), float(f), float(f_p)))
    return out


def multiple_regression(df: DataFrame, target: str, predictors: list[str]) -> DataFrame:
    """(term, coef, se, t, p, beta, …) of the linear model over complete rows; empty when it cannot be solved."""
    names = [target, *predictors]
    n, means, s = _moment_matrix(df, names)
    return df.sparkSession.createDataFrame(_solve(n, means, s, names, 3), _COEF)


def drivers(df: DataFrame, target: str, candidates: list[str]) -> DataFrame:
    """Which metrics move the target on their own: standardised regression, strongest first.

    Constant predictors and those nearly derived from the target (|r| >= .95) are left out; two or more must remain.
    """
    names = [target, *[c for c in candidates if c != target]]
    n, means, s = _moment_matrix(df, names)
    r = [abs(s[0, i]) / np.sqrt(s[0, 0] * s[i, i]) if s[0, 0] > 0 and s[i, i] > 0 else 1.0 for i in range(len(names))]
    use = [0] + [i for i in range(1, len(names)) if s[i, i] > 0 and r[i] < 0.95]
    rows = _solve(n, means[use], s[np.ix_(use, use)], [names[i] for i in use], 5) if len(use) > 2 else []
    out = df.sparkSession.createDataFrame([x for x in rows if x[1] != "intercept"], _COEF)
    return out.withColumn("significant", F.col("p") < 0.05).orderBy(F.desc(F.abs("beta")), "term")


def welch(df: DataFrame, dim: str, a: str, b: str, metric: str, p_value: bool = True) -> DataFrame:
    """One row: Welch's t of a metric between two values of a dimension."""
    x, k = finite(metric), col(dim).cast("string")
    sides = df.where(k.isin(a, b)).agg(*[
        f(F.when(k == v, x)).alias(f"{n}_{s}") for s, v in (("a", a), ("b", b))
        for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = (F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(va + vb), F.lit(0.0))
    dof = (va + vb) ** 2 / F.nullif(va ** 2 / (F.col("n_a") - 1) + vb ** 2 / (F.col("n_b") - 1), F.lit(0.0))
    out = sides.select("n_a", "n_b", "mean_a", "mean_b", t.alias("t"), dof.alias("df"))
    return out.withColumn("p", p_t(F.col("t"), F.col("df"))) if p_value else out


def group_moments(df: DataFrame, dims: list[str], metrics: list[str]) -> DataFrame:
    """(dimension, metric, key, n, mean, ss) of every metric in every group of every dimension, in one shuffle."""
    base = df.select(*[col(d) for d in dims], *[finite(m).alias(f"__m{i}") for i, m in enumerate(metrics)])
    long = long_dims(base, dims, [f"__m{i}" for i in range(len(metrics))]).where(F.col("key").isNotNull())
    stats = [F.struct(F.lit(m).alias("metric"), F.count(f"__m{i}").alias("n"), F.avg(f"__m{i}").alias("mean"),
                      (F.var_pop(f"__m{i}") * F.count(f"__m{i}")).alias("ss")).alias(f"s{i}") for i, m in enumerate(metrics)]
    wide = long.groupBy("dimension", "key").agg(*stats)
    return wide.select("dimension", "key", F.inline(F.array(*[F.col(f"s{i}") for i in range(len(metrics))])))


def anova(groups: DataFrame, p_value: bool = True, sizes: tuple[int, int] | None = None) -> DataFrame:
    """One-way analysis of variance per (dimension, metric) from group moments; groups of one row are left out.

    With `sizes` only dimensions of so many groups. Their number and the grand mean come first, by a grouping that keeps one row a pair, so the groups
    of a wide dimension never meet in a task.
    """
    g = groups.where(F.col("n") >= 2)
    grand = g.groupBy("dimension", "metric").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.count("*").alias("groups"))
    if sizes:
        grand = grand.where(F.col("groups").between(*sizes))
    top, bottom = F.struct("mean", "key"), F.struct("mean", "key")
    one = g.join(grand.drop("groups"), ["dimension", "metric"]).groupBy("dimension", "metric").agg(
        F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum("ss").alias("within"),
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("between"),
        F.max_by("key", top).alias("top"), F.max("mean").alias("top_mean"), F.min_by("key", bottom).alias("bottom"),
        F.min("mean").alias("bottom_mean"), F.min_by("n", bottom).alias("bottom_n"))
    out = one.where("groups >= 2").select(
        "dimension", "metric", "groups", "rows",
        ratio(F.col("between") / (F.col("groups") - 1), F.col("within") / (F.col("rows") - F.col("groups"))).alias("f"),
        ratio("between", F.col("between") + F.col("within")).alias("eta_sq"),
        "top", "top_mean", "bottom", "bottom_mean", "bottom_n")
    return out.withColumn("p", p_f(F.col("f"), F.col("groups") - 1, F.col("rows") - F.col("groups"))) if p_value else out


def value_tautology(metric: Column, dimension: Column) -> Column:
    """A higher average only means a dearer product: the metric is a unit price or the dimension is the product."""
    return readable(metric).rlike(fixed.UNIT_PRICE_ONLY) | readable(dimension).rlike(fixed.PRODUCT_NAME)


def group_comparisons(df: DataFrame, dims: list[str], metrics: list[str], top: int = 4) -> DataFrame:
    """Which group differences are real: analysis of variance for every dimension of 2 to 20 values and every metric."""
    tests = anova(group_moments(df, dims, metrics), sizes=(2, 20))
    out = benjamini_hochberg(tests, "p").withColumn("tautology", value_tautology(F.col("metric"), F.col("dimension")))
    return out.orderBy(F.desc("significant"), F.desc("eta_sq"), "dimension", "metric").limit(top)


def pair_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """(a, b, va, vb, n): joint counts of every dimension pair, in one shuffle."""
    slim = df.select(*[col(d).cast("string").alias(f"d{i}") for i, d in enumerate(dims)])
    pairs = [F.struct(F.lit(dims[i]).alias("a"), F.lit(dims[j]).alias("b"), F.col(f"d{i}").alias("va"), F.col(f"d{j}").alias("vb"))
             for i, j in combinations(range(len(dims)), 2)]
    both = slim.select(F.inline(F.array(*pairs))).where(F.col("va").isNotNull() & F.col("vb").isNotNull())
    return both.groupBy("a", "b", "va", "vb").agg(F.count("*").alias("n"))


def chi_square(counts: DataFrame) -> DataFrame:
    """(a, b, chi2, df, p, cramers_v, n) from joint counts; empty cells enter through the totals."""
    rows = counts.groupBy("a", "b", "va").agg(F.sum("n").alias("rn"))
    cols = counts.groupBy("a", "b", "vb").agg(F.sum("n").alias("cn"))
    cells = counts.join(rows, ["a", "b", "va"]).join(cols, ["a", "b", "vb"])
    inner = cells.groupBy("a", "b").agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("rn").cast("double") * F.col("cn"))).alias("q"),
        F.count_distinct("va").alias("r"), F.count_distinct("vb").alias("c"))
    chi = F.greatest(F.col("n") * (F.col("q") - 1), F.lit(0.0))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    out = inner.where("r >= 2 and c >= 2").select("a", "b", "r", "c", F.col("n").cast("long").alias("n"), chi.alias("chi2"), dof.alias("df"))
    v = F.sqrt(ratio(F.col("chi2"), F.col("n") * (F.least("r", "c") - 1)))
    return out.withColumn("cramers_v", v).withColumn("p", p_chi2(F.col("chi2"), F.col("df")))


def associations(df: DataFrame, dims: list[str], top: int = 4) -> DataFrame:
    """Dimension pairs (2 to 15 values each) that go together, by (significant, V).

    A sketch of the number of values of every dimension, in one pass, leaves out wide ones before any pair is counted; the exact rule follows.
    """
    sketches = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.coalesce(col(d).cast("string"), F.lit("")))).alias(f"d{i}") for i, d in enumerate(dims)]).first()
    dims = [d for i, d in enumerate(dims) if sketches[f"d{i}"] <= 20]  # 15, one for NULL, and room for the sketch's error
    if len(dims) < 2:
        return chi_square(pair_counts(df.limit(0).withColumns({"__a": F.lit(""), "__b": F.lit("")}), ["__a", "__b"])).withColumn("significant", F.lit(False))
    tests = chi_square(pair_counts(df, dims)).where(F.col("r").between(2, 15) & F.col("c").between(2, 15))
    return (tests.withColumn("significant", F.col("p") < 0.05)
            .orderBy(F.desc("significant"), F.desc("cramers_v"), "a", "b").limit(top))


def relationships(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Full symmetric matrix in long form (a, b, r, strength, redundant) with a unit diagonal."""
    pairs = correlations(df, metrics, bands=(0.6, 0.3), p_value=False)
    slim = pairs.select("a", "b", "r", "redundant")
    mirrored = slim.unionByName(slim.select(F.col("b").alias("a"), F.col("a").alias("b"), "r", "redundant"))
    names = mirrored.select("a").distinct()
    diagonal = names.select("a", F.col("a").alias("b"), F.lit(1.0).alias("r"), F.lit(False).alias("redundant"))
    size = F.abs("r")
    return mirrored.unionByName(diagonal).withColumn(
        "strength", F.when(size >= 0.6, "strong").when(size >= 0.3, "moderate").otherwise("weak"))


def heatmap(df: DataFrame, metrics: list[str], digits: int = 3) -> DataFrame:
    """The matrix in display form: one row per metric, one column per metric."""
    return relationships(df, metrics).groupBy("a").pivot("b", metrics).agg(F.round(F.first("r"), digits))


def strongest_pair(df: DataFrame, metrics: list[str], least: float = 0.3, of: str | None = None) -> DataFrame:
    """The strongest pair above `least` that is not redundant; with `of`, the strongest correlate of that metric."""
    out = correlations(df, metrics, p_value=False).where((F.abs("r") > least) & ~F.col("redundant"))
    if of:
        out = out.where((F.col("a") == of) | (F.col("b") == of))
    return out.orderBy(F.desc(F.abs("r")), "a", "b").limit(1)


def distributions(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Shape of each metric: skew, excess kurtosis, Jarque-Bera and its exact p; 20 rows or more, not constant."""
    long = long_metrics(df, metrics).where(F.col("value").isNotNull())
    one = long.groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
                                     F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skew") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    out = one.where("n >= 20 and sd > 0").withColumn("jarque_bera", jb).withColumn("p", F.exp(-F.col("jarque_bera") / 2))
    shape = F.when(F.col("skew") > 0.5, "right-skewed").when(F.col("skew") < -0.5, "left-skewed").otherwise("symmetric")
    return out.withColumn("normal", F.col("p") > 0.05).withColumn("shape", shape)


def describe(df: DataFrame, metrics: list[str]) -> DataFrame:
    """n, mean, sd, cv, min, quartiles, max, population skew and excess kurtosis of each metric."""
    long = long_metrics(df, metrics).where(F.col("value").isNotNull())
    one = long.groupBy("metric").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.coalesce(F.skewness("value"), F.lit(0.0)).alias("skew"),
        F.coalesce(F.kurtosis("value"), F.lit(0.0)).alias("kurtosis"))
    q = quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["metric"])
    return one.join(q, "metric").withColumn("cv", ratio("sd", F.abs("mean")))
