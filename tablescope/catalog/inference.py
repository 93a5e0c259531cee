"""Statistical tests over lineitem, orders, events and labels."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import stats as K
from .book import Book
from .concentration import rounded

book = Book()

METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = list(combinations(METRICS, 2))

PEARSON = "r as (" + " union all ".join(
    f"select '{a}' as a, '{b}' as b, count(*) as n, corr({a}, {b}) as r from lineitem" for a, b in PAIRS) + ")"


@book.add("k1_correlations", f"""with {PEARSON} select a, b, n, round(r, 6) as r, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) as ci_low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) as ci_high,
  round(r * sqrt((n - 2) / (1 - r * r)), 4) as t, case when abs(r) > .7 then 'strong' when abs(r) > .4 then 'moderate' else 'weak' end as strength, abs(r) >= .98 as redundant from r""")
def _(t):
    return rounded(K.correlations(t.lineitem, METRICS, p_value=False), {"r": 6, "ci_low": 6, "ci_high": 6, "t": 4})


@book.add("k1_correlations_with_p")
def _(t):
    return rounded(K.correlations(t.lineitem, METRICS), {"r": 6, "ci_low": 6, "ci_high": 6, "t": 4, "p": 8})


SPEAR = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_discount", "l_tax")]


def _spear(a: str, b: str) -> str:
    return f"""select '{a}' as a, '{b}' as b, count(*) as n, corr(x, y) as rho, corr(u, v) as r from (select {a} as u, {b} as v,
  rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as x, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as y from lineitem)"""


@book.add("k2_spearman", "with s as (" + " union all ".join(_spear(a, b) for a, b in SPEAR) + """) select a, b, n, round(rho, 6) as rho, round(r, 6) as r,
  abs(rho) - abs(r) >= .15 and abs(rho) > .5 as nonlinear from s""")
def _(t):
    metrics = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(K.spearman(t.lineitem, metrics).where(F.struct("a", "b").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in SPEAR])), {"rho": 6, "r": 6})


_SHAPE = """mo as (select metric, count(*) as n, avg(v) as mean, median(v) as md, stddev_pop(v) as sd, min(v) as mn, max(v) as mx from v group by 1),
sk as (select v.metric, avg(pow((v - mean) / sd, 3)) as skew, avg(pow((v - mean) / sd, 4)) - 3 as kurtosis from v join mo using (metric) group by 1),
jb as (select mo.*, skew, kurtosis, n / 6.0 * (skew * skew + kurtosis * kurtosis / 4) as jarque_bera from mo join sk using (metric))"""
_MONTHLY_P = """v as (select strftime(date_trunc('month', o_orderdate), '%Y-%m') as metric, o_totalprice as v from orders)"""


@book.add("k3_false_discovery", f"""with {_MONTHLY_P}, {_SHAPE}, p as (select metric as month, exp(-jarque_bera / 2) as p from jb where n >= 20), k as (select *, row_number() over (order by p) as k, count(*) over () as m from p),
c as (select coalesce(max(k) filter (p <= k / m * 0.05), 0) as cut from k) select month, round(p, 8) as p, k <= cut as significant from k, c""")
def _(t):
    by = (t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
          .agg(F.count("*").alias("n"), F.skewness("o_totalprice").alias("s"), F.kurtosis("o_totalprice").alias("k")).where("n >= 20"))
    jb = F.col("n") / 6.0 * (F.col("s") ** 2 + F.col("k") ** 2 / 4)
    out = K.benjamini_hochberg(by.select("month", F.exp(-jb / 2).alias("p")), "p")
    return out.withColumn("p", rnd("p", 8))


@book.add("k5_simple_regression", """with s as (select count(*) as n, regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, regr_r2(l_extendedprice, l_quantity) as r2,
  regr_sxx(l_extendedprice, l_quantity) as sxx, regr_syy(l_extendedprice, l_quantity) as syy from lineitem), e as (select *, sqrt(syy * (1 - r2) / (n - 2) / sxx) as se from s)
select n, round(b, 4) as slope, round(a, 3) as intercept, round(r2, 6) as r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) as adj_r2, round(se, 6) as se, round(b / se, 3) as t from e""")
def _(t):
    out = K.simple_regression(t.lineitem, "l_quantity", "l_extendedprice", p_value=False).drop("f")
    return rounded(out, {"slope": 4, "intercept": 3, "r2": 6, "adj_r2": 6, "se": 6, "t": 3})


@book.add("k6_scatter_line", """select round(regr_slope(o_totalprice, o_custkey), 6) as slope, round(regr_intercept(o_totalprice, o_custkey), 3) as intercept, round(regr_r2(o_totalprice, o_custkey), 8) as r2 from orders""")
def _(t):
    out = K.simple_regression(t.orders, "o_custkey", "o_totalprice", p_value=False)
    return out.select(rnd("slope", 6).alias("slope"), rnd("intercept", 3).alias("intercept"), rnd("r2", 8).alias("r2"))


_TWO = """c as (select count(*) as n, avg(l_extendedprice) as my, avg(l_quantity) as m1, avg(l_tax) as m2, var_pop(l_extendedprice) * count(*) as yy, var_pop(l_quantity) * count(*) as s11,
  var_pop(l_tax) * count(*) as s22, covar_pop(l_quantity, l_tax) * count(*) as s12, covar_pop(l_quantity, l_extendedprice) * count(*) as s1y, covar_pop(l_tax, l_extendedprice) * count(*) as s2y from lineitem),
d as (select *, s11 * s22 - s12 * s12 as det from c), b as (select *, (s22 * s1y - s12 * s2y) / det as b1, (s11 * s2y - s12 * s1y) / det as b2 from d),
f as (select *, yy - b1 * s1y - b2 * s2y as sse from b), g as (select *, 1 - sse / yy as r2, sse / (n - 3) as mse from f)"""


@book.add("k7_multiple_regression", f"""with {_TWO} select 'l_quantity' as term, round(b1, 4) as coef, round(sqrt(mse * s22 / det), 6) as se, round(b1 * sqrt(s11 / yy), 6) as beta, n, round(r2, 6) as r2,
  round((r2 / 2) / ((1 - r2) / (n - 3)), 2) as f from g
 union all select 'l_tax', round(b2, 4), round(sqrt(mse * s11 / det), 6), round(b2 * sqrt(s22 / yy), 6), n, round(r2, 6), round((r2 / 2) / ((1 - r2) / (n - 3)), 2) from g
 union all select 'intercept', round(my - b1 * m1 - b2 * m2, 4), round(sqrt(mse * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)), 6), null, n, round(r2, 6), round((r2 / 2) / ((1 - r2) / (n - 3)), 2) from g""")
def _(t):
    out = K.multiple_regression(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"])
    return rounded(out.select("term", "coef", "se", "beta", "n", "r2", "f"), {"coef": 4, "se": 6, "beta": 6, "r2": 6, "f": 2})


@book.add("k8_drivers", f"""with {_TWO} select 'l_quantity' as term, round(b1 * sqrt(s11 / yy), 6) as beta, round(r2, 6) as r2, n from g union all select 'l_tax', round(b2 * sqrt(s22 / yy), 6), round(r2, 6), n from g""")
def _(t):
    li = t.lineitem.withColumn("net", F.col("l_extendedprice") * 0.9).withColumn("fixed", F.lit(1.0))  # derived and constant: left out
    out = K.drivers(li, "l_extendedprice", ["l_quantity", "l_tax", "net", "fixed"])
    return rounded(out.select("term", "beta", "r2", "n"), {"beta": 6, "r2": 6})


@book.add("k8_drivers_with_p")
def _(t):
    out = K.drivers(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax", "l_discount", "l_linenumber"])
    return rounded(out, {"coef": 4, "se": 6, "t": 4, "p": 8, "beta": 6, "r2": 6, "adj_r2": 6, "f": 2, "f_p": 8})


@book.add("k9_welch", """with s as (select count(*) filter (o_orderstatus = 'F') as n_a, count(*) filter (o_orderstatus = 'O') as n_b, avg(o_totalprice) filter (o_orderstatus = 'F') as ma, avg(o_totalprice) filter (o_orderstatus = 'O') as mb,
  var_samp(o_totalprice) filter (o_orderstatus = 'F') / count(*) filter (o_orderstatus = 'F') as va, var_samp(o_totalprice) filter (o_orderstatus = 'O') / count(*) filter (o_orderstatus = 'O') as vb from orders)
select n_a, n_b, round(ma, 4) as mean_a, round(mb, 4) as mean_b, round((ma - mb) / sqrt(va + vb), 6) as t, round((va + vb) ** 2 / (va ** 2 / (n_a - 1) + vb ** 2 / (n_b - 1)), 3) as df from s""")
def _(t):
    return rounded(K.welch(t.orders, "o_orderstatus", "F", "O", "o_totalprice", p_value=False), {"mean_a": 4, "mean_b": 4, "t": 6, "df": 3})


_GROUPS = "g as (" + " union all ".join(
    f"select '{d}' as dimension, '{m}' as metric, {d} as key, count({m}) as n, avg({m}) as mean, var_pop({m}) * count({m}) as ss from lineitem group by 3"
    for d in ["l_returnflag", "l_linestatus"] for m in ["l_extendedprice", "l_quantity", "l_discount"]) + """),
a as (select g.*, sum(n * mean) over w / sum(n) over w as grand from g window w as (partition by dimension, metric)),
s as (select dimension, metric, count(*) as groups, sum(n)::bigint as rows, sum(ss) as within_, sum(n * (mean - grand) ** 2) as between_, arg_max(key, mean) as top, max(mean) as top_mean, arg_min(key, mean) as bottom, min(mean) as bottom_mean from a group by 1, 2),
f as (select *, (between_ / (groups - 1)) / (within_ / (rows - groups)) as f, between_ / (between_ + within_) as eta_sq from s)"""


@book.add("k10_anova", f"""with {_GROUPS} select dimension, metric, groups, rows, round(f, 6) as f, round(eta_sq, 8) as eta_sq, top, round(top_mean, 4) as top_mean, bottom, round(bottom_mean, 4) as bottom_mean,
  case when groups = 3 then round(pow(1 + 2 * f / (rows - 3), -(rows - 3) / 2.0), 8) end as p from f""")
def _(t):
    out = K.anova(K.group_moments(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity", "l_discount"])).drop("bottom_n")
    out = out.withColumn("p", F.when(F.col("groups") == 3, F.col("p")))  # the closed form with 2 degrees of freedom
    return rounded(out, {"f": 6, "eta_sq": 8, "top_mean": 4, "bottom_mean": 4, "p": 8})


@book.add("k11_group_comparisons")
def _(t):
    out = K.group_comparisons(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_extendedprice", "l_quantity", "l_discount"])
    return rounded(out, {"f": 6, "eta_sq": 8, "top_mean": 4, "bottom_mean": 4, "p": 8})


_CHI = """j as (select l_returnflag, l_linestatus, o_orderpriority from lineitem join orders on l_orderkey = o_orderkey),
k as (select 'l_returnflag' as a, 'l_linestatus' as b, l_returnflag as va, l_linestatus as vb, count(*) as n from j group by 3, 4
 union all select 'l_returnflag', 'o_orderpriority', l_returnflag, o_orderpriority, count(*) from j group by 3, 4
 union all select 'l_linestatus', 'o_orderpriority', l_linestatus, o_orderpriority, count(*) from j group by 3, 4),
z as (select *, sum(n) over (partition by a, b, va) as rn, sum(n) over (partition by a, b, vb) as cn, sum(n) over (partition by a, b) as tn from k),
c as (select a, b, count(distinct va) as r, count(distinct vb) as c, max(tn)::bigint as n, sum((n - rn * cn / tn) ** 2 / (rn * cn / tn)) as chi2 from z group by 1, 2),
x as (select *, (r - 1) * (c - 1) as df, chi2 / 2 as h from c)"""


@book.add("k12_associations", f"""with {_CHI} select a, b, r, c, n, round(chi2, 6) as chi2, df, round(sqrt(chi2 / (n * (least(r, c) - 1))), 6) as cramers_v,
  round(exp(-h) * case df when 2 then 1 when 4 then 1 + h when 8 then 1 + h + h * h / 2 + h * h * h / 6 end, 8) as p from x""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = K.associations(j, ["l_returnflag", "l_linestatus", "o_orderpriority"]).drop("significant")
    return rounded(out, {"chi2": 6, "cramers_v": 6, "p": 8})


@book.add("k12_labels_association", """with k as (select quality, toxic, count(*) as n from labels group by 1, 2), z as (select *, sum(n) over (partition by quality) as rn, sum(n) over (partition by toxic) as cn, sum(n) over () as tn from k)
select max(tn)::bigint as n, round(max(tn) * (sum(n * n / (rn * cn)) - 1), 6) as chi2, round(sqrt(sum(n * n / (rn * cn)) - 1), 6) as cramers_v from z""")
def _(t):
    out = K.chi_square(K.pair_counts(t.labels, ["quality", "toxic"]))
    return out.select("n", rnd("chi2", 6).alias("chi2"), rnd("cramers_v", 6).alias("cramers_v"))


_ALL = f"""{PEARSON}, m as (select a, b, r from r union all select b, a, r from r union all select distinct a, a, 1.0 from (select a from r union select b from r))"""


@book.add("k13_relationships", f"""with {_ALL} select a, b, round(r, 6) as r, a <> b and abs(r) >= .98 as redundant, case when abs(r) >= .6 then 'strong' when abs(r) >= .3 then 'moderate' else 'weak' end as strength from m""")
def _(t):
    return rounded(K.relationships(t.lineitem, METRICS), {"r": 6})


@book.add("k14_redundant_pairs", """select 'o_totalprice' as a, 'totalprice' as b, true as redundant union all select 'o_totalprice', 'gross', true union all select 'totalprice', 'gross', true
 union all select 'o_totalprice', 'o_custkey', abs((select corr(o_totalprice, o_custkey) from orders)) >= .98 union all select 'totalprice', 'o_custkey', false union all select 'gross', 'o_custkey', false""")
def _(t):
    o = t.orders.withColumn("totalprice", F.sqrt("o_totalprice")).withColumn("gross", F.col("o_totalprice") * 1.2 + 3)
    out = K.correlations(o, ["o_totalprice", "totalprice", "gross", "o_custkey"], p_value=False)
    return out.select("a", "b", "redundant")


@book.add("k15_heatmap", f"with {_ALL} select a, " + ", ".join(f"max(round(r, 3) + 0.0) filter (b = '{m}') as {m}" for m in METRICS) + " from m group by a")
def _(t):
    return K.heatmap(t.lineitem, METRICS)


@book.add("k16_strongest_pair", """with l as (select l_discount, l_extendedprice * l_discount as saving, l_extendedprice, l_tax from lineitem),
r as (select 'saving' as a, 'l_discount' as b, corr(saving, l_discount) as r from l union all select 'saving', 'l_extendedprice', corr(saving, l_extendedprice) from l
 union all select 'l_discount', 'l_tax', corr(l_discount, l_tax) from l union all select 'saving', 'l_tax', corr(saving, l_tax) from l)
select a, b, round(r, 6) as r from r where abs(r) > .3 and abs(r) < .98 order by abs(r) desc limit 1""")
def _(t):
    li = t.lineitem.withColumn("saving", F.col("l_extendedprice") * F.col("l_discount"))
    out = K.strongest_pair(li, ["saving", "l_discount", "l_extendedprice", "l_tax"])
    return rounded(out.select("a", "b", "r"), {"r": 6})


_V = "v as (" + " union all ".join(f"select '{m}' as metric, {m}::double as v from lineitem" for m in METRICS) + ")"


@book.add("k17_distributions", f"""with {_V}, {_SHAPE} select metric, n, round(mean, 4) as mean, round(skew, 6) as skew, round(kurtosis, 6) as kurtosis, round(jarque_bera, 3) as jarque_bera, round(exp(-jarque_bera / 2), 8) as p,
  exp(-jarque_bera / 2) > .05 as normal, case when skew > .5 then 'right-skewed' when skew < -.5 then 'left-skewed' else 'symmetric' end as shape from jb where n >= 20 and sd > 0""")
def _(t):
    return rounded(K.distributions(t.lineitem, METRICS).drop("sd"), {"mean": 4, "skew": 6, "kurtosis": 6, "jarque_bera": 3, "p": 8})


@book.add("c5_describe", f"""with {_V}, {_SHAPE}, q as (select metric, quantile_cont(v, .25) as q1, median(v) as median, quantile_cont(v, .75) as q3, stddev_samp(v) as sds from v group by 1)
select jb.metric, n, round(mean, 4) as mean, round(sds, 4) as sd, mn as min, mx as max, round(skew, 6) as skew, round(kurtosis, 6) as kurtosis, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3, round(sds / abs(mean), 6) as cv
from jb join q using (metric)""")
def _(t):
    return rounded(K.describe(t.lineitem, METRICS), {"mean": 4, "sd": 4, "skew": 6, "kurtosis": 6, "q1": 4, "median": 4, "q3": 4, "cv": 6})
