"""Concentration, best sellers and headline figures over lineitem joined with part, and orders."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import concentration as C
from ..operators import kpi as K
from ..operators import profile as P
from ..operators.timeseries import period_sums
from ..session import localize
from .book import Book

book = Book()

DIMS = ["p_brand", "p_type", "l_suppkey"]


def items(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))


def totals(t):
    return C.dimension_totals(items(t), DIMS, ["l_extendedprice", "l_quantity"])


TOTALS_SQL = """j as (select * from lineitem join part on l_partkey = p_partkey),
tot as (""" + " union all ".join(
    f"select '{d}' as dimension, '{m}' as metric, cast({d} as varchar) as key, sum({m}) as value from j group by 3"
    for d in DIMS for m in ["l_extendedprice", "l_quantity"]) + """),
rk as (select *, row_number() over (partition by dimension, metric order by round(value, 4) desc, key) as rank,
  sum(value) over (partition by dimension, metric order by round(value, 4) desc, key rows unbounded preceding) as cum,
  sum(value) over (partition by dimension, metric) as total, count(*) over (partition by dimension, metric) as n from tot where value > 0)"""


def rounded(df, digits: dict):
    return df.select(*[(rnd(c, digits[c]) if c in digits else F.col(c)).alias(c) for c in df.columns])


def ranked(t):
    return C.ranked_totals(totals(t).withColumn("value", F.round("value", 4)))


@book.add("g9_vital_few", f"""with {TOTALS_SQL} select dimension, metric, key, round(value, 2) as value, round(value / total, 6) as share,
  round(cum / total, 6) as cum_share, rank from rk where (cum - value) / total < 0.8""")
def _(t):
    return rounded(C.members(ranked(t)), {"value": 2, "share": 6, "cum_share": 6})


@book.add("g10_gini", """with c as (select o_custkey, sum(o_totalprice) as v, count(*)::double as n from orders group by 1),
r as (select v, n, row_number() over (order by v) as i, row_number() over (order by n) as k, count(*) over () as m from c)
select 'value' as measure, round(sum((2 * i - m - 1) * v) / (max(m) * sum(v)), 6) as gini from r
union all select 'orders', round(sum((2 * k - m - 1) * n) / (max(m) * sum(n)), 6) from r""")
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("value"), F.count("*").cast("double").alias("orders"))
    long = per.unpivot(["o_custkey"], ["value", "orders"], "measure", "v")
    return C.gini(long, "v", ["measure"]).withColumn("gini", rnd("gini", 6))


_PROFILE = """select dimension, metric, max(total) as total, max(n) as n, coalesce(min(rank) filter (cum / total >= 0.8), max(n)) as pareto_count,
 coalesce(min(cum / total) filter (cum / total >= 0.8), 1) as pareto_share, max(value / total) as top_share,
 sum((2 * (n - rank + 1) - n - 1) * value) / (max(n) * max(total)) as gini, sum((value / total) * (value / total)) as hhi from rk group by 1, 2"""


@book.add("g11_concentration_profile", f"""with {TOTALS_SQL}, p as ({_PROFILE})
select dimension, metric, round(total, 2) as total, cast(n as bigint) as "distinct", cast(pareto_count as bigint) as pareto_count, round(pareto_share, 6) as pareto_share,
 round(top_share, 6) as top_share, round(gini, 6) as gini, round(hhi, 6) as hhi, case when gini >= .6 then 'high' when gini >= .4 then 'moderate' else 'low' end as level
from p where n >= 4""")
def _(t):
    return rounded(C.profile(ranked(t)), {"total": 2, "pareto_share": 6, "top_share": 6, "gini": 6, "hhi": 6})


@book.add("g11_concentration_segments", f"""with {TOTALS_SQL}
select dimension, metric, least(rank, 9) as rank, case when least(rank, 9) <= 8 then min(key) else
   'Other (' || (max(n) - 8) || case when max(n) = 9 then ' category)' else ' categories)' end end as key,
 round(sum(value), 2) as value, round(sum(value) / max(total), 6) as share, round(max(cum) / max(total), 6) as cum_share, least(rank, 9) > 8 as is_other
from rk group by dimension, metric, least(rank, 9)""")
def _(t):
    out = C.segments(ranked(t)).withColumn("rank", F.col("rank").cast("long"))
    return rounded(out, {"value": 2, "share": 6, "cum_share": 6})


_SALES = """o as (select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as status, o_orderpriority as priority, o_totalprice as sales_amount, o_totalprice / 7 as score_rate,
  'b' || cast(floor(log2(o_orderkey + 1)) as int) as order_band from orders)"""


@book.add("g12_analyze_concentration", f"""with {_SALES}, dims as (select 'customer_id' as dimension, cast(customer_id as varchar) as key, sales_amount as v from o
 union all select 'priority', priority, sales_amount from o union all select 'order_band', order_band, sales_amount from o),
t as (select dimension, key, 'sales_amount' as metric, sum(v) as value from dims group by 1, 2 union all select dimension, key, 'row count', count(*)::double from dims group by 1, 2),
rk as (select *, row_number() over (partition by dimension, metric order by value desc, key) as rank, sum(value) over (partition by dimension, metric) as total, count(*) over (partition by dimension, metric) as n from t),
p as (select dimension, metric, max(n) as n, sum((2 * (n - rank + 1) - n - 1) * value) / (max(n) * max(total)) as gini from rk group by 1, 2 having max(n) >= 4 and max(n) < (select count(*) from o)),
b as (select *, row_number() over (partition by dimension order by metric = 'row count', gini desc) as r from p)
select dimension, metric, cast(n as bigint) as "distinct", round(gini, 6) as gini from b where r = 1 and gini >= 0.3 order by gini desc limit 3""")
def _(t):
    """Measures and dimensions are chosen from the profile: a rate is no measure, a status of three values and a key of each row are no dimensions."""
    o = t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
                        F.col("o_totalprice").alias("sales_amount"), (F.col("o_totalprice") / 7).alias("score_rate"), F.concat(F.lit("b"), F.floor(F.log2(F.col("o_orderkey") + 1)).cast("int").cast("string")).alias("order_band"))
    prof = localize(P.override_roles(P.profile(o, "orders"), {"customer_id": "identifier", "order_id": "identifier"}))
    kinds = P.metric_kinds(prof, P.key_metrics(prof))
    out = C.analyze(o, [r["column"] for r in C.measures(prof, kinds).collect()], [r["column"] for r in C.dimensions(prof).collect()])
    return out.select("dimension", "metric", "distinct", rnd("gini", 6).alias("gini"))


_SELLERS = """j as (select * from lineitem join part on l_partkey = p_partkey),
s as (select 'p_brand' as dimension, p_brand as key, sum(l_extendedprice) as revenue, sum(l_quantity) as units from j group by 2
 union all select 'p_type', p_type, sum(l_extendedprice), sum(l_quantity) from j group by 2
 union all select 'l_returnflag', l_returnflag, sum(l_extendedprice), sum(l_quantity) from j group by 2
 union all select 'l_orderkey', l_orderkey::varchar, sum(l_extendedprice), sum(l_quantity) from j group by 2),
z as (select *, sum(revenue) over (partition by dimension) as tr, sum(units) over (partition by dimension) as tu, count(*) over (partition by dimension) as n,
  row_number() over (partition by dimension order by revenue, key) as i from s),
g as (select dimension, sum((2 * i - n - 1) * revenue) / (max(n) * max(tr)) as gini, max(n) as n from z group by 1 having max(n) between 2 and 60),
best as (select dimension, gini from g order by gini desc, dimension limit 1),
r as (select dimension, key, revenue, units, tr, tu, n, gini, row_number() over (order by revenue desc, key) as rr, row_number() over (order by units desc, key) as ur from z join best using (dimension))"""


@book.add("g13_best_sellers", f"""with {_SELLERS} select dimension, key, round(revenue, 2) as revenue, round(revenue / tr, 6) as revenue_share, units,
  round(units / tu, 6) as unit_share, rr as revenue_rank, ur as units_rank, round(gini, 6) as gini, cast(n as bigint) as "distinct" from r where rr <= 6 or ur <= 6""")
def _(t):
    out = C.best_sellers(items(t), ["p_brand", "p_type", "l_returnflag", "l_orderkey"], "l_extendedprice", "l_quantity", identifiers=["l_orderkey"])
    return rounded(out, {"revenue": 2, "revenue_share": 6, "unit_share": 6, "gini": 6})


@book.add("g14_pareto", f"""with {TOTALS_SQL}, f as (select *, greatest(1, round_even(n * 0.2, 0)) as fifth from rk where n >= 5)
select dimension, metric, cast(max(n) as bigint) as items, count(*) filter ((cum - value) / total < .8) as items_for_80, round(max(cum / total) filter (rank <= fifth), 6) as top_fifth_share,
 cast(max(fifth) as bigint) as top_fifth_count, round(count(*) filter ((cum - value) / total < .8) / max(n), 6) as share_of_items_for_80,
 max(cum / total) filter (rank <= fifth) >= .7 as concentrated from f group by 1, 2""")
def _(t):
    return rounded(C.pareto(ranked(t)), {"top_fifth_share": 6, "share_of_items_for_80": 6})


_MONTHS_SQL = """m as (select date_trunc('month', l_shipdate) as period, sum(l_extendedprice) as value from lineitem group by 1),
q as (select *, row_number() over (order by period) as pos, count(*) over () as n from m),
tt as (select * from q where not (pos = n and n >= 4 and value < 0.5 * (select median(value) from q where pos < n))),
e as (select *, row_number() over (order by period) as p2, count(*) over () as n2 from tt)"""


@book.add("h1_sales_kpis", f"""with {_MONTHS_SQL}, a as (select sum(l_extendedprice) as total, sum(l_quantity) as units, avg(l_extendedprice) as mean, median(l_extendedprice) as med,
   sum(l_extendedprice * l_discount) as cost from lineitem)
select 'total' as id, round(total, 2) as value, null as label, 1.0::double as relevance from a union all select 'volume', round(units, 2), null, .95 from a
union all select 'average', round(mean, 4), null, .8 from a union all select 'median', round(med, 4), null, .8 from a
union all select 'margin', round((total - cost) / total, 4), null, .92 from a
union all select 'trend', round(((select value from e where p2 = n2) - (select value from e where p2 = case when n2 > 12 then n2 - 12 else 1 end)) / abs((select value from e where p2 = case when n2 > 12 then n2 - 12 else 1 end)), 4), null, .9
union all (select 'best_month', round(value, 2), strftime(period, '%Y-%m'), .6 from m order by value desc, period limit 1)""")
def _(t):
    li = t.lineitem.withColumn("cost", F.col("l_extendedprice") * F.col("l_discount"))
    out = K.sales_kpis(li, "l_extendedprice", "l_quantity", "cost", "l_shipdate")
    value = F.when(F.col("id").isin("total", "volume", "best_month"), rnd("value", 2)).otherwise(rnd("value", 4))
    return out.select("id", value.alias("value"), "label", "relevance")


@book.add("h4_spark_line", f"""with {_MONTHS_SQL} select strftime(period, '%Y-%m') as label, round(value, 2) as value from tt order by period desc limit 40""")
def _(t):
    return K.spark_line(period_sums(t.lineitem, "l_shipdate", "l_extendedprice")).withColumn("value", rnd("value", 2))


@book.add("h6_top_performer", f"""with {_SELLERS} select dimension, key, round(revenue / tr, 6) as share from r where rr = 1 and revenue / tr >= 0.15""")
def _(t):
    out = C.best_sellers(items(t), ["p_brand", "p_type", "l_returnflag", "l_orderkey"], "l_extendedprice", "l_quantity", identifiers=["l_orderkey"])
    return K.top_performer(out).withColumn("share", rnd("share", 6))


@book.add("h8_metric_kpis", """select 'total-l_quantity' as id, round(sum(l_quantity), 4) as value, .55::double as relevance from lineitem
 union all select 'total-l_extendedprice', round(sum(l_extendedprice), 4), .7 from lineitem
 union all select 'average-l_discount', round(avg(l_discount), 4), .62 from lineitem union all select 'average-l_tax', round(avg(l_tax), 4), .62 from lineitem""")
def _(t):
    from ..operators.grouping import numeric_context
    base = numeric_context(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    kinds = (base.withColumn("additive", F.col("metric").isin("l_quantity", "l_extendedprice"))
             .withColumn("rate_like", F.col("metric").isin("l_discount", "l_tax"))
             .withColumn("money", F.col("metric") == "l_extendedprice"))
    return K.metric_kpis(kinds).withColumn("value", rnd("value", 4))


@book.add("h9_financial_kpis", """with f as (select o_orderpriority, date_trunc('month', o_orderdate) as period, sum(o_totalprice) as value from orders group by 1, 2),
r as (select *, value / lag(value) over (partition by o_orderpriority order by period) - 1 as ret from f)
select o_orderpriority, count(*) as n, round(arg_min(value, period), 2) as first, round(arg_max(value, period), 2) as last,
 round(arg_max(value, period) / arg_min(value, period) - 1, 6) as growth, round(pow(arg_max(value, period) / arg_min(value, period), 1.0 / (count(*) - 1)) - 1, 6) as cagr,
 round(stddev_samp(ret), 6) as volatility, round(avg(ret) / stddev_samp(ret), 6) as risk_adjusted from r group by 1""")
def _(t):
    frame = period_sums(t.orders, "o_orderdate", "o_totalprice", "monthly", ["o_orderpriority"])
    return rounded(K.financial_kpis(frame, ["o_orderpriority"]),
                   {"first": 2, "last": 2, "growth": 6, "cagr": 6, "volatility": 6, "risk_adjusted": 6})
