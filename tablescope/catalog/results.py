"""Samples, rebuilt grids, chart data, structured questions, facts and actions."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import anomaly, concentration, findings, forecast, grouping, segment, stats
from ..plans import charts
from ..plans.analyze import analyze
from ..plans.spec import QuerySpec, focal_facts, run_spec
from ..sources import samples, tokens
from .anomalies import MAD, _events
from .book import Book
from .concentration import _SELLERS, items, rounded
from .segments import _RFM
from .series import _LINE, nations

book = Book()


@book.add("a6_exact_sample", """select l_orderkey, l_linenumber, l_partkey, (select count(*) from lineitem) as sampled_from from (
  select *, md5('7|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey) as h from lineitem order by h, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 2000)""")
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return samples.exact_sample(t.lineitem.select(*keys), 2000, keys).drop("l_suppkey")


@book.add("a7_systematic_sample", """with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as idx, count(*) over () as n from orders)
select o_orderkey from r where idx in (select floor(i * (select max(n) from r)::double / 1000)::bigint from range(1000) x(i))""")
def _(t):
    return samples.systematic_sample(t.orders.select("o_orderkey"), ["o_orderkey"], 1000)


@book.add("a7_row_budget", """select count(*) as rows, round(avg(length('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}')), 6) as mean_bytes,
  least(count(*), 100000, floor(3800000 / avg(length('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}'))))::bigint as cap from orders""")
def _(t):
    return samples.row_budget(t.orders.select("o_orderkey", "o_orderstatus")).withColumn("mean_bytes", rnd("mean_bytes", 6))


@book.add("a8_downsample", f"""with {_LINE}, z as (select c_nationkey, period, value, t, n from x) select c_nationkey, strftime(period, '%Y-%m') as label, round(value, 2) as value from z
 where t::bigint in (select floor(i * z.n::double / 24)::bigint from range(24) y(i))""")
def _(t):
    out = samples.downsample(nations(t), "period", 24, ["c_nationkey"])
    return out.select("c_nationkey", "label", rnd("value", 2).alias("value"))


@book.add("a8_scatter_points", """with r as (select o_orderkey, o_custkey, o_totalprice, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders)
select o_orderkey, o_custkey, o_totalprice from r where i % greatest(1, n // 300) = 0""")
def _(t):
    return samples.scatter_points(t.orders, "o_custkey", "o_totalprice", ["o_orderkey"])


def _tokens(t) -> DataFrame:
    """Each customer's orders as a printed page: a header line and one line per order, words placed by x and y."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = t.orders.withColumn("line", F.row_number().over(w))
    def word(x: int, text, shift=0):
        return F.struct(F.lit(float(x)).alias("x"), text.alias("str"), F.lit(float(shift)).alias("dy"))
    # priority is printed as two words with a normal space, so they must end up in one cell
    first, second = F.substring_index("o_orderpriority", "-", 1), F.substring_index("o_orderpriority", "-", -1)
    body = rows.select("o_custkey", "line", F.inline(F.array(
        word(10, F.col("o_orderkey").cast("string")), word(100, F.col("o_orderstatus"), 1), word(150, first), word(160, second))))
    head = t.orders.select("o_custkey").distinct().select("o_custkey", F.lit(0).alias("line"), F.inline(F.array(
        word(10, F.lit("Key")), word(100, F.lit("Field")), word(150, F.lit("Field")))))
    return head.unionByName(body).select(F.col("o_custkey").alias("doc_id"), "x", (5000 - 12 * F.col("line") - F.col("dy")).cast("double").alias("y"), "str",
                                         (F.length("str") * 5.0).alias("width"))


@book.add("a11_token_grid", """with r as (select o_custkey as doc_id, row_number() over (partition by o_custkey order by o_orderkey) as row, o_orderkey, o_orderstatus, replace(o_orderpriority, '-', ' ') as p from orders),
b as (select doc_id, row, unnest([0, 1, 2])::bigint as col, unnest([cast(o_orderkey as varchar), o_orderstatus, p]) as text from r)
select * from b union all select doc_id, 0, unnest([0, 1, 2])::bigint, unnest(['Key', 'Field', 'Field 2']) from (select distinct doc_id from r)""")
def _(t):
    return tokens.tokens_to_grid(_tokens(t))


@book.add("p1_chart_frames", """with m as (select date_trunc('month', l_shipdate) as p, sum(l_extendedprice) as v from lineitem group by 1), q as (select *, row_number() over (order by p) as pos, count(*) over () as n from m),
ln as (select 'line' as chart, strftime(p, '%Y-%m') as key, v as value from q where not (pos = n and n >= 4 and v < .5 * (select median(v) from q where pos < n)))
select chart, key, round(value, 2) as value from ln union all select 'bar', l_returnflag, round(sum(l_extendedprice), 2) from lineitem group by 2
 union all select 'frequency_l_linestatus', l_linestatus, count(*)::double from lineitem group by 2 union all select 'frequency_l_returnflag', l_returnflag, count(*)::double from lineitem group by 2""")
def _(t):
    frames = charts.recommend(t.lineitem, ["l_extendedprice", "l_quantity"], ["l_returnflag", "l_linestatus"], "l_shipdate", "l_extendedprice")
    parts = [frames["line"].select(F.lit("line").alias("chart"), F.col("label").alias("key"), "value"),
             frames["bar"].select(F.lit("bar").alias("chart"), "key", "value"),
             *[frames[f"frequency_{d}"].select(F.lit(f"frequency_{d}").alias("chart"), "key", F.col("n").cast("double").alias("value"))
               for d in ("l_returnflag", "l_linestatus")]]
    return reduce(DataFrame.unionByName, parts).withColumn("value", rnd("value", 2))


@book.add("p2_pie", """with s as (select p_brand as key, sum(l_extendedprice) as v from lineitem join part on l_partkey = p_partkey group by 1), r as (select *, row_number() over (order by v desc, key) as k, count(*) over () as n, sum(v) over () as t from s)
select case when k <= 12 then key else 'Other (' || (n - 12) || ' categories)' end as key, round(sum(v), 2) as value, round(sum(v) / max(t), 6) as share, bool_or(k > 12) as is_other from r group by 1""")
def _(t):
    return rounded(charts.build(items(t), "pie", "p_brand", "l_extendedprice"), {"value": 2, "share": 6})


@book.add("p2_stacked", "select l_returnflag, l_linestatus, count(*)::double as value from lineitem group by 1, 2")
def _(t):
    return charts.stacked(t.lineitem, "l_returnflag", "l_linestatus", None)


@book.add("p2_line_and_bar", """select 'line' as chart, strftime(p, '%Y-%m') as key, n::double as value from (select p, n, row_number() over (order by p) as i, count(*) over () as c from
  (select date_trunc('month', o_orderdate) as p, count(*) as n from orders group by 1)) q where not (i = c and c >= 4 and n < .5 * (select median(n) from (select count(*) as n, date_trunc('month', o_orderdate) as p from orders group by 2) r where r.p < q.p))
 union all select 'bar', o_orderpriority, round(avg(o_totalprice), 4) from orders group by 2 union all (select 'count', o_orderstatus, count(*)::double from orders group by 2)""")
def _(t):
    """A line of row counts in the table's own cadence, bars of means and of counts."""
    o = t.orders.withColumn("month", F.date_trunc("month", "o_orderdate").cast("date"))
    parts = [("line", charts.build(o, "line", "month").select(F.col("label").alias("key"), "value")), ("bar", charts.build(o, "bar", "o_orderpriority", "o_totalprice", "mean")), ("count", charts.build(o, "bar", "o_orderstatus"))]
    return reduce(DataFrame.unionByName, [x.select(F.lit(n).alias("chart"), "key", rnd("value", 4).alias("value")) for n, x in parts])


@book.add("p1_strongest_scatter", "select l_discount as x, l_extendedprice * l_discount as y, count(*) as n from lineitem group by 1, 2")
def _(t):
    """All points of the most strongly related pair of metrics, which the correlations choose; equal points are counted."""
    li = t.lineitem.withColumn("saving", F.col("l_extendedprice") * F.col("l_discount"))
    pair = stats.strongest_pair(li, ["l_quantity", "saving", "l_discount", "l_tax"], least=0.0).first()
    a, b = sorted((pair["a"], pair["b"]))
    return li.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))


@book.add("p4_statistics_specs", """select 'correlation' as question, 'l_quantity ~ l_extendedprice' as key, round(corr(l_quantity, l_extendedprice), 6) as value from lineitem
 union all select 'welch', 'A N', round((avg(l_quantity) filter (l_returnflag = 'A') - avg(l_quantity) filter (l_returnflag = 'N')) / sqrt(var_samp(l_quantity) filter (l_returnflag = 'A') / count(*) filter (l_returnflag = 'A') + var_samp(l_quantity) filter (l_returnflag = 'N') / count(*) filter (l_returnflag = 'N')), 6) from lineitem
 union all select 'frequency', l_returnflag, count(*)::double from lineitem group by 2
 union all select 'outliers', 'squared', count(*)::double from (select pow(value, 2) as v from events) where abs(v - (select avg(pow(value, 2)) from events)) >= 3 * (select stddev_samp(pow(value, 2)) from events)""")
def _(t):
    """Correlation, significance, distribution and outliers as structured questions."""
    li, ev = t.lineitem, t.events.withColumn("squared", F.col("value") * F.col("value"))
    parts = [run_spec(li, QuerySpec("correlation", metric="l_quantity", metric2="l_extendedprice")).select(F.lit("correlation").alias("question"), F.concat_ws(" ~ ", "a", "b").alias("key"), F.col("r").alias("value")),
             run_spec(li, QuerySpec("significance", metric="l_quantity", dimension="l_returnflag", compare=("A", "N"))).select(F.lit("welch").alias("question"), F.lit("A N").alias("key"), F.col("t").alias("value")),
             run_spec(li, QuerySpec("distribution", dimension="l_returnflag")).select(F.lit("frequency").alias("question"), "key", F.col("n").cast("double").alias("value")),
             run_spec(ev, QuerySpec("outliers", metric="squared")).select(F.lit("outliers").alias("question"), F.col("metric").alias("key"), F.col("count").cast("double").alias("value"))]
    return reduce(DataFrame.unionByName, parts).withColumn("value", rnd("value", 6))


_SPECS = [
    ("total", QuerySpec("aggregate", metric="l_extendedprice"), None),
    ("mean discount of R", QuerySpec("metric", metric="l_discount", additive=False, filter=("l_returnflag", "eq", "R")), None),
    ("rows in 1997", QuerySpec("count", filter=("l_shipdate", "year", 1997)), None),
    ("top flags", QuerySpec("groupRank", metric="l_quantity", dimension="l_returnflag", top=2), "l_returnflag"),
    ("by status", QuerySpec("groupAggregate", metric="l_quantity", dimension="l_linestatus", agg="max"), "l_linestatus"),
]


@book.add("p4_run_specs", """select 'total' as question, null as key, round(sum(l_extendedprice), 2) as value from lineitem union all select 'mean discount of R', null, round(avg(l_discount), 6) from lineitem where l_returnflag = 'R'
 union all select 'rows in 1997', null, count(*)::double from lineitem where year(l_shipdate) = 1997
 union all (select 'top flags', l_returnflag, round(sum(l_quantity), 2) from lineitem group by 2 order by 3 desc limit 2) union all select 'by status', l_linestatus, max(l_quantity) from lineitem group by 2
 union all select 'trend ' || strftime(p, '%Y-%m'), null, round(c, 6) from (select date_trunc('month', l_shipdate) as p, sum(l_extendedprice) / lag(sum(l_extendedprice)) over (order by date_trunc('month', l_shipdate)) - 1 as c from lineitem group by 1)
 union all select 'compare A N', 'total_diff', round(sum(l_quantity) filter (l_returnflag = 'N') - sum(l_quantity) filter (l_returnflag = 'A'), 2) from lineitem
 union all select 'gini', 'l_suppkey', round(sum((2 * i - n - 1) * v) / (max(n) * sum(v)), 6) from (select sum(l_extendedprice) as v, row_number() over (order by sum(l_extendedprice)) as i, count(*) over () as n from lineitem group by l_suppkey)""")
def _(t):
    li = t.lineitem
    parts = []
    for name, spec, key in _SPECS:
        out = run_spec(li, spec)
        parts.append(out.select(F.lit(name).alias("question"), (F.col(key) if key else F.lit(None).cast("string")).alias("key"),
                                rnd("value", 6 if "discount" in name else 2).alias("value")))
    trend = run_spec(li, QuerySpec("trend", metric="l_extendedprice", time="l_shipdate"))
    parts.append(trend.select(F.concat(F.lit("trend "), F.col("label")).alias("question"), F.lit(None).cast("string").alias("key"), rnd("change", 6).alias("value")))
    diff = run_spec(li, QuerySpec("compare", metric="l_quantity", dimension="l_returnflag", compare=("A", "N")))
    parts.append(diff.select(F.lit("compare A N").alias("question"), F.lit("total_diff").alias("key"), rnd("total_diff", 2).alias("value")))
    conc = run_spec(li, QuerySpec("concentration", metric="l_extendedprice", dimension="l_suppkey"))
    parts.append(conc.select(F.lit("gini").alias("question"), F.col("dimension").alias("key"), rnd("gini", 6).alias("value")))
    return reduce(DataFrame.unionByName, parts)


@book.add("p4_best_customers", f"with {_RFM} select entity, round(monetary, 2) as monetary from g where segment = 'champions' order by monetary desc, entity limit 10")
def _(t):
    out = run_spec(t.orders, QuerySpec("bestCustomers", metric="o_totalprice", entity="o_custkey", time="o_orderdate"))
    return out.select("entity", rnd("monetary", 2).alias("monetary"))


@book.add("p5_focal_facts", " union all ".join(
    f"select '{d}' as dimension, {d} as key, round(sum(l_extendedprice), 2) as value, round(sum(l_extendedprice) / (select sum(l_extendedprice) from lineitem), 6) as share from lineitem join part on l_partkey = p_partkey group by 2"
    for d in ["p_brand", "p_type", "l_returnflag"]))
def _(t):
    return rounded(focal_facts(items(t), "l_extendedprice", ["p_brand", "p_type", "l_returnflag"]), {"value": 2, "share": 6})


def _keyed(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("dataset_key", F.lit(name))


@book.add("o1_facts", f"""with b as (select * from (with {_SELLERS} select 'items' as dataset_key, 'bestseller' as kind, key as subject, revenue / tr as value, 2 as priority, null as confidence from r where rr = 1)),
f as (select * from (with {_RFM} select 'orders' as dataset_key, 'rfm' as kind, segment as subject, sum(monetary) / sum(sum(monetary)) over () as value, 11 as priority, null as confidence, from g group by segment) where subject in ('champions', 'at-risk')),
o as (select * from (with {MAD}, n as (select metric, case when count >= 5 and greatest(high, count - high) / count >= .8 and abs(skew) > 1 and abs(strongest) / abs(median) <= 15 then 'skew' else 'anomaly' end as k, count from s order by count desc, metric limit 1)
  select 'events' as dataset_key, 'outliers' as kind, metric as subject, count::double as value, 13 as priority, null as confidence, k from n)),
c as (select 'items' as dataset_key, 'correlation' as kind, 'saving ~ l_discount' as subject, corr(l_extendedprice * l_discount, l_discount) as value, 9 as priority, 'high' as confidence from lineitem
  union all select 'items', 'correlation', 'saving ~ l_extendedprice', corr(l_extendedprice * l_discount, l_extendedprice), 9, 'high' from lineitem),
h as (select 'value' as metric, value as v from events union all select 'squared', value * value from events), hm as (select metric, avg(v) as m, stddev_pop(v) as sd from h group by 1),
d as (select 'events' as dataset_key, 'distribution' as kind, h.metric as subject, avg(pow((v - m) / sd, 3)) as value, 14 as priority, null as confidence from h join hm using (metric)
  where h.metric not in (select subject from o where k = 'skew') group by 3 order by value desc limit 1)
select dataset_key, kind, subject, round(value, 4) as value, priority, confidence from (select * from b union all select * from f union all select * exclude (k) from o union all select * from c union all select * from d)""")
def _(t):
    li = t.lineitem.withColumn("saving", F.col("l_extendedprice") * F.col("l_discount"))
    both = ["value", "squared"]
    members = segment.rfm_members(t.orders, "o_custkey", "o_orderdate", "o_totalprice")
    out = findings.build_facts({
        "best_sellers": _keyed(concentration.best_sellers(items(t), ["p_brand", "p_type", "l_returnflag"], "l_extendedprice", "l_quantity"), "items"),
        "correlations": _keyed(stats.correlations(li, ["saving", "l_discount", "l_extendedprice", "l_tax"]), "items"),
        "rfm": _keyed(segment.rfm_segments(members), "orders"),
        "outliers": _keyed(anomaly.outlier_summary(_events(t), both), "events"),
        "distributions": _keyed(stats.distributions(_events(t), both), "events")})
    return out.select("dataset_key", "kind", "subject", rnd("value", 4).alias("value"), "priority", "confidence")


@book.add("o2_actions", f"""with b as (select * from (with {_SELLERS} select 'items' as dataset_key, 'grow best seller' as action, key as subject, .95 as score, 'high' as impact from r where rr = 1)),
k as (select 'orders' as dataset_key, 'diversify' as action, 'large: ' || big as subject, .45 + n / (select count(*) from orders) * .2 as score, case when n / (select count(*) from orders) > .7 then 'high' else 'medium' end as impact
  from (select case when o_totalprice > 100000 then 'yes' else 'no' end as big, count(*) as n from orders group by 1 order by n desc limit 1) where n / (select count(*) from orders) >= .5),
f as (select * from (with {_LINE}, st as (select c_nationkey, max(n) as n, regr_slope(value, t) as b, regr_intercept(value, t) as a, min(value) as low, arg_max(value, t) as lv from x group by 1),
  p as (select *, least(12, greatest(3, round_even(n * .15, 0))) as h from st), q as (select *, (greatest(a + b * (n + h - 1), 0) - lv) / abs(lv) as c from p)
  select 'nation ' || c_nationkey as dataset_key, 'plan for forecast' as action, 'o_totalprice' as subject, .5 + least(.15, abs(c)) as score, 'medium' as impact from q where abs(c) > .05))
select *replace (round(score, 4) as score), 1::bigint as rank from (select * from b union all select * from k union all select * from f)""".replace("*replace", "* replace"))
def _(t):
    n = nations(t)
    ahead = forecast.linear_forecast(n, ["c_nationkey"]).select(
        F.concat(F.lit("nation "), F.col("c_nationkey")).alias("dataset_key"), F.lit("o_totalprice").alias("metric"), "step", "forecast", "last_value")
    big = t.orders.select(F.when(F.col("o_totalprice") > 100000, "yes").otherwise("no").alias("large"))
    out = findings.build_actions({
        "best_sellers": _keyed(concentration.best_sellers(items(t), ["p_brand", "p_type", "l_returnflag"], "l_extendedprice", "l_quantity"), "items"),
        "categories": _keyed(grouping.category_facts(big, ["large"]), "orders"), "forecast": ahead})
    return out.drop("size").withColumn("score", rnd("score", 4))


@book.add("z_analyze_orders")
def _(t):
    """Facts and actions of the whole analysis of all orders."""
    o = t.orders.select(F.col("o_custkey").cast("string").alias("customer_id"), F.col("o_orderstatus").alias("order_status"), F.col("o_totalprice").alias("sales_amount"),
                        F.col("o_orderdate").alias("order_date"), F.col("o_orderpriority").alias("priority"))
    found = analyze(o, "orders", cleaned=True)
    facts = found["facts"].select("dataset_key", F.lit("fact").alias("what"), "kind", "subject", rnd("value", 4).alias("value"))
    actions = found["actions"].select("dataset_key", F.lit("action").alias("what"), F.col("action").alias("kind"), "subject", rnd("score", 4).alias("value"))
    return facts.unionByName(actions)
