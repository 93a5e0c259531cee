"""Outliers of lineitem amounts and event values."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import anomaly as L
from .book import Book
from .concentration import rounded

book = Book()

_V = """v as (select 'value' as metric, value as v, event_type, event_id from events union all select 'squared', value * value, event_type, event_id from events),
md as (select metric, median(v) as md, avg(v) as mu, stddev_samp(v) as sd, stddev_pop(v) as sp, count(*) as n from v group by 1),
mm as (select md.*, mad.mad from md join (select v.metric, median(abs(v - md)) as mad from v join md using (metric) group by 1) mad using (metric)),
sk as (select v.metric, avg(pow((v - mu) / sp, 3)) as skew from v join md using (metric) group by 1),
z as (select v.*, mu, md, sd, n, skew, {score} as score from v join mm using (metric) join sk using (metric)), o as (select * from z where abs(score) >= {cut}),
s as (select metric, max(n) as rows, count(*) as count, count(*) filter (score > 0) as high, arg_max(v, abs(score)) as strongest, max(abs(score)) as sc, max(skew) as skew, max(md) as median from o group by 1)"""
MAD = _V.format(score=".6745 * (v - md) / mad", cut="3.5")
ZED = _V.format(score="(v - mu) / sd", cut="3")
_SUMMARY = """select metric, rows, count, round(count / rows, 6) as share, case when count >= 5 and greatest(high, count - high) / count >= .8 and abs(skew) > 1 and abs(strongest) / abs(median) <= 15 then 'skew' else 'anomaly' end as kind,
 case when high > 0 and count > high then 'both' when high > 0 then 'high' else 'low' end as direction, round(strongest, 4) as strongest, round(skew, 6) as skew from s"""


def _events(t):
    return t.events.withColumn("squared", F.col("value") * F.col("value"))


@book.add("l1_z_outliers", f"with {ZED} select metric, event_id, round(v, 4) as value, round(score, 6) as score from o")
def _(t):
    return rounded(L.outliers(_events(t), ["value", "squared"], ["event_id"], "z"), {"value": 4, "score": 6})


@book.add("l2_mad_outliers", f"with {MAD} select metric, event_id, round(v, 4) as value, round(score, 6) as score from o")
def _(t):
    return rounded(L.outliers(_events(t), ["value", "squared"], ["event_id"], "mad"), {"value": 4, "score": 6})


def _summary(t, method):
    out = L.outlier_summary(_events(t), ["value", "squared"], method)
    return rounded(out.select("metric", "rows", "count", "share", "kind", "direction", "strongest", "skew"), {"share": 6, "strongest": 4, "skew": 6})


@book.add("l2_mad_summary", f"with {MAD} {_SUMMARY}")
def _(t):
    return _summary(t, "mad")


@book.add("l3_tail_or_anomaly", f"with {ZED} {_SUMMARY}")
def _(t):
    return _summary(t, "z")


@book.add("l1_examples", f"with {ZED}, d as (select metric, v, score, count(*) as n from o group by all), r as (select *, row_number() over (partition by metric order by abs(score) desc, v) as rank from d) select metric, round(v, 4) as value, round(score, 6) as score, n, rank from r where rank <= 4")
def _(t):
    return rounded(L.examples(_events(t), ["value", "squared"], 4, "z"), {"value": 4, "score": 6})


@book.add("l4_anomalies", f"with {ZED} select * from ({_SUMMARY}) where kind = 'anomaly'")
def _(t):
    out = L.anomalies(_events(t), ["value", "squared"])
    return rounded(out.select("metric", "rows", "count", "share", "kind", "direction", "strongest", "skew"), {"share": 6, "strongest": 4, "skew": 6})


@book.add("l5_root_cause", """with w as (select l_extendedprice * l_extendedprice * l_discount as x, l_returnflag, l_linestatus, cast(l_linenumber as varchar) as l_linenumber from lineitem),
f as (select *, abs((x - (select avg(x) from w)) / (select stddev_samp(x) from w)) >= 3 as o from w),
d as (select 'l_returnflag' as dimension, l_returnflag as key, o from f union all select 'l_linestatus', l_linestatus, o from f union all select 'l_linenumber', l_linenumber, o from f),
b as (select dimension, key, count(*) filter (o) as outliers, count(*) as n from d group by 1, 2),
x as (select *, outliers / sum(outliers) over w as share, n / sum(n) over w as base_share, sum(outliers) over w as tot from b window w as (partition by dimension)),
y as (select *, share / base_share as lift from x where tot >= 3 and outliers >= 2 and share / base_share > 1.0001),
bd as (select dimension from y group by 1 order by max(lift) desc, dimension limit 1)
select dimension, key, outliers, round(share, 6) as share, round(base_share, 6) as base_share, round(lift, 6) as lift from y join bd using (dimension) order by lift desc, key limit 2""")
def _(t):
    li = t.lineitem.withColumn("weight", F.col("l_extendedprice") * F.col("l_extendedprice") * F.col("l_discount"))
    out = L.breakdown(li, "weight", ["l_returnflag", "l_linestatus", "l_linenumber"], least=1.0001)
    return rounded(out, {"share": 6, "base_share": 6, "lift": 6})


@book.add("d3_z_outliers", """with s as (select avg(value) as m, stddev_samp(value) as s from events) select event_id, round((value - m) / s, 6) as z from events, s where abs((value - m) / s) >= 3.5""")
def _(t):
    return L.z_outliers(t.events, "value", 3.5).select("event_id", rnd("z", 6).alias("z"))
