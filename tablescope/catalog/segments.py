"""Clusters, RFM and cohorts of customers and users."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import segment as M
from ..session import new_path
from ..sources import sinks
from .book import Book
from .concentration import rounded

book = Book()


def customers(t):
    spend = t.orders.groupBy("o_custkey").agg(F.count("*").cast("double").alias("orders"), F.sum("o_totalprice").alias("spend"),
                                              F.avg("o_totalprice").alias("mean_order"))
    return t.customer.join(spend, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_acctbal", "orders", "spend", "mean_order")


FEATURES = ["c_acctbal", "orders", "spend", "mean_order"]


@book.add("m1_cluster_summary")
def _(t):
    c = customers(t)
    out = M.cluster_summary(c, M.fit_clusters(c, FEATURES))
    return out.select("cluster", "size", rnd("share", 6).alias("share"), "label")


@book.add("m2_cluster_members")
def _(t):
    c = customers(t)
    return M.cluster_members(c, M.fit_clusters(c, FEATURES)).select("c_custkey", "cluster")


_RFM = """e as (select o_custkey as entity, (select max(o_orderdate)::date from orders) - max(o_orderdate)::date as recency, count(*) as frequency, sum(o_totalprice) as monetary from orders group by 1),
q as (select *, count(*) over () as n, row_number() over (order by recency, entity) as rr, row_number() over (order by frequency, entity) as fr from e),
s as (select entity, recency, frequency, monetary, 6 - least(5, (rr - 1) * 5 // n + 1) as r, least(5, (fr - 1) * 5 // n + 1) as f from q),
g as (select *, case when r >= 4 and f >= 4 then 'champions' when f >= 4 and r >= 2 then 'loyal' when r >= 4 then 'potential' when r <= 2 and f >= 3 then 'at-risk' when r <= 2 then 'hibernating' else 'attention' end as segment from s)"""


@book.add("m3_quintiles", f"with {_RFM} select f as score, count(*) as n, min(frequency) as low, max(frequency) as high from g group by 1")
def _(t):
    out = M.rfm_members(t.orders, "o_custkey", "o_orderdate", "o_totalprice")
    return out.groupBy(F.col("f").alias("score")).agg(F.count("*").alias("n"), F.min("frequency").alias("low"), F.max("frequency").alias("high"))


@book.add("m4_rfm_segments", f"""with {_RFM} select segment, count(*) as size, round(avg(recency), 4) as avg_recency, round(avg(frequency), 4) as avg_frequency, round(sum(monetary), 2) as monetary,
  round(count(*) / sum(count(*)) over (), 6) as share, round(sum(monetary) / sum(sum(monetary)) over (), 6) as monetary_share from g group by 1""")
def _(t):
    out = M.rfm_segments(M.rfm_members(t.orders, "o_custkey", "o_orderdate", "o_totalprice")).drop("avg_monetary")
    return rounded(out, {"avg_recency": 4, "avg_frequency": 4, "monetary": 2, "share": 6, "monetary_share": 6})


@book.add("m5_rfm_members", f"with {_RFM} select entity, recency, frequency, round(monetary, 2) as monetary, r, f, segment from g")
def _(t):
    return rounded(M.rfm_members(t.orders, "o_custkey", "o_orderdate", "o_totalprice"), {"monetary": 2})


def _cohort_sql(table: str, entity: str, period: str, fmt: str) -> str:
    return f"""with a as (select distinct {entity} as e, {period} as p from {table}), i as (select p, row_number() over (order by p) - 1 as idx from (select distinct p from a)),
x as (select e, idx, min(idx) over (partition by e) as cohort from a join i using (p)), c as (select cohort, idx - cohort as offset_, count(*) as active from x group by 1, 2),
s as (select cohort, active as size from c where offset_ = 0 order by cohort desc limit 12), n as (select count(*) as n from i),
g as (select cohort, size, unnest(generate_series(0, least(11, n - 1 - cohort))) as offset_ from s, n)
select g.cohort, strftime(i.p, '{fmt}') as cohort_label, size, g.offset_ as offset, coalesce(active, 0) as active, floor(coalesce(active, 0) * 100.0 / size + .5)::bigint as retention
from g left join c on c.cohort = g.cohort and c.offset_ = g.offset_ join i on i.idx = g.cohort"""


@book.add("m7_cohorts_weekly", _cohort_sql("events", "user_id", "date_trunc('week', ts)", "%G-W%V"))
def _(t):
    return M.cohorts(t.events, "user_id", "ts", "weekly")


@book.add("m7_cohorts_monthly", _cohort_sql("orders", "o_custkey", "date_trunc('month', o_orderdate)", "%Y-%m"))
def _(t):
    return M.cohorts(t.orders, "o_custkey", "o_orderdate", "monthly")


@book.add("a10_segment_worklist", f"with {_RFM} select entity, round(monetary, 2) as monetary from g where segment = 'at-risk'")
def _(t):
    out = M.rfm_members(t.orders, "o_custkey", "o_orderdate", "o_totalprice")
    path = new_path(t.spark, "members")
    sinks.write_members(out, path, "segment")
    return t.spark.read.parquet(path).where(F.col("segment") == "at-risk").select("entity", rnd("monetary", 2).alias("monetary"))
