"""Filters, joins and grouped aggregates over orders, lineitem, part and customer."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import grouping as G
from ..operators import relational as R
from ..operators.timeseries import month_by_segment
from ..session import new_path
from ..sources import readers, sinks
from .book import Book

book = Book()


@book.add("a0_month_by_segment", """with m as (select strftime(date_trunc('month', o_orderdate), '%Y-%m') as month, c_mktsegment as segment,
  sum(o_totalprice) as revenue, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2)
select month, segment, round(revenue, 2) as revenue, cast(n as bigint) as orders,
  round(revenue / sum(revenue) over (partition by month), 6) as share_of_month from m""")
def _(t):
    return month_by_segment(t.orders, t.customer)


@book.add("a4_read_parquet_nested", """select vec_id, cast(label as bigint) as label, cast(len(embedding) as bigint) as width,
  embedding[1]::double as first_value from embeddings""")
def _(t):
    flat = readers.flatten_nested(t.embeddings)
    parsed = F.from_json("embedding", "array<float>")
    return flat.select("vec_id", F.col("label").cast("long").alias("label"), F.size(parsed).cast("long").alias("width"),
                       parsed[0].cast("double").alias("first_value"))


_ORDERS_TEXT = """select o_orderkey::varchar as order_key, o_orderstatus as status, case when o_orderkey % 3 = 0 then null else 'a "' || o_orderpriority || '", ' || o_orderstatus end as note,
 strftime(o_orderdate, '%Y-%m-%d') as day from orders"""


def _orders_text(t):
    o, day = t.orders, F.date_format("o_orderdate", "yyyy-MM-dd")
    note = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit('a "'), "o_orderpriority", F.lit('", '), "o_orderstatus"))
    return o.select(F.col("o_orderkey").cast("string").alias("order_key"), F.col("o_orderstatus").alias("status"), note.alias("note"), day.alias("day"))


@book.add("a1_read_csv", _ORDERS_TEXT)
def _(t):
    """All orders written as delimited text with quotes, separators and empty cells, and read back as text."""
    path = new_path(t.spark, "csv")
    sinks.write_csv(_orders_text(t), path)
    return readers.read_delimited(t.spark, path)


@book.add("a2_read_tsv", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def _(t):
    """Tab-separated, types inferred."""
    path = new_path(t.spark, "tsv")
    sinks.write_csv(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path, sep="\t")
    out = readers.read_delimited(t.spark, path, sep="\t", infer=True)
    return out.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@book.add("a3_read_json", """select o_custkey, '{"n":' || count(*) || ',"last":' || max(o_orderkey) || '}' as facts, to_json(list(o_orderkey order by o_orderkey))::varchar as keys from orders group by o_custkey""")
def _(t):
    """Records with nested values written as JSON lines and read back, nested values as JSON text."""
    path = new_path(t.spark, "json")
    t.orders.groupBy("o_custkey").agg(F.struct(F.count("*").alias("n"), F.max("o_orderkey").alias("last")).alias("facts"), F.sort_array(F.collect_list("o_orderkey")).alias("keys")).write.json(path)
    out = readers.read_json(t.spark, path)
    parsed = F.from_json("facts", "n long, last long")
    return out.select("o_custkey", F.to_json(parsed).alias("facts"), "keys")


@book.add("a5_choose_source", """select name, cast(n as bigint) as n_rows, n = max(n) over () as chosen from (
  select 'orders' as name, count(*) as n from orders union all select 'lineitem', count(*) from lineitem
  union all select 'part', count(*) from part union all select 'customer', count(*) from customer
  union all select 'events', count(*) from events)""")
def _(t):
    return readers.choose_source({n: getattr(t, n) for n in ["orders", "lineitem", "part", "customer", "events"]})


@book.add("e1_filter", """select 'between' as op, cast(count(*) as bigint) as n, round(sum(o_totalprice), 2) as total from orders where o_totalprice between 100000 and 200000
 union all select 'year', count(*), round(sum(o_totalprice), 2) from orders where year(o_orderdate) = 1997
 union all select 'contains', count(*), round(sum(o_totalprice), 2) from orders where lower(o_orderpriority) like '%urgent%'
 union all select 'eq', count(*), round(sum(o_totalprice), 2) from orders where o_orderstatus = 'F'
 union all select 'gte', count(*), round(sum(o_totalprice), 2) from orders where o_totalprice >= 250000
 union all select 'lt', count(*), round(sum(o_totalprice), 2) from orders where o_totalprice < 50000""")
def _(t):
    o = t.orders
    specs = [("between", "o_totalprice", 100000, 200000), ("year", "o_orderdate", 1997, None),
             ("contains", "o_orderpriority", "urgent", None), ("eq", "o_orderstatus", "F", None),
             ("gte", "o_totalprice", 250000, None), ("lt", "o_totalprice", 50000, None)]
    one = o.agg(*[F.struct(F.lit(op).alias("op"), F.count_if(R.condition(o, c, op, v, v2)).alias("n"),
                           F.round(F.sum(F.when(R.condition(o, c, op, v, v2), F.col("o_totalprice"))), 2).alias("total"))
                  .alias(op) for op, c, v, v2 in specs])
    return one.select(F.inline(F.array(*[F.col(s[0]) for s in specs])))


@book.add("e1_filter_rows", "select o_orderkey, o_totalprice from orders where o_totalprice between 100000 and 200000 and year(o_orderdate) = 1997")
def _(t):
    return R.where(R.where(t.orders, "o_totalprice", "between", 100000, 200000), "o_orderdate", "year", 1997).select(
        "o_orderkey", "o_totalprice")


@book.add("e2_search_any", "select * from part where contains(lower(concat_ws(chr(1), p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)), 'widget')")
def _(t):
    return R.search(t.part, "Widget")


@book.add("e3_sort_page", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 20")
def _(t):
    return R.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


@book.add("e3_deep_page", """select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey
  limit 50 offset (select 50 * (count(*) // 50 * 9 // 10) from lineitem)""")
def _(t):
    """The page at nine tenths of all line items by price."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    order = [F.desc("l_extendedprice"), *map(F.asc, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])]
    return R.deep_page(li, order, li.count() // 50 * 9 // 10, 50).drop("l_partkey", "l_suppkey")


@book.add("e4_sort_by_time", "select o_orderkey, o_orderdate from orders order by o_orderdate, o_orderkey")
def _(t):
    return R.by_time(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@book.add("e5_top_per_group", """select * from (select o_orderstatus, o_orderkey, o_totalprice,
  row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 6""")
def _(t):
    return R.top_per_group(t.orders.select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"],
                           [F.desc("o_totalprice"), F.asc("o_orderkey")], 6)


def _long_keys(table: str, prefix: str, cols: str) -> str:
    parts = " union all ".join(
        f"select '{c}' as {prefix}_key, lower(trim(cast({c} as varchar))) as key from {table}" for c in cols.split())
    return f"select {prefix}_key, key, count(*) as {prefix}_n from ({parts}) where key <> '' group by 1, 2"


@book.add("f1_suggest_join_keys", f"""with l as ({_long_keys('orders', 'left', 'o_orderkey o_custkey o_orderstatus o_orderpriority')}),
r as ({_long_keys('customer', 'right', 'c_custkey c_name c_nationkey c_mktsegment')}),
f as (select left_key, sum(left_n) as filled from l group by 1), u as (select right_key, max(right_n) = 1 as right_unique from r group by 1),
h as (select left_key, right_key, sum(left_n) as matched from l join r using (key) group by 1, 2)
select left_key, right_key, round(cast(matched as double) / cast(filled as double), 6) as overlap, right_unique,
  replace(left_key, '_', '') = replace(right_key, '_', '') as name_match from h join f using (left_key) join u using (right_key)
where matched / filled >= 0.9""")
def _(t):
    left = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    right = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return R.suggest_join_keys(left, right).withColumn("overlap", rnd("overlap", 6))


_LOOKUP = """with c as (select c_custkey, c_name, c_mktsegment, lower('Nation_' || c_nationkey) as nk from customer),
n as (select lower(trim(n_name)) as nk, n_nationkey, n_regionkey, row_number() over (partition by lower(trim(n_name)) order by n_nationkey) as rn from nation)"""


@book.add("f2_lookup_left", """with c as (select c_custkey, c_name, c_mktsegment, c_nationkey from customer),
o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders)
select c_custkey, c_name, c_mktsegment, o_orderkey, o_orderstatus from c left join o on c_custkey = o_custkey and rn = 1""")
def _(t):
    left = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    right = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    return R.lookup_join(left, right, "c_custkey", "o_custkey", "o_orderkey")


@book.add("f2_lookup_renamed", """with x as (select s_suppkey, s_name, 'NATION_' || s_nationkey as "Name" from supplier)
select s_suppkey, s_name, x."Name", n_nationkey as "NAME (2)" from x left join nation on lower(x."Name") = lower(n_name)""")
def _(t):
    left = t.supplier.select("s_suppkey", "s_name", F.concat(F.lit("NATION_"), F.col("s_nationkey")).alias("Name"))
    right = t.nation.select("n_name", F.col("n_nationkey").alias("NAME"))
    return R.lookup_join(left, right, "Name", "n_name", "NAME")


@book.add("f3_lookup_inner", """with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders)
select c_custkey, c_mktsegment, o_orderkey, o_totalprice from customer join o on c_custkey = o_custkey and rn = 1""")
def _(t):
    return R.lookup_join(t.customer.select("c_custkey", "c_mktsegment"), t.orders.select("o_custkey", "o_orderkey", "o_totalprice"),
                         "c_custkey", "o_custkey", "o_orderkey", "inner")


def _half(t, first: bool):
    year = F.year("o_orderdate")
    return t.orders.where(year <= 1997 if first else year > 1997)


@book.add("f4_match_columns", """with a as (select lower(column_name) as k, column_name as a, column_type in ('BIGINT', 'INTEGER', 'DOUBLE') as an
  from (describe orders)), b as (select replace(lower(column_name), 'l_orderkey', 'o_orderkey') as k, column_name as b, column_type in ('BIGINT', 'INTEGER', 'DOUBLE') as bn from (describe lineitem))
select case when a is not null then a else b end as name, case when a is null then 'only_b' when b is null then 'only_a' when an and bn then 'shared_numeric' else 'shared_other' end as status
from a full outer join b using (k)""")
def _(t):
    return R.match_columns(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "O_ORDERKEY"))


@book.add("g1_sum_by", """select coalesce(o_orderpriority, '-') as key, round(sum(o_totalprice), 2) as value from orders group by 1""")
def _(t):
    return G.sum_by(t.orders, "o_orderpriority", "o_totalprice").withColumn("value", rnd("value", 2))


@book.add("g2_count_by", """select p_brand as key, cast(count(*) as bigint) as n, round(count(*) / (select count(*) from part), 6) as share
  from part group by 1 order by n desc, key limit 15""")
def _(t):
    return G.count_by(t.part, "p_brand").withColumn("share", rnd("share", 6))


@book.add("g3_aggregates", """select 'sum' as agg, round(sum(l_extendedprice), 2) as value from lineitem
 union all select 'mean', round(avg(l_extendedprice), 4) from lineitem union all select 'max', max(l_extendedprice) from lineitem
 union all select 'min', min(l_extendedprice) from lineitem union all select 'median', round(median(l_extendedprice), 4) from lineitem
 union all select 'count', count(*)::double from lineitem union all select 'distinct', count(distinct l_partkey)::double from lineitem""")
def _(t):
    li = t.lineitem
    digits = {"sum": 2, "mean": 4, "median": 4}
    out = None
    for agg in G.AGGREGATES:
        one = G.aggregate(li, "l_partkey" if agg == "distinct" else "l_extendedprice", agg)
        one = one.select(F.lit(agg).alias("agg"), rnd("value", digits.get(agg, 2)).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@book.add("g4_rank_groups", """(select 'sum' as agg, p_brand, round(sum(l_extendedprice), 2) as value from lineitem join part on l_partkey = p_partkey group by 2 order by value desc, p_brand limit 10)
 union all (select 'mean', p_brand, round(avg(l_discount), 6) from lineitem join part on l_partkey = p_partkey group by 2 order by avg(l_discount), p_brand limit 10)""")
def _(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    a = G.rank_groups(j, "p_brand", "l_extendedprice").select(F.lit("sum").alias("agg"), "p_brand", rnd("value", 2).alias("value"))
    b = G.rank_groups(j, "p_brand", "l_discount", additive=False, largest=False).select(
        F.lit("mean").alias("agg"), "p_brand", rnd("value", 6).alias("value"))
    return a.unionByName(b)


@book.add("g4_group_median", """select l_returnflag, round(median(l_extendedprice), 4) as value from lineitem group by 1""")
def _(t):
    return G.group_aggregate(t.lineitem, ["l_returnflag"], "l_extendedprice", "median").withColumn("value", rnd("value", 4))


@book.add("g5_count_distinct", "select o_orderstatus, count(distinct o_custkey)::double as value from orders group by 1")
def _(t):
    return G.group_aggregate(t.orders, ["o_orderstatus"], "o_custkey", "distinct")


@book.add("g6_share_of_total", """select 'metric' as by_, round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2) as slice, round(sum(o_totalprice), 2) as total,
   round(sum(o_totalprice) filter (o_orderstatus = 'F') / sum(o_totalprice), 6) as share from orders
 union all select 'rows', count(*) filter (o_orderstatus = 'F')::double, count(*)::double, round(count(*) filter (o_orderstatus = 'F') / count(*), 6) from orders""")
def _(t):
    pred = F.col("o_orderstatus") == "F"
    parts = [G.share_of_total(t.orders, pred, m).select(
        F.lit(n).alias("by_"), rnd("slice", 2).alias("slice"), rnd("total", 2).alias("total"), rnd("share", 6).alias("share"))
        for n, m in (("metric", "o_totalprice"), ("rows", None))]
    return parts[0].unionByName(parts[1])


@book.add("g7_percentiles", """select round(quantile_cont(o_totalprice, 0.9), 4) as p90, round(quantile_cont(o_totalprice, 0.75), 4) as p75, round(quantile_cont(o_totalprice, 0.25), 4) as p25 from orders""")
def _(t):
    from ..functions.ranking import quantiles
    q = quantiles(t.orders, "o_totalprice", {"p90": .9, "p75": .75, "p25": .25})
    return q.select(*[rnd(c, 4).alias(c) for c in q.columns])


@book.add("g8_crosstab", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as value from lineitem group by 1, 2")
def _(t):
    return G.crosstab(t.lineitem, "l_returnflag", "l_linestatus", "l_quantity").withColumn("value", rnd("value", 2))


_DIMS_SQL = """d as (select 'o_orderstatus' as dimension, o_orderstatus as key from orders union all select 'o_orderpriority', o_orderpriority from orders),
c as (select dimension, key, count(*) as n from d where key is not null group by 1, 2),
r as (select *, row_number() over (partition by dimension order by n desc, key) as rank, n / sum(n) over (partition by dimension) as share from c)"""


@book.add("g15_category_facts", f"""with {_DIMS_SQL} select dimension, key, cast(n as bigint) as n, round(share, 6) as share, rank,
   round(max(share) over (partition by dimension), 6) as leader_share from r where rank <= 6""")
def _(t):
    out = G.category_facts(t.orders, ["o_orderstatus", "o_orderpriority"])
    return out.withColumn("share", rnd("share", 6)).withColumn("leader_share", rnd("leader_share", 6))


@book.add("c6_top_values", f"with {_DIMS_SQL} select dimension, key, cast(n as bigint) as n, round(share, 6) as share, rank from r where rank <= 12")
def _(t):
    return G.top_values(t.orders, ["o_orderstatus", "o_orderpriority"]).withColumn("share", rnd("share", 6))


_COMPARE_SQL = """with l as (select 'o_totalprice' as metric, case when year(o_orderdate) <= 1997 then 'a' else 'b' end as src, o_totalprice as v from orders
  union all select 'o_custkey', case when year(o_orderdate) <= 1997 then 'a' else 'b' end, o_custkey::double from orders),
w as (select metric, count(*) filter (src = 'a') as na, count(*) filter (src = 'b') as nb, sum(v) filter (src = 'a') as sa, sum(v) filter (src = 'b') as sb,
  avg(v) filter (src = 'a') as ma, avg(v) filter (src = 'b') as mb, var_samp(v) filter (src = 'a') / count(*) filter (src = 'a') as va, var_samp(v) filter (src = 'b') / count(*) filter (src = 'b') as vb from l group by 1)
select metric, cast(na as bigint) as n_a, cast(nb as bigint) as n_b, round(sa, 2) as sum_a, round(sb, 2) as sum_b, round(ma, 4) as mean_a, round(mb, 4) as mean_b,
 round((sb - sa) / abs(sa), 6) as sum_change, round((mb - ma) / abs(ma), 6) as mean_change, round((nb - na) / na, 6) as rows_change,
 round((ma - mb) / sqrt(va + vb), 6) as welch_t, round((va + vb) ** 2 / (va ** 2 / (na - 1) + vb ** 2 / (nb - 1)), 3) as welch_df from w"""


@book.add("g16_compare_datasets", _COMPARE_SQL)
def _(t):
    out = R.compare_datasets(_half(t, True), _half(t, False), ["o_totalprice", "o_custkey"], p_value=False)
    digits = {"sum_a": 2, "sum_b": 2, "mean_a": 4, "mean_b": 4, "sum_change": 6, "mean_change": 6, "rows_change": 6, "welch_t": 6,
              "welch_df": 3}
    return out.select(*[(rnd(c, digits[c]) if c in digits else F.col(c)).alias(c) for c in out.columns])


@book.add("g17_compare_groups", """select round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2) as total_a, round(sum(o_totalprice) filter (o_orderstatus = 'O'), 2) as total_b,
 round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as mean_a, round(avg(o_totalprice) filter (o_orderstatus = 'O'), 4) as mean_b,
 round(sum(o_totalprice) filter (o_orderstatus = 'O') - sum(o_totalprice) filter (o_orderstatus = 'F'), 2) as total_diff,
 round(avg(o_totalprice) filter (o_orderstatus = 'O') - avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as mean_diff,
 round(sum(o_totalprice) filter (o_orderstatus = 'O') / sum(o_totalprice) filter (o_orderstatus = 'F') - 1, 6) as total_change from orders""")
def _(t):
    out = G.compare_groups(t.orders, "o_orderstatus", "F", "O", "o_totalprice")
    return out.select(*[rnd(c, 6 if c == "total_change" else 4 if c.startswith("mean") else 2).alias(c) for c in out.columns])


@book.add("g17_compare_years", """select round(sum(o_totalprice) filter (year(o_orderdate) = 1996), 2) as total_a, round(sum(o_totalprice) filter (year(o_orderdate) = 1997), 2) as total_b,
 round(sum(o_totalprice) filter (year(o_orderdate) = 1997) / sum(o_totalprice) filter (year(o_orderdate) = 1996) - 1, 6) as total_change from orders""")
def _(t):
    out = G.compare_years(t.orders, "o_orderdate", 1996, 1997, "o_totalprice")
    return out.select(rnd("total_a", 2).alias("total_a"), rnd("total_b", 2).alias("total_b"), rnd("total_change", 6).alias("total_change"))


@book.add("g18_histogram", """with s as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
h as (select least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20)))::bigint as bin, count(*) as n from lineitem, s group by 1)
select b.bin::bigint as bin, round(lo + b.bin * ((hi - lo) / 20), 4) as low, round(lo + (b.bin + 1) * ((hi - lo) / 20), 4) as high, coalesce(n, 0)::bigint as n
from range(20) b(bin) cross join s left join h using (bin)""")
def _(t):
    h = G.histogram(t.lineitem, "l_extendedprice")
    return h.withColumn("low", rnd("low", 4)).withColumn("high", rnd("high", 4))


@book.add("g18_histogram_12", """with s as (select min(value) as lo, max(value) as hi from events),
h as (select least(11, floor((value - lo) / ((hi - lo) / 12)))::bigint as bin, count(*) as n from events, s group by 1)
select b.bin::bigint as bin, round(lo + b.bin * ((hi - lo) / 12), 4) as low, round(lo + (b.bin + 1) * ((hi - lo) / 12), 4) as high, coalesce(n, 0)::bigint as n
from range(12) b(bin) cross join s left join h using (bin)""")
def _(t):
    h = G.histogram(t.events, "value", bins=12, min_rows=20)
    return h.withColumn("low", rnd("low", 4)).withColumn("high", rnd("high", 4))


@book.add("g19_numeric_context", " union all ".join(
    f"""select '{m}' as metric, round(sum({m}), 2) as sum, round(avg({m}), 4) as mean, round(median({m}), 4) as median, min({m}) as min, max({m}) as max, cast(count({m}) as bigint) as n from lineitem"""
    for m in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def _(t):
    out = G.numeric_context(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.withColumn("sum", rnd("sum", 2)).withColumn("mean", rnd("mean", 4)).withColumn("median", rnd("median", 4))
