"""Profiles, roles, domains and data quality over business-named views of the tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import profile as P
from ..operators import quality as Q
from ..operators import clean as C
from ..operators.anomaly import outlier_share
from ..session import freeze, localize
from .book import Book
from .cleaning import COLUMNS, MESSY_SQL, TYPES, messy
from .concentration import rounded

book = Book()

# business names for the driver's columns: {view: (table, {new name: (column, kind)})}
VIEWS = {
    "sales": ("orders", {"order_id": ("o_orderkey", "n"), "customer_id": ("o_custkey", "n"), "order_status": ("o_orderstatus", "s"),
                         "sales_amount": ("o_totalprice", "n"), "order_date": ("o_orderdate", "d"), "priority": ("o_orderpriority", "s")}),
    "shipments": ("lineitem", {"order_id": ("l_orderkey", "n"), "quantity": ("l_quantity", "n"), "price": ("l_extendedprice", "n"),
                               "discount_rate": ("l_discount", "n"), "tax_rate": ("l_tax", "n"), "return_flag": ("l_returnflag", "s"),
                               "ship_date": ("l_shipdate", "d")}),
    "clients": ("customer", {"customer_id": ("c_custkey", "n"), "name": ("c_name", "s"), "nation_code": ("c_nationkey", "n"),
                             "balance": ("c_acctbal", "n"), "segment": ("c_mktsegment", "s")}),
    "products": ("part", {"part_id": ("p_partkey", "n"), "product": ("p_name", "s"), "brand": ("p_brand", "s"), "type": ("p_type", "s"),
                          "size": ("p_size", "n"), "unit_price": ("p_retailprice", "n")}),
    "sessions": ("events", {"event_id": ("event_id", "n"), "time": ("ts", "d"), "user_id": ("user_id", "n"), "channel": ("event_type", "s"),
                            "engagement": ("value", "n")}),
}


def view(t, name: str) -> DataFrame:
    table, cols = VIEWS[name]
    return getattr(t, table).select(*[F.col(c).alias(n) for n, (c, _) in cols.items()])


def profiles(t) -> DataFrame:
    return localize(reduce(DataFrame.unionByName, [P.profile(view(t, v), v) for v in VIEWS]))


def _profile_sql() -> str:
    parts = []
    for v, (table, cols) in VIEWS.items():
        for i, (name, (c, kind)) in enumerate(cols.items()):
            num = kind == "n"
            stats = (f"min({c})::double, max({c})::double, avg({c})::double, coalesce(stddev_samp({c}), 0)::double, sum({c})::double, median({c})::double, bool_and({c} = floor({c}))"
                     if num else "null::double, null::double, null::double, null::double, null::double, null::double, null::boolean")
            dates = f"min({c})::timestamp, max({c})::timestamp" if kind == "d" else "null::timestamp, null::timestamp"
            parts.append(f"""select '{v}' as table_name, '{name}' as col, {i} as position, '{kind}' as kind, count(*) as rows, count({c}) as non_null, count(distinct {c}) as dist, {stats}, {dates} from {table}""")
    names = "table_name, col, position, kind, rows, non_null, dist, mn, mx, mean, sd, total, med, whole, dmin, dmax"
    words = "replace(col, '_', ' ')"
    return f"""raw({names}) as ({' union all '.join(parts)}),
typed as (select *, dist / non_null as card, non_null / rows as fill, case when kind = 'd' then 'date'
  when kind = 'n' then case when regexp_matches({words}, '(price|amount|sales|balance|value|cost)') then 'currency'
    when whole and regexp_matches(col, '(_id|id$|code|number|key)') and dist / non_null > 0.8 then 'id' when whole then 'integer' else 'number' end
  when dist / non_null < 0.5 and dist <= 50 then 'category' when regexp_matches(col, '(_id|id$|key)') then 'id' else 'text' end as type from raw),
prof as (select *, case when type = 'date' then 'time' when type = 'id' then 'identifier' when type in ('currency', 'integer', 'number') then 'metric'
  when type = 'category' or (type = 'text' and card < .5) then 'dimension' else 'other' end as role from typed),
facts as (select table_name, max(rows) as rows, arg_max(col, dist) filter (role = 'time') as time_column,
  max(rows) >= 12 and bool_or(role = 'time') and bool_or(role in ('dimension', 'identifier') and dist >= 2 and dist <= greatest(2, rows * .7)) as transaction_grain,
  bool_or(role = 'metric') as has_metric from prof group by 1)"""


PROF = _profile_sql()


@book.add("c3_profile_tables", f"""with {PROF} select table_name, col as "column", rows, non_null, dist as "distinct", round(fill, 6) as fill, round(card, 6) as cardinality, type, role,
  round(mn, 4) as min, round(mx, 4) as max, round(mean, 4) as mean, round(sd, 4) as sd, round(total, 2) as sum, round(med, 4) as median, dmin as date_min, dmax as date_max from prof""")
def _(t):
    out = profiles(t).drop("position", "all_integer")
    return rounded(out, {"fill": 6, "cardinality": 6, "min": 4, "max": 4, "mean": 4, "sd": 4, "sum": 2, "median": 4})


@book.add("c3_profile_approx")
def _(t):
    out = reduce(DataFrame.unionByName, [P.profile(getattr(t, n), n, exact=False) for n in
                                         ["lineitem", "documents", "pages", "benchmark", "conversations", "labels"]])
    return out.drop("all_integer")


@book.add("c3_samples", """with v as (select distinct 'order_status' as "column", cast(o_orderstatus as varchar) as v from orders union all select distinct 'priority', o_orderpriority from orders)
select "column", list(v order by v)[1:5] as samples from v group by 1""")
def _(t):
    return P.samples(view(t, "sales").select("order_status", "priority"))


@book.add("c4_numeric_summary", " union all ".join(
    f"select '{c}' as \"column\", min({c}) as min, max({c}) as max, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as sd, round(sum({c}), 2) as sum, round(median({c}), 4) as median, count(*) as n from events" for c in ["value"]))
def _(t):
    p = P.profile(t.events.select("value"), "events")
    return rounded(p.select("column", "min", "max", "mean", "sd", "sum", "median", F.col("non_null").alias("n")), {"mean": 4, "sd": 4, "sum": 2, "median": 4})


@book.add("c2_datelike", f"""with {MESSY_SQL}, e as (select order_date, amount from doubled union all select '', format('{{:,.2f}}', amount) from totals union all select '-', 'N/A' from nation),
v as (select 'order_date' as "column", order_date as v from e where order_date not in ('', '-') union all select 'amount', amount from e where amount not in ('N/A', '-'))
select "column", round(avg(cast(regexp_matches(v, '^\\s*-?[0-9,]+(\\.[0-9]+)?\\s*$') as int)), 6) as numeric_share, "column" = 'order_date' as datelike from v group by 1""")
def _(t):
    return P.is_datelike(messy(t).select("order_date", "amount")).select("column", rnd("numeric_share", 6).alias("numeric_share"), "datelike")


@book.add("c7_roles", f"""with {PROF} select table_name, role, count(*) as n from prof group by 1, 2""")
def _(t):
    return profiles(t).groupBy("table_name", "role").agg(F.count("*").alias("n"))


@book.add("c8_table_facts", f"with {PROF} select table_name, rows, time_column, transaction_grain, has_metric from facts")
def _(t):
    return P.table_facts(profiles(t))


_WORDS = "replace(col, '_', ' ')"
_KEY = f"""{PROF}, dom as (select table_name, 'x' as domain from facts),
m as (select prof.*, regexp_matches({_WORDS}, '\\b(sales|amount)\\b') as rev, regexp_matches({_WORDS}, '\\b(quantity|units?)\\b') as qty, regexp_matches({_WORDS}, '(\\brate\\b|\\bid\\b|\\bcode\\b)') as attr,
  type = 'currency' or regexp_matches({_WORDS}, '\\b(price|rate)\\b') as priced from prof where role = 'metric'),
k as (select table_name, coalesce(arg_max(col, total) filter (rev and not attr and not qty), case when max(f.transaction_grain) then arg_max(col, total) filter (priced and not attr) end) as revenue
  from m join facts f using (table_name) group by 1),
q as (select table_name, max(revenue) as revenue, arg_max(col, total) filter (qty and not attr and col is distinct from revenue) as quantity,
  coalesce(max(revenue), arg_max(col, total) filter (type = 'currency'), arg_max(col, sd)) as primary_metric from m join k using (table_name) group by 1)"""


@book.add("c10_key_metrics", f"with {_KEY} select * from q")
def _(t):
    return P.key_metrics(profiles(t))


@book.add("c12_metric_kinds", f"""with {_KEY}, z as (select table_name, col, case when col = revenue then 'value' when qty and not attr then 'quantity'
   when regexp_matches({_WORDS}, '\\b(sales|amount)\\b') and not attr then 'value' else 'attribute' end as kind, regexp_matches({_WORDS}, '\\brate\\b') as rate_like from m join k using (table_name))
select table_name, col as "column", kind, rate_like, kind <> 'attribute' as additive, case when kind <> 'attribute' then 'sum' else 'mean' end as agg_kind from z""")
def _(t):
    p = profiles(t)
    return P.metric_kinds(p, P.key_metrics(p))


@book.add("c13_value_tautology", f"""with {PROF} select a.table_name, a.col as metric, b.col as dimension, regexp_matches(replace(a.col, '_', ' '), '\\bprice\\b') or regexp_matches(replace(b.col, '_', ' '), '\\b(product|brand|type)\\b') as tautology
 from prof a join prof b on a.table_name = b.table_name where a.role = 'metric' and b.role = 'dimension'""")
def _(t):
    from ..operators.stats import value_tautology
    p = profiles(t)
    m = p.where(F.col("role") == "metric").select("table_name", F.col("column").alias("metric"))
    d = p.where(F.col("role") == "dimension").select("table_name", F.col("column").alias("dimension"))
    return m.join(d, "table_name").withColumn("tautology", value_tautology(F.col("metric"), F.col("dimension")))


_DOMAIN = f"""{PROF}, h as (select table_name, sum(regexp_matches({_WORDS}, '(\\bprice\\b|\\bvolume\\b|\\bbalance\\b)')::int) as weak,
  sum(regexp_matches({_WORDS}, '(sales|order|quantity|units?\\b|product|customer|client|\\bprice\\b|discount|brand|category)')::int) as sales,
  sum(regexp_matches({_WORDS}, '(channel|session|engagement|click|spend)')::int) as marketing from prof group by 1),
s as (select h.table_name, case when sales > 0 then sales + transaction_grain::int else 0 end as sales, case when transaction_grain then 0 else weak + (time_column is not null and weak > 0)::int end as fin, marketing, time_column, has_metric from h join facts using (table_name)),
x as (select *, greatest(sales, fin, marketing) as score from s)"""


@book.add("c15_domain", f"""with {_DOMAIN} select table_name, case when score = 0 then 'generic' when sales = score then 'sales-operational' when fin = score then 'financial-timeseries' else 'marketing' end as domain,
  cast(score as bigint) as score, case when score > 0 then round(least(.95, .4 + score * .16), 4) when time_column is not null and has_metric then .5 else .3 end as confidence from x""")
def _(t):
    return P.detect_domain(profiles(t)).withColumn("confidence", rnd("confidence", 4))


@book.add("c16_industry", f"""with {PROF}, t as (select table_name, string_agg(replace(col, '_', ' '), ' | ' order by position) as h from prof group by 1),
k as (select * from (values ('E-commerce / retail', 'order', 3), ('E-commerce / retail', 'product', 3), ('E-commerce / retail', 'quantity', 3), ('E-commerce / retail', 'discount', 3), ('E-commerce / retail', 'units', 3),
 ('Sales / revenue', 'sales', 4), ('Sales / revenue', 'rep', 4), ('Sales / revenue', 'revenue', 4), ('Marketing / advertising', 'channel', 2), ('Finance / investing', 'balance', 7), ('Finance / investing', 'return', 7), ('SaaS / subscriptions', 'arr', 1)) v(industry, key, o)),
c as (select table_name, industry, count(*) as hits, max(o) as o from t join k on contains(h, key) group by 1, 2), r as (select *, row_number() over (partition by table_name order by hits desc, o) as rn from c)
select table_name, industry, hits from r where rn = 1""")
def _(t):
    return P.detect_industry(profiles(t))


@book.add("c17_currency", f"""select 'cells' as input, case when f > o then 'USD' else 'EUR' end as code, case when f > o then '$' else '€' end as symbol, 'cells' as source
 from (select sum(w) filter (o_orderstatus = 'F') as f, sum(w) filter (o_orderstatus = 'O') as o from (select o_orderstatus, 1 + (o_orderpriority = '2-HIGH')::int as w from orders))
 union all select 'header', 'EUR', '€', 'header' union all select 'word', 'GBP', '£', 'header' union all select 'none', 'USD', '$', 'default'""")
def _(t):
    m = messy(t)
    priced = t.part.select(F.col("p_retailprice").alias("unit_price_eur"), F.col("p_retailprice").alias("price_sterling"), F.col("p_retailprice").alias("price"))
    parts = [("cells", m, ["amount"]), ("header", priced, ["unit_price_eur"]), ("word", priced, ["price_sterling"]), ("none", priced, ["price"])]
    return reduce(DataFrame.unionByName, [P.detect_currency(df, cols).select(F.lit(n).alias("input"), "code", "symbol", "source") for n, df, cols in parts])


def _gappy(t):
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", "o_totalprice", F.when(p == "5-LOW", F.lit(None)).otherwise(F.col("o_orderstatus")).alias("status"),
                           F.when(p.isin("1-URGENT", "2-HIGH"), p).alias("priority"), F.lit("EU").alias("market"))


_GAPS = """g as (select 'status' as col, avg((o_orderpriority <> '5-LOW')::int) as fill, 1 as o from orders union all select 'priority', avg((o_orderpriority in ('1-URGENT', '2-HIGH'))::int), 2 from orders),
c as (select col, fill, case when fill < .7 then 'bad' else 'warn' end as severity, case when fill < .9 then 'sparse' else 'single value' end as reason from g where fill < .9 union all select 'market', 1.0, 'warn', 'single value')"""


@book.add("c18_caveats", f"""with {_GAPS} select 'orders' as table_name, col as "column", severity, reason, round(fill, 6) as fill, row_number() over (order by severity <> 'bad', case col when 'status' then 1 when 'priority' then 2 else 3 end) as rank from c""")
def _(t):
    return P.caveats(P.profile(_gappy(t), "orders")).withColumn("fill", rnd("fill", 6))


@book.add("c18_kpi_caveats", """select 'a' as id, 'priority' as caveat_column, 'bad' as severity from (select count(*) from orders) union all select 'b', 'market', 'warn' union all select 'c', null, null""")
def _(t):
    kpis = _gappy(t).agg(F.sum("o_totalprice").alias("v")).select(F.inline(F.array(*[
        F.struct(F.lit("orders").alias("table_name"), F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(h).alias("how_computed")) for i, n, h in
        [("a", "Top priority", "status and Priority shares"), ("b", "Market total", "sum"), ("c", "Total", "sum")]])))
    return P.caveat_for_kpi(kpis, P.caveats(P.profile(_gappy(t), "orders"))).select("id", "caveat_column", "severity")


@book.add("c19_text_columns", """select 'text' as "column", round(avg(len(regexp_split_to_array(v, '\\s+'))), 4) as mean_words from (select regexp_replace(text, '^ +| +$', '', 'g') as v from documents) where v <> ''""")
def _(t):
    d = t.documents
    return P.text_columns(d, P.profile(d, "documents")).withColumn("mean_words", rnd("mean_words", 4))


@book.add("m6_pick_entity", f"""with {PROF}, e as (select table_name, col, position, role, dist > 1 and dist < rows as recurs, regexp_matches(replace(col, '_', ''), '(customer|user|session|id$)') as named from prof)
select table_name, coalesce(arg_min(col, position) filter (recurs and role = 'identifier'), arg_min(col, position) filter (recurs and named)) as entity from e group by 1""")
def _(t):
    return P.pick_entity(profiles(t))


_SCORE = f"""{MESSY_SQL}, r as (select (select count(*) from doubled) + (select count(*) from totals) + (select count(*) from nation) as before_, (select count(*) from rows_) as after_, (select count(*) from rows_ where p = '2-HIGH') as dups,
 (select count(*) filter (s = 'F') * 2 + count(*) + count(*) filter (s = 'F' or (s = 'P' and p = '5-LOW')) + count(*) filter (amount not in ('N/A', '-') and (s in ('F', 'O') or p = '1-URGENT' or amount like '%0')) + count(*) filter (s = 'F') * 2 from doubled) as messy_cells),
a as (select cast(case when s = 'P' and p in ('5-LOW', '3-MEDIUM') then null when s = 'P' and p = '1-URGENT' then -true_amount else true_amount end as double) as amount from rows_),
o as (select count(amount) as cells, count(*) filter (abs((amount - (select avg(amount) from a)) / (select stddev_samp(amount) from a)) >= 3.5) as extreme from a),
f as (select (6 + (select count(amount) / count(*) from a)) / 7 as fill)"""


@book.add("d1_scorecard", f"""with {_SCORE}, c as (select 'completeness' as "check", fill as score, .3 as weight from f union all select 'uniqueness', 1 - dups / before_, .2 from r union all select 'informative', 1.0, .15
 union all select 'consistency', greatest(0, 1 - 2 * messy_cells / (after_ * 7)), .15 from r union all select 'outliers', greatest(0, 1 - 10 * extreme / cells), .2 from o),
t as (select round(sum(score * weight) / sum(weight) * 100)::bigint as total from c)
select total, case when total >= 90 then 'A' when total >= 80 then 'B' when total >= 70 then 'C' when total >= 60 then 'D' else 'F' end as grade, "check", round(score, 6) as score, weight::double as weight,
 case when score >= .85 then 'good' when score >= .6 then 'warn' else 'bad' end as status from c, t""")
def _(t):
    raw = messy(t)
    cleaned = C.clean(raw, type_overrides=TYPES)
    table = freeze(cleaned.df)  # read several times below
    p = P.profile(table.select(*COLUMNS), "messy", types=TYPES)
    return Q.scorecard(p, cleaned.report, outlier_share(table, ["amount"])).withColumn("score", rnd("score", 6))


_DUPES = """with b as (select o_orderstatus, o_orderpriority, cast(null as varchar) as note, 'EU' as market from orders), d as (select count(*) as rows, count(*) - (select count(*) from (select distinct * from b)) as dups from b)"""


def _flat(t):
    return t.orders.select("o_orderstatus", "o_orderpriority", F.lit(None).cast("string").alias("note"), F.lit("EU").alias("market"))


@book.add("d2_quality_rating", f"""{_DUPES} select 4::bigint as columns, .75::double as completeness, 1::bigint as constants, 1::bigint as sparse, rows, dups as duplicates,
  round(greatest(0, least(1, .75 * .7 + (1 - dups / rows) * .3 - .05)) * 100)::bigint as score, case when round((.75 * .7 + (1 - dups / rows) * .3 - .05) * 100) >= 85 then 'good' when round((.75 * .7 + (1 - dups / rows) * .3 - .05) * 100) >= 65 then 'fair' else 'weak' end as rating from d""")
def _(t):
    return Q.rating(P.profile(_flat(t), "flat"), Q.duplicate_rows(_flat(t)))


@book.add("d2_quality_issues", f"""{_DUPES} select 'sparse' as kind, 'note' as subject, 1.0::double as size union all select 'constant', 'market', 1.0 union all select 'duplicates', 'rows', dups::double from d""")
def _(t):
    return Q.issues(P.profile(_flat(t), "flat"), Q.duplicate_rows(_flat(t)))
