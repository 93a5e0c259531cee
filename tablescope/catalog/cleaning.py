"""Cleaning operators over a messy text rendering of all orders."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..operators import clean as C
from ..operators.infer import pattern_shares, types_from_shares
from ..session import localize
from ..sources.sinks import spreadsheet_safe
from .book import Book, Tables

book = Book()

COLUMNS = ["order_id", "customer", "amount", "order_date", "status", "priority", "is_open"]
TYPES = {"order_id": "id", "customer": "text", "amount": "currency", "order_date": "date", "status": "category",
         "priority": "category", "is_open": "boolean"}


def messy(t: Tables) -> DataFrame:
    """All orders as a spreadsheet export would show them: mixed formats, copies, totals and blank rows."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    us = F.format_number("o_totalprice", 2)
    plain = F.replace(us, F.lit(","))
    eu = F.translate(us, ",.", ".,")
    rows = t.wide("orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.when(s == "F", F.concat(F.lit("  Customer   "), F.col("o_custkey"), F.lit(" ")))
        .otherwise(F.concat(F.lit("Customer "), F.col("o_custkey"))).alias("customer"),
        F.when(s == "F", F.concat(F.lit("$"), us)).when(s == "O", F.concat(eu, F.lit(" €")))
        .when(p == "5-LOW", "N/A").when(p == "1-URGENT", F.concat(F.lit("("), us, F.lit(")")))
        .when(p == "3-MEDIUM", "-").otherwise(plain).alias("amount"),
        F.when(s == "F", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(s == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(p == "5-LOW", F.date_format("o_orderdate", "d MMM yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).alias("order_date"),
        F.when(s == "F", F.concat(F.lit(" "), s)).otherwise(s).alias("status"),
        F.when(p == "3-MEDIUM", "-").otherwise(p).alias("priority"),
        F.when(s == "O", "Yes").when(s == "F", "no").otherwise("1").alias("is_open"), p.alias("__p"))
    copies = rows.where(F.col("__p") == "2-HIGH")
    totals = t.orders.groupBy("o_orderstatus").agg(F.format_number(F.sum("o_totalprice"), 2).alias("amount")).select(
        F.lit("").alias("order_id"), F.lit("Grand Total").alias("customer"), "amount", F.lit("").alias("order_date"),
        F.col("o_orderstatus").alias("status"), F.lit("").alias("priority"), F.lit(None).cast("string").alias("is_open"),
        F.lit("").alias("__p"))
    blank = t.nation.select(*[F.lit(v).alias(c) for c, v in zip(
        COLUMNS, ["", " ", "N/A", "-", "null", "", "?"])], F.lit("").alias("__p"))
    return rows.unionByName(copies).unionByName(totals).unionByName(blank).drop("__p")


MESSY_SQL = """
rows_ as (select cast(o_orderkey as varchar) as order_id,
   case when o_orderstatus='F' then '  Customer   ' || o_custkey || ' ' else 'Customer ' || o_custkey end as customer,
   case when o_orderstatus='F' then '$' || format('{:,.2f}', o_totalprice)
        when o_orderstatus='O' then translate(format('{:,.2f}', o_totalprice), ',.', '.,') || ' €'
        when o_orderpriority='5-LOW' then 'N/A'
        when o_orderpriority='1-URGENT' then '(' || format('{:,.2f}', o_totalprice) || ')'
        when o_orderpriority='3-MEDIUM' then '-'
        else format('{:.2f}', o_totalprice) end as amount,
   case when o_orderstatus='F' then strftime(o_orderdate, '%d/%m/%Y')
        when o_orderstatus='O' then strftime(o_orderdate, '%Y-%m-%d')
        when o_orderpriority='5-LOW' then strftime(o_orderdate, '%-d %b %Y')
        else strftime(o_orderdate, '%Y-%m-%d %H:%M') end as order_date,
   case when o_orderstatus='F' then ' ' || o_orderstatus else o_orderstatus end as status,
   case when o_orderpriority='3-MEDIUM' then '-' else o_orderpriority end as priority,
   case o_orderstatus when 'O' then 'Yes' when 'F' then 'no' else '1' end as is_open,
   o_totalprice as true_amount, o_orderdate as true_date, o_orderpriority as p, o_orderstatus as s, o_custkey as k
  from orders),
doubled as (select * from rows_ union all select * from rows_ where p = '2-HIGH'),
totals as (select o_orderstatus as s, sum(o_totalprice) as amount from orders group by 1)
"""

NUMBER_CASE = """case when s = 'P' and p in ('5-LOW', '3-MEDIUM') then null when s = 'P' and p = '1-URGENT' then -true_amount
  else true_amount end"""


@book.add("b1_null_markers", f"""with {MESSY_SQL}
select 'amount' as column_name, cast((select count(*) from doubled where amount in ('N/A', '-')) + (select count(*) from nation) as bigint) as missing
union all select 'priority', cast((select count(*) from totals) + (select count(*) from nation) as bigint)
union all select 'order_date', cast((select count(*) from totals) + (select count(*) from nation) as bigint)
union all select 'is_open', cast((select count(*) from totals) + (select count(*) from nation) as bigint)""")
def _(t):
    out = C.null_markers(messy(t), TYPES)
    one = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ["amount", "priority", "order_date", "is_open"]])
    return one.unpivot([], ["amount", "priority", "order_date", "is_open"], "column_name", "missing")


@book.add("b2_normalize_raw", """select cast(o_orderkey as bigint) as o_orderkey, round(o_totalprice, 2) as amount,
  'Customer ' || o_custkey as customer, case when o_orderstatus = 'F' then null else o_orderstatus end as note from orders""")
def _(t):
    raw = t.orders.select("o_orderkey", F.translate(F.format_number("o_totalprice", 2), ",.", ".,").alias("amount"),
                          F.concat(F.lit(" Customer "), F.col("o_custkey"), F.lit("  ")).alias("customer"),
                          F.when(F.col("o_orderstatus") == "F", "#N/A").otherwise(F.col("o_orderstatus")).alias("note"))
    return C.normalize_raw(raw).withColumn("amount", F.round("amount", 2))


@book.add("b3_parse_number", f"""with {MESSY_SQL}
select amount, cast(count(*) as bigint) as n, round({NUMBER_CASE}, 2) as value from doubled group by all""")
def _(t):
    m = messy(t).where(F.col("order_id") != "")
    return m.groupBy("amount").agg(F.count("*").alias("n")).select(
        "amount", "n", F.round(cells.parse_number(F.col("amount")), 2).alias("value"))


@book.add("b4_day_first", """select max(case when day(o_orderdate) > 12 then true end) as dmy_is_day_first,
  coalesce(max(case when day(o_orderdate) > 12 then false end), false) as mdy_is_day_first from orders""")
def _(t):
    raw = t.orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("dmy"),
                          F.date_format("o_orderdate", "MM/dd/yyyy").alias("mdy"))
    found = C.day_first_columns(raw, ["dmy", "mdy"], "o_orderkey")
    votes = raw.agg(F.max(cells.day_first_vote(F.col("dmy"))).alias("a"), F.min(cells.day_first_vote(F.col("mdy"))).alias("b"))
    return votes.select((F.lit(found["dmy"]) & (F.col("a") == 1)).alias("dmy_is_day_first"),
                        (F.lit(found["mdy"]) | (F.col("b") == 1)).alias("mdy_is_day_first"))


@book.add("b5_canonical_date", f"""with {MESSY_SQL}
select order_date, cast(count(*) as bigint) as n, case when s = 'P' and p <> '5-LOW' then strftime(true_date, '%Y-%m-%d %H:%M')
   else strftime(true_date, '%Y-%m-%d') end as canonical from doubled group by all""")
def _(t):
    m = messy(t).where(F.col("order_id") != "")
    return m.groupBy("order_date").agg(F.count("*").alias("n")).select(
        "order_date", "n", cells.canonical_date(F.col("order_date"), True).alias("canonical"))


CLEAN_ROWS = f"""cleaned as (select order_id, 'Customer ' || k as customer, round({NUMBER_CASE}, 2) as amount,
   cast(true_date as timestamp) as order_date, s as status, case when p = '3-MEDIUM' then '-' else p end as priority,
   s <> 'F' as is_open from doubled)"""


@book.add("b6_normalize_cells", f"with {MESSY_SQL}, {CLEAN_ROWS} select * from cleaned")
def _(t):
    m = messy(t).where(F.col("order_id") != "")
    out = m.select(*[cells.typed(cells.normalize(F.col(c), TYPES[c], True), TYPES[c]).alias(c) for c in COLUMNS])
    return out.withColumn("amount", F.round("amount", 2))


@book.add("b7_drop_empty_rows", f"""with {MESSY_SQL} select status, cast(count(*) as bigint) as n from
  (select status from doubled union all select s from totals) group by 1""")
def _(t):
    return messy(t).where(~C.is_empty_row(COLUMNS, TYPES)).groupBy("status").agg(F.count("*").alias("n"))


@book.add("b8_drop_total_rows", f"""with {MESSY_SQL} select priority, cast(count(*) as bigint) as n from
  (select priority from doubled union all select '' from nation) group by 1""")
def _(t):
    return messy(t).where(~C.is_total_row(COLUMNS, TYPES)).groupBy("priority").agg(F.count("*").alias("n"))


@book.add("b9_exact_dedup", f"with {MESSY_SQL} select distinct order_id, customer, amount, order_date, status, priority, is_open from rows_")
def _(t):
    m = messy(t)
    return m.where(~C.is_empty_row(COLUMNS, TYPES) & ~C.is_total_row(COLUMNS, TYPES)).dropDuplicates()


@book.add("b10_cleaning_report", f"""with {MESSY_SQL}, r as (
select 'table' as scope, 'rows_before' as metric, (select count(*) from doubled) + (select count(*) from totals) + (select count(*) from nation) as n
union all select 'table', 'empty_rows', (select count(*) from nation)
union all select 'table', 'total_rows', (select count(*) from totals)
union all select 'table', 'rows_after', (select count(*) from rows_)
union all select 'table', 'duplicates', (select count(*) from rows_ where p = '2-HIGH')
union all select 'order_id', m, 0 from (values ('missing'), ('normalized'), ('trimmed')) v(m)
union all select 'customer', 'missing', 0
union all select 'customer', 'normalized', (select count(*) from doubled where s = 'F')
union all select 'customer', 'trimmed', (select count(*) from doubled where s = 'F')
union all select 'status', 'missing', 0
union all select 'status', 'normalized', (select count(*) from doubled where s = 'F')
union all select 'status', 'trimmed', (select count(*) from doubled where s = 'F')
union all select 'priority', m, 0 from (values ('missing'), ('normalized'), ('trimmed')) v(m)
union all select 'is_open', 'missing', 0
union all select 'is_open', 'normalized', (select count(*) from doubled)
union all select 'is_open', 'trimmed', 0
union all select 'amount', 'missing', (select count(*) from doubled where amount in ('N/A', '-'))
union all select 'amount', 'trimmed', 0
union all select 'order_date', 'missing', 0
union all select 'order_date', 'trimmed', 0
union all select 'order_date', 'normalized', (select count(*) from doubled where s = 'F' or (s = 'P' and p = '5-LOW'))
union all select 'amount', 'normalized', (select count(*) from doubled where amount not in ('N/A', '-')
   and (s in ('F', 'O') or p = '1-URGENT' or amount like '%0')) )
select scope, metric, cast(n as bigint) as n from r
union all select 'table', 'cells_normalized', cast(sum(n) as bigint) from r where metric = 'normalized'
union all select 'table', 'cells_trimmed', cast(sum(n) as bigint) from r where metric = 'trimmed'""")
def _(t):
    pairs = C.side_by_side(messy(t), TYPES, {"order_date": True})
    return C.report(pairs, TYPES)


@book.add("b11_preview")
def _(t):
    m = messy(t).where(F.col("order_id") != "").withColumn("row_id", F.col("order_id").try_cast("long"))
    return C.preview(m, TYPES, {"order_date": True}, "row_id")


@book.add("b12_clean_table", f"with {MESSY_SQL}, {CLEAN_ROWS} select distinct * from cleaned")
def _(t):
    cleaned = C.clean(messy(t), type_overrides={"order_id": "id"})
    return cleaned.df.withColumn("amount", F.round("amount", 2))


@book.add("b13_drop_empty_columns", "select o_orderkey, o_orderstatus from orders")
def _(t):
    raw = t.orders.select("o_orderkey", F.lit(None).cast("string").alias("unused"), "o_orderstatus")
    return C.drop_empty_columns(raw)


_TYPED_SQL = f"""with {MESSY_SQL},
everything as (select order_id, customer, amount, order_date, status, priority, is_open from doubled
  union all select '', 'Grand Total', format('{{:,.2f}}', amount), '', s, '', null from totals
  union all select '', ' ', 'N/A', '-', 'null', '', '?' from nation),
long as (unpivot everything on columns(*) into name column_name value raw),
cell as (select column_name, trim(raw) as v from long where lower(trim(raw)) not in
  ('', 'n/a', 'na', 'null', 'none', 'unknown', '-', '--', '?', '.')),
m as (select column_name, count(*) as n, count(distinct lower(v)) as d,
  avg(cast(lower(v) in ('true', 'yes', 'y', '1', 'false', 'no', 'n', '0') as int)) as boolean_share,
  avg(cast(regexp_matches(v, '^\\s*\\(?\\s*([$€]\\s?[0-9.,]+|[0-9.,]+\\s?[$€])\\s*\\)?\\s*$') as int)) as currency_share,
  avg(cast(regexp_matches(v, '^\\s*-?[0-9,]+(\\.[0-9]+)?\\s*$') as int)) as numeric_share,
  avg(cast(length(v) >= 6 and (regexp_matches(v, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') or regexp_matches(v, '^[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{2,4}}')
      or regexp_matches(v, '^[0-9]{{1,2}}\\s+[A-Za-z]{{3,}}\\s+[0-9]{{2,4}}')) as int)) as date_share
  from cell group by 1)
select column_name, cast(n as bigint) as non_missing, round(boolean_share, 6) as boolean_share, round(currency_share, 6) as currency_share,
  round(numeric_share, 6) as numeric_share, round(date_share, 6) as date_share,
  case when boolean_share > .95 and d <= 3 then 'boolean' when currency_share > .7 then 'currency'
       when column_name = 'amount' and numeric_share > .7 then 'currency' when date_share > .7 then 'date'
       when numeric_share > .8 then case when column_name = 'order_id' and d / n > .8 then 'id' else 'integer' end
       when d / n < .5 and d <= 50 then 'category' when column_name = 'order_id' then 'id' else 'text' end as semantic_type from m"""


@book.add("c1_infer_types", _TYPED_SQL)
def _(t):
    shares = localize(pattern_shares(messy(t)))
    names = F.create_map(*[F.lit(x) for kv in types_from_shares(shares).items() for x in kv])
    return shares.select(
        F.col("column").alias("column_name"), F.col("non_missing").cast("long").alias("non_missing"),
        *[F.round(c, 6).alias(c) for c in ["boolean_share", "currency_share", "numeric_share", "date_share"]],
        names[F.col("column")].alias("semantic_type"))


@book.add("a9_spreadsheet_safe", """with v as (select o_orderkey, case o_orderstatus when 'F' then '=' || o_orderpriority
   when 'O' then '-' || cast(floor(o_totalprice) as bigint) else '@' || o_custkey end as cell from orders)
select o_orderkey, case when cell like '-%' then cell else '''' || cell end as cell from v""")
def _(t):
    s = F.col("o_orderstatus")
    raw = t.orders.select("o_orderkey", F.when(s == "F", F.concat(F.lit("="), F.col("o_orderpriority")))
                          .when(s == "O", F.concat(F.lit("-"), F.floor("o_totalprice")))
                          .otherwise(F.concat(F.lit("@"), F.col("o_custkey"))).alias("cell"))
    return spreadsheet_safe(raw)
