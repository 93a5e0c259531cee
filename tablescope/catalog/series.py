"""Time series and forecasts: lineitem by ship month, orders by month, events by day."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rnd
from ..operators import forecast as J
from ..operators import timeseries as S
from .book import Book
from .concentration import rounded

book = Book()


def monthly(t):
    return S.period_sums(t.lineitem, "l_shipdate", "l_extendedprice", "monthly", ["l_returnflag"])


def daily(t):
    return S.period_sums(t.events, "ts", "value", "daily", ["event_type"])


M = """m as (select l_returnflag, date_trunc('month', l_shipdate)::date as period, sum(l_extendedprice) as value, count(*) as n from lineitem group by 1, 2),
o as (select *, row_number() over (partition by l_returnflag order by period) as pos, count(*) over (partition by l_returnflag) as np from m)"""
TRIM = M + """, med as (select l_returnflag, median(value) as med from o where pos < np group by 1),
tr as (select o.* from o join med using (l_returnflag) where not (pos = np and np >= 4 and value < 0.5 * med))"""


@book.add("i1_cadence", """with g as (select 'orders' as name, d from (select distinct o_orderdate as d from orders) union all
  select 'shipped months', d from (select distinct date_trunc('month', l_shipdate) as d from lineitem)
  union all select 'quarters', d from (select distinct date_trunc('quarter', o_orderdate) as d from orders)
  union all select 'events', d from (select distinct ts as d from events)),
x as (select name, epoch(d) / 86400.0 - lag(epoch(d) / 86400.0) over (partition by name order by d) as gap from g),
c as (select name, median(gap) as g from x where gap > 0 group by 1)
select name, case when g <= 1.5 then 'daily' when g <= 10 then 'weekly' when g <= 45 then 'monthly' when g <= 130 then 'quarterly' else 'yearly' end as cadence from c""")
def _(t):
    frames = {"orders": (t.orders, "o_orderdate"),
              "shipped months": (t.lineitem.select(F.date_trunc("month", "l_shipdate").alias("d")), "d"),
              "quarters": (t.orders.select(F.date_trunc("quarter", "o_orderdate").alias("d")), "d"), "events": (t.events, "ts")}
    found = [(n, S.detect_cadence(df, c)) for n, (df, c) in frames.items()]
    return t.spark.createDataFrame(found, "name string, cadence string")


@book.add("i2_period_labels", """select o_orderdate, strftime(o_orderdate, '%Y-%m-%d') as daily, strftime(o_orderdate, '%G-W%V') as weekly, strftime(o_orderdate, '%Y-%m') as monthly,
  year(o_orderdate) || '-Q' || quarter(o_orderdate) as quarterly, cast(year(o_orderdate) as varchar) as yearly from (select distinct o_orderdate from orders)""")
def _(t):
    d = t.orders.select("o_orderdate").distinct()
    return d.select("o_orderdate", *[S.period_label(S.period_start("o_orderdate", c), c).alias(c) for c in S.UNIT])


@book.add("i3_period_sums", f"""with {M} select l_returnflag, period, strftime(period, '%Y-%m') as label, round(value, 2) as value, n from m""")
def _(t):
    return rounded(monthly(t), {"value": 2})


@book.add("i4_trim_partial_tail", f"""with {TRIM} select l_returnflag, strftime(period, '%Y-%m') as label, round(value, 2) as value from tr""")
def _(t):
    return rounded(S.trim_partial_tail(monthly(t), ["l_returnflag"]), {"value": 2}).select("l_returnflag", "label", "value")


_CHANGES = f"""with {M} select l_returnflag, strftime(period, '%Y-%m') as label, pos, round(value, 2) as value,
 round((value - lag(value) over w) / abs(lag(value) over w), 6) as change, round((value - lag(value, 12) over w) / abs(lag(value, 12) over w), 6) as year_change,
 case when pos >= 3 then round(avg(value) over (partition by l_returnflag order by period rows 2 preceding), 3) end as moving_average from o window w as (partition by l_returnflag order by period)"""


@book.add("i5_changes", _CHANGES)
def _(t):
    out = S.changes(monthly(t), "monthly", ["l_returnflag"])
    return rounded(out.select("l_returnflag", "label", "pos", "value", "change", "year_change", "moving_average"),
                   {"value": 2, "change": 6, "year_change": 6, "moving_average": 3})


@book.add("i6_calendar_year_change", f"""with {M} select a.l_returnflag, strftime(a.period, '%Y-%m') as label, round((a.value - b.value) / abs(b.value), 6) as year_change
 from m a left join m b on a.l_returnflag = b.l_returnflag and b.period = (a.period - interval 1 year)::date""")
def _(t):
    out = S.changes(monthly(t), "monthly", ["l_returnflag"], calendar=True)
    return out.select("l_returnflag", "label", rnd("year_change", 6).alias("year_change"))


@book.add("i7_moving_average_daily", """with m as (select event_type, ts::date as period, sum(value) as value from events group by 1, 2),
o as (select *, row_number() over (partition by event_type order by period) as pos from m)
select event_type, strftime(period, '%Y-%m-%d') as label, case when pos >= 7 then round(avg(value) over (partition by event_type order by period rows 6 preceding), 4) end as moving_average from o""")
def _(t):
    return S.changes(daily(t), "daily", ["event_type"]).select("event_type", "label", rnd("moving_average", 4).alias("moving_average"))


@book.add("i8_best_and_worst", f"""with {M} select l_returnflag, strftime(arg_max(period, value), '%Y-%m') as best, round(max(value), 2) as best_value,
 strftime(arg_min(period, value), '%Y-%m') as worst, round(min(value), 2) as worst_value from m group by 1""")
def _(t):
    return rounded(S.best_and_worst(monthly(t), ["l_returnflag"]), {"best_value": 2, "worst_value": 2})


@book.add("i9_biggest_swing", f"""with {M}, d as (select l_returnflag, pos, np, period, lag(period) over w as fp, (value - lag(value) over w) / abs(lag(value) over w) as move from o window w as (partition by l_returnflag order by period)),
b as (select *, row_number() over (partition by l_returnflag order by abs(move) desc nulls last, pos) as r, median(abs(move)) over (partition by l_returnflag) as typical from d)
select l_returnflag, strftime(fp, '%Y-%m') as from_label, strftime(period, '%Y-%m') as to_label, round(move, 6) as change, round(typical, 6) as typical,
 abs(move) >= .2 and abs(move) >= 2.5 * typical as notable from b where r = 1 and np >= 4""")
def _(t):
    return rounded(S.biggest_swing(monthly(t), ["l_returnflag"]), {"change": 6, "typical": 6})


@book.add("i10_seasonality_month", """with m as (select o_orderpriority, date_trunc('month', o_orderdate) as period, sum(o_totalprice) as value from orders group by 1, 2),
a as (select o_orderpriority, avg(value) as mean, count(*) as n, count(distinct month(period)) as seen from m group by 1),
p as (select o_orderpriority, month(period) as position, avg(value) as m from m group by 1, 2),
x as (select o_orderpriority, position, p.m / a.mean as idx from p join a using (o_orderpriority) where n >= 24 and seen = 12)
select o_orderpriority, cast(position as bigint) as position, round(idx, 6) as index, cast(arg_max(position, idx) over w as bigint) as peak, cast(arg_min(position, idx) over w as bigint) as trough,
 round(max(idx) over w - min(idx) over w, 6) as strength, max(idx) over w >= 1.15 as seasonal from x window w as (partition by o_orderpriority)""")
def _(t):
    frame = S.period_sums(t.orders, "o_orderdate", "o_totalprice", "monthly", ["o_orderpriority"])
    return rounded(S.seasonality(frame, "monthly", ["o_orderpriority"]), {"index": 6, "strength": 6})


@book.add("i10_seasonality_weekday", """with m as (select ts::date as period, sum(value) as value from events group by 1),
x as (select dayofweek(period) + 1 as position, avg(value) / (select avg(value) from m) as idx from m group by 1)
select cast(position as bigint) as position, round(idx, 6) as index, cast(arg_max(position, idx) over () as bigint) as peak, cast(arg_min(position, idx) over () as bigint) as trough,
 round(max(idx) over () - min(idx) over (), 6) as strength, max(idx) over () >= 1.15 as seasonal from x""")
def _(t):
    frame = S.period_sums(t.events, "ts", "value", "daily")
    return rounded(S.seasonality(frame, "daily"), {"index": 6, "strength": 6})


@book.add("i11_metric_frames", " union all ".join(
    f"""select '{m}' as metric, date_trunc('month', l_shipdate)::date as period, strftime(date_trunc('month', l_shipdate), '%Y-%m') as label, round(sum({m}), 2) as value, count(*) as n from lineitem group by 2, 3"""
    for m in ["l_quantity", "l_extendedprice", "l_discount"]))
def _(t):
    return rounded(S.metric_period_sums(t.lineitem, "l_shipdate", ["l_quantity", "l_extendedprice", "l_discount"]), {"value": 2})


def _trend_sql(source: str, key: str) -> str:
    """The same test written with self-joins on the position instead of lags."""
    return f"""{source},
z as (select {key}, pos - 1.0 - (np - 1) / 2.0 as dt, value - avg(value) over (partition by {key}) as dv, np, pos, avg(value) over (partition by {key}) as mean from o),
b as (select {key}, max(np) as np, max(mean) as mean, sum(dt * dv) / sum(dt * dt) as slope, sum(dt * dt) as sxx, sum(dv * dv) as sst from z group by 1),
e as (select z.{key}, pos, dt, dv - slope * dt as e, dt * (dv - slope * dt) as u from z join b using ({key})),
l as (select *, greatest(1, least(np - 2, floor(4 * pow(np / 100.0, 2.0 / 9)))) as lg from b),
cross_ as (select a.{key}, sum(case when a.pos = c.pos then a.u * a.u else 2 * (1 - (c.pos - a.pos) / (lg + 1)) * a.u * c.u end) as meat
  from e a join e c on a.{key} = c.{key} and c.pos >= a.pos join l on l.{key} = a.{key} and c.pos - a.pos <= lg group by 1),
ee as (select a.{key}, sum(a.e * a.e) as sse, sum(a.e * c.e) as lag1 from e a left join e c on a.{key} = c.{key} and c.pos = a.pos + 1 group by 1),
tt as (select {key}, np as n, slope, sqrt(greatest(meat, 0)) / sxx as se, 1 - sse / sst as r2, lag1 / sse as autocorrelation, mean - slope * (np - 1) / 2 as s0
  from b join cross_ using ({key}) join ee using ({key}))"""


@book.add("i12_trend_summary", f"""with {_trend_sql(M, 'l_returnflag')},
q as (select l_returnflag, period, pos, np, value, (value - lag(value) over w) / abs(lag(value) over w) as change, (value - lag(value, 12) over w) / abs(lag(value, 12) over w) as yc from o window w as (partition by l_returnflag order by period))
select l_returnflag, strftime(period, '%Y-%m') as latest, round(value, 2) as latest_value, round(change, 6) as change, round(yc, 6) as year_change,
 case when slope > 0 then 'up' when slope < 0 then 'down' else 'flat' end as direction, round(r2, 6) as r2, round(slope, 4) as slope from q join tt using (l_returnflag) where pos = np""")
def _(t):
    out = S.trend_summary(monthly(t), "monthly", ["l_returnflag"], p_value=False)
    return rounded(out.select("l_returnflag", "latest", "latest_value", "change", "year_change", "direction", "r2", "slope"),
                   {"latest_value": 2, "change": 6, "year_change": 6, "r2": 6, "slope": 4})


@book.add("k4_trend_test", f"""with {_trend_sql(M, 'l_returnflag')} select l_returnflag, n, round(slope, 4) as slope, round(se, 4) as se, round(slope / se, 6) as t, round(r2, 6) as r2,
  round(autocorrelation, 6) as autocorrelation from tt""")
def _(t):
    out = S.trend_test(monthly(t), ["l_returnflag"], p_value=False)
    return rounded(out.select("l_returnflag", "n", "slope", "se", "t", "r2", "autocorrelation"),
                   {"slope": 4, "se": 4, "t": 6, "r2": 6, "autocorrelation": 6})


_D = """m as (select event_type, ts::date as period, sum(value) as value from events group by 1, 2),
o as (select *, row_number() over (partition by event_type order by period) as pos, count(*) over (partition by event_type) as np from m)"""


@book.add("i14_trend_facts", f"""with {_trend_sql(_D, 'event_type')} select event_type, n, round(s0, 4) as fitted_start, round(s0 + slope * (n - 1), 4) as fitted_end,
  round(slope * (n - 1) / abs(s0), 6) as fitted_change, round(slope / se, 6) as t from tt""")
def _(t):
    out = S.trend_test(daily(t), ["event_type"], p_value=False)
    return rounded(out.select("event_type", "n", "fitted_start", "fitted_end", "fitted_change", "t"),
                   {"fitted_start": 4, "fitted_end": 4, "fitted_change": 6, "t": 6})


@book.add("i13_seasonal_strength")
def _(t):
    return rounded(S.seasonal_strength(monthly(t), 12, ["l_returnflag"]), {"seasonal_strength": 6})


@book.add("i13_classical", """with m as (select l_returnflag, date_trunc('month', l_shipdate) as p, sum(l_extendedprice) as v from lineitem group by 1, 2),
a as (select *, row_number() over (partition by l_returnflag order by p) - 1 as i, count(*) over (partition by l_returnflag) as n from m),
b as (select *, (avg(v) over (partition by l_returnflag order by i rows between 6 preceding and 5 following) + avg(v) over (partition by l_returnflag order by i rows between 5 preceding and 6 following)) / 2 as trend from a),
d as (select *, case when i >= 6 and i + 6 < n then v - trend end as x from b),
f as (select l_returnflag, i % 12 as k, avg(x) as season from d group by 1, 2),
c as (select l_returnflag, avg(season) as level from f group by 1),
r as (select d.l_returnflag, n, x, x - (season - level) as rest from d join f on d.l_returnflag = f.l_returnflag and i % 12 = k join c on c.l_returnflag = d.l_returnflag where x is not null)
select a.l_returnflag, case when max(a.n) >= 24 then round(greatest(0, 1 - var_pop(rest) / var_pop(x)), 6) end as seasonal_strength_classical from (select distinct l_returnflag, n from a) a left join r on a.l_returnflag = r.l_returnflag group by 1""")
def _(t):
    return rounded(S.classical_strength(monthly(t), 12, ["l_returnflag"]), {"seasonal_strength_classical": 6})


_CONTRIB = """p as (select distinct date_trunc('month', o_orderdate) as p from orders), l as (select p, row_number() over (order by p desc) as r from p),
d as (select 'o_orderpriority' as dimension, o_orderpriority as key, o_orderdate, o_totalprice from orders union all select 'c_nationkey', cast(c_nationkey as varchar), o_orderdate, o_totalprice from orders join customer on o_custkey = c_custkey
 union all select 'c_mktsegment', c_mktsegment, o_orderdate, o_totalprice from orders join customer on o_custkey = c_custkey),
s as (select dimension, key, coalesce(sum(o_totalprice) filter (r = 2), 0) as prev, coalesce(sum(o_totalprice) filter (r = 1), 0) as latest from d join l on date_trunc('month', o_orderdate) = l.p where r <= 2 group by 1, 2),
k as (select *, latest - prev as delta, row_number() over (partition by dimension order by abs(latest - prev) desc, key) as rank, count(*) over (partition by dimension) as n, sum(prev) over (partition by dimension) as tp, sum(latest) over (partition by dimension) as tl from s),
f as (select dimension, case when rank <= 8 then key else 'Other (' || (n - 8) || ')' end as key, sum(prev) as prev, sum(latest) as latest, sum(delta) as delta, max(tp) as tp, max(tl) as tl, bool_or(rank > 8) as other from k group by 1, 2),
pw as (select dimension, max(abs(delta)) / sum(abs(delta)) as power from k group by 1)"""
_CONTRIB_OUT = """dimension, key, round(prev, 2) as prev, round(latest, 2) as latest, round(delta, 2) as delta, round(delta / (tl - tp), 6) as contribution,
 round(prev / tp, 6) as share_prev, round(latest / tl, 6) as share_latest, case when not other and prev = 0 and latest <> 0 then 'new' when not other and latest = 0 and prev <> 0 then 'lost'
 when abs(delta) <= 1e-9 * (abs(tp) + abs(tl) + 1) then 'flat' when delta > 0 then 'grew' else 'shrank' end as status"""


def _contributions(t, keep):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    out = S.contributions(j, "o_orderdate", "o_totalprice", ["o_orderpriority", "c_nationkey", "c_mktsegment"], "monthly", keep_dims=keep)
    return rounded(out, {"prev": 2, "latest": 2, "delta": 2, "contribution": 6, "share_prev": 6, "share_latest": 6})


@book.add("i15_contributions", f"with {_CONTRIB} select {_CONTRIB_OUT} from f")
def _(t):
    return _contributions(t, None)


@book.add("i16_best_contribution_dims", f"with {_CONTRIB} select {_CONTRIB_OUT} from f where dimension in (select dimension from pw order by power desc, dimension limit 2)")
def _(t):
    return _contributions(t, 2)


def nations(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return S.trim_partial_tail(S.period_sums(j, "o_orderdate", "o_totalprice", "monthly", ["c_nationkey"]), ["c_nationkey"])


@book.add("j1_holt")
def _(t):
    return rounded(J.forecast(nations(t), ["c_nationkey"], model="holt"), {c: 2 for c in ("forecast", "lower", "upper", "residual_std", "last_value")})


@book.add("j2_holt_winters")
def _(t):
    return rounded(J.forecast(nations(t), ["c_nationkey"], season=12), {c: 2 for c in ("forecast", "lower", "upper", "residual_std", "last_value")})


@book.add("j4_forecast_daily")
def _(t):
    return rounded(J.forecast(daily(t), ["event_type"]), {c: 4 for c in ("forecast", "lower", "upper", "residual_std", "last_value")})


@book.add("j4_forecast_series")
def _(t):
    return rounded(J.forecast(nations(t), ["c_nationkey"]), {c: 2 for c in ("forecast", "lower", "upper", "residual_std", "last_value")})


@book.add("j3_smoothing_parameters")
def _(t):
    return rounded(J.smoothing_parameters(nations(t), ["c_nationkey"]), {"residual_std": 2})


_LINE = """j as (select cast(c_nationkey as varchar) as c_nationkey, date_trunc('month', o_orderdate) as period, sum(o_totalprice) as value from orders join customer on o_custkey = c_custkey group by 1, 2),
a as (select *, row_number() over (partition by c_nationkey order by period) as pos, count(*) over (partition by c_nationkey) as np from j),
md as (select c_nationkey, median(value) as med from a where pos < np group by 1),
tr as (select c_nationkey, period, value from a join md using (c_nationkey) where not (pos = np and np >= 4 and value < .5 * med)),
x as (select *, row_number() over (partition by c_nationkey order by period) - 1.0 as t, count(*) over (partition by c_nationkey) as n from tr)"""


@book.add("j5_likelihood_forecast")
def _(t):
    out = J.forecast(monthly(t), ["l_returnflag"], 6, "likelihood", season=12)
    return rounded(out.select("l_returnflag", "step", "forecast", "lower", "upper", "method"), {"forecast": 0, "lower": 0, "upper": 0})


@book.add("j5_linear_forecast", f"""with {_LINE}, st as (select c_nationkey, max(n) as n, regr_slope(value, t) as b, regr_intercept(value, t) as a, regr_syy(value, t) as syy, regr_sxy(value, t) as sxy, regr_sxx(value, t) as sxx,
  min(value) as low, arg_max(value, t) as last_value from x group by 1),
h as (select *, sqrt((syy - sxy * sxy / sxx) / (n - 1)) as sd, unnest(generate_series(1, least(12, greatest(3, round_even(n * .15, 0)))::bigint)) as step from st where n >= 6),
p as (select *, case when low >= 0 then greatest(a + b * (n + step - 1), 0) else a + b * (n + step - 1) end as f from h)
select c_nationkey, step, round(f, 2) as forecast, round(case when low >= 0 then greatest(f - 1.96 * sd * sqrt(step), 0) else f - 1.96 * sd * sqrt(step) end, 2) as lower,
 round(f + 1.96 * sd * sqrt(step), 2) as upper, round(sd, 2) as residual_std, round(last_value, 2) as last_value from p""")
def _(t):
    return rounded(J.linear_forecast(nations(t), ["c_nationkey"]), {c: 2 for c in ("forecast", "lower", "upper", "residual_std", "last_value")})


@book.add("j7_backtest_linear", f"""with {_LINE}, k as (select *, least(6, greatest(2, floor(n / 5))) as hold, avg(abs(value)) over (partition by c_nationkey) as size from x),
g as (select * from k where n - hold >= 6), ln as (select c_nationkey, regr_slope(value, t) as b, regr_intercept(value, t) as a from g where t < n - hold group by 1)
select c_nationkey, count(*) as test_points, round(avg(abs(value - a - b * t) / abs(value)) filter (abs(value) > .01 * size), 6) as mape, round(avg(abs(value - a - b * t)), 2) as mae
from g join ln using (c_nationkey) where t >= n - hold group by 1 having count(*) filter (abs(value) > .01 * size) >= 2""")
def _(t):
    return rounded(J.backtest(nations(t), ["c_nationkey"]), {"mape": 6, "mae": 2})


@book.add("j7_backtest_smoothing")
def _(t):
    return rounded(J.backtest(nations(t), ["c_nationkey"], "auto"), {"mape": 6, "mae": 2})


@book.add("j8_default_horizon", f"""with {_LINE} select c_nationkey, max(n) as n, least(12, greatest(3, round(max(n) * .15)))::bigint as horizon, least(12, greatest(3, round_even(max(n) * .15, 0)))::bigint as horizon_half_even from x group by 1""")
def _(t):
    n = nations(t).groupBy("c_nationkey").agg(F.count("*").alias("n"))
    def clamp(x):
        return F.least(F.lit(12), F.greatest(F.lit(3), x)).cast("long")
    return n.withColumn("horizon", clamp(F.round(F.col("n") * 0.15))).withColumn("horizon_half_even", clamp(F.bround(F.col("n") * 0.15)))


@book.add("p3_forecast_chart", f"""with {_LINE}, st as (select c_nationkey, max(n) as n, regr_slope(value, t) as b, regr_intercept(value, t) as a, min(value) as low from x group by 1),
h as (select *, unnest(generate_series(1, least(12, greatest(3, round_even(n * .15, 0)))::bigint)) as step from st where n >= 6)
select c_nationkey, cast(t + 1 as bigint) as pos, strftime(period, '%Y-%m') as label, round(value, 2) as actual, null::double as forecast from x
union all select c_nationkey, cast(n + step as bigint), '+' || step, null, round(case when low >= 0 then greatest(a + b * (n + step - 1), 0) else a + b * (n + step - 1) end, 2) from h""")
def _(t):
    n = nations(t)
    out = J.history_and_forecast(n, J.linear_forecast(n, ["c_nationkey"]), ["c_nationkey"])
    return rounded(out.select("c_nationkey", "pos", "label", "actual", "forecast"), {"actual": 2, "forecast": 2})
