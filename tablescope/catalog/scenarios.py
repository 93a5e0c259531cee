"""What-if scoring of parts and brands with a regression of lineitem prices."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scenario as N
from ..operators.stats import multiple_regression
from .book import Book
from .concentration import rounded
from .inference import _TWO

book = Book()


def _model(t):
    li = t.lineitem
    return N.driver_model(multiple_regression(li, "l_extendedprice", ["l_quantity", "l_tax"]), li)


@book.add("n1_predict", f"""with {_TWO}, s as (select l_partkey as scenario, avg(l_quantity) as q, avg(l_tax) as x from lineitem group by 1)
select scenario, round(my + b1 * (q - m1) + b2 * (x - m2), 4) as predicted from s, g""")
def _(t):
    by = t.lineitem.groupBy(F.col("l_partkey").alias("scenario")).agg(F.avg("l_quantity").alias("l_quantity"), F.avg("l_tax").alias("l_tax"))
    long = by.unpivot(["scenario"], ["l_quantity", "l_tax"], "lever", "x")
    base = t.lineitem.agg(F.avg("l_extendedprice")).first()[0]
    return rounded(N.predict(long, _model(t), base), {"predicted": 4})


@book.add("n2_goal_seek", f"""with {_TWO}, l as (select 'l_quantity' as lever, b1 as coef, m1 as mean, (select stddev_samp(l_quantity) from lineitem) as sd, (select min(l_quantity) from lineitem) as mn, (select max(l_quantity) from lineitem) as mx from g
 union all select 'l_tax', b2, m2, (select stddev_samp(l_tax) from lineitem), (select min(l_tax) from lineitem), (select max(l_tax) from lineitem) from g),
go as (select p_brand as goal, avg(l_extendedprice) - (select avg(l_extendedprice) from lineitem) as d from lineitem join part on l_partkey = p_partkey group by 1),
x as (select goal, lever, d / coef as dx, mean + d / coef as tv, abs(d / coef) / sd as sds, mean + d / coef between mn and mx as in_range from go, l)
select goal, lever, round(dx, 2) + 0.0 as delta_x, round(tv, 2) + 0.0 as to_value, round(sds, 3) as sds, in_range, row_number() over (partition by goal order by in_range desc, sds, lever) as rank from x""")
def _(t):
    overall = t.lineitem.agg(F.avg("l_extendedprice")).scalar()
    goals = (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("goal"))
             .agg(F.avg("l_extendedprice").alias("m")).select("goal", (F.col("m") - overall).alias("target_delta")))
    return rounded(N.goal_seek(goals, _model(t)), {"delta_x": 2, "to_value": 2, "sds": 3})
