"""A selection of the catalog against DuckDB on the smallest tables; tests/compare.py runs all of it."""
import os

import pytest

from tablescope import catalog

from .compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
SOME = ["a0_month_by_segment", "a7_systematic_sample", "b3_parse_number", "b10_cleaning_report", "c15_domain", "d1_scorecard", "f1_suggest_join_keys",
        "g9_vital_few", "g14_pareto", "i12_trend_summary", "i15_contributions", "j5_linear_forecast", "k10_anova", "k12_associations", "l2_mad_summary",
        "m4_rfm_segments", "m7_cohorts_weekly", "m8_themes", "n2_goal_seek", "o3_verify_numbers", "p4_run_specs"]


def test_every_statement_has_a_query():
    runs, sql = catalog.queries(), catalog.oracle_sql()
    assert set(sql) <= set(runs) and len(runs) > 150


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    cur = duck(FOLDER).execute(catalog.oracle_sql()[name])
    problem = compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], cur.fetchall())
    assert problem is None, problem
