"""Registered queries against DuckDB on the smallest tables. SHELFSIGHT_ALL_QUERIES=1 runs every one."""

import os

import duckdb
import pytest

from shelfsight.plans.catalogue import QUERIES
from tools.check_oracle import TABLES, plain

FOLDER = "/root/testdata/sf0.001"
CORE = ["txt_2_normalize_search_text", "prj_7_catalog_cards", "flt_4_ranges", "srt_1_review_score", "win_2_release_changes", "sco_10_review_intelligence",
        "sco_17_theme_reconciliation", "sco_16_signal_summary", "sum_1_release_summaries", "cmp_6_narrative", "snk_6_promote_variants", "pln_4_work_plan",
        "jn_8_match_documents", "jn_9_first_duplicate", "ext_2_page_body", "edt_4_apply_moderation", "str_2_run_health"]
CHOSEN = [n for n, q in QUERIES.items() if q.sql and (os.environ.get("SHELFSIGHT_ALL_QUERIES") or n in CORE)]
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in FORBIDDEN if node in plan]
    columns = sorted(df.columns)
    cursor = duck.execute(QUERIES[name].sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
