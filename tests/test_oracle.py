"""Every registered query against its DuckDB twin (row count, column names,
exact multiset of values). sf0.001 by default; LEDGERWASH_ORACLE_SF picks
another scale."""

import pytest

from conftest import SF_ORACLE
from ledgerwash.oracle import ORACLE_SQL as ORACLE
from ledgerwash.plans.registry import REGISTRY as QUERIES
from oracle_compare import compare, duck



# Statements of the source that end in ORDER BY; ties are broken alike on both sides.
ORDERED = ("q1_spend_by_category", "q2a_spend_by_text_period", "q2b_monthly_spend", "q3_top_customers", "q4_status_breakdown",
           "q5_top_merchants", "q6_spend_by_account_type", "q7_running_totals", "q8_sigma_outliers", "d01_duplicate_keys",
           "d01_duplicate_keys_top10", "d03_duplicate_rows", "d08_distinct_category_sorted", "v7_top_categories",
           "v7_latest_months", "k2_monthly_debit_line")


@pytest.fixture(scope="module")
def con():
    c = duck(SF_ORACLE)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    assert name in ORACLE, f"{name} has no oracle SQL"
    _, problems = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_ORACLE, ordered=name in ORDERED)
    assert not problems, problems
