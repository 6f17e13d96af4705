"""Every registered batch query against its DuckDB SQL, in both plan forms where there are two."""

import pytest
from oracle_check import compare

from bidflow.operators.sizing import SLICE_CONF, SMALL_INPUT_CONF
from bidflow.plans.oracle import ORACLE
from bidflow.plans.registry import QUERIES
from bidflow.streaming.registry import STREAMS

# Queries below which a skew-proof form replaces the plain one on large inputs.
TWO_FORMS = [
    "q3", "q3_latest", "closed_auctions", "q8", "q8_as_written", "q8_changelog", "q4_running", "q6", "latest_match_join",
    "word_count_running", "time_ordered", "control_history", "moved_bins", "latency_timeline", "incident_breakdown",
    "experiment_params", "result_log_scan",
]


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES) | set(STREAMS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, duck):
    assert compare(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) is None


@pytest.mark.parametrize("name", TWO_FORMS)
def test_large_form(name, spark, sf_dir, duck):
    spark.conf.set(SMALL_INPUT_CONF, "0")
    spark.conf.set(SLICE_CONF, "20000")
    try:
        assert compare(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) is None
    finally:
        spark.conf.unset(SMALL_INPUT_CONF)
        spark.conf.unset(SLICE_CONF)


# Expected sizes on the two smaller scale factors, to notice a query and its SQL failing together.
ROWS = {
    "q2": (37, 492), "q3": (131, 1490), "q3_latest": (131, 1358), "q3_semijoin": (65, 643), "q3_semijoin_as_written": (12, 137),
    "closed_auctions": (537, 5145), "closed_auctions_no_lower_bound": (1174, 11847), "q5": (743, 743), "q7": (531, 720),
    "q8": (53, 555), "q8_as_written": (64, 573), "word_count": (100, 100), "word_count_running": (1000, 10000),
}


@pytest.mark.parametrize("name", list(ROWS))
def test_row_counts(name, spark, sf_dir):
    expected = {"sf0.001": 0, "sf0.01": 1}[sf_dir.rsplit("/", 1)[1]]
    assert QUERIES[name](spark, sf_dir).count() == ROWS[name][expected]
