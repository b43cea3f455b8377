"""Every registered query against its SQL, and the shape of its plan."""

import pytest

import __spark_entry__ as contract
from check import compare
from conftest import SF_TINY
from corpusmill.plans.oracles import ORACLES
from corpusmill.plans.registered import QUERIES

# Only these may hand rows to Python: they parse Python code or run an encoder.
PYTHON = {"skeleton", "chain_skeleton", "symbols", "tree_symbols", "tokens_bpe"}
# These measure documents without their text.
MEASURES = {"document_tokens", "run_summary"}
# These look at names alone and may not read the text of a document.
NAMES_ONLY = {
    "dir_prune", "filter_exclude", "filter_grouped", "filter_include", "filter_default_noise", "filter_extension", "stack_match",
    "tree_mode", "scan_status", "split_ext", "classify_test", "classify_resource", "route_target", "tree_nodes",
    "tree_line_counts", "gitignore_rules", "error_report",
}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_TINY)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("ArrowEvalPython" in plan) <= (name in PYTHON) and "BatchEvalPython" not in plan
    if name in NAMES_ONLY:
        reads = [part.split(">")[0] for part in plan.split("ReadSchema: struct<")[1:]]
        assert not any("text:" in r for r in reads)
    if name in MEASURES:
        assert "content" not in plan
    assert compare(df, SF_TINY, ORACLES[name]) == []


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert rows and rows[0].n_tokens > 0
