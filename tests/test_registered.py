"""Every registered query against its SQL twin, and the shape of its plan."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry
from compare import connect, differences
from gatewaylens.plans.oracle import oracle_texts
from gatewaylens.plans.queries import registered

SF_DIR = "/root/testdata/sf0.001"
QUERIES, TWINS = registered(), oracle_texts()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


def test_entry_has_a_stable_schema(spark):
    assert [f.simpleString() for f in entry(spark).schema] == ["id:bigint", "day:date", "c:bigint"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, con, name):
    assert differences(spark, con, name, QUERIES[name], TWINS[name], SF_DIR) == []


# Sorting and joining in ways that put a whole table in one task or meet every row with every other.
# `load_progress` orders days, `recent_activity` and `migration_sample` are top-n reports.
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_plan_has_no_bottleneck(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name != "load_progress":
        windows = [m.start() for m in re.finditer(r"Window \[", plan)]
        assert not any("SinglePartition" in plan[at:at + 4000].split("Scan")[0] for at in windows)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["key_usage_7d"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "events.parquet" in line)
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in scan
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>", scan)
