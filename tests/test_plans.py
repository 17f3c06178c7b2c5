"""
single-partition exchange on row-level data, no cross/nested-loop joins, no
Python UDFs, one dedup exchange per plan."""

import re

import pytest

from ledgerwash.plans.registry import REGISTRY

AGG = ("HashAggregate", "SortAggregate", "ObjectHashAggregate")


def _final_plan(df) -> list[str]:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0].split("\n")


def _op(line: str) -> str:
    return re.sub(r"^[\s:+\-*()\d]*", "", line)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_plan_lint(spark, name):
    lines = _final_plan(REGISTRY[name](spark, "/root/testdata/sf0.001"))
    ops = [_op(l) for l in lines if _op(l) and "QueryStage" not in l and "AQEShuffleRead" not in l]
    for i, op in enumerate(ops):
        if op.startswith("Exchange SinglePartition"):
            child = ops[i + 1]
            grouped = child.startswith(AGG) or (child.startswith("Project") and ops[i + 2].startswith(AGG))
            assert grouped, f"single-partition exchange over row-level data: {child[:80]}"
    text = "\n".join(ops)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text, bad
    computed = [op for op in ops if op.startswith("Exchange hashpartitioning(transaction_id")]
    assert len(computed) <= 1, "the dedup shuffle runs more than once"
