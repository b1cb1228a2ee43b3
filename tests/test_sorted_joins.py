"""Rows that an array was spread into are estimated as their one row before; none of them are broadcast."""

import pytest

from stintlab import plans


def broadcast_whole(plan):
    """The lines of spread rows that reach a broadcast without being counted together or joined before."""
    lines = [line.replace("*", " ") for line in plan.splitlines()]
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" not in line:
            continue
        for below, deep in zip(lines[i + 1 :], depth[i + 1 :], strict=True):
            if deep <= depth[i] or "Aggregate" in below or "Join" in below:
                break
            if "Generate" in below:
                yield below


@pytest.mark.parametrize("name", ["gate_passes", "detected_laps", "lateral_offsets", "reference_statuses"])
def test_spread_rows_are_not_sent_to_the_driver(spark, name):
    queries, _ = plans.registered()
    plan = queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "SortMergeJoin" in plan and not list(broadcast_whole(plan))
