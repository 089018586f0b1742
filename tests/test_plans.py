"""The plans that matter at scale: what travels, and by which keys."""

import re

import pytest
from conftest import SMALL

from logharbor import fixtures as X
from logharbor.operators import audit as C
from logharbor.operators import restore as R
from logharbor.schemas import TP


@pytest.fixture
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def physical(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", line) for line in plan.splitlines()]


def exchanges_above(lines, column):
    """Exchange keys on the way from the scan that reads ``column`` to the result."""
    depth = lambda line: len(re.match(r"[\s:|+-]*", line).group())
    (scan,) = [i for i, line in enumerate(lines) if "FileScan" in line and column in line]
    level, keys = depth(lines[scan]), []
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            level = depth(line)
            if "Exchange" in line:
                keys.append(re.search(r"\((.*?), \d+\)", line).group(1))
    return keys


def test_restore_moves_payloads_once(no_broadcast):
    spark = no_broadcast
    df = R.restore_rows(X.plan(spark, SMALL), X.archive(spark, SMALL))
    assert exchanges_above(physical(df), "headers") == ["path, _block"]


def test_restore_statistics_read_two_columns(spark):
    blocks = R.planned_blocks(X.plan(spark, SMALL), X.archive(spark, SMALL))
    scans = [line for line in physical(blocks) if "FileScan" in line and "offset" in line]
    assert len(scans) == 1
    assert "FileScan parquet [offset,path]" in scans[0]


def test_latest_records_leave_payloads_in_place(spark):
    plan = physical(R.latest_records(X.records(spark, SMALL)))
    assert any("BroadcastHashJoin" in line for line in plan)
    assert not any("Exchange hashpartitioning" in line for line in plan)


def test_tip_offsets_are_hash_aggregated(spark):
    for df in (R.target_progress(X.restored(spark, SMALL)), R.partition_watermarks(X.records(spark, SMALL))):
        plan = physical(df)
        assert not any("SortAggregate" in line for line in plan)


def test_gaps_are_not_found_by_one_task_per_partition(no_broadcast):
    rows = X.records(no_broadcast, SMALL).select(*TP, "offset")
    windows = [line for line in physical(C.offset_gaps(rows)) if re.search(r"[-:] Window \[", line)]
    by_partition = [w for w in windows if "windowspecdefinition(topic, partition, _cut ASC" in w]
    by_block = [w for w in windows if "windowspecdefinition(topic, partition, _cut, offset ASC" in w]
    assert by_partition and by_block and len(by_partition) + len(by_block) == len(windows)
    assert all("_edge" in w for w in by_partition)
