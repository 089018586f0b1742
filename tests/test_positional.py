import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logharbor.operators import asof
from logharbor.operators import positional as POS


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    data = []
    for topic, partition, count in [("a", 0, 90), ("a", 1, 1), ("b", 0, 40)]:
        for pos in sorted(rng.sample(range(300), count)):
            data.append((topic, partition, pos, rng.randint(0, 50)))
    return spark.createDataFrame(data, "topic string, partition int, pos bigint, v bigint").cache()


KEYS = ["topic", "partition"]


def ordered():
    return W.partitionBy(*KEYS).orderBy("pos")



@pytest.mark.parametrize("width", [1, 7, 64, 1000])
def test_blocks_do_not_change_results(log, width):
    before = ordered().rowsBetween(W.unboundedPreceding, -1)
    pairs = [
        (
            POS.number_rows(log, KEYS, "pos", "x", width=width),
            log.withColumn("x", (F.row_number().over(ordered()) - 1).cast("bigint")),
        ),
        (
            POS.running_before(log, KEYS, "pos", "v", "max", "x", width=width),
            log.withColumn("x", F.max("v").over(before)),
        ),
        (
            POS.running_before(log, KEYS, "pos", "v", "sum", "x", width=width),
            log.withColumn("x", F.sum("v").over(before)),
        ),
        (
            POS.neighbour(log, KEYS, "pos", "v", "x", following=False, width=width),
            log.withColumn("x", F.lag("v").over(ordered())),
        ),
        (
            POS.neighbour(log, KEYS, "pos", "v", "x", following=True, width=width),
            log.withColumn("x", F.lead("v").over(ordered())),
        ),
    ]
    names = [*KEYS, "pos", "v", "x"]
    for got, expected in pairs:
        assert rows(got, *names) == rows(expected, *names)


@pytest.mark.parametrize("width", [3, 50, 1000])
def test_first_at_or_after(spark, log, width):
    wanted = spark.createDataFrame(
        [("a", 0, t) for t in range(-1, 320, 9)] + [("a", 1, 5), ("b", 0, 299), ("b", 0, 299), ("none", 0, 1)],
        "topic string, partition int, target bigint",
    )
    points = log.withColumn("value", F.col("pos") * 10)
    got = asof.first_at_or_after(points, wanted, "pos", "value", "target", width=width)
    data = [tuple(r) for r in log.collect()]
    expected = []
    for topic, partition, target in {tuple(r) for r in wanted.collect()}:
        hits = [d[2] for d in data if d[0] == topic and d[1] == partition and d[2] >= target]
        hit = min(hits) if hits else None
        expected.append((topic, partition, target, hit, None if hit is None else hit * 10))
    found = rows(got)
    answered = [r for r in sorted(expected, key=lambda r: [(v is None, str(v)) for v in r]) if r[3] is not None]
    assert [r for r in found if r[3] is not None] == answered
    assert len(found) == len(expected)


def test_no_window_spans_a_whole_partition(log):
    """Rows are shuffled by key and block; only block summaries are by key alone."""
    plan = POS.number_rows(log, KEYS, "pos", "x")._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(topic" in plan
    row_windows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert row_windows and all("_cut" in line for line in row_windows)
