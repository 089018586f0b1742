import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logharbor.operators import audit as C

SCHEMA = "topic string, partition int, offset bigint, source_offset bigint, timestamp bigint, key binary, value binary, headers map<string,binary>"


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def clean(spark, n=200):
    return table(
        spark, [("t", i % 2, i, i * 3, i, b"k", str(i).encode(), {"h": b"1", "restore.source-offset": str(i * 3).encode()}) for i in range(n)]
    )


def source(log):
    return log.withColumn("offset", F.col("source_offset")).drop("source_offset").withColumn(
        "headers", F.map_filter("headers", lambda k, _: k == "h")
    )


def test_clean_log_has_no_findings(spark):
    log = clean(spark)
    assert C.restore_duplicates(log).isEmpty()
    assert C.restore_order_violations(log).isEmpty()
    assert C.restore_count_diff(source(log), log).isEmpty()
    assert C.restore_content_diff(source(log), log).isEmpty()


def test_duplicates_across_buckets(spark):
    rng = random.Random(2)
    offsets = [rng.randint(0, 200_000) for _ in range(3_000)] + [70_000] * 500 + [0, 0]
    log = table(spark, [("t", 0, i, o, 0, b"", b"", {}) for i, o in enumerate(offsets)])
    expected = sorted(
        (("t", 0, o, offsets.count(o)) for o in set(offsets) if offsets.count(o) > 1), key=lambda r: [(False, str(v)) for v in r]
    )
    assert rows(C.restore_duplicates(log)) == expected


@pytest.mark.parametrize("width", [4, 100_000])
def test_content_findings(spark, width):
    log = clean(spark)
    first = log.where("offset = 10")
    broken = (
        log.where("offset <> 4")
        .withColumn("value", F.when(F.col("offset") == 6, None).otherwise(F.col("value")))
        .withColumn("timestamp", F.when(F.col("offset") == 9, F.lit(0)).otherwise(F.col("timestamp")))
        .unionByName(first.withColumn("source_offset", F.lit(5_000).cast("bigint")))
        .unionByName(first)
    )
    got = rows(C.restore_content_diff(source(log), broken, width=width), "partition", "source_offset", "verdict")
    assert got == [(0, 12, "missing"), (0, 18, "changed"), (0, 30, "extra"), (0, 5000, "extra"), (1, 27, "changed")]


def test_null_key_is_not_an_empty_value(spark):
    one = table(spark, [("t", 0, 0, 0, 0, None, b"a", {})])
    two = table(spark, [("t", 0, 0, 0, 0, b"a", None, {})])
    assert rows(C.restore_content_diff(source(one), two), "verdict") == [("changed",)]


def test_order_and_gaps(spark):
    sources = [0, 1, 5, 4, 4, 9]
    log = table(spark, [("t", 0, i * 2, s, 0, b"", b"", {}) for i, s in enumerate(sources)])
    for width in (2, 1000):
        got = rows(C.restore_order_violations(log, width=width), "offset", "previous_source")
        assert got == [(6, 5), (8, 4)]
        assert C.offset_gaps(log, width=width).count() == 5


def test_overlaps(spark):
    files = spark.createDataFrame(
        [("a", "t", 0, 0, 0, 9), ("b", "t", 0, 5, 5, 7), ("c", "t", 0, 10, 10, 19), ("d", "t", 0, 30, 3, 4), ("e", "t", 1, 0, 0, 9)],
        "path string, topic string, partition int, file_offset bigint, first_offset bigint, last_offset bigint",
    )
    assert rows(C.segment_overlaps(files), "path", "earlier_last") == [("b", 9), ("d", 19)]


def test_paths_agree_with_rows(spark):
    archive = spark.createDataFrame(
        [("p/t/0/f", "t", 0), ("p/t/0/f", "u", 0), ("p/t/x/f", "t", 1), ("f", "t", 0)],
        "path string, topic string, partition int",
    )
    assert rows(C.path_mismatches(archive), "path", "topic") == [("f", "t"), ("p/t/0/f", "u"), ("p/t/x/f", "t")]


def test_lag(spark):
    offsets = spark.createDataFrame([("g", "t", 0, 4), ("g", "t", 1, -1)], "group_id string, topic string, partition int, offset bigint")
    marks = spark.createDataFrame([("t", 0, 10), ("t", 1, 10)], "topic string, partition int, end_offset bigint")
    assert rows(C.group_lag(offsets, marks), "partition", "lag") == [(0, 6)]
