import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logharbor import restore_log
from logharbor.operators import restore as R

SCHEMA = "path string, topic string, partition int, offset bigint, timestamp bigint, key binary, value binary, headers map<string,binary>"


def path(topic, partition, name):
    return f"p/{topic}/{partition}/{topic}-{partition}-{name:019d}.avro"


def tables(spark, files):
    """Plan and archive of ``(topic, partition, name, offsets)`` files."""
    ordered = sorted(files, key=lambda f: path(*f[:3]))
    plan = [(i, path(t, p, n), t, str(p)) for i, (t, p, n, _) in enumerate(ordered)]
    data = [
        (path(t, p, n), t, p, o, 1000 + o, b"k", str(o).encode(), {"h": b"1"})
        for t, p, n, offsets in files
        for o in offsets
    ]
    return (
        spark.createDataFrame(plan, "plan_seq bigint, value string, topic string, partition string"),
        spark.createDataFrame(data, SCHEMA),
    )


def fold(files, last=None, following=None):
    """Literal restore: file after file, rows above the last restored offset."""
    last, following = dict(last or {}), dict(following or {})
    out = []
    for t, p, n, offsets in sorted(files, key=lambda f: path(*f[:3])):
        kept = [o for o in sorted(offsets) if o > last.get((t, p), -1)]
        for o in kept:
            out.append((t, p, following.get((t, p), 0), o))
            following[(t, p)] = following.get((t, p), 0) + 1
        if kept:
            last[(t, p)] = kept[-1]
    return out


def placed(df):
    return rows(df, "topic", "partition", "offset", "source_offset")


def expected(found):
    return sorted(found, key=lambda r: [(v is None, str(v)) for v in r])


FILES = st.lists(
    st.tuples(
        st.sampled_from(["a", "b"]),
        st.integers(0, 1),
        st.integers(0, 12),
        st.lists(st.integers(0, 40), min_size=1, max_size=12),
    ),
    min_size=1,
    max_size=8,
    unique_by=lambda f: f[:3],
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(files=FILES, width=st.sampled_from([4, 1000]))
def test_equal_to_a_literal_fold(spark, files, width):
    plan, archive = tables(spark, files)
    assert placed(R.restore_rows(plan, archive, width=width)) == expected(fold(files))


def test_not_a_distinct(spark):
    """Rows below the last restored offset are dropped even if no other file has them."""
    files = [("t", 0, 0, range(0, 10, 2)), ("t", 0, 10, [10, 11]), ("t", 0, 30, [1, 3, 5])]
    plan, archive = tables(spark, files)
    got = [r[3] for r in placed(R.restore_rows(plan, archive))]
    assert sorted(got) == [0, 2, 4, 6, 8, 10, 11]


def test_repeats_inside_one_file_stay(spark):
    plan, archive = tables(spark, [("t", 0, 0, [1, 1, 2]), ("t", 0, 2, [2, 3])])
    assert sorted(r[3] for r in placed(R.restore_rows(plan, archive))) == [1, 1, 2, 3]


def test_repeated_plan_records_change_nothing(spark):
    plan, archive = tables(spark, [("t", 0, 0, range(5)), ("t", 0, 5, range(5, 9))])
    again = plan.unionByName(plan.withColumn("plan_seq", F.col("plan_seq") + 2))
    assert placed(R.restore_rows(again, archive)) == placed(R.restore_rows(plan, archive))


def test_resume_restores_the_rest_once(spark):
    rng = random.Random(11)
    files = []
    for p in range(2):
        at = 0
        for _ in range(6):
            n = rng.randint(1, 20)
            files.append(("t", p, at, list(range(at, at + n))))
            if rng.random() < 0.5:
                files.append(("t", p, at + 1, list(range(at, at + n))))
            at += n + rng.randint(0, 3)
    plan, archive = tables(spark, files)
    whole = R.restore_rows(plan, archive, topic_prefix="r.").drop("path")
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    for done in (0, 13, 10_000):
        target = whole.where(F.col("offset") < done)
        rest = restore_log(plan, archive, target, topic_prefix="r.").drop("path")
        assert placed(target.unionByName(rest)) == placed(whole)


def test_renamed_and_stamped(spark):
    plan, archive = tables(spark, [("t", 3, 7, [7, 9])])
    got = R.restore_rows(plan, archive, topic_prefix="new.").orderBy("offset").collect()
    assert [(r["topic"], r["partition"], r["offset"], r["timestamp"]) for r in got] == [("new.t", 3, 0, 1007), ("new.t", 3, 1, 1009)]
    assert [bytes(r["headers"]["restore.source-offset"]) for r in got] == [b"7", b"9"]
    assert bytes(got[0]["headers"]["h"]) == b"1"


def test_excluded_topics(spark):
    plan, archive = tables(spark, [("keep", 0, 0, [0]), ("drop-me", 0, 0, [0])])
    assert [r[0] for r in placed(R.restore_rows(plan, archive, exclude="^drop"))] == ["keep"]


def test_foreign_data_is_refused_or_allowed(spark):
    plan, archive = tables(spark, [("t", 0, 0, [0, 1])])
    foreign = spark.createDataFrame(
        [("t", 0, 5, {"h": b"1"})], "topic string, partition int, offset bigint, headers map<string,binary>"
    )
    with pytest.raises(ValueError, match="t/0 holds other data"):
        restore_log(plan, archive, foreign)
    got = restore_log(plan, archive, foreign, fail_on_existing=False)
    assert placed(got) == [("t", 0, 6, 0), ("t", 0, 7, 1)]


def test_absent_and_badly_named_files_stop_a_restore(spark):
    plan, archive = tables(spark, [("t", 0, 0, [0, 1])])
    there = plan.first()["value"]
    gone = there.replace("-0.avro", "-9.avro") if "-0.avro" in there else there[:-6] + "9.avro"
    for name, reason in ((gone, "absent"), ("p/t/0/readme", "bad path"), ("p/t/x/t-x-0000000000000000001.avro", "bad path")):
        more = plan.select("plan_seq", "value").unionByName(
            spark.createDataFrame([(99, name)], "plan_seq bigint, value string").select(
                F.col("plan_seq").cast(plan.schema["plan_seq"].dataType), "value"
            )
        )
        assert rows(R.missing_files(more, archive)) == [(name, 99, reason)]
        with pytest.raises(ValueError, match="1 planned files cannot be restored"):
            restore_log(more, archive)
    assert R.missing_files(plan, archive).isEmpty()
    assert R.missing_files(more, archive, exclude="^t$").isEmpty()


def test_unrelated_topics_and_old_headers_do_no_harm(spark):
    plan, archive = tables(spark, [("t", 0, 0, [0, 1, 2])])
    target = spark.createDataFrame(
        [
            ("unrelated", 0, 5, {"h": b"1"}),
            ("r.t", 0, 0, {"restore.source-offset": b"broken"}),
            ("r.t", 0, 1, {"restore.source-offset": b"1"}),
        ],
        "topic string, partition int, offset bigint, headers map<string,binary>",
    )
    assert placed(restore_log(plan, archive, target, topic_prefix="r.")) == [("r.t", 0, 2, 2)]
    assert rows(R.target_progress(target.where("topic = 'r.t'"))) == [("r.t", 0, 1, 2)]


def test_bad_partition_name_fails(spark):
    plan = spark.createDataFrame([(0, "p/t/x/t-x-0.avro")], "plan_seq bigint, value string")
    archive = spark.createDataFrame([("p/t/x/t-x-0.avro", "t", 0, 0, 0, b"", b"", {})], SCHEMA)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        R.restore_rows(plan, archive).collect()


def test_latest_and_watermarks(spark):
    data = [("t", p, o, {"restore.source-offset": str(o * 2).encode()}) for p in range(3) for o in range(p, 10)]
    log = spark.createDataFrame(data, "topic string, partition int, offset bigint, headers map<string,binary>")
    assert rows(R.latest_records(log), "partition", "offset") == [(0, 9), (1, 9), (2, 9)]
    assert rows(R.latest_records(log, [2]), "partition", "offset") == [(2, 9)]
    assert R.latest_records(log.limit(0)).count() == 0
    assert rows(R.partition_watermarks(log)) == [("t", 0, 0, 10), ("t", 1, 1, 10), ("t", 2, 2, 10)]
    assert rows(R.target_progress(log)) == [("t", 0, 18, 10), ("t", 1, 18, 10), ("t", 2, 18, 10)]


def test_file_progress_ignores_bad_indexes(spark):
    seen = spark.createDataFrame(
        [(0, "t", "0", "1", "s"), (1, "t", "0", "x", "s"), (2, "t", "1", None, "s"), (3, "t", "0", "2", "s")],
        "plan_seq bigint, topic string, partition string, file_index string, topics_sha string",
    )
    assert rows(R.file_progress(seen)) == [("t", "0", "s", 2)]
