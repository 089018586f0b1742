"""Rounds of a stored log that are bounded by records."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.schemas import RECORD
from logharbor.shared import new_path, remove_folder, written_folders
from logharbor.sources import storage as S
from logharbor.sources.polled import LogRun, PolledReader, PollIndex, _merged, drain, poll_log, share_out

LOGGED = T.StructType([*RECORD.fields, T.StructField("source_offset", T.LongType())])


def logged(spark, offsets):
    """Records of {(topic, partition): offsets}."""
    data = [
        (b"k", str(o).encode() if o % 3 else None, {"h": b"v"} if o % 2 else {}, topic, part, 1000 + o, o, None)
        for (topic, part), held in offsets.items()
        for o in held
    ]
    return spark.createDataFrame(data, LOGGED)


@pytest.fixture
def polled(spark):
    return PollIndex(spark, new_path(spark, "log"), new_path(spark, "index"), width=8), new_path(spark, "poll")


def append(index, table, run=16):
    S.write_topics(table, index.log, run=run)
    index.extend()


def poll(spark, index, root, limit):
    def keep(part, number):
        part.write.mode("overwrite").parquet(f"{root}/rounds/round_no={number}")

    drain(poll_log(spark, index.log, index.root, limit), f"{root}/checkpoint", keep)


def kept(spark, root):
    schema = T.StructType([*RECORD.fields, T.StructField("round_no", T.LongType())])
    return spark.read.schema(schema).parquet(f"{root}/rounds")


def test_shares_follow_the_backlog_and_add_up():
    assert share_out({"a": 3, "b": 4}, 10) == {"a": 3, "b": 4}
    assert share_out({"a": 90, "b": 10}, 10) == {"a": 9, "b": 1}
    for limit in (1, 2, 5, 17):
        taken = share_out({"hot": 1000, "b": 3, "c": 1, "d": 1}, limit)
        assert sum(taken.values()) == limit and all(n >= 0 for n in taken.values())
    assert share_out({}, 5) == {}


def test_rounds_hold_at_most_the_limit_and_all_rows_once(spark, polled):
    index, root = polled
    first = {("hot", 0): range(100), ("a", 0): range(5), ("a", 1): range(7, 20), ("né \"x\"", 3): [0]}
    append(index, logged(spark, first))
    assert index.unknown_files() == []  # names that a path escapes are known too
    poll(spark, index, root, 20)
    sizes = {r["round_no"]: r["count"] for r in kept(spark, root).groupBy("round_no").count().collect()}
    assert max(sizes.values()) <= 20 and len(sizes) == 6
    second = {("hot", 0): range(100, 130), ("new", 0): range(4)}
    append(index, logged(spark, second))
    poll(spark, index, root, 20)  # a restart: a new reader, which is told where to go on
    got = kept(spark, root)
    assert max(r["count"] for r in got.groupBy("round_no").count().collect()) <= 20
    want = logged(spark, first).union(logged(spark, second)).drop("source_offset")
    shown = [F.to_json("headers").alias("headers"), "key", "value", "topic", "partition", "timestamp", "offset"]
    assert rows(got, *shown) == rows(want, *shown)
    before = len(written_folders(spark, f"{root}/rounds"))
    poll(spark, index, root, 20)
    assert len(written_folders(spark, f"{root}/rounds")) == before


def test_a_round_that_was_not_committed_is_run_again_whole(spark, polled):
    index, root = polled
    append(index, logged(spark, {("t", 0): range(50), ("t", 1): range(10)}))
    poll(spark, index, root, 25)
    want = rows(kept(spark, root), "round_no", "topic", "partition", "offset")
    last = max(int(n) for n in written_folders(spark, f"{root}/checkpoint/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        remove_folder(spark, f"{root}/checkpoint/commits/{name}")
    remove_folder(spark, f"{root}/rounds/round_no={last}")
    append(index, logged(spark, {("t", 0): range(50, 60)}))
    poll(spark, index, root, 25)
    got = rows(kept(spark, root).where(F.col("offset") < 50), "round_no", "topic", "partition", "offset")
    assert got == want
    assert kept(spark, root).count() == 70


def test_holes_are_passed_over_and_empty_logs_wait(spark, polled):
    index, root = polled
    poll(spark, index, root, 5)
    assert kept(spark, root).count() == 0
    append(index, logged(spark, {("t", 0): [*range(3), *range(10**9, 10**9 + 9)]}))
    poll(spark, index, root, 5)
    got = kept(spark, root)
    assert got.count() == 12 and got.select("round_no").distinct().count() <= 4


def test_an_append_that_is_not_complete_is_not_seen(spark, polled):
    index, root = polled
    append(index, logged(spark, {("t", 0): range(10)}))
    append(index, logged(spark, {("t", 0): range(10, 20)}))
    torn = f"{index.root}/append-{1:012d}"
    remove_folder(spark, f"{torn}/_SUCCESS")
    reader = PolledReader(index.log, index.root, 100, RECORD)
    assert reader.latestOffset() == {json.dumps(["t", 0]): 10}
    assert len(index.unknown_files()) == 1  # the next extension writes it again
    index.extend()
    assert reader.latestOffset() == {json.dumps(["t", 0]): 20}


def test_a_long_file_is_read_by_many_tasks(monkeypatch):
    runs = [LogRun("f", "t", 0, a, a + 100) for a in range(0, 1000, 100)]
    monkeypatch.setattr("logharbor.sources.polled.BLOCK", 300)
    assert [(r.start, r.end) for r in _merged(runs)] == [(0, 300), (300, 600), (600, 900), (900, 1000)]


def test_a_limit_below_one_is_refused():
    with pytest.raises(ValueError):
        PolledReader("log", "index", 0, RECORD)
