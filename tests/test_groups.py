import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logharbor import snapshot_groups, translate_groups
from logharbor.operators import groups as G

OFFSETS = "group_id string, topic string, partition int, offset bigint, leader_epoch int, metadata string"
LOG = "topic string, partition int, offset bigint, source_offset bigint"
ENTRIES = "group_id string, topic string, partition int, offset bigint, target bigint"


def test_snapshot_leaves_out_empty_and_unset(spark):
    offsets = spark.createDataFrame(
        [
            ("g1", "t", 0, 5, -1, ""),
            ("g1", "t", 1, 20, 3, "m"),
            ("g1", "emptied", 0, 7, -1, ""),
            ("g1", "t", 2, -1, -1, ""),
            ("g2", "emptied", 0, 7, -1, ""),
        ],
        OFFSETS,
    )
    marks = "topic string, partition int, {0}_offset bigint"
    starts = spark.createDataFrame([("t", 0, 0), ("t", 1, 0), ("emptied", 0, 7)], marks.format("start"))
    ends = spark.createDataFrame([("t", 0, 9), ("t", 1, 30), ("emptied", 0, 7), ("u", 0, 0)], marks.format("end"))
    got = {r["group_id"]: r["topics"] for r in snapshot_groups(offsets, starts, ends).collect()}
    assert got["g2"] == []
    (topic,) = got["g1"]
    assert topic["topic"] == "t"
    assert [tuple(p) for p in topic["partitions"]] == [(0, 5, None, None), (1, 20, 3, "m")]


def log(spark, sources, topic="t", partition=0):
    return spark.createDataFrame([(topic, partition, i, s) for i, s in enumerate(sources)], LOG)


def translated(spark, sources, offset, **options):
    entry = spark.createDataFrame([("g", "t", 0, offset, offset - 1)], ENTRIES)
    row = G.translate_offsets(entry, log(spark, sources), **options).first()
    return row["case"], row["restored_offset"]


@pytest.mark.parametrize(
    "sources, offset, expected",
    [
        (list(range(10, 110)) + [115], 50, ("exact", 40)),
        (list(range(10, 110)), 110, ("tip", 100)),
        ([200], 50, ("start", 0)),
        (list(range(10, 110)) + [120], 115, ("next", 100)),
        (list(range(10, 60)), 115, ("pending", None)),
        (list(range(0, 10)), 0, ("start", 0)),
        ([-1, -1, 200, 300], 50, ("next", 2)),
        ([5, 5, 9], 6, ("exact", 1)),
        ([5, -1], 3, ("pending", None)),
    ],
)
@pytest.mark.parametrize("width", [8, 100_000])
def test_translation_scenarios(spark, sources, offset, expected, width):
    assert translated(spark, sources, offset, width=width) == expected


def test_floor_at_the_first_offset(spark):
    moved = log(spark, [200, 201]).withColumn("offset", F.col("offset") + 40)
    entry = spark.createDataFrame([("g", "t", 0, 50, 49)], ENTRIES)
    assert G.translate_offsets(entry, moved, floor="start").first()["restored_offset"] == 40


def literal(sources, target):
    """Scan from the start for the last processed record."""
    if not sources or sources[-1] < target:
        return None
    for offset, source in enumerate(sources):
        if source == target:
            return offset + 1
        if source > target:
            return offset if offset else 0
    return None


@pytest.mark.parametrize("width", [5, 1000])
def test_equal_to_a_literal_search(spark, width):
    rng = random.Random(9)
    data, entries, expected = [], [], []
    for partition in range(12):
        sources = sorted(rng.sample(range(120), rng.randint(1, 60)))
        data += [("p.t", partition, i, s) for i, s in enumerate(sources)]
        for g in range(15):
            target = rng.randint(-1, 125)
            entries.append((f"g{g}", "t", partition, target + 1, target))
            expected.append((f"g{g}", partition, literal(sources, target)))
    got = G.translate_offsets(
        spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(data, LOG), "p.", width=width
    )
    key = lambda r: [(v is None, str(v)) for v in r]
    assert rows(got, "group_id", "partition", "restored_offset") == sorted(expected, key=key)


def test_bad_header_in_a_partition_nobody_asked_for(spark):
    headers = "topic string, partition int, offset bigint, headers map<string,binary>"
    good = [("p.t", 0, i, {"restore.source-offset": str(i).encode()}) for i in range(5)]
    bad = [("p.t", 1, 0, {"restore.source-offset": b"not a number"})]
    log = spark.createDataFrame(good + bad, headers)
    entries = spark.createDataFrame([("g", "t", 0, 4, 3)], ENTRIES)
    got = G.translate_offsets(entries, log, "p.").first()
    assert (got["case"], got["restored_offset"]) == ("exact", 4)


def nested(spark, groups):
    from logharbor.schemas import GROUPS

    data = [
        (g, [(t, [(p, o, None, None) for p, o in parts]) for t, parts in topics]) for g, topics in groups
    ]
    return spark.createDataFrame(data, GROUPS)


def test_whole_translation(spark):
    snapshot = nested(
        spark,
        [
            ("g1", [("t", [(0, 5), (1, 6)]), ("skipped", [(0, 1)])]),
            ("g1", [("missing", [(0, 3)])]),
            ("g2", [("t", [(0, 80), (1, 2)])]),
            ("g3", [("t", [(0, 4)])]),
            ("ignored", [("t", [(0, 4)])]),
            ("empty", [("t", [])]),
        ],
    )
    restored = log(spark, range(10), "r.t", 0).unionByName(log(spark, range(10), "r.t", 1))
    restored = restored.unionByName(log(spark, range(10), "r.skipped", 0))
    committed = spark.createDataFrame(
        [("n.g3", "r.t", 0, 50), ("n.g1", "r.t", 1, -1)],
        "group_id string, topic string, partition int, offset bigint",
    )
    topics = spark.createDataFrame([("r.t", False), ("r.skipped", False)], "topic string, is_internal boolean")
    out = translate_groups(
        snapshot, restored, committed, topics, "^g", "", "^skip", group_prefix="n.", topic_prefix="r."
    )
    assert rows(out.commits) == [
        ("n.g1", "r.t", 0, 5, -1),
        ("n.g1", "r.t", 1, 6, -1),
        ("n.g2", "r.t", 1, 2, -1),
    ]
    assert rows(out.remaining, "group_id", "topic", "partition") == [("g2", "t", 0)]
    assert rows(out.status) == [
        ("g1", "missing", 2),
        ("g1", "skipped", 2),
        ("g1", "t", 4),
        ("g2", "t", 1),
        ("g3", "t", 3),
    ]


def test_topic_without_partitions(spark):
    """Unknown groups stay scheduled, known ones count as restored before."""
    snapshot = nested(spark, [("a", [("t", []), ("u", [(0, 1)])]), ("b", [("t", []), ("u", [(0, 1)])])])
    committed = spark.createDataFrame([("b", "x", 0, 1)], "group_id string, topic string, partition int, offset bigint")
    topics = spark.createDataFrame([("u", False)], "topic string, is_internal boolean")
    out = translate_groups(snapshot, log(spark, range(3), "u"), committed, topics)
    assert rows(out.status) == [("a", "t", 0), ("a", "u", 4), ("b", "t", 3), ("b", "u", 4)]


def test_rounds_until_done(spark):
    entries = spark.createDataFrame(
        [("g", "t", 0, 3, 2), ("g", "t", 0, 8, 7), ("h", "t", 0, 30, 29)], ENTRIES
    )
    states = [lambda: log(spark, range(5)), lambda: log(spark, range(10))]
    resolved, remaining = G.translate_until_done(entries, states)
    assert rows(resolved, "group_id", "offset", "restored_offset", "round") == [("g", 3, 3, 1), ("g", 8, 8, 2)]
    assert rows(remaining, "group_id") == [("h",)]


def test_snapshot_filter(spark):
    snapshot = nested(spark, [("one", [("t", [(0, 1)])]), ("two", [("t", [(0, 1)])]), ("none", [("t", [])])])
    assert rows(G.filter_groups(snapshot), "group_id") == [("one",), ("two",)]
    assert rows(G.filter_groups(snapshot, "o", "^tw"), "group_id") == [("one",)]
    assert G.filter_groups(snapshot, "").count() == 0
