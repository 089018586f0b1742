import hashlib

import pytest
from conftest import rows
from pyspark.sql import functions as F

from logharbor.operators import planner as PL

MB = 1024 * 1024


def listing(spark, paths):
    return spark.createDataFrame([(p, n) for p, n in paths], "path string, length bigint")


def topics(spark, names):
    return spark.createDataFrame([(n,) for n in names], "topic string")


def ordered(order):
    return [r["topic"] for r in order.orderBy("rank").collect()]


@pytest.mark.parametrize(
    "include, exclude, names, expected",
    [
        (".*", "", ["clicks", "views"], ["clicks", "views"]),
        ("", "", ["clicks"], []),
        ("clicks, views", "", ["clicks", "errors", "views"], ["clicks", "views"]),
        ("e", "", ["clicks", "errors", "views"], ["errors", "views"]),
        (".*", "^v", ["clicks", "errors", "views"], ["clicks", "errors"]),
        (".*", "^v,s$", ["clicks", "error", "views"], ["error"]),
        ("^eu-", "-raw$", ["eu-clicks", "eu-clicks-raw", "us-clicks"], ["eu-clicks"]),
        # the regex list gives the order, names count only inside one regex
        (r"web\., app\.", r"\.tmp", ["app.a", "app.b", "web.a", "web.b", "web.tmp"], ["web.a", "web.b", "app.a", "app.b"]),
        # a topic keeps the place of the first regex that finds it
        (r"app, app-eu\.", "", ["app-eu.a", "app.b", "web.a"], ["app-eu.a", "app.b"]),
    ],
)
def test_include_and_exclude(spark, include, exclude, names, expected):
    chosen = PL.filter_topics(topics(spark, names), include, exclude)
    assert ordered(PL.topic_order(chosen)) == expected


@pytest.mark.parametrize(
    "sizes, expected",
    [
        ({"a": 10, "b": 10, "c": 10}, ["a", "b", "c"]),
        ({"a": 200, "b": 200, "c": 200}, ["a", "b", "c"]),
        ({"a": 10, "b": 200, "c": 10, "d": 200}, ["a", "c", "b", "d"]),
        ({"a": 100, "b": 100.0001}, ["a", "b"]),
        ({"a": 200, "b": None}, ["b", "a"]),
    ],
)
def test_large_topics_last(spark, sizes, expected):
    known = [(t, int(n * MB)) for t, n in sizes.items() if n is not None]
    table = spark.createDataFrame(known, "topic string, bytes bigint")
    chosen = PL.filter_topics(topics(spark, sizes), ".*")
    assert ordered(PL.topic_order(chosen, table, large_last=True, large_mb=100)) == expected


def test_fingerprint_depends_on_order_and_set(spark):
    def sha(names, include=".*"):
        return PL.topics_sha(PL.topic_order(PL.filter_topics(topics(spark, names), include))).first()[0]

    assert sha(["a", "b"]) == sha(["b", "a"]) == hashlib.sha256(b"a,b").hexdigest()
    assert sha(["a", "b"], "b,a") == hashlib.sha256(b"b,a").hexdigest()
    assert sha(["a"]) != sha(["a", "b"])


def test_paths(spark):
    df = listing(spark, [("p/t/3/t-3-0000000000000000009.avro", 1), ("t/f", 1), ("", 1), ("a/b/c", 1)])
    got = rows(PL.parse_paths(df), "path", "parseable", "topic", "partition", "file", "first_offset")
    assert got == [
        ("", True, "", "", "", None),
        ("a/b/c", True, "a", "b", "c", None),
        ("p/t/3/t-3-0000000000000000009.avro", True, "t", "3", "t-3-0000000000000000009.avro", 9),
        ("t/f", False, None, None, None, None),
    ]
    assert rows(PL.unparseable_keys(df), "path") == [("t/f",)]


def name(topic, partition, offset):
    return f"vault/{topic}/{partition}/{topic}-{partition}-{offset:019d}.avro"


ARCHIVE = [
    (name(t, p, o), 100)
    for t in ("alpha", "beta", "gamma")
    for p in (0, 1, 2, 10, 11)
    for o in (0, 5, 999_999, 1_000_000, 30_000_000)
]


def planned(spark, archive=ARCHIVE, include=".*", resume_from=None):
    listed = PL.list_objects(listing(spark, archive), "vault")
    order = PL.topic_order(PL.filter_topics(listed.select("topic").distinct(), include))
    resume = PL.checked_resume(resume_from, order)
    return PL.plan_records(listed, order, "vault", resume), order


def test_plan_follows_topic_then_path(spark):
    plan, _ = planned(spark, include="gamma,alpha")
    got = [tuple(r) for r in plan.orderBy("plan_seq").select("plan_seq", "value", "file_index").collect()]
    expected, index = [], {}
    for topic in ("gamma", "alpha"):
        for path in sorted(p for p, _ in ARCHIVE if f"/{topic}/" in p):
            folder = path.rsplit("/", 1)[0]
            index[folder] = index.get(folder, 0) + 1
            expected.append((len(expected), path, index[folder]))
    assert got == expected


def test_odd_names_keep_path_order(spark):
    odd = [("t/0/x", 1), ("t/0/t-0-0000000000000000001.avro", 1), ("t/0/deep/er/y", 1), ("t/0-a/z", 1), ("t/f", 1), ("t/0/", 1)]
    listed = PL.list_objects(listing(spark, odd))
    order = PL.topic_order(PL.filter_topics(listed.select("topic").distinct(), ".*"))
    got = [r["value"] for r in PL.plan_records(listed, order).orderBy("plan_seq").collect()]
    assert got == sorted(p for p, _ in odd if p.count("/") >= 2)


@pytest.mark.parametrize("written", [1, 7, 25, 26, 74, 75])
def test_resume_continues_where_the_plan_stops(spark, written):
    whole, _ = planned(spark)
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    rest, _ = planned(spark, resume_from=whole.where(f"plan_seq < {written}"))
    assert rows(rest) == rows(whole.where(f"plan_seq >= {written}"))


def test_resume_plans_what_a_broken_append_lost(spark):
    whole, order = planned(spark)
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    listed = PL.list_objects(listing(spark, ARCHIVE), "vault")
    earlier = whole.where("plan_seq < 40")
    folders = [r["key"] for r in earlier.groupBy("key").agg({"plan_seq": "min"}).orderBy("min(plan_seq)").collect()]
    for lost in (F.col("key") == folders[0], (F.col("key") == folders[1]) & (F.col("file_index") > 1)):
        left = earlier.where(~lost)
        resume = PL.checked_resume(left, order)
        again = PL.plan_records(listed, order, "vault", resume, PL.folder_tips(left))
        wanted = whole.where(lost | (F.col("plan_seq") >= 40))
        assert rows(again, "value", "file_index") == rows(wanted, "value", "file_index")
        first = again.orderBy("plan_seq").first()
        assert first["plan_seq"] == 40 and first["key"] in folders[:2]


def test_resume_refuses_a_plan_with_lost_records(spark):
    whole, order = planned(spark)
    whole = spark.createDataFrame(whole.collect(), whole.schema)
    folder = whole.where("file_index = 2").orderBy("plan_seq").first()["key"]
    torn = whole.where(~((F.col("key") == folder) & (F.col("file_index") == 1)))
    with pytest.raises(ValueError, match="is numbered up to"):
        PL.checked_resume(torn, order)


def test_resume_refuses_other_topics(spark):
    whole, _ = planned(spark)
    with pytest.raises(ValueError, match="another|was made for a topic list"):
        planned(spark, include="alpha,beta", resume_from=whole.where("topic = 'alpha'"))
    with pytest.raises(ValueError, match="no topic it names"):
        planned(spark, include="beta", resume_from=whole.where("topic = 'alpha'"))


def test_resume_point_of_the_last_topic_in_order(spark):
    records = [(0, name("one", 0, 1)), (1, name("one", 12, 5)), (2, name("two", 0, 9)), (3, name("two", 2, 4))]
    latest = spark.createDataFrame(
        [(i, v.rsplit("/", 1)[0] + "/", v, None, None) for i, v in records],
        "plan_seq bigint, key string, value string, file_index bigint, topics_sha string",
    )
    order = PL.topic_order(PL.filter_topics(topics(spark, ["one", "two"]), "two,one"))
    got = PL.resume_point(latest, order).first()
    assert (got["topic"], got["file"], got["file_index"], got["topics_sha"]) == ("one", name("one", 12, 5), 0, "")
    nothing = PL.resume_point(latest.limit(0), order)
    assert nothing.isEmpty()


def test_late_files_are_reported(spark):
    plan, _ = planned(spark, include="alpha")
    late = ARCHIVE + [(name("alpha", 0, 3), 1), (name("beta", 0, 3), 1)]
    listed = PL.list_objects(listing(spark, late), "vault")
    assert rows(PL.never_planned(listed, plan), "path") == [(name("alpha", 0, 3),)]
