import pytest
from pyspark.sql import functions as F

from logharbor.functions import headers as H
from logharbor.functions import paths as P
from logharbor.functions.text import first_match, matches_any, regex_list, split_and_trim
from logharbor.operators import archive as A


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_lists():
    assert split_and_trim(" a, ,b") == ["a", "", "b"]
    assert regex_list(" a, ,b ") == ["a", "b"]
    assert regex_list("") == []


def test_bad_regex_is_refused(spark):
    with pytest.raises(ValueError, match="not a regular expression"):
        regex_list("ok, [")


def test_matching_is_unanchored(spark):
    assert one(spark, matches_any(F.lit("billing-eu.x"), ["billing"]))
    assert not one(spark, matches_any(F.lit("x"), []))
    assert one(spark, first_match(F.lit("b1"), ["a", "1", "b"])) == 1
    assert one(spark, first_match(F.lit("c"), ["a", "1"])) is None


def test_prefix():
    assert P.normalize_prefix("") == ""
    assert P.normalize_prefix("a/b") == "a/b/"
    assert P.normalize_prefix("a/") == "a/"


def test_segment_path(spark):
    path = P.segment_path("pre", F.lit("my-topic"), F.lit(0), F.lit(12345))
    assert one(spark, path) == "pre/my-topic/0/my-topic-0-0000000000000012345.avro"


@pytest.mark.parametrize(
    "name, expected",
    [
        ("a/t/0/t-0-0000000000000000007.avro", 7),
        ("a/my-topic/3/my-topic-3-12.avro", 12),
        ("a/t/0/t-5.avro", None),
        ("a/t/0/t-0-x.avro", None),
        ("a/t/0/t-0-7.txt", None),
    ],
)
def test_offset_in_name(spark, name, expected):
    assert one(spark, P.offset_in_name(F.lit(name))) == expected


def test_folder(spark):
    assert one(spark, P.folder(F.lit("a/b/c"))) == "a/b/"
    assert one(spark, P.folder(F.lit("abc"))) == "abc"


HEADERS = "array<struct<key:string,value:binary>>"


def raw(spark, entries):
    return spark.createDataFrame([(entries,)], f"headers {HEADERS}")


def test_last_repeated_header_wins(spark):
    df = raw(spark, [("a", b"1"), ("b", None), ("a", b"2"), ("c", b"3"), ("a", b"4")])
    got = df.select(H.collapse(F.col("headers")).alias("h"), H.has_repeats(F.col("headers")).alias("r")).first()
    assert {k: bytes(v) for k, v in got["h"].items()} == {"a": b"4", "b": b"", "c": b"3"}
    assert got["r"]


def test_no_header_list(spark):
    got = raw(spark, None).select(H.collapse(F.col("headers")).alias("h")).first()
    assert got["h"] == {}


def test_no_headers(spark):
    got = raw(spark, []).select(H.collapse(F.col("headers")).alias("h"), H.has_repeats(F.col("headers")).alias("r")).first()
    assert got["h"] == {} and not got["r"]


def test_header_lookup_takes_the_first(spark):
    df = raw(spark, [("k1", b"v1"), ("k2", b"v2"), ("k1", b"v3")])
    look = lambda name: df.select(H.first_value_of(F.col("headers"), name).cast("string")).first()[0]
    assert look("k1") == "v1"
    assert look("k2") == "v2"
    assert look("k3") is None


def mapped(spark, headers):
    return spark.createDataFrame([(headers, 42)], "headers map<string,binary>, offset bigint")


def test_source_offset(spark):
    read = lambda h: mapped(spark, h).select(H.source_offset(F.col("headers"))).first()[0]
    assert read({"restore.source-offset": b"17"}) == 17
    assert read({}) == -1
    with pytest.raises(Exception, match="bad source offset header"):
        read({"restore.source-offset": b"x"})
    with pytest.raises(Exception, match="bad source offset header"):
        read({"restore.source-offset": b"99999999999999999999"})


def test_stamp_adds_or_replaces(spark):
    for before in ({"a": b"1"}, {"a": b"1", "restore.source-offset": b"7"}):
        got = mapped(spark, before).select(H.stamp(F.col("headers"), F.col("offset")).alias("h")).first()["h"]
        assert {k: bytes(v) for k, v in got.items()} == {"a": b"1", "restore.source-offset": b"42"}


def test_archive_round_trip(spark):
    raw_rows = spark.sql(
        "SELECT CAST(NULL AS BINARY) AS key, CAST('v' AS BINARY) AS value, "
        "array(struct('b' AS key, CAST('2' AS BINARY) AS value), struct('a' AS key, CAST('1' AS BINARY) AS value)) AS headers, "
        "'t' AS topic, 0 AS partition, TIMESTAMP '2024-01-01 00:00:00.123987' AS timestamp, 5L AS offset"
    )
    archived = A.archive_rows(raw_rows)
    first = archived.first()
    assert first["timestamp"] == 1704067200123  # cut, not rounded
    back = A.raw_records(archived).first()
    assert [(h["key"], bytes(h["value"])) for h in back["headers"]] == [("a", b"1"), ("b", b"2")]
    assert back["timestamp"].microsecond == 123000
    assert archived.select(A.row_bytes()).first()[0] == 1 + 4
