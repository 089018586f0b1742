import pytest
from conftest import rows
from pyspark.sql import Row
from pyspark.sql import functions as F

from logharbor import archive_log
from logharbor.operators import audit as C
from logharbor.operators import planner as PL
from logharbor.operators import restore as R
from logharbor.schemas import RECORD
from logharbor.shared import new_path, staged
from logharbor.sources import storage as S
from logharbor.streaming import jobs as J
from logharbor.streaming.idle import _Segment


def log(spark, first, count):
    data = [
        (b"k", b"v" * (5 + i % 9), {"h": b"1"}, "t", p, i, i)
        for p in (0, 1)
        for i in range(first, first + count)
    ]
    return spark.createDataFrame(data, RECORD)


@pytest.fixture(scope="module")
def parts(spark):
    return [log(spark, 0, 60), log(spark, 60, 60), log(spark, 120, 45)]


def test_stream_equals_batch(spark, parts):
    """Micro-batches that end where polls end give the same segments as one batch run."""
    job = J.ArchiveStream(new_path(spark, "stream"), min_size=400, poll_records=20, prefix="b")
    feed = new_path(spark, "feed")
    for part in parts:
        S.write_feed(part, feed)
        job.run(S.stream_log(spark, feed))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    batch = archive_log(whole, "b", min_size=400, poll_records=20)
    names = ["path", "first_offset", "last_offset", "rows", "bytes", "closed"]
    assert rows(job.manifest(spark), *names) == rows(batch.manifest, *names)
    assert rows(job.commits(spark)) == rows(batch.commits)
    published = job.archive(spark).count()
    assert published == batch.rows.count() < whole.count()
    job.flush(spark)
    assert C.restore_content_diff(whole, R.source_offsets(
        R.stamp_source_offset(job.archive(spark))
    )).isEmpty()


def test_repeated_micro_batch_and_flush_in_between(spark, parts):
    job = J.ArchiveStream(new_path(spark, "stream"), min_size=500, poll_records=16, prefix="b")
    feed = new_path(spark, "feed")
    for part in parts:
        S.write_feed(part, feed)
        job.run(S.stream_log(spark, feed))
        job.repeat_last_batch(spark)
        job.flush(spark)
        job.flush(spark)
        job.drop_published_spool(spark)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert rows(job.archive(spark), "partition", "offset") == rows(whole, "partition", "offset")
    manifest = job.manifest(spark)
    assert manifest.agg(F.sum("rows")).first()[0] == whole.count()
    assert rows(C.rows_per_file(job.archive(spark))) == rows(manifest, "path", "rows")


def test_flush_of_nothing(spark):
    job = J.ArchiveStream(new_path(spark, "stream"))
    job.flush(spark)


def test_restore_stream_equals_batch(spark, parts):
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    archived = archive_log(whole, "b", min_size=400, poll_records=20, flush=True)
    root = new_path(spark, "archive")
    S.write_archive(archived.rows, root)
    listed = PL.list_objects(S.manifest_objects(archived.manifest), "b")
    order = PL.topic_order(PL.filter_topics(listed.select("topic").distinct(), ".*"))
    plan = staged(PL.plan_records(listed, order, "b"), "plan")
    feed = new_path(spark, "feed")
    for part in J.in_order(plan, "plan_seq", 3):
        S.write_feed(part, feed)
    job = J.RestoreStream(
        new_path(spark, "stream"),
        lambda files: S.read_archive(spark, root, "b", files=files),
        topic_prefix="r.",
    )
    job.run(J.plan_stream(spark, feed, maxFilesPerTrigger="1"))
    names = ["topic", "partition", "offset", "source_offset"]
    batch = R.restore_rows(plan, S.read_archive(spark, root, "b"), topic_prefix="r.")
    assert rows(job.restored(spark), *names) == rows(batch, *names)
    # a round that runs again replaces what it wrote
    job.restore_round(spark.read.schema(plan.schema).parquet(feed).where("plan_seq < 2"), 0)


def test_observed_rounds_agree_with_what_they_wrote(spark, parts):
    archived = archive_log(parts[0], "b", min_size=200, poll_records=10, flush=True)
    root = new_path(spark, "archive")
    S.write_archive(archived.rows, root)
    listed = PL.list_objects(S.manifest_objects(archived.manifest), "b")
    order = PL.topic_order(PL.filter_topics(listed.select("topic").distinct(), ".*"))
    plan = staged(PL.plan_records(listed, order, "b"), "plan")
    job = J.RestoreStream(
        new_path(spark, "stream"), lambda files: S.read_archive(spark, root, "b", files=files), fold=2
    )
    total = plan.count()
    cuts = [0, 2, 2, 5, total]  # the second round is empty
    for number, (first, end) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = plan.where((F.col("plan_seq") >= first) & (F.col("plan_seq") < end))
        job.restore_round(part, number)
        if number == 2:
            half = job.percent_done(spark, total).first()
            assert half["plan_records"] == 5 and half["percent_done"] == 500 // total
            job.restore_round(part, number)  # a restart repeats a round, its row is replaced
    written = spark.read.parquet(f"{job.root}/target").groupBy("round_no").count()
    rows_of = {r["round_no"]: r["count"] for r in written.collect()}
    seen = job.observed(spark).collect()
    assert {r["round_no"]: r["rows"] for r in seen} == {0: 0, 1: 0, 2: 0, 3: 0} | rows_of
    by_round = {r["round_no"]: (r["plan_records"], r["last_plan_seq"]) for r in seen}
    assert by_round == {0: (2, 1), 1: (0, None), 2: (3, 4), 3: (total - 5, total - 1)}
    assert job.percent_done(spark, total).first()["percent_done"] == 100
    assert job.percent_done(spark, 0).first()["percent_done"] is None
    # settled rounds are folded
    assert len(job._observed.rounds(spark)) < 4


def test_restore_stream_refuses_foreign_data(spark, parts):
    foreign = parts[0].select("topic", "partition", "offset", "headers")
    job = J.RestoreStream(new_path(spark, "stream"), lambda files: None, target=foreign)
    first = foreign.first()
    path = f"{first['topic']}/{first['partition']}/{first['topic']}-{first['partition']}-0000000000000000000.avro"
    plan = spark.createDataFrame([(0, path)], "plan_seq bigint, value string")
    with pytest.raises(ValueError, match="holds other data"):
        job.restore_round(plan, 0)


class FakeHandle:
    """State and timers of one key, as the engine hands them to a processor."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = tuple(value)

    def clear(self):
        self.value = None

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


class At:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def opened(round_no, first, last):
    return Row(topic="t", partition=0, first_offset=first, last_offset=last, rows=1, bytes=10, round=round_no)


class Watching:
    def __init__(self, **limits):
        self.handle, self.segment = FakeHandle(), _Segment(**limits)
        self.segment.init(self.handle)

    def sees(self, now, *rows_):
        assert list(self.segment.handleInputRows(("t", 0), iter(rows_), At(now))) == []
        return self

    def until(self, end):
        """Fires the timers that are due, in order; what they report, with the time."""
        out = []
        while self.handle.timers and min(self.handle.timers) <= end:
            at = min(self.handle.timers)
            self.handle.timers.discard(at)
            out += [(at, r.reason, r.last_offset) for r in self.segment.handleExpiredTimer(("t", 0), At(at), None)]
        return out


def test_open_segments_are_reported_when_idle_or_old():
    limits = {"idle_ms": 100, "max_age_ms": 1000, "check_ms": 30}
    still = Watching(**limits).sees(0, opened(0, 0, 9))
    assert still.until(99) == [] and len(still.handle.timers) == 1
    assert still.until(500) == [(100, "idle", 9)] and not still.handle.exists() and not still.handle.timers
    # a segment listed again without new records goes on being idle, one that grows does not
    listed = Watching(**limits).sees(0, opened(0, 0, 9)).sees(60, opened(2, 0, 9))
    assert listed.until(200) == [(100, "idle", 9)]
    grown = Watching(**limits).sees(0, opened(0, 0, 9)).sees(60, opened(2, 0, 12))
    assert grown.until(155) == [] and grown.until(200) == [(160, "idle", 12)]
    # one that never rests is old in the end; the next segment starts anew
    busy = Watching(**limits)
    told = []
    for now in range(0, 1100, 50):
        told += busy.until(now)
        busy.sees(now, opened(now, 0, now))
    assert [(reason, at) for at, reason, _ in told] == [("old", 1000)]
    next_ = Watching(**limits).sees(0, opened(0, 0, 9)).sees(90, opened(2, 10, 12))
    assert next_.until(189) == [] and next_.until(300) == [(190, "idle", 12)]


def test_open_segments_that_close_are_forgotten():
    closed = Watching(idle_ms=100, max_age_ms=1000, check_ms=30).sees(0, opened(0, 0, 9)).sees(50, opened(2, None, None))
    assert closed.until(2000) == [] and not closed.handle.timers
    # rows come in any order, and an older round is no news
    mixed = Watching(idle_ms=100, max_age_ms=1000, check_ms=30).sees(0, opened(4, 5, 9), opened(2, 0, 4))
    assert mixed.sees(10, opened(2, 0, 4)).until(200) == [(100, "idle", 9)]
    assert Watching(idle_ms=1, max_age_ms=1, check_ms=1).until(100) == []
    late = Watching(idle_ms=100, max_age_ms=1000, check_ms=30)
    assert list(late.segment.handleExpiredTimer(("t", 0), At(5), None)) == []


def test_flush_of_reported_segments_only(spark, parts):
    job = J.ArchiveStream(new_path(spark, "stream"), min_size=10**6, poll_records=20, prefix="b", watch=True)
    place = "topic string, partition int, first_offset bigint, last_offset bigint"
    told = spark.createDataFrame([("t", 0, 0, 59), ("t", 1, 0, 19), ("u", 0, 0, 59)], place)
    job.archive_batch(parts[0], 0)
    assert rows(spark.read.parquet(f"{job.root}/open"), "partition", "first_offset", "last_offset", "rows") == [
        (0, 0, 59, 60), (1, 0, 59, 60),
    ]
    job.flush(spark, only=told)  # partition 1 has moved since it was reported
    job.flush(spark, only=told)
    assert rows(job.manifest(spark), "partition", "first_offset", "last_offset") == [(0, 0, 59)]
    after = spark.read.parquet(f"{job.root}/open/round_no=1")
    assert rows(after, "partition", "first_offset") == [(0, None), (1, 0)]
    job.archive_batch(parts[1], 1)
    job.flush(spark)
    assert rows(job.manifest(spark), "partition", "first_offset", "last_offset") == [(0, 0, 59), (0, 60, 119), (1, 0, 119)]
    whole = parts[0].unionByName(parts[1])
    assert rows(job.archive(spark), "partition", "offset") == rows(whole, "partition", "offset")
