"""One query per operator, over the log, archive and groups derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor import fixtures as X
from logharbor.functions import headers as H
from logharbor.operators import archive as A
from logharbor.operators import asof
from logharbor.operators import audit as C
from logharbor.operators import groups as G
from logharbor.operators import intervals as I
from logharbor.operators import planner as PL
from logharbor.operators import restore as R
from logharbor.operators.rolling import roll_segments
from logharbor.plans.jobs import plan_restore
from logharbor.schemas import RECORD, SOURCE_OFFSET_HEADER, TP
from logharbor.shared import new_path, staged
from logharbor.sources import objects as O
from logharbor.sources import storage as S
from logharbor.sources.commit_log import CommitLog
from logharbor.sources.followed import SourceBlocks, translate_followed as follow_log
from logharbor.sources.journal import PlanJournal
from logharbor.sources.offset_index import OffsetIndex
from logharbor.sources.polled import PollIndex, drain, poll_log
from logharbor.sources.print_tree import PrintTree, tree_diff
from logharbor.streaming import jobs as J
from logharbor.streaming.idle import IdleWatch

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _queries[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def _str(name: str):
    return F.col(name).cast("string").alias(name)


def _header(name: str, alias: str):
    return H.value_of(F.col("headers"), name).cast("string").alias(alias)


_RESTORED = [
    "topic",
    "partition",
    "offset",
    "source_offset",
    "timestamp",
]


def _readable(restored: DataFrame) -> DataFrame:
    return restored.select(
        *_RESTORED,
        _str("key"),
        _str("value"),
        _header("origin-id", "origin_id"),
        _header(SOURCE_OFFSET_HEADER, "stamp"),
    )


# --- sources -------------------------------------------------------------------------


@query
def scan_topics_regex(spark, sf):
    log = R.scan_topics(X.records(spark, sf), "click, ^pur, err", "rr")
    return log.select(*TP, "offset", _str("key"), _str("value"))


@query
def scan_archive(spark, sf):
    path = new_path(spark, "written")
    kept = X.kept_records(spark, sf)
    S.write_archive(A.with_segments(kept, staged(X.rolled(spark, sf), "rolled"), flush=True), path)
    rows = S.read_archive(spark, path, X.PREFIX)
    return R.stamp_source_offset(rows).select(
        F.concat(F.lit(X.TOPIC_PREFIX), "topic").alias("topic"),
        "partition",
        "offset",
        "path",
        _str("value"),
        _header(SOURCE_OFFSET_HEADER, "stamp"),
    )


@query
def list_topics(spark, sf):
    return PL.list_topics(X.objects(spark, sf), X.PREFIX)


@query
def list_objects(spark, sf):
    return PL.list_objects(X.objects(spark, sf), X.PREFIX).select("topic", "path", "length")


@query
def latest_record_per_partition(spark, sf):
    return R.latest_records(X.records(spark, sf)).select(
        *TP, "offset", _str("key"), _str("value"), _header("origin-id", "origin_id")
    )


@query
def latest_record_of_partitions(spark, sf):
    log = X.records(spark, sf).where(F.col("topic") == "view")
    return R.latest_records(log, [0, 2]).select(*TP, "offset", _str("key"), _str("value"))


@query
def partition_watermarks(spark, sf):
    return R.partition_watermarks(X.records(spark, sf))


@query
def scan_group_snapshot(spark, sf):
    path = new_path(spark, "snapshot")
    S.write_snapshot(X.snapshot(spark, sf), path)
    return G.flatten_groups(G.filter_groups(S.read_snapshot(spark, path), "^group-1, ^group-2", "7$"))


@query
def record_at_offset(spark, sf):
    log = R.source_offsets(X.restored(spark, sf)).select(*TP, "offset", "source_offset")
    wanted = (
        X.files(spark, sf)
        .select(
            F.concat(F.lit(X.TOPIC_PREFIX), "topic").alias("topic"),
            "partition",
            F.col("first_offset").alias("start_offset"),
        )
        .distinct()
    )
    return asof.record_at_offset(log, wanted, width=64)


def _indexed_log(spark, sf):
    """The restored log as two appends wrote it, with its index."""
    path = new_path(spark, "indexed-log")
    index = OffsetIndex(spark, path, new_path(spark, "offset-index"), width=64)
    first = X.half_restored(spark, sf)
    rest = X.restored(spark, sf).join(first.select(*TP, "offset"), [*TP, "offset"], "left_anti")
    for part in (first, rest):
        S.write_topics(part, path, run=64)
        index.extend()
    return index


@query
def record_at_offset_indexed(spark, sf):
    wanted = (
        X.files(spark, sf)
        .select(
            F.concat(F.lit(X.TOPIC_PREFIX), "topic").alias("topic"),
            "partition",
            F.col("first_offset").alias("start_offset"),
        )
        .distinct()
    )
    found = _indexed_log(spark, sf).records_at(wanted)
    return found.select(*TP, "start_offset", "offset", "source_offset")


@query
def latest_record_indexed(spark, sf):
    return _readable(_indexed_log(spark, sf).latest())


# --- archive building ------------------------------------------------------------------


@query
def archive_rows(spark, sf):
    return A.archive_rows(X.raw_records(spark, sf)).select(
        *TP,
        "offset",
        "timestamp",
        _str("key"),
        _str("value"),
        F.size("headers").cast("bigint").alias("n_headers"),
        _header("origin-id", "origin_id"),
        _header("event-type", "event_type"),
        _header("note", "note"),
    )


@query
def duplicate_headers(spark, sf):
    return A.duplicate_headers(X.raw_records(spark, sf)).select(*TP, "offset")


@query
def record_from_archive(spark, sf):
    names = F.array_join(F.transform("headers", lambda h: h["key"]), ",")
    values = F.array_join(F.transform("headers", lambda h: h["value"].cast("string")), ",")
    return A.raw_records(X.records(spark, sf)).select(
        *TP,
        "offset",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("time"),
        names.alias("header_keys"),
        values.alias("header_values"),
    )


@query
def row_size(spark, sf):
    return X.records(spark, sf).select(*TP, "offset", A.row_bytes().alias("bytes"))


@query
def poll_batches(spark, sf):
    return A.poll_batches(X.kept_records(spark, sf))


@query
def segment_roll(spark, sf):
    return X.rolled(spark, sf)


@query
def segment_roll_poll_size(spark, sf):
    """Batches cut by offset instead of an own batch column."""
    rows = X.records(spark, sf).drop("batch_no")
    return roll_segments(A.poll_batches(rows, poll_records=40), 7_000, chunk=8)


@query
def segment_manifest(spark, sf):
    return A.segment_manifest(X.rolled(spark, sf), X.PREFIX)


@query
def segment_flush(spark, sf):
    return A.segment_manifest(X.rolled(spark, sf), X.PREFIX, flush=True)


@query
def archive_write(spark, sf):
    path = new_path(spark, "written")
    kept = X.kept_records(spark, sf)
    S.write_archive(A.with_segments(kept, staged(X.rolled(spark, sf), "rolled")), path)
    return (
        S.read_archive(spark, path, X.PREFIX)
        .groupBy("path", *TP)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("offset").alias("first_offset"),
            F.max("offset").alias("last_offset"),
            F.max("timestamp").alias("last_timestamp"),
        )
    )


def _segments(spark, sf, flush=False):
    return A.with_segments(X.kept_records(spark, sf), staged(X.rolled(spark, sf), "rolled"), flush=flush)


@query
def archive_objects_write(spark, sf):
    """One object per closed segment, published by two writes, read back and listed."""
    root = new_path(spark, "objects")
    rows = _segments(spark, sf)
    for part in (F.col("partition") == 0, F.col("partition") != 0):
        O.write_objects(rows.where(part), root)
    back = S.read_objects(spark, root, X.PREFIX, fmt="parquet")
    read = back.groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"), F.max("timestamp").alias("last_timestamp")
    )
    listed = S.list_objects(spark, root, X.PREFIX).groupBy("path", "length").agg(F.count(F.lit(1)).alias("listed"))
    manifest = O.written_objects(spark, root, X.PREFIX).drop("rows")
    return manifest.join(read, "path").join(listed, ["path", "length"]).select(
        "path", *TP, "rows", "first_offset", "last_offset", "bytes", "last_timestamp", "listed"
    )


@query
def committed_offsets(spark, sf):
    return A.committed_offsets(A.segment_manifest(X.rolled(spark, sf)))


@query
def open_segment_rows(spark, sf):
    commits = A.committed_offsets(A.segment_manifest(X.rolled(spark, sf)))
    return A.open_rows(X.kept_records(spark, sf), commits).select(*TP, "offset", _str("value"))


@query
def idle_partitions(spark, sf):
    """Measured two hours before the newest record of the log."""
    log = X.records(spark, sf)
    newest = log.agg(F.max("timestamp")).first()[0]
    return A.idle_partitions(log, newest, 2 * 3_600_000)


def _leftovers(spark, sf):
    """Archived files taken as staged, judged at the offset in the middle of each partition."""
    rows = X.archive(spark, sf).select(*TP, F.col("file_offset").alias("first_offset"), "offset")
    current = R.partition_watermarks(X.kept_records(spark, sf)).select(
        *TP, F.expr("(start_offset + end_offset) div 2").alias("current_offset")
    )
    return rows.select(*TP, "first_offset").distinct(), rows, current


@query
def reconcile_segments(spark, sf):
    return A.reconcile_segments(*_leftovers(spark, sf))


@query
def reconcile_segments_first_offset(spark, sf):
    return A.reconcile_segments(*_leftovers(spark, sf), match="first_offset")


@query
def unexpected_leftovers(spark, sf):
    return A.unexpected_leftovers(A.reconcile_segments(*_leftovers(spark, sf)))


@query
def orphan_partitions(spark, sf):
    """Folders of the log's partitions and of one past each; two thirds are assigned."""
    pairs = X.records(spark, sf).select(*TP).distinct()
    folders = pairs.select(
        "topic",
        F.explode(
            F.array(
                F.col("partition").cast("string"),
                (F.col("partition") + 3).cast("string"),
                F.concat(F.lit("tmp-"), F.col("partition").cast("string")),
            )
        ).alias("folder"),
    )
    return A.orphan_partitions(folders, pairs.where(F.col("partition") < 2))


# --- planning ----------------------------------------------------------------------------


@query
def parse_archive_path(spark, sf):
    return PL.parse_paths(X.objects(spark, sf)).drop("length")


@query
def unparseable_keys(spark, sf):
    return PL.unparseable_keys(X.objects(spark, sf))


_INCLUDE = "view, ^(pur|sig), r"
_EXCLUDE = "^x, up$"


@query
def filter_topics_ordered(spark, sf):
    topics = PL.filter_topics(PL.list_topics(X.objects(spark, sf), X.PREFIX), _INCLUDE, _EXCLUDE)
    return PL.topic_order(topics).select(F.col("rank").cast("bigint").alias("rank"), "topic")


@query
def topic_inventory(spark, sf):
    return PL.inventory(PL.list_objects(X.objects(spark, sf), X.PREFIX))


@query
def topic_sizes(spark, sf):
    return PL.topic_sizes(PL.inventory(PL.list_objects(X.objects(spark, sf), X.PREFIX)))


def _large_order(spark, sf):
    """Topics above the mean size go last; sizes are taken as MB to suit the threshold."""
    listed = PL.list_objects(X.objects(spark, sf), X.PREFIX)
    sizes = PL.topic_sizes(PL.inventory(listed))
    mean = sizes.agg(F.expr("sum(bytes) div count(*)")).first()[0]
    scaled = sizes.withColumn("bytes", F.col("bytes") * 1024 * 1024)
    topics = PL.filter_topics(listed.select("topic").distinct(), ".*")
    return PL.topic_order(topics, scaled, large_last=True, large_mb=mean)


@query
def large_topics_last(spark, sf):
    return _large_order(spark, sf).select(F.col("rank").cast("bigint").alias("rank"), "topic")


@query
def topics_sha(spark, sf):
    return PL.topics_sha(_large_order(spark, sf))


@query
def plan_file_index(spark, sf):
    return X.plan(spark, sf).select(F.col("value").alias("path"), "topic", "partition", "file_index")


@query
def plan_records(spark, sf):
    listed = PL.list_objects(X.objects(spark, sf), X.PREFIX)
    return PL.plan_records(listed, X.topic_order(spark, sf, _INCLUDE, _EXCLUDE), X.PREFIX)


@query
def plan_write(spark, sf):
    path = new_path(spark, "plan")
    S.write_plan(X.plan(spark, sf), path)
    return S.read_plan(spark, path).select("plan_seq", "key", "value", "file_index")


@query
def plan_resume_point(spark, sf):
    order = X.topic_order(spark, sf)
    return PL.resume_point(PL.latest_plan_records(X.earlier_plan(spark, sf)), order)


@query
def plan_sha_guard(spark, sf):
    """Goes on for the same topics; a plan made for other topics is refused. Both fingerprints are returned."""
    earlier = X.earlier_plan(spark, sf)

    def goes_on(order):
        try:
            return PL.checked_resume(earlier, order) is not None
        except ValueError:
            return False

    orders = {name: X.topic_order(spark, sf, exclude=name) for name in ("", "view")}
    made_for = earlier.groupBy("topic").agg(F.max("topics_sha").alias("planned_sha"))
    answers = [
        order.select(
            "topic", F.lit(name).alias("excluded"), "topics_sha", F.lit(goes_on(order)).alias("goes_on")
        )
        for name, order in orders.items()
    ]
    return answers[0].unionByName(answers[1]).join(made_for, "topic", "left")


@query
def plan_resume_records(spark, sf):
    order = X.topic_order(spark, sf)
    resume = PL.checked_resume(X.earlier_plan(spark, sf), order)
    return PL.plan_records(PL.list_objects(X.objects(spark, sf), X.PREFIX), order, X.PREFIX, resume)


def _damaged_plans(spark, sf):
    """The earlier plan without its first folder's records, and without the tail of its second folder."""
    earlier = X.earlier_plan(spark, sf)
    folders = [r["key"] for r in earlier.groupBy("key").agg(F.min("plan_seq").alias("s")).orderBy("s").limit(2).collect()]
    tail = (F.col("key") == folders[-1]) & (F.col("file_index") > 2)
    return {"folder": earlier.where(F.col("key") != folders[0]), "tail": earlier.where(~tail)}


@query
def plan_resume_holes(spark, sf):
    """Going on from plans that lost records before the resume point."""
    order = X.topic_order(spark, sf)
    listed = PL.list_objects(X.objects(spark, sf), X.PREFIX)
    parts = []
    for lost, plan in _damaged_plans(spark, sf).items():
        resume = PL.checked_resume(plan, order)
        again = PL.plan_records(listed, order, X.PREFIX, resume, PL.folder_tips(plan))
        parts.append(again.select(F.lit(lost).alias("lost"), "plan_seq", "value", "file_index"))
    return parts[0].unionByName(parts[1])


@query
def plan_from_wire(spark, sf):
    """The plan in the form Kafka carries it, read back."""
    plan = X.plan(spark, sf)
    wire = S.plan_to_wire(plan).join(
        plan.select(
            F.col("value").cast("binary").alias("value"),
            F.col("plan_seq").alias("offset"),
            F.lit(0).alias("partition"),
        ),
        "value",
    )
    return S.plan_from_wire(wire).select("key", "value", "topic", "partition", "file_index", "topics_sha")


@query
def list_written_objects(spark, sf):
    """A listing of real files below topic and partition folders."""
    root = new_path(spark, "objects")
    O.write_objects(_segments(spark, sf, flush=True), root)
    listed = PL.list_objects(S.list_objects(spark, root, X.PREFIX), X.PREFIX)
    counted = PL.inventory(listed.where("length > 0"))
    return counted.select("topic", F.col("partition").cast("int").alias("partition"), "files")


_PAGE = 16


@query
def plan_journal_resume(spark, sf):
    """A journal whose last page was torn, gone on with after objects came late and new ones came."""
    order = X.topic_order(spark, sf)
    listed = PL.list_objects(X.objects(spark, sf), X.PREFIX)
    early = staged(
        PL.plan_records(listed.where(~F.col("path").endswith("1.avro")), order, X.PREFIX), "early"
    )
    journal = PlanJournal(spark, new_path(spark, "journal"), page=_PAGE)
    pages = journal.write_pages(early.where(F.col("plan_seq") < early.count() * 3 // 5))
    journal.close_pages(pages.where(F.col("records") == _PAGE))
    planned = plan_restore(X.objects(spark, sf), X.PREFIX, journal=journal)
    journal.append(planned.plan)
    none = F.lit(None)
    late = planned.late.select(
        none.cast("bigint").alias("plan_seq"),
        F.col("path").alias("value"),
        none.cast("bigint").alias("file_index"),
        none.cast("int").alias("page"),
    )
    return journal.read().select(*late.columns).unionByName(late)


@query
def never_planned(spark, sf):
    """Files that came after the earlier plan was written, here those named 1 mod 10."""
    listed = PL.list_objects(X.objects(spark, sf), X.PREFIX)
    before = X.earlier_plan(spark, sf).where(~F.col("value").endswith("1.avro"))
    return PL.never_planned(listed, before).select("path", "topic")


@query
def plan_progress(spark, sf):
    counted = PL.inventory(PL.list_objects(X.objects(spark, sf), X.PREFIX))
    return PL.plan_progress(X.topic_order(spark, sf), counted, X.earlier_plan(spark, sf)).withColumn(
        "topic_done", F.col("topic_done").cast("int")
    )


# --- restore -----------------------------------------------------------------------------


def _with_losses(spark, sf):
    """The restored log without stretches below its tips."""
    lost = (F.col("source_offset") % 200).between(50, 69) & (F.col("partition") != 1)
    return X.restored(spark, sf).where(~lost)


def _missing(spark, sf):
    wanted = I.runs_of(X.restored(spark, sf), "source_offset", 64)
    return I.difference(wanted, I.runs_of(_with_losses(spark, sf), "source_offset", 64), 64)


@query
def restore_missing_ranges(spark, sf):
    """Stretches of source offsets that a target has lost below its tips."""
    return _missing(spark, sf)


@query
def restore_fill_ranges(spark, sf):
    """Rows that fill the lost stretches, numbered behind the target's tips."""
    lost = staged(
        _missing(spark, sf).withColumn("topic", F.expr(f"substr(topic, {len(X.TOPIC_PREFIX) + 1})")), "lost"
    )
    plan = X.plan(spark, sf).join(lost.select("topic").distinct(), "topic", "left_semi")
    filled = R.fill_ranges(plan, X.archive(spark, sf), lost, _with_losses(spark, sf), X.TOPIC_PREFIX, width=64)
    return _readable(filled)


@query
def restore_exclude(spark, sf):
    return R.exclude_files(X.plan(spark, sf), "ror$, ^vi").select("plan_seq", "value")


@query
def header_lookup(spark, sf):
    raw = F.col("headers")
    return X.raw_records(spark, sf).select(
        *TP,
        "offset",
        H.first_value_of(raw, "origin-id").cast("string").alias("origin_id"),
        F.exists(raw, lambda h: h["key"] == "note").alias("has_note"),
        F.exists(raw, lambda h: h["key"] == "absent").alias("has_absent"),
    )


@query
def source_offset(spark, sf):
    """Restored rows, with the unrestored ones of the same log beside them."""
    both = X.restored(spark, sf).select(*TP, "offset", "headers").unionByName(
        X.records(spark, sf).select(*TP, "offset", "headers")
    )
    return both.select(*TP, "offset", H.source_offset(F.col("headers")).alias("source_offset"))


@query
def stamp_source_offset(spark, sf):
    """Stamps a log that has no stamps, then one that has other stamps."""
    fresh = R.stamp_source_offset(X.records(spark, sf).select(*TP, "offset", "headers"))
    again = R.stamp_source_offset(X.restored(spark, sf).select(*TP, "offset", "headers"))
    return fresh.unionByName(again).select(
        *TP,
        "offset",
        _header(SOURCE_OFFSET_HEADER, "stamp"),
        F.size("headers").cast("bigint").alias("n_headers"),
    )


@query
def last_restored_offset(spark, sf):
    files = R.planned_files(X.plan(spark, sf))
    target = X.half_restored(spark, sf).where(F.col("partition") != 1)
    return R.last_restored_offset(files, R.target_progress(target), X.TOPIC_PREFIX)


@query
def existing_data_violations(spark, sf):
    """Two partitions of each topic were restored; the third holds foreign records."""
    ours = X.restored(spark, sf).where(F.col("partition") < 2)
    foreign = X.restored(spark, sf).where(F.col("partition") == 2).withColumn(
        "headers", H.without_stamp(F.col("headers"))
    )
    return R.existing_data_violations(ours.unionByName(foreign)).select(*TP, "offset")


@query
def restore_dedup(spark, sf):
    return R.restore_rows(X.plan(spark, sf), X.archive(spark, sf)).select(
        "path", *TP, "source_offset"
    )


@query
def restore_topic(spark, sf):
    return _readable(
        R.restore_rows(X.plan(spark, sf), X.archive(spark, sf), topic_prefix=X.TOPIC_PREFIX)
    )


@query
def restore_topic_small_blocks(spark, sf):
    """The same restore with blocks far smaller than a file."""
    return _readable(
        R.restore_rows(
            X.plan(spark, sf), X.archive(spark, sf), topic_prefix=X.TOPIC_PREFIX, exclude="click", width=16
        )
    )


@query
def restore_progress(spark, sf):
    return R.restore_progress(X.restored(spark, sf))


@query
def restore_resume(spark, sf):
    """Second run over the whole plan onto a target that holds three fifths already."""
    progress = staged(R.target_progress(X.half_restored(spark, sf)), "progress")
    return _readable(
        R.restore_rows(X.plan(spark, sf), X.archive(spark, sf), progress, X.TOPIC_PREFIX)
    )


@query
def restore_file_progress(spark, sf):
    seen = X.earlier_plan(spark, sf).withColumn(
        "file_index",
        F.when(F.col("plan_seq") % 6 == 5, F.lit("n/a")).otherwise(F.col("file_index").cast("string")),
    )
    totals = PL.inventory(PL.list_objects(X.objects(spark, sf), X.PREFIX))
    return R.file_progress(seen, totals)


@query
def restore_missing_files(spark, sf):
    """A plan that also names absent files and unusable paths."""
    plan = X.plan(spark, sf)
    added = plan.where(F.col("plan_seq") % 10 == 0)
    absent = added.withColumn("value", F.concat("key", F.lit("absent-0-0000000000000000001.avro")))
    unusable = added.withColumn("value", F.concat("key", F.lit("notes.txt")))
    named = plan.unionByName(absent).unionByName(unusable)
    return R.missing_files(named, X.archive(spark, sf)).select("path", "plan_seq", "reason")


@query
def restore_write(spark, sf):
    """The restored log through its sink and back."""
    path = new_path(spark, "topics")
    S.write_topics(X.restored(spark, sf), path)
    return S.read_topics(spark, path).select(*TP, "offset", "source_offset", _str("value"))


@query
def restore_skipped_rows(spark, sf):
    return R.skipped_rows(X.plan(spark, sf), X.archive(spark, sf))


# --- consumer groups -----------------------------------------------------------------------


@query
def empty_partitions(spark, sf):
    return G.empty_partitions(*X.log_ends(spark, sf))


@query
def valid_group_offsets(spark, sf):
    empty = G.empty_partitions(*X.log_ends(spark, sf))
    return G.valid_group_offsets(X.group_offsets(spark, sf), empty).select(
        *G.ENTRY, "offset", "leader_epoch", "metadata"
    )


@query
def normalise_offsets(spark, sf):
    return G.normalise_offsets(X.group_offsets(spark, sf)).select(
        *G.ENTRY, "offset", "leader_epoch", "metadata"
    )


@query
def group_snapshot(spark, sf):
    """The nested snapshot, flattened to compare; groups without offsets keep one row."""
    empty = G.empty_partitions(*X.log_ends(spark, sf))
    offsets = X.group_offsets(spark, sf).drop("group_no")
    nested = G.group_snapshot(offsets.select("group_id"), offsets, empty)
    return nested.select("group_id", F.explode_outer("topics").alias("t")).select(
        "group_id", F.col("t.topic").alias("topic"), F.explode_outer("t.partitions").alias("p")
    ).select("group_id", "topic", "p.*")


@query
def group_snapshot_write(spark, sf):
    """Written twice to the same place: the second run replaces the first."""
    path = new_path(spark, "snapshot")
    snapshot = X.snapshot(spark, sf)
    S.write_snapshot(snapshot.where(F.col("group_id").endswith("1")), path)
    S.write_snapshot(snapshot, path)
    return S.read_snapshot(spark, path).select(
        "group_id",
        F.size("topics").cast("bigint").alias("topics"),
        F.expr("aggregate(topics, 0L, (n, t) -> n + size(t.partitions))").alias("partitions"),
    )


@query
def filter_groups(spark, sf):
    return G.filter_groups(X.snapshot(spark, sf), "group-[1-4], 9$", "2").select("group_id")


@query
def flatten_groups(spark, sf):
    return G.flatten_groups(X.snapshot(spark, sf))


def _entries(spark, sf):
    return G.flatten_groups(G.filter_groups(X.snapshot(spark, sf)))


def _pending(spark, sf):
    return G.pending_groups(
        _entries(spark, sf), X.committed(spark, sf), X.GROUP_PREFIX, X.TOPIC_PREFIX
    )


@query
def pending_groups(spark, sf):
    return _pending(spark, sf)


@query
def exclude_group_topics(spark, sf):
    return G.exclude_group_topics(_entries(spark, sf), "^cl, ost$")


@query
def existing_group_topics(spark, sf):
    return G.existing_group_topics(_entries(spark, sf), X.topics(spark, sf), X.TOPIC_PREFIX)


@query
def group_readiness(spark, sf):
    log = X.half_restored(spark, sf).where((F.col("topic") != "r.view") | (F.col("partition") != 0))
    foreign = (F.col("topic") == "r.error") & (F.col("partition") == 2)
    headers = F.when(foreign, H.without_stamp(F.col("headers"))).otherwise(F.col("headers"))
    log = log.select(*TP, "offset", headers.alias("headers"))
    return G.group_readiness(_entries(spark, sf), log, X.TOPIC_PREFIX).drop("latest_offset")


@query
def translate_offsets(spark, sf):
    return G.translate_offsets(_entries(spark, sf), X.restored(spark, sf), X.TOPIC_PREFIX)


@query
def translate_offsets_small_blocks(spark, sf):
    """The same lookup with many blocks, over the headers instead of the offset column."""
    log = X.half_restored(spark, sf).drop("source_offset")
    return G.translate_offsets(_entries(spark, sf), log, X.TOPIC_PREFIX, floor="start", width=32)


@query
def translation_cases(spark, sf):
    """Cases per topic on a restored log whose first fifth of source offsets is gone."""
    log = X.restored(spark, sf)
    last = staged(log.groupBy(*TP).agg(F.expr("max(source_offset) div 5").alias("_gone")), "gone")
    cut = log.join(last, TP).where(F.col("source_offset") >= F.col("_gone")).drop("_gone")
    return (
        G.translate_offsets(_entries(spark, sf), cut, X.TOPIC_PREFIX)
        .groupBy("topic", "case")
        .agg(F.count(F.lit(1)).alias("entries"), F.sum("restored_offset").alias("offset_sum"))
    )


@query
def group_commits(spark, sf):
    translated = G.translate_offsets(_pending(spark, sf), X.restored(spark, sf), X.TOPIC_PREFIX)
    return G.group_commits(translated, X.GROUP_PREFIX, X.TOPIC_PREFIX)


def _commit_log(spark, sf):
    """Three rounds of commits of most groups, with a compaction after the second."""
    log = CommitLog(spark, new_path(spark, "commit-log"))
    number, offset = F.col("group_no"), F.col("offset")
    for done in range(3):
        rows = X.group_offsets(spark, sf).where((number % 4 != 1) & ((number + done) % 3 != 0))
        log.append(
            rows.select(
                F.concat(F.lit(X.GROUP_PREFIX), "group_id").alias("group_id"),
                F.concat(F.lit(X.TOPIC_PREFIX), "topic").alias("topic"),
                "partition",
                F.when(offset < 0, offset).otherwise(offset + 5 * done).alias("offset"),
                "leader_epoch",
            )
        )
        if done == 1:
            log.compact()
    return log


@query
def group_commit_log(spark, sf):
    return _commit_log(spark, sf).read()


@query
def pending_groups_of_log(spark, sf):
    committed = _commit_log(spark, sf).read()
    return G.pending_groups(_entries(spark, sf), committed, X.GROUP_PREFIX, X.TOPIC_PREFIX)


@query
def translate_two_rounds(spark, sf):
    resolved, remaining = G.translate_until_done(
        _entries(spark, sf),
        [lambda: X.half_restored(spark, sf), lambda: X.restored(spark, sf)],
        X.TOPIC_PREFIX,
    )
    open_rows = remaining.select(
        *G.ENTRY, F.lit(None).cast("bigint").alias("restored_offset"), F.lit(0).alias("round")
    )
    return resolved.select(*G.ENTRY, "restored_offset", "round").unionByName(open_rows)


@query
def translate_followed(spark, sf):
    """Entries translated while the restored log is appended in three parts."""
    log = X.restored(spark, sf)
    ends = staged(log.groupBy(*TP).agg(F.count(F.lit(1)).alias("_rows")), "ends")
    part = F.expr("offset * 3 div _rows")
    parted = log.join(ends, TP).withColumn("_part", part).drop("_rows")
    path = new_path(spark, "topics")

    def appends():
        for number in range(3):
            S.write_topics(parted.where(F.col("_part") == number).drop("_part"), path)
            yield number

    table = SourceBlocks(spark, path, new_path(spark, "source-blocks"), width=256)
    resolved, remaining = follow_log(_entries(spark, sf), table, appends(), X.TOPIC_PREFIX)
    open_rows = remaining.select(
        *G.ENTRY, F.lit(None).cast("bigint").alias("restored_offset"), F.lit(0).alias("round")
    )
    return resolved.select(*G.ENTRY, "restored_offset", "round").unionByName(open_rows)


@query
def group_status(spark, sf):
    snapshot = G.filter_groups(X.snapshot(spark, sf))
    pending = staged(_pending(spark, sf), "pending")
    kept = G.exclude_group_topics(pending, "purch")
    selected = staged(
        G.existing_group_topics(kept, X.topics(spark, sf), X.TOPIC_PREFIX), "selected"
    )
    translated = G.translate_offsets(selected, X.restored(spark, sf), X.TOPIC_PREFIX)
    return G.group_status(
        snapshot, pending, selected, translated, X.committed(spark, sf), X.GROUP_PREFIX
    )


# --- audit ---------------------------------------------------------------------------------


@query
def rows_per_file(spark, sf):
    return C.rows_per_file(X.archive(spark, sf))


@query
def segment_overlaps(spark, sf):
    return C.segment_overlaps(X.files(spark, sf), width=64).select(
        "path", "first_offset", "last_offset", "earlier_last"
    )


@query
def path_mismatches(spark, sf):
    """An archive in which the files of one topic lie in the folder of another."""
    moved = F.regexp_replace("path", "/view/", "/click/")
    return C.path_mismatches(X.archive(spark, sf).withColumn("path", moved))


@query
def offset_gaps(spark, sf):
    return C.offset_gaps(X.kept_records(spark, sf), width=100)


@query
def restore_duplicates(spark, sf):
    return C.restore_duplicates(X.naive_replay(spark, sf))


@query
def restore_count_diff(spark, sf):
    return C.restore_count_diff(X.records(spark, sf), X.naive_replay(spark, sf), X.TOPIC_PREFIX)


@query
def restore_content_diff(spark, sf):
    return C.restore_content_diff(X.records(spark, sf), X.damaged(spark, sf), X.TOPIC_PREFIX)


@query
def restore_tree_diff(spark, sf):
    """A stored log against a stored restore with rows changed, lost and added in three partitions."""
    source = X.kept_records(spark, sf).where("NOT (topic = 'error' AND partition = 0 AND offset % 30 = 5)")
    lost = "NOT (topic = 'r.click' AND partition = 2 AND source_offset % 40 = 3)"
    hit = F.expr("topic = 'r.view' AND partition = 1 AND source_offset % 50 = 7")
    target = X.restored(spark, sf).where(lost).withColumn(
        "value", F.when(hit, F.concat("value", F.lit(b"!"))).otherwise(F.col("value"))
    )
    trees = []
    for log, how in ((source, {"pos": "offset", "topic_prefix": X.TOPIC_PREFIX}), (target, {})):
        path, root = new_path(spark, "log"), new_path(spark, "prints")
        tree = PrintTree(spark, path, root, width=256, fan=4, levels=3, **how)
        for part in (0, 1):  # two appends, the tree is extended by each
            S.write_topics(log.where(F.expr("offset div 256 % 2") == part).drop("batch_no"), path, run=1024)
            tree.extend()
        trees.append(tree)
    return tree_diff(*trees)


@query
def restore_order_violations(spark, sf):
    return C.restore_order_violations(X.naive_replay(spark, sf), width=50)


@query
def restore_is_clean(spark, sf):
    """Duplicates, order violations and rows of the restored log that differ from the archive."""
    log = X.restored(spark, sf)
    findings = [
        ("duplicate", C.restore_duplicates(log)),
        ("order", C.restore_order_violations(log)),
        ("content", C.restore_content_diff(X.kept_records(spark, sf), log, X.TOPIC_PREFIX)),
    ]
    rows = None
    for name, found in findings:
        part = found.select(F.lit(name).alias("finding"), "topic", "partition", "source_offset")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query
def group_lag(spark, sf):
    return C.group_lag(X.group_offsets(spark, sf), X.watermarks(spark, sf)).select(
        *G.ENTRY, "offset", "end_offset", "lag"
    )


# --- streaming -----------------------------------------------------------------------------


@query
def stream_archive(spark, sf):
    """Archive a stream of files, then flush; one manifest row per segment."""
    size = 4 * X.ROLL_BYTES
    job = J.ArchiveStream(new_path(spark, "stream"), size, poll_records=40, prefix=X.PREFIX)
    feed = new_path(spark, "feed")
    for part in J.in_order(X.kept_records(spark, sf), "timestamp", 3):
        S.write_feed(part, feed)
        job.run(S.stream_log(spark, feed))
    job.flush(spark)
    stored = job.archive(spark).groupBy("path").agg(F.count(F.lit(1)).alias("stored_rows"))
    return job.manifest(spark).join(stored, "path").select(
        *TP, "first_offset", "last_offset", "rows", "stored_rows", "bytes", "closed", "path"
    )


@query
def stream_bounded_poll(spark, sf):
    """The restored log polled in rounds of bounded size; the stream is restarted behind an append."""
    log, root = new_path(spark, "polled-log"), new_path(spark, "polled")
    index = PollIndex(spark, log, new_path(spark, "poll-index"), width=64)
    first = X.half_restored(spark, sf)
    rest = X.restored(spark, sf).join(first.select(*TP, "offset"), [*TP, "offset"], "left_anti")
    limit = X.restored(spark, sf).count() // 8 + 1

    def keep(rows, round_no):
        rows.write.mode("overwrite").parquet(f"{root}/rounds/round_no={round_no}")

    for part in (first, rest):
        S.write_topics(part, log, run=64)
        index.extend()
        drain(poll_log(spark, log, index.root, limit), f"{root}/checkpoint", keep)
    kept = spark.read.schema(T.StructType([*RECORD.fields, T.StructField("round_no", T.LongType())])).parquet(
        f"{root}/rounds"
    )
    sizes = kept.groupBy("round_no").agg((F.count(F.lit(1)) <= limit).alias("bounded"))
    return kept.join(sizes, "round_no").select(*TP, "offset", "timestamp", _str("value"), "bounded")


@query
def stream_idle_segments(spark, sf):
    """A watched archive job whose partitions fall idle after the log has ended; the watch is restarted."""
    size, feed = 4 * X.ROLL_BYTES, new_path(spark, "feed")
    job = J.ArchiveStream(new_path(spark, "stream"), size, poll_records=40, prefix=X.PREFIX, watch=True)
    root = new_path(spark, "watch")
    for number, part in enumerate(J.in_order(X.kept_records(spark, sf), "timestamp", 3)):
        S.write_feed(part, feed)
        job.run(S.stream_log(spark, feed))
        if number == 1:  # nothing is idle yet, the state is left to the second run
            awake = IdleWatch(root, job.root, idle_ms=10**12, max_age_ms=10**12, check_ms=10)
            awake.run_until(spark, lambda q: any(p["numInputRows"] for p in q.recentProgress), 300)
    held = spark.read.parquet(f"{job.root}/state/round_no=4").select(*TP).distinct().count()
    watch = IdleWatch(root, job.root, idle_ms=0, check_ms=10)
    last = spark.read.parquet(f"{job.root}/open/round_no=4").where("first_offset IS NOT NULL")
    place = [*TP, "first_offset", "last_offset"]
    watch.run_until(spark, lambda q: watch.reports(spark).join(last, place, "left_semi").count() == held, 300)
    job.flush(spark, only=watch.reports(spark))
    told = watch.reports(spark).select(*place, "reason").distinct()
    return job.manifest(spark).join(told, place, "left").select(
        *place, "rows", "bytes", "closed", "path", F.when(~F.col("closed"), F.col("reason")).alias("reason")
    )


@query
def stream_restart(spark, sf):
    """A job stopped after each part of the log, its last micro-batch run twice, then flushed twice."""
    feed = new_path(spark, "feed")
    size = 4 * X.ROLL_BYTES
    job = J.ArchiveStream(new_path(spark, "stream"), size, poll_records=40, prefix=X.PREFIX)
    for part in J.in_order(X.kept_records(spark, sf), "timestamp", 2):
        S.write_feed(part, feed)
        job.run(S.stream_log(spark, feed))
        job.repeat_last_batch(spark)
        job.flush(spark)
        job.drop_published_spool(spark)
    job.flush(spark)
    return job.archive(spark).select(*TP, "offset", _str("value"))


def _restore_in_rounds(spark, sf):
    feed, root = new_path(spark, "plan-feed"), new_path(spark, "archive")
    S.write_archive(X.archive(spark, sf).withColumnRenamed("file_offset", "segment"), root)
    job = J.RestoreStream(
        new_path(spark, "stream"),
        lambda files: S.read_archive(spark, root, X.PREFIX, files=files),
        topic_prefix=X.TOPIC_PREFIX,
    )
    for part in J.in_order(X.plan(spark, sf), "plan_seq", 4):
        S.write_feed(part, feed)
        job.run(J.plan_stream(spark, feed))
    return job


@query
def stream_restore(spark, sf):
    """Restore from a plan that arrives in several rounds."""
    job = _restore_in_rounds(spark, sf)
    return job.restored(spark).select(*TP, "offset", "source_offset", _str("value"))


@query
def restore_observed_progress(spark, sf):
    """What each round of a running restore reports."""
    return _restore_in_rounds(spark, sf).observed(spark)
