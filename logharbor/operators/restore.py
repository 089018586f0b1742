"""Replaying archived segments into topics without restoring anything twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logharbor.functions import headers as H
from logharbor.functions import paths as P
from logharbor.functions.text import matches_any, regex_list
from logharbor.operators.intervals import rows_within
from logharbor.operators.positional import BLOCK, block_start, running_before
from logharbor.schemas import SOURCE_OFFSET_HEADER, TP
from logharbor.shared import staged, staged_split


def scan_topics(records: DataFrame, include: str, exclude: str = "") -> DataFrame:
    """Records of topics found by an include and by no exclude regex."""
    name = F.col("topic")
    return records.where(
        matches_any(name, regex_list(include)) & ~matches_any(name, regex_list(exclude))
    )


def partition_watermarks(log: DataFrame) -> DataFrame:
    """First offset and next offset of every non-empty partition."""
    return log.groupBy(*TP).agg(
        F.min("offset").alias("start_offset"), (F.max("offset") + 1).alias("end_offset")
    )


def latest_records(log: DataFrame, partitions: Sequence[int] = ()) -> DataFrame:
    """Newest record of each (selected) non-empty partition.

    The newest offsets come from a pass over three narrow columns; the records are
    then picked by an equality join, so payloads are neither sorted nor aggregated.
    """
    if partitions:
        log = log.where(F.col("partition").isin(list(partitions)))
    tips = staged(log.groupBy(*TP).agg(F.max("offset").alias("offset")), "tips")
    return log.join(tips, [*TP, "offset"])


def source_offsets(log: DataFrame) -> DataFrame:
    """Add ``source_offset`` from the header unless the log has it as a column already."""
    if "source_offset" in log.columns:
        return log
    return log.withColumn("source_offset", H.source_offset(F.col("headers")))


def stamp_source_offset(rows: DataFrame) -> DataFrame:
    return rows.withColumn("headers", H.stamp(F.col("headers"), F.col("offset")))


def exclude_files(plan: DataFrame, exclude: str = "") -> DataFrame:
    """Plan records whose topic, taken from the path, matches no exclude regex."""
    topic = P.part_from_end(F.col("value"), 3)
    return plan.where(~F.coalesce(matches_any(topic, regex_list(exclude)), F.lit(False)))


def planned_partitions(plan: DataFrame, topic_prefix: str = "", exclude: str = "") -> DataFrame:
    """Target partitions a plan writes to, under their restored names."""
    return (
        planned_files(exclude_files(plan, exclude), strict=False)
        .where(F.col("partition").isNotNull())
        .select(F.concat(F.lit(topic_prefix), F.col("topic")).alias("topic"), "partition")
        .distinct()
    )


def planned_target(
    target: DataFrame, plan: DataFrame, topic_prefix: str = "", exclude: str = ""
) -> DataFrame:
    """The part of a target log that lies in partitions the plan writes to."""
    wanted = staged(planned_partitions(plan, topic_prefix, exclude), "planned-partitions")
    return target.join(wanted, TP, "left_semi")


def existing_data_violations(target: DataFrame) -> DataFrame:
    """Newest records of target partitions that no restore has written."""
    return latest_records(target).where(~F.map_contains_key("headers", SOURCE_OFFSET_HEADER))


def target_progress(target: DataFrame) -> DataFrame:
    """Per target partition: source offset of its newest record (-1 without header) and next offset.

    Only the newest records' headers are read, so an older bad one does no harm.
    """
    return source_offsets(latest_records(target)).select(
        *TP,
        F.col("source_offset").alias("last_source_offset"),
        (F.col("offset") + 1).alias("next_offset"),
    )


def last_restored_offset(files: DataFrame, progress: DataFrame | None, topic_prefix: str = "") -> DataFrame:
    """Per (topic, partition) of the planned files: last restored source offset, -1 if none."""
    wanted = files.select(*TP).distinct()
    if progress is None:
        return wanted.select(
            *TP,
            F.lit(-1).cast("bigint").alias("last_source_offset"),
            F.lit(0).cast("bigint").alias("next_offset"),
        )
    known = progress.select(
        F.col("topic").alias("_target"), "partition", "last_source_offset", "next_offset"
    )
    return (
        wanted.withColumn("_target", F.concat(F.lit(topic_prefix), F.col("topic")))
        .join(known, ["_target", "partition"], "left")
        .select(
            *TP,
            F.coalesce("last_source_offset", F.lit(-1)).alias("last_source_offset"),
            F.coalesce("next_offset", F.lit(0)).alias("next_offset"),
        )
    )


def planned_files(plan: DataFrame, strict: bool = True) -> DataFrame:
    """Each planned file once, at its first place in the plan, with a numeric partition.

    A partition folder that is no number raises, or gives null without ``strict``.
    """
    partition = P.part_from_end(F.col("path"), 2)
    return (
        plan.groupBy(F.col("value").alias("path"))
        .agg(F.min("plan_seq").alias("plan_seq"))
        .withColumn("topic", P.part_from_end(F.col("path"), 3))
        .withColumn("partition", partition.cast("int") if strict else partition.try_cast("int"))
    )


def missing_files(
    plan: DataFrame, present: DataFrame, exclude: str = ""
) -> DataFrame:
    """Planned files that cannot be read: path, plan_seq and whether the path is bad or absent.

    ``present`` has the paths that exist: a listing or manifest, or the rows of the
    archive, where a file without rows counts as absent.
    """
    path = F.col("path")
    good = P.is_parseable(path) & F.col("partition").isNotNull() & (P.offset_in_name(path) >= 0)
    there = present.select(path.alias("_present")).distinct()
    return (
        planned_files(exclude_files(plan, exclude), strict=False)
        .withColumn("good", F.coalesce(good, F.lit(False)))
        .join(there, path == F.col("_present"), "left")
        .where(~F.col("good") | F.col("_present").isNull())
        .select("path", "plan_seq", F.when(F.col("good"), "absent").otherwise("bad path").alias("reason"))
    )


def planned_blocks(plan: DataFrame, archive: DataFrame, width: int = BLOCK) -> DataFrame:
    """Per planned file and block of its offsets: rows, first and last offset.

    Reads two narrow columns of the archive.  Rows are counted before they meet the plan, so
    however long that is, what is shuffled is a row per block and task.
    """
    return (
        archive.groupBy("path", block_start(F.col("offset"), width).alias("_block"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("offset").alias("first"),
            F.max("offset").alias("last"),
        )
        .join(planned_files(plan), "path")
    )


def file_floors(
    blocks: DataFrame, progress: DataFrame | None = None, topic_prefix: str = ""
) -> DataFrame:
    """Per planned file the offset its rows must exceed to be restored, and where its partition goes on.

    The floor is the greatest offset of all files before it in the plan, or of the last
    restored record.  Decided on one row per file.
    """
    files = blocks.groupBy("path", *TP, "plan_seq").agg(F.max("last").alias("file_last"))
    floors = running_before(files, TP, "plan_seq", "file_last", "max", "_earlier")
    if progress is None:
        last, following = F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")
    else:
        restored = staged(last_restored_offset(blocks, progress, topic_prefix), "restored")
        floors = floors.join(restored, TP)
        last, following = F.col("last_source_offset"), F.col("next_offset")
    return floors.select(
        "path", F.greatest("_earlier", last).alias("floor"), following.alias("next_offset")
    )


def _placed_blocks(
    plan: DataFrame,
    archive: DataFrame,
    progress: DataFrame | None,
    topic_prefix: str,
    width: int,
) -> tuple[DataFrame, DataFrame]:
    """All planned blocks; and of those that keep rows the floor and the target offset of the first.

    How many rows a block keeps follows from its statistics, except where the floor
    lies inside the block; only those are counted on the rows.
    """
    planned = staged(planned_blocks(plan, archive, width), "planned-blocks")
    floors = file_floors(planned, progress, topic_prefix)
    whole, cut = staged_split(
        planned.join(floors, "path")
        .where(F.col("last") > F.col("floor"))
        .withColumn("cut", F.col("first") <= F.col("floor")),
        "kept-blocks",
        "cut",
    )
    kept = whole.withColumn("kept", F.col("rows"))
    if cut is not None:
        counted = (
            archive.select("path", "offset", block_start(F.col("offset"), width).alias("_block"))
            .join(cut.select("path", "_block", "floor"), ["path", "_block"])
            .where(F.col("offset") > F.col("floor"))
            .groupBy("path", "_block")
            .agg(F.count(F.lit(1)).alias("kept"))
        )
        kept = staged(kept.unionByName(cut.join(counted, ["path", "_block"])), "counted-blocks")
    placed = running_before(kept, TP, "plan_seq", "kept", "sum", "_earlier", ties=["_block"]).select(
        "path",
        "_block",
        "floor",
        "kept",
        (F.col("next_offset") + F.coalesce("_earlier", F.lit(0))).cast("bigint").alias("_at"),
    )
    return planned, placed


def restore_rows(
    plan: DataFrame,
    archive: DataFrame,
    progress: DataFrame | None = None,
    topic_prefix: str = "",
    exclude: str = "",
    width: int = BLOCK,
) -> DataFrame:
    """Rows the plan restores, renamed and stamped, with the offsets they get in the target.

    ``archive`` holds archive rows and the ``path`` of their file; ``progress`` is
    :func:`target_progress` of the target, absent for a fresh one.  The rows travel
    once, shuffled by file and offset block, which serves both the lookup of the
    floor and the numbering and keeps any file or partition spread out.
    """
    # what the plan leaves out stays behind at the scan
    if exclude:
        left_out = matches_any(P.part_from_end(F.col("path"), 3), regex_list(exclude))
        archive = archive.where(~F.coalesce(left_out, F.lit(False)))
    archive = archive.withColumn("_block", block_start(F.col("offset"), width))
    _, placed = _placed_blocks(exclude_files(plan, exclude), archive, progress, topic_prefix, width)
    order = W.partitionBy("path", "_block").orderBy("offset", "timestamp", "key", "value")
    return (
        archive.join(placed, ["path", "_block"])
        .where(F.col("offset") > F.col("floor"))
        .withColumn("_target", F.col("_at") + F.row_number().over(order) - 1)
        .select(
            F.concat(F.lit(topic_prefix), F.col("topic")).alias("topic"),
            "partition",
            F.col("_target").cast("bigint").alias("offset"),
            "timestamp",
            "key",
            "value",
            H.stamp(F.col("headers"), F.col("offset")).alias("headers"),
            F.col("offset").alias("source_offset"),
            "path",
        )
    )


def fill_ranges(
    plan: DataFrame,
    archive: DataFrame,
    lost: DataFrame,
    target: DataFrame,
    topic_prefix: str = "",
    exclude: str = "",
    width: int = BLOCK,
) -> DataFrame:
    """Rows that fill what a target has lost below its tips, numbered behind them.

    ``lost`` has runs (topic, partition, first, last) of source offsets under the archive's topic
    names, as ``intervals.difference`` finds them.  Only archive rows inside a run take part.
    """
    tips = target_progress(target).withColumn("last_source_offset", F.lit(-1).cast("bigint"))
    inside = rows_within(archive, lost, "offset", width)
    return restore_rows(plan, inside, staged(tips, "tips"), topic_prefix, exclude, width)


def skipped_rows(
    plan: DataFrame,
    archive: DataFrame,
    progress: DataFrame | None = None,
    topic_prefix: str = "",
    width: int = BLOCK,
) -> DataFrame:
    """Per planned file: rows read, restored and left out as late or repeated."""
    planned, placed = _placed_blocks(plan, archive, progress, topic_prefix, width)
    kept = placed.groupBy("path").agg(F.sum("kept").alias("kept"))
    return (
        planned.groupBy("path")
        .agg(F.sum("rows").alias("rows"))
        .join(kept, "path", "left")
        .select(
            "path",
            "rows",
            F.coalesce("kept", F.lit(0)).alias("restored"),
            (F.col("rows") - F.coalesce("kept", F.lit(0))).alias("skipped"),
        )
    )


def restore_progress(restored: DataFrame) -> DataFrame:
    """Last source offset and next target offset per target partition."""
    return restored.groupBy(*TP).agg(
        F.max("source_offset").alias("last_source_offset"),
        (F.max("offset") + 1).alias("next_offset"),
    )


def file_progress(plan_seen: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Newest file index seen per partition; records without a numeric index are ignored.

    ``plan_seen`` holds the plan records handled so far, with ``file_index`` as text or
    number.  With ``totals`` (topic, partition, files) the share done is added.
    """
    index = F.col("file_index").cast("string")
    number = F.when(index.rlike("^[+-]?[0-9]+$"), index.try_cast("bigint"))
    seen = (
        plan_seen.withColumn("_index", number)
        .where(F.col("_index").isNotNull())
        .groupBy("topic", "partition", "topics_sha")
        .agg(F.max_by("_index", "plan_seq").alias("file_index"))
    )
    if totals is None:
        return seen
    return seen.join(totals.select("topic", "partition", "files"), ["topic", "partition"]).withColumn(
        "percent_done", F.expr("file_index * 100 div files")
    )
