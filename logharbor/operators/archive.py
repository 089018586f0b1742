"""From log records to archived segments, and the state a stopped archive job leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.functions import headers as H
from logharbor.functions import paths as P
from logharbor.schemas import IDLE_THRESHOLD_MS, POLL_RECORDS, TP
from logharbor.shared import staged


def archive_rows(records: DataFrame) -> DataFrame:
    """Raw records (header list, timestamp) -> archive rows (header map, epoch ms)."""
    return records.withColumns(
        {"headers": H.collapse(F.col("headers")), "timestamp": F.unix_millis("timestamp")}
    )


def duplicate_headers(records: DataFrame) -> DataFrame:
    """Records whose header list repeats a key, of which the archive keeps the last value."""
    return records.where(H.has_repeats(F.col("headers")))


def raw_records(rows: DataFrame) -> DataFrame:
    """Archive rows -> raw records; headers come back as a list sorted by key."""
    return rows.withColumns(
        {"headers": H.as_list(F.col("headers")), "timestamp": F.timestamp_millis("timestamp")}
    )


def row_bytes() -> Column:
    """Logical size of an archive row: key, value and headers, uncompressed."""
    zero = F.lit(0)
    return (
        F.coalesce(F.octet_length("key"), zero)
        + F.coalesce(F.octet_length("value"), zero)
        + H.byte_size(F.col("headers"))
    ).cast("bigint")


def poll_batches(rows: DataFrame, poll_records: int = POLL_RECORDS) -> DataFrame:
    """One row per poll batch of a partition: rows, bytes, first and last offset.

    Rows may carry their own ``batch_no``; otherwise a batch is ``poll_records``
    consecutive offsets, which is repeatable and needs no sort.
    """
    if "batch_no" not in rows.columns:
        rows = rows.withColumn("batch_no", F.expr(f"offset div {int(poll_records)}"))
    return (
        rows.withColumn("_bytes", row_bytes())
        .groupBy(*TP, "batch_no")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("_bytes").alias("bytes"),
            F.min("offset").alias("first_offset"),
            F.max("offset").alias("last_offset"),
        )
    )


def segment_manifest(rolled: DataFrame, prefix: str = "", flush: bool = False) -> DataFrame:
    """One row per segment with its object path; open segments only with ``flush``."""
    segments = (
        rolled.groupBy(*TP, F.col("segment").alias("first_offset"))
        .agg(
            F.max("last_offset").alias("last_offset"),
            F.sum("rows").alias("rows"),
            F.sum("bytes").alias("bytes"),
            F.max("closes").alias("closed"),
        )
        .withColumn(
            "path", P.segment_path(prefix, F.col("topic"), F.col("partition"), F.col("first_offset"))
        )
    )
    return segments if flush else segments.where("closed")


def with_segments(rows: DataFrame, rolled: DataFrame, flush: bool = False) -> DataFrame:
    """Rows of published segments, each with the first offset of its segment."""
    if not flush:
        done = rolled.where("closes").select(*TP, "segment")
        rolled = rolled.join(done, [*TP, "segment"], "left_semi")
    return rows.join(rolled.select(*TP, "batch_no", "segment"), [*TP, "batch_no"])


def committed_offsets(manifest: DataFrame) -> DataFrame:
    """Next offset to read per partition: one past the last published record."""
    return manifest.groupBy(*TP).agg((F.max("last_offset") + 1).alias("committed"))


def open_rows(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows not yet in a published segment: what a restart reads again."""
    return (
        rows.join(staged(commits, "commits"), TP, "left")
        .where(F.col("offset") >= F.coalesce(F.col("committed"), F.lit(0)))
        .drop("committed")
    )


def idle_partitions(
    rows: DataFrame, as_of_ms: int | Column, threshold_ms: int = IDLE_THRESHOLD_MS
) -> DataFrame:
    """Partitions whose newest record is older than the threshold (strictly)."""
    as_of = as_of_ms if isinstance(as_of_ms, Column) else F.lit(as_of_ms)
    return (
        rows.groupBy(*TP)
        .agg(F.max("timestamp").alias("last_timestamp"))
        .withColumn("idle_ms", as_of - F.col("last_timestamp"))
        .where(F.col("idle_ms") > threshold_ms)
    )


def reconcile_segments(
    staged_segments: DataFrame,
    staged_rows: DataFrame,
    current: DataFrame,
    match: str = "current_offset",
) -> DataFrame:
    """Judge leftover staged segments against the next offset of their partition.

    ``staged_segments`` has topic, partition, first_offset; ``staged_rows`` has these and
    offset; ``current`` has topic, partition, current_offset.  Same first offset:
    ``overwrite``.  Higher: ``unexpected``.  Lower: ``superseded`` if the segment holds
    the current offset, else ``unexpected``.  ``match="first_offset"`` asks instead
    whether the segment holds its own first offset, i.e. is not empty.
    """
    if match not in ("current_offset", "first_offset"):
        raise ValueError("match must be current_offset or first_offset")
    current = staged(current, "current")
    judged = staged_segments.join(current, TP)
    segment = [*TP, "first_offset"]
    holding = (
        staged_rows.join(current, TP)
        .where(F.col("offset") == F.col(match))
        .groupBy(*segment)
        .agg(F.lit(True).alias("_holds"))
    )
    outcome = (
        F.when(F.col("first_offset") == F.col("current_offset"), "overwrite")
        .when(F.col("first_offset") > F.col("current_offset"), "unexpected")
        .when(F.col("_holds"), "superseded")
        .otherwise("unexpected")
    )
    return (
        judged.join(holding, segment, "left")
        .withColumn("outcome", outcome)
        .drop("_holds")
    )


def unexpected_leftovers(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(F.count_if(F.col("outcome") == "unexpected").alias("unexpected"))


def orphan_partitions(folders: DataFrame, assigned: DataFrame) -> DataFrame:
    """Staged (topic, partition folder) pairs that are not assigned; other folder names are ignored."""
    return (
        folders.withColumn(
            "partition",
            F.when(F.col("folder").rlike("^[+-]?[0-9]+$"), F.col("folder").try_cast("int")),
        )
        .where(F.col("partition").isNotNull())
        .join(assigned, TP, "left_anti")
        .select("topic", "partition", "folder")
    )
