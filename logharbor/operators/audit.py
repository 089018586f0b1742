"""Checks of archives and restored logs; each returns the offending rows or counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.functions import headers as H
from logharbor.functions import paths as P
from logharbor.operators.positional import BLOCK, block_start, neighbour, running_before
from logharbor.operators.restore import source_offsets
from logharbor.schemas import TP
from logharbor.shared import staged


def rows_per_file(archive: DataFrame) -> DataFrame:
    return archive.groupBy("path").agg(F.count(F.lit(1)).alias("rows"))


def path_mismatches(archive: DataFrame) -> DataFrame:
    """Files with rows of another topic or partition than their path says.

    Exclusion and progress go by the path, the target topic by the row, so they should agree.
    """
    agrees = (P.part_from_end(F.col("path"), 3) == F.col("topic")) & (
        P.part_from_end(F.col("path"), 2) == F.col("partition").cast("string")
    )
    return (
        archive.where(~F.coalesce(agrees, F.lit(False)))
        .groupBy("path", *TP)
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def segment_overlaps(files: DataFrame, width: int = BLOCK) -> DataFrame:
    """Files holding offsets that an earlier-named file reaches too.

    ``files`` has path, topic, partition, file_offset (from the name), first_offset, last_offset.
    """
    reach = running_before(
        files, TP, "file_offset", "last_offset", "max", "earlier_last", width=width
    )
    return reach.where(F.col("earlier_last") >= F.col("first_offset"))


def offset_gaps(rows: DataFrame, width: int = BLOCK) -> DataFrame:
    """Places where the next offset of the partition is not the following number."""
    narrow = rows.select(*TP, "offset")
    return (
        neighbour(narrow, TP, "offset", "offset", "next_offset", following=True, width=width)
        .where(F.col("next_offset") - F.col("offset") > 1)
        .withColumn("missing", F.col("next_offset") - F.col("offset") - 1)
    )


def restore_duplicates(restored: DataFrame) -> DataFrame:
    """Source offsets that occur more than once in a target partition.

    Offsets are first marked in bitmaps, one per bucket of consecutive offsets and built
    map-side, so little travels.  Only buckets with more rows than marked offsets are
    counted offset by offset.
    """
    marked = source_offsets(restored).where(F.col("source_offset") >= 0).select(*TP, "source_offset")
    marked = marked.withColumn("_bucket", F.bitmap_bucket_number("source_offset"))
    bucket = [*TP, "_bucket"]
    suspect = staged(
        marked.groupBy(*bucket)
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("source_offset"))).alias("_offsets"),
        )
        .where(F.col("_rows") > F.col("_offsets"))
        .select(*bucket),
        "suspect-buckets",
    )
    return (
        marked.join(suspect, bucket, "left_semi")
        .groupBy(*TP, "source_offset")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def restore_count_diff(source: DataFrame, restored: DataFrame, topic_prefix: str = "") -> DataFrame:
    """Partitions whose row counts differ between the source log and the restored log."""
    expected = source.groupBy(F.concat(F.lit(topic_prefix), "topic").alias("topic"), "partition").agg(
        F.count(F.lit(1)).alias("source_rows")
    )
    actual = restored.groupBy(*TP).agg(F.count(F.lit(1)).alias("restored_rows"))
    return (
        expected.join(actual, TP, "full_outer")
        .select(
            *TP,
            F.coalesce("source_rows", F.lit(0)).alias("source_rows"),
            F.coalesce("restored_rows", F.lit(0)).alias("restored_rows"),
        )
        .where(F.col("source_rows") != F.col("restored_rows"))
    )


def content_words() -> list[Column]:
    """Two 64-bit words standing for source offset, time, key, value and headers of a row.

    The restore stamp does not count.  Nulls are told apart from empty values.
    """
    parts = [
        F.col("source_offset"),
        F.col("timestamp"),
        F.col("key").isNull(),
        F.col("key"),
        F.col("value").isNull(),
        F.col("value"),
        H.as_list(H.without_stamp(F.col("headers"))),
    ]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def halves(word: str) -> list[Column]:
    """The two 32-bit halves of a word, to be added up without overflow."""
    return [F.col(word).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(word, 32)]


def _block_prints(rows: DataFrame) -> DataFrame:
    """Row count and order-free fingerprint of each block of source offsets, built map-side."""
    words = rows.select(*TP, "_block", *[w.alias(f"_w{i}") for i, w in enumerate(content_words())])
    return words.groupBy(*TP, "_block").agg(
        F.struct(F.count(F.lit(1)), *[F.sum(half) for half in halves("_w0") + halves("_w1")]).alias("_print")
    )


def restore_content_diff(
    source: DataFrame, restored: DataFrame, topic_prefix: str = "", width: int = BLOCK
) -> DataFrame:
    """Source offsets whose restored content differs or which one side has more often.

    First the two logs are compared by one fingerprint per block of offsets, so nothing
    but these travels where they agree.  Rows of the other blocks are compared by the
    128-bit digests that occur at each offset.
    """
    block = block_start(F.col("source_offset"), width).alias("_block")
    content = ["timestamp", "key", "value", "headers"]
    left = source.select(
        F.concat(F.lit(topic_prefix), "topic").alias("topic"),
        "partition",
        F.col("offset").alias("source_offset"),
        *content,
    ).select("*", block)
    right = source_offsets(restored).select(*TP, "source_offset", *content).select("*", block)
    group = [*TP, "_block"]
    expected = _block_prints(left).withColumnRenamed("_print", "_expected")
    actual = _block_prints(right).withColumnRenamed("_print", "_actual")
    differing = staged(
        expected.join(actual, group, "full_outer")
        .where(~F.col("_expected").eqNullSafe(F.col("_actual")))
        .select(*group),
        "differing-blocks",
    )

    return differing_contents(left, right, differing)


def differing_contents(left: DataFrame, right: DataFrame, differing: DataFrame) -> DataFrame:
    """Source offsets of the ``differing`` blocks (topic, partition, _block) whose contents differ.

    Both sides have topic, partition, source_offset, _block and the content columns.
    """
    group = [*TP, "_block"]

    def contents(side: DataFrame, weight: int) -> DataFrame:
        first, second = content_words()
        return side.join(differing, group, "left_semi").select(
            *TP, "source_offset", first.alias("_w0"), second.alias("_w1"), F.lit(weight).alias("_weight")
        )

    # contents that occur more often on one side; no row is paired with another
    surplus = (
        contents(left, 1)
        .unionByName(contents(right, -1))
        .groupBy(*TP, "source_offset", "_w0", "_w1")
        .agg(F.sum("_weight").alias("_surplus"))
        .where(F.col("_surplus") != 0)
    )
    lacks, has_more = F.max("_surplus") > 0, F.min("_surplus") < 0
    verdict = F.when(lacks & has_more, "changed").when(lacks, "missing").otherwise("extra")
    return surplus.groupBy(*TP, "source_offset").agg(verdict.alias("verdict"))


def restore_order_violations(restored: DataFrame, width: int = BLOCK) -> DataFrame:
    """Rows whose source offset does not exceed that of the row before them."""
    narrow = source_offsets(restored).select(*TP, "offset", "source_offset")
    return neighbour(
        narrow, TP, "offset", "source_offset", "previous_source", following=False, width=width
    ).where(F.col("source_offset") <= F.col("previous_source"))


def group_lag(offsets: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Records each group still has to read per partition."""
    return (
        offsets.where(F.col("offset") >= 0)
        .join(watermarks.select(*TP, "end_offset"), TP)
        .withColumn("lag", F.col("end_offset") - F.col("offset"))
    )
