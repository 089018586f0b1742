"""First log position at or after a wanted one, per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logharbor.operators.positional import BLOCK, block_start
from logharbor.schemas import TP
from logharbor.shared import staged


def first_at_or_after(
    points: DataFrame,
    wanted: DataFrame,
    pos: str,
    value: str,
    target: str,
    blocks: DataFrame | None = None,
    width: int = BLOCK,
) -> DataFrame:
    """For each distinct (topic, partition, target): the least ``pos >= target`` and its least value.

    No wanted row meets a log row in a join.  Log and wanted positions are cut into
    blocks; a window inside a wanted block answers where the block holds a match, and
    one row per block tells where the log goes on otherwise.  Only blocks that hold a
    wanted position leave the scan.  ``value`` must not fall as ``pos`` rises, as offsets
    do not along a restored log.  ``blocks`` (topic, partition, _block, _pos, _value) may
    pass in the per-block least position and value when the caller has them.
    """
    group = [*TP, "_block"]
    wanted = (
        wanted.select(*TP, F.col(target).alias("_pos"))
        .distinct()
        .withColumn("_block", block_start(F.greatest(F.col("_pos"), F.lit(0)), width))
    )
    points = points.select(*TP, F.col(pos).alias("_pos"), F.col(value).alias("_value")).withColumn(
        "_block", block_start(F.col("_pos"), width)
    )
    if blocks is None:
        blocks = points.groupBy(*group).agg(
            F.min("_pos").alias("_pos"), F.min("_value").alias("_value")
        )
    touched = staged(wanted.select(*group).distinct(), "wanted-blocks")
    # the next block that holds anything, for each wanted block
    after = W.partitionBy(*TP).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    marked = (
        blocks.select(*group, "_pos", "_value", F.lit(False).alias("_wanted"))
        .unionByName(
            touched.select(
                *group,
                F.lit(None).cast("bigint").alias("_pos"),
                F.lit(None).cast("bigint").alias("_value"),
                F.lit(True).alias("_wanted"),
            )
        )
        .groupBy(*group)
        .agg(F.max("_pos").alias("_pos"), F.max("_value").alias("_value"), F.max("_wanted").alias("_wanted"))
    )
    beyond = (
        marked.withColumn("_next_pos", F.last("_pos", ignorenulls=True).over(after))
        .withColumn("_next_value", F.last("_value", ignorenulls=True).over(after))
        .where("_wanted")
        .select(*group, "_next_pos", "_next_value")
    )
    inside = (
        points.join(touched, group, "left_semi")
        .groupBy(*group, "_pos")
        .agg(F.min("_value").alias("_value"))
        .withColumn("_found", F.col("_pos"))
        .withColumn("_asked", F.lit(0))
    )
    asked = wanted.select(
        *group,
        "_pos",
        F.lit(None).cast("bigint").alias("_value"),
        F.lit(None).cast("bigint").alias("_found"),
        F.lit(1).alias("_asked"),
    )
    onwards = (
        W.partitionBy(*group)
        .orderBy(F.desc("_pos"), "_asked")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        inside.unionByName(asked)
        .withColumn("_found", F.last("_found", ignorenulls=True).over(onwards))
        .withColumn("_value", F.last("_value", ignorenulls=True).over(onwards))
        .where(F.col("_asked") == 1)
        .join(beyond, group)
        .select(
            *TP,
            F.col("_pos").alias(target),
            F.coalesce("_found", "_next_pos").alias("found_pos"),
            F.coalesce("_value", "_next_value").alias("found_value"),
        )
    )


def record_at_offset(log: DataFrame, wanted: DataFrame, width: int = BLOCK) -> DataFrame:
    """First record at or after ``start_offset`` for each (topic, partition, start_offset)."""
    hits = first_at_or_after(log, wanted, "offset", "offset", "start_offset", width=width)
    hits = staged(
        hits.where(F.col("found_pos").isNotNull()).select(
            *TP, "start_offset", F.col("found_pos").alias("offset")
        ),
        "hits",
    )
    return log.join(hits, [*TP, "offset"])
