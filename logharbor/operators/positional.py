"""Positional operators that keep hot partitions spread over many tasks.

A window over a whole log partition would sort that partition in a single task,
and one partition may hold a third of all rows.  Positions are numbers, so each
partition is cut into blocks of ``width`` positions.  Since a position occurs once
per key (ties only where the caller's data repeats it), a block holds at most
``width`` rows.  Every operator then works in two levels:

* one row per block, map-side combined, scanned in order per key - ``width`` times
  fewer rows than the data;
* a window inside each block, shuffled by key **and** block.

Results are exact; blocks never change what is computed.  Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 1 << 17


def block_start(pos: Column, width: int = BLOCK) -> Column:
    return pos - pos % F.lit(width)


def _earlier(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    out: str,
    ties: Sequence[str] = (),
    width: int = BLOCK,
) -> DataFrame:
    """Add the 0-based rank of each row in its key, ordered by ``pos`` and then ``ties``."""
    cut = df.withColumn("_cut", block_start(F.col(pos), width))
    group = [*keys, "_cut"]
    before = (
        cut.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(_earlier(keys, ["_cut"])), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(W.partitionBy(*group).orderBy(pos, *ties))
    return (
        cut.withColumn("_inside", inside)
        .join(before, group)
        .withColumn(out, (F.col("_before") + F.col("_inside") - 1).cast("bigint"))
        .drop("_cut", "_before", "_inside")
    )


def _combine(how: str, column: str) -> Column:
    return {"sum": F.sum, "max": F.max}[how](column)


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    how: str,
    out: str,
    ties: Sequence[str] = (),
    width: int = BLOCK,
) -> DataFrame:
    """Add sum or max of ``value`` over all earlier rows of the key; null when there are none."""
    cut = df.withColumn("_cut", block_start(F.col(pos), width))
    group = [*keys, "_cut"]
    before = (
        cut.groupBy(*group)
        .agg(_combine(how, value).alias("_total"))
        .withColumn("_before", _combine(how, "_total").over(_earlier(keys, ["_cut"])))
        .drop("_total")
    )
    inside = _combine(how, value).over(_earlier(group, [pos, *ties]))
    joined = cut.withColumn("_inside", inside).join(before, group)
    if how == "max":
        total = F.greatest("_before", "_inside")
    else:
        total = F.coalesce(F.col("_before") + F.col("_inside"), F.col("_before"), F.col("_inside"))
    return joined.withColumn(out, total).drop("_cut", "_before", "_inside")


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    out: str,
    following: bool,
    width: int = BLOCK,
) -> DataFrame:
    """Add ``value`` of the next (``following``) or previous row of the key; null at the ends."""
    cut = df.withColumn("_cut", block_start(F.col(pos), width))
    group = [*keys, "_cut"]
    blocks = W.partitionBy(*keys).orderBy("_cut")
    rows = W.partitionBy(*group).orderBy(pos)
    edge = cut.groupBy(*group).agg(
        (F.min_by(value, pos) if following else F.max_by(value, pos)).alias("_edge")
    )
    shift = F.lead if following else F.lag
    edge = edge.withColumn("_beyond", shift("_edge").over(blocks)).drop("_edge")
    return (
        cut.withColumn("_at_edge", shift(F.lit(1)).over(rows).isNull())
        .withColumn("_near", shift(value).over(rows))
        .join(edge, group)
        .withColumn(out, F.when(F.col("_at_edge"), F.col("_beyond")).otherwise(F.col("_near")))
        .drop("_cut", "_at_edge", "_near", "_beyond")
    )
