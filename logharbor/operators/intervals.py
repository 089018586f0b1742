"""Sets of log positions as sorted runs, with union and difference.

One tip per partition stands for everything below it only while nothing below it is lost.  Runs
(``first``, ``last``, both inside) say what is really there, in one row per stretch without a
gap.  All steps cut partitions into blocks of positions, so a hot one is dealt to many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.operators.positional import BLOCK, block_start, neighbour, number_rows, running_before
from logharbor.schemas import TP
from logharbor.shared import staged

RUN = [*TP, "first", "last"]


def runs_of(log: DataFrame, pos: str, width: int = BLOCK) -> DataFrame:
    """Maximal runs of consecutive positions of each partition; repeated positions count once."""
    points = log.select(*TP, F.col(pos).alias("at")).distinct()
    numbered = number_rows(staged(points, "points"), TP, "at", "number", width=width)
    # along a run, position and number rise together
    return (
        numbered.groupBy(*TP, (F.col("at") - F.col("number")).alias("run"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .select(*RUN)
    )


def _stretches(parts: dict[str, DataFrame], keep: Column, width: int) -> DataFrame:
    """Runs of positions where ``keep`` holds, an expression over how many runs of each part
    cover them."""

    def edges(name: str, runs: DataFrame) -> DataFrame:
        step = lambda at, by: F.struct(at.alias("at"), F.lit(by).cast("bigint").alias("by"))
        both = F.explode(F.array(step(F.col("first"), 1), step(F.col("last") + 1, -1))).alias("e")
        counts = (F.col("e.by") if n == name else F.lit(0).cast("bigint") for n in parts)
        named = (c.alias(n) for c, n in zip(counts, parts, strict=True))
        return runs.select(*TP, both).select(*TP, F.col("e.at").alias("at"), *named)

    every = None
    for name, runs in parts.items():
        every = edges(name, runs) if every is None else every.unionByName(edges(name, runs))
    points = staged(every.groupBy(*TP, "at").agg(*(F.sum(n).alias(n) for n in parts)), "edges")
    for name in parts:
        points = staged(running_before(points, TP, "at", name, "sum", f"{name}_before", width=width), "covered")
    points = points.select(
        *TP, "at", *((F.coalesce(f"{n}_before", F.lit(0)) + F.col(n)).alias(n) for n in parts)
    )
    marked = points.select(*TP, "at", keep.alias("inside"))
    # only where it changes, so that runs that touch become one
    marked = neighbour(marked, TP, "at", "inside", "earlier", following=False, width=width)
    turns = marked.where(F.col("inside") != F.coalesce("earlier", F.lit(False))).select(*TP, "at", "inside")
    turns = staged(turns, "turns")
    ended = neighbour(turns, TP, "at", "at", "end", following=True, width=width)
    return ended.where("inside").select(*TP, F.col("at").alias("first"), (F.col("end") - 1).alias("last"))


def difference(left: DataFrame, right: DataFrame, width: int = BLOCK) -> DataFrame:
    """Runs of the positions of ``left`` that are not in ``right``."""
    return _stretches({"l": left, "r": right}, (F.col("l") > 0) & (F.col("r") == 0), width)


def union(left: DataFrame, right: DataFrame, width: int = BLOCK) -> DataFrame:
    """Runs of the positions of either; touching runs become one."""
    return _stretches({"l": left, "r": right}, (F.col("l") > 0) | (F.col("r") > 0), width)


def rows_within(log: DataFrame, runs: DataFrame, pos: str, width: int = BLOCK) -> DataFrame:
    """Rows of a log whose position lies in one of the runs, which must not overlap.

    Runs are cut at blocks, so rows and runs meet by topic, partition and block.
    """
    starts = F.sequence(block_start(F.col("first"), width), block_start(F.col("last"), width), F.lit(width).cast("bigint"))
    cut = runs.select(*RUN, F.explode(starts).alias("_block"))
    return (
        log.withColumn("_block", block_start(F.col(pos), width))
        .join(cut, [*TP, "_block"])
        .where(F.col(pos).between(F.col("first"), F.col("last")))
        .select(*log.columns)
    )
