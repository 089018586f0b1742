"""Mixing sources to target weights by Pareto order sampling.

Sources share ``factor`` times the size of all documents by weight; a source stops at
``ceiling`` times its own size and what it leaves is shared again.  The share per weight
rises from round to round, so each round is one sum over the source table and only that
number moves to the driver.

Inside a source every document gets the whole copies that are certain, and the rest of
the target is filled in Pareto order: documents are ranked by random odds divided by
their inclusion odds and taken from the front while that brings the words nearer to the
target.  Each row has random odds of its own, from a hash of seed, id, text and its number
among the rows that share both; as such rows are alike, reruns agree.  Ranks are running
sums over blocks of rank positions, never a window over a whole source, and equal rows
are numbered where they lie, behind a count per task.

Inclusion odds within a source follow ``weight``, a column of the documents; by default
all documents of a source share the same odds.

Defined results: a null text has size 0; null sources are one source, ordered last;
sources without words have target 0; rows that share an id, or have none, are drawn one by
one.  An empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logharbor.llm.common import column_or_null, staged, table
from logharbor.operators.positional import running_before

#: The contract's weights, share and ceiling.
WEIGHTS = (5.0, 2.0, 1.0)
FACTOR = 1.5
CEILING = 2.0

_PLACES = 1 << 52
_BLOCK = 1 << 40


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last, without sorting in one task.

    The table is dealt by ranges; partition counts, as many as there are partitions, give
    each partition its first number.
    """
    parts = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = (F.col("source").isNull(), F.col("source"))
    dealt = sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = staged(
        dealt.withColumn("part", F.spark_partition_id()).withColumn(
            "place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ),
        "sources",
    )
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return placed.join(first, "part").select(
        "source", "source_size", (F.col("first") + F.col("place")).alias("rank")
    )


def share_out(items: DataFrame, amount: float) -> float:
    """Level at which the sum of least(cap, weight * level) over ``items`` is ``amount``.

    The level only rises, as capped items leave the open weight to the others.
    """
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * level
        row = items.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(full, 1)),
        ).first()
        if row[2] == capped or not row[1]:
            return level
        level, capped = max(level, (amount - row[0]) / row[1]), row[2]


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...], factor: float, ceiling: float
) -> DataFrame:
    """source, source_size, its number and its target."""
    weight: Column = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.col("rank") % len(weights) == i, F.lit(w)).otherwise(weight)
    sources = staged(
        ranked_sources(sizes)
        .withColumn("weight", weight)
        .withColumn("cap", ceiling * F.col("source_size")),
        "source-weights",
    )
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = share_out(sources, factor * total)
    return sources.select(
        "source",
        "source_size",
        "rank",
        F.least(F.col("cap"), F.col("weight") * F.lit(level)).cast("double").alias("target"),
    )


def _document_levels(docs: DataFrame, ceiling: float) -> DataFrame:
    """Add each source's level: copies expected of a document are least(ceiling, weight * level)."""
    level = docs.select("rank").distinct().select("rank", F.lit(0.0).alias("level"))
    capped = -1
    while True:
        full = F.col("weight") * F.col("level") >= ceiling
        sums = staged(
            docs.join(level, "rank")
            .groupBy("rank")
            .agg(
                F.first("target").alias("target"),
                F.max("level").alias("old"),
                F.coalesce(F.sum(F.when(full, ceiling * F.col("size"))), F.lit(0.0)).alias("fixed"),
                F.coalesce(
                    F.sum(F.when(~full, F.col("weight") * F.col("size"))), F.lit(0.0)
                ).alias("open"),
                F.count(F.when(full, 1)).alias("capped"),
            ),
            "levels",
        )
        now = sums.agg(F.coalesce(F.sum("capped"), F.lit(0))).first()[0]
        rise = F.when(F.col("open") > 0, (F.col("target") - F.col("fixed")) / F.col("open"))
        level = sums.select("rank", F.greatest("old", F.coalesce(rise, "old")).alias("level"))
        if now == capped:
            return docs.join(level, "rank")
        capped = now


def with_numbers(rows: DataFrame) -> DataFrame:
    """Add ``number``, the 0-based number of each row among those with its ``key``.

    Only rows whose key is repeated are dealt anew: by key and by the task they were read in,
    so a key that many rows share is numbered in many tasks.
    """
    repeated = staged(
        rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated"
    )
    zero = F.lit(0).cast("bigint")
    if repeated.isEmpty():
        return rows.withColumn("number", zero)
    part = F.struct(
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
    )
    several = staged(
        rows.join(repeated, "key", "left_semi").withColumn("numbering", part), "repeated-rows"
    )
    of_part = [F.col("key"), F.col("numbering.part")]
    earlier = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = (
        several.groupBy(*of_part)
        .agg(F.count(F.lit(1)).alias("n"))
        .select("key", "part", F.coalesce(F.sum("n").over(earlier), zero).alias("before"))
    )
    inside = F.row_number().over(W.partitionBy(*of_part).orderBy("numbering.at"))
    numbered = (
        several.withColumn("inside", inside)
        .withColumn("part", F.col("numbering.part"))
        .join(staged(before, "numbered-parts"), ["key", "part"])
        .select(*rows.columns, (F.col("before") + F.col("inside") - 1).alias("number"))
    )
    return (
        rows.join(repeated, "key", "left_anti").withColumn("number", zero).unionByName(numbered)
    )


def _key(docs: DataFrame) -> Column:
    """What equal rows share."""
    doc_id = column_or_null(docs, "doc_id", "bigint")
    text = column_or_null(docs, "text", "string")
    return F.xxhash64(doc_id.isNull(), doc_id, text.isNull(), text)


def _drawn(rows: DataFrame, ceiling: float, seed: int) -> DataFrame:
    """Add whole copies, inclusion odds and the place in Pareto order of each row.

    Needs key, number, weight and the source's level and usual odds; a row whose copies are
    certain has no odds and no place.
    """
    expected = F.coalesce(F.least(F.lit(ceiling), F.col("weight") * F.col("level")), F.lit(0.0))
    uniform = F.xxhash64(F.lit(seed), "key", "number").bitwiseAND(F.lit(_PLACES - 1)) + 0.5
    rows = (
        rows.withColumn("expected", expected)
        .withColumn("whole", F.floor("expected"))
        .withColumn("chance", F.col("expected") - F.col("whole"))
        .withColumn("odds", F.when(F.col("chance") > 0, F.col("chance") / (1 - F.col("chance"))))
    )
    if "usual_odds" not in rows.columns:
        return rows
    random = uniform / _PLACES
    pareto = random / (1 - random) / F.col("odds")
    scaled = pareto * F.col("usual_odds")
    place = F.floor(scaled / (1 + scaled) * F.lit(float(_PLACES))).cast("bigint")
    return rows.withColumn("place", place).withColumn(
        "tie", F.xxhash64(F.lit(seed + 1), "key", "number")
    )


def mixing_plan(
    sized: DataFrame, weights: tuple[float, ...], factor: float, ceiling: float, seed: int,
    weighted: bool,
) -> DataFrame:
    """One row per source: size, target, level, usual odds and the last place that is taken.

    A row's copies follow from its source's row, its key and its number, so texts do not travel
    unless rows are repeated.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = staged(source_targets(sizes, weights, factor, ceiling), "targets")
    of_source = targets.withColumnRenamed("source", "of_source")
    known = sized.join(of_source, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    if weighted:
        known = _document_levels(staged(known, "weighted"), ceiling)
    else:
        share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        known = known.withColumn("level", F.coalesce(share, F.lit(0.0)))
    usual = staged(
        _drawn(known, ceiling, seed)
        .groupBy("rank")
        .agg(
            F.max("level").alias("level"),
            F.sum(F.col("whole") * F.col("size")).alias("certain_words"),
            F.avg("odds").alias("usual_odds"),
        ),
        "usual-odds",
    )
    ordered = (
        _drawn(known.drop("level").join(usual, "rank"), ceiling, seed)
        .where(F.col("odds").isNotNull())
        .select("rank", "tie", "size", "place", (F.col("target") - F.col("certain_words")).alias("open"))
    )
    summed = running_before(
        ordered, ["rank"], "place", "size", "sum", "before", ties=["tie"], width=_BLOCK
    )
    # each row's middle lies within the open words: rows up to the last such one are taken
    near = F.coalesce(F.col("before"), F.lit(0)) + F.col("size") / 2 <= F.col("open")
    last = summed.where(near).groupBy("rank").agg(F.max(F.struct("place", "tie")).alias("last"))
    return staged(
        targets.join(usual.select("rank", "level", "usual_odds"), "rank", "left")
        .join(last, "rank", "left")
        .withColumn("level", F.coalesce("level", F.lit(0.0))),
        "mixing-plan",
    )


def _copies(rows: DataFrame, plan: DataFrame, ceiling: float, seed: int) -> DataFrame:
    """``rows`` (key, number, source, weight and more) with the plan's columns and copies."""
    of_source = plan.withColumnRenamed("source", "of_source")
    joined = rows.join(of_source, F.col("source").eqNullSafe(F.col("of_source")), "left")
    taken = F.coalesce(F.struct("place", "tie") <= F.col("last"), F.lit(False))
    extra = F.when(F.col("odds").isNotNull() & taken, 1).otherwise(0)
    return _drawn(joined, ceiling, seed).withColumn(
        "copies", (F.col("whole") + extra).cast("bigint")
    )


def _sized(docs: DataFrame, weight: str | None) -> DataFrame:
    """doc_id, source, size, weight, key and number of each row, written once."""
    text = F.coalesce(column_or_null(docs, "text", "string"), F.lit(""))
    rows = docs.select(
        column_or_null(docs, "doc_id", "bigint").alias("doc_id"),
        column_or_null(docs, "source", "string").alias("source"),
        F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("bigint").alias("size"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
        _key(docs).alias("key"),
    )
    return staged(with_numbers(staged(rows, "sizes")), "sized")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    factor: float = FACTOR,
    ceiling: float = CEILING,
    weight: str | None = None,
    seed: int = 6,
) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken words of each row of ``docs``."""
    sized = _sized(docs, weight)
    plan = mixing_plan(sized, weights, factor, ceiling, seed, weight is not None)
    return _copies(sized, plan, ceiling, seed).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    factor: float = FACTOR,
    ceiling: float = CEILING,
    weight: str | None = None,
    seed: int = 6,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    sized = _sized(docs, weight)
    plan = mixing_plan(sized, weights, factor, ceiling, seed, weight is not None)
    rows = docs.select(
        F.struct("*").alias("row"),
        column_or_null(docs, "source", "string").alias("source"),
        (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"),
        _key(docs).alias("key"),
    )
    repeats = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return _copies(with_numbers(rows), plan, ceiling, seed).select("row", repeats.alias("copy")).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and taken words of every document."""
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )
