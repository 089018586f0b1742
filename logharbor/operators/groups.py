"""Consumer-group positions: snapshot, and translation onto a restored log."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.functions import headers as H
from logharbor.functions.text import matches_any, regex_list
from logharbor.operators.asof import first_at_or_after
from logharbor.operators.positional import BLOCK, block_start
from logharbor.schemas import (
    ALREADY_RESTORED,
    IN_PROGRESS,
    RESTORED,
    SCHEDULED,
    SKIPPED,
    TP,
)
from logharbor.shared import staged

ENTRY = ["group_id", "topic", "partition"]


def empty_partitions(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Partitions whose start equals their end; without a start they do not count as empty."""
    return (
        ends.join(starts, TP)
        .where(F.col("start_offset") == F.col("end_offset"))
        .select(*TP)
    )


def valid_group_offsets(offsets: DataFrame, empty: DataFrame) -> DataFrame:
    """Committed offsets that exist (>= 0) and lie in partitions that hold records."""
    return offsets.where(F.col("offset") >= 0).join(staged(empty, "empty"), TP, "left_anti")


def normalise_offsets(offsets: DataFrame) -> DataFrame:
    """Epoch -1 and empty metadata become null."""
    return offsets.withColumns(
        {
            "leader_epoch": F.nullif(F.col("leader_epoch"), F.lit(-1)),
            "metadata": F.nullif(F.col("metadata"), F.lit("")),
        }
    )


def group_snapshot(groups: DataFrame, offsets: DataFrame, empty: DataFrame) -> DataFrame:
    """One nested row per group; a topic needs a valid offset, a group does not.

    ``groups`` lists all group ids.  The arrays of a group are bounded by the number of
    partitions of the cluster.
    """
    valid = normalise_offsets(valid_group_offsets(offsets, empty))
    per_topic = valid.groupBy("group_id", "topic").agg(
        F.sort_array(
            F.collect_list(F.struct("partition", "offset", "leader_epoch", "metadata"))
        ).alias("partitions")
    )
    per_group = per_topic.groupBy("group_id").agg(
        F.sort_array(F.collect_list(F.struct("topic", "partitions"))).alias("topics")
    )
    nothing = F.array().cast(per_group.schema["topics"].dataType)
    return (
        groups.select("group_id")
        .distinct()
        .join(per_group, "group_id", "left")
        .select("group_id", F.coalesce("topics", nothing).alias("topics"))
    )


def filter_groups(snapshot: DataFrame, include: str = ".*", exclude: str = "") -> DataFrame:
    """Groups found by an include and by no exclude regex that hold at least one partition."""
    name = F.col("group_id")
    return snapshot.where(
        matches_any(name, regex_list(include))
        & ~matches_any(name, regex_list(exclude))
        & F.exists("topics", lambda t: F.size(t["partitions"]) > 0)
    )


def flatten_groups(snapshot: DataFrame) -> DataFrame:
    """One row per committed position; ``target`` is the last record the group processed."""
    return (
        snapshot.select("group_id", F.explode("topics").alias("t"))
        .select("group_id", F.col("t.topic").alias("topic"), F.explode("t.partitions").alias("p"))
        .select(
            "group_id",
            "topic",
            F.col("p.partition").alias("partition"),
            F.col("p.offset").alias("offset"),
            (F.col("p.offset") - 1).alias("target"),
        )
    )


def pending_groups(
    entries: DataFrame, committed: DataFrame, group_prefix: str = "", topic_prefix: str = ""
) -> DataFrame:
    """Entries without a committed offset (>= 0) under their restored names."""
    done = committed.where(F.col("offset") >= 0).select(
        F.col("group_id").alias("_group"), F.col("topic").alias("_topic"), "partition"
    )
    return (
        entries.withColumn("_group", F.concat(F.lit(group_prefix), F.col("group_id")))
        .withColumn("_topic", F.concat(F.lit(topic_prefix), F.col("topic")))
        .join(done, ["_group", "_topic", "partition"], "left_anti")
        .select(*entries.columns)
    )


def exclude_group_topics(entries: DataFrame, exclude: str = "") -> DataFrame:
    return entries.where(~matches_any(F.col("topic"), regex_list(exclude)))


def usable_topics(topics: DataFrame) -> DataFrame:
    """Topics that may be written to: not internal, listed without error."""
    usable = topics.where(~F.col("is_internal"))
    if "error" in topics.columns:
        usable = usable.where(F.col("error").isNull())
    return usable


def existing_group_topics(entries: DataFrame, topics: DataFrame, topic_prefix: str = "") -> DataFrame:
    """Entries whose restored topic exists."""
    present = staged(usable_topics(topics).select(F.col("topic").alias("_topic")).distinct(), "topics")
    return (
        entries.withColumn("_topic", F.concat(F.lit(topic_prefix), F.col("topic")))
        .join(present, "_topic", "left_semi")
        .drop("_topic")
    )


def log_blocks(log: DataFrame, width: int, *by: str) -> DataFrame:
    """One pass over narrow columns of the restored log: a row per block of source offsets, and ``by``."""
    source = F.col("source_offset")
    block = F.when(source < 0, F.lit(-1).cast("bigint")).otherwise(block_start(source, width))
    return log.groupBy(*by, *TP, block.alias("_block")).agg(
        F.min("source_offset").alias("_pos"),
        F.max("source_offset").alias("_last_pos"),
        F.min("offset").alias("_value"),
        F.max("offset").alias("_last_offset"),
        F.max_by("source_offset", "offset").alias("_last_source"),
    )


def merged_blocks(parts: DataFrame) -> DataFrame:
    """Blocks of a whole log from the blocks of its parts."""
    return parts.groupBy(*TP, "_block").agg(
        F.min("_pos").alias("_pos"),
        F.max("_last_pos").alias("_last_pos"),
        F.min("_value").alias("_value"),
        F.max("_last_offset").alias("_last_offset"),
        F.max_by("_last_source", "_last_offset").alias("_last_source"),
    )


def _partition_tips(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*TP).agg(
        F.min("_pos").alias("lowest_source"),
        F.min("_value").alias("start_offset"),
        F.max("_last_offset").alias("latest_offset"),
        F.max_by("_last_source", "_last_offset").alias("latest_source"),
    )


def restored_log(log: DataFrame, entries: DataFrame, topic_prefix: str) -> DataFrame:
    """Source and target offsets of the partitions entries ask for, under source topic names.

    Other partitions leave before any header is read; Catalyst broadcasts their list if it is small.
    """
    named = log.where(F.col("topic").startswith(topic_prefix)).withColumn(
        "topic", F.substr(F.col("topic"), F.lit(len(topic_prefix) + 1))
    )
    asked = staged(entries.select(*TP).distinct(), "asked-partitions").withColumn(
        "_asked", F.col("partition")
    )
    rows = named.join(asked, TP)
    if "source_offset" in rows.columns:
        source = F.col("source_offset")
    else:
        # tied to the join's column, so that no filter on it can move below the join
        source = F.when(F.col("_asked") == F.col("partition"), H.source_offset(F.col("headers")))
    return rows.select(*TP, "offset", source.alias("source_offset"))


def _readiness(entries: DataFrame, tips: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("latest_offset").isNull(), "no record")
        .when(F.col("latest_source") == -1, "no header")
        .when(F.col("latest_source") < F.col("target"), "behind")
        .otherwise("ready")
    )
    return entries.join(tips, TP, "left").withColumn("readiness", reason)


def group_readiness(
    entries: DataFrame, log: DataFrame, topic_prefix: str = "", width: int = BLOCK
) -> DataFrame:
    """Whether the restored log already covers each entry, and why not."""
    tips = _partition_tips(log_blocks(restored_log(log, entries, topic_prefix), width))
    return _readiness(entries, tips).select(
        *ENTRY, "target", "latest_offset", "latest_source", "readiness"
    )


def translate_offsets(
    entries: DataFrame,
    log: DataFrame,
    topic_prefix: str = "",
    floor: str = "zero",
    width: int = BLOCK,
) -> DataFrame:
    """Offset at which each group continues in the restored log, with the case it fell under.

    ``tip``: the newest record is the last one processed.  ``exact``: that record was
    found.  ``next``: it is missing, the group continues at the next one.  ``start``: all
    restored records are later, the group continues at 0 (``floor="start"``: at the first
    offset).  ``pending``: the log does not cover it yet, no offset.
    """
    narrow = restored_log(log, entries, topic_prefix)
    blocks = staged(log_blocks(narrow, width), "log-blocks")
    return translate_by_blocks(entries, blocks, lambda sought: narrow, floor, width)


def translate_by_blocks(
    entries: DataFrame,
    blocks: DataFrame,
    rows_for: Callable[[DataFrame], DataFrame],
    floor: str = "zero",
    width: int = BLOCK,
) -> DataFrame:
    """:func:`translate_offsets` for a log whose blocks are known.

    ``rows_for`` is given the entries that need a lookup and returns the log rows it takes: in
    each block that holds a target, all with this source offset or a later one.
    """
    if floor not in ("zero", "start"):
        raise ValueError("floor must be zero or start")
    judged = _readiness(entries, _partition_tips(blocks))
    sought = judged.where(
        (F.col("readiness") == "ready") & (F.col("latest_source") > F.col("target"))
    )
    found = first_at_or_after(
        rows_for(sought).where(F.col("source_offset") >= 0),
        sought,
        "source_offset",
        "offset",
        "target",
        blocks=blocks.where(F.col("_block") >= 0),
        width=width,
    )
    case = (
        F.when(F.col("readiness") != "ready", "pending")
        .when(F.col("latest_source") == F.col("target"), "tip")
        .when(F.col("lowest_source") > F.col("target"), "start")
        .when(F.col("target") < 0, "start")
        .when(F.col("found_pos") == F.col("target"), "exact")
        .otherwise("next")
    )
    lowest = F.lit(0).cast("bigint") if floor == "zero" else F.col("start_offset")
    offset = (
        F.when(F.col("case") == "tip", F.col("latest_offset") + 1)
        .when(F.col("case") == "exact", F.col("found_value") + 1)
        .when(F.col("case") == "next", F.col("found_value"))
        .when(F.col("case") == "start", lowest)
    )
    return (
        judged.join(found, [*TP, "target"], "left")
        .withColumn("case", case)
        .withColumn("restored_offset", offset)
        .select(*ENTRY, "offset", "target", "readiness", "case", "restored_offset")
    )


def group_commits(translated: DataFrame, group_prefix: str = "", topic_prefix: str = "") -> DataFrame:
    """Offsets to commit for the restored groups."""
    return translated.where(F.col("case") != "pending").select(
        F.concat(F.lit(group_prefix), F.col("group_id")).alias("group_id"),
        F.concat(F.lit(topic_prefix), F.col("topic")).alias("topic"),
        "partition",
        F.col("restored_offset").alias("offset"),
        F.lit(-1).alias("leader_epoch"),
    )


def translate_until_done(
    entries: DataFrame,
    log_states: Iterable[Callable[[], DataFrame]],
    topic_prefix: str = "",
    width: int = BLOCK,
) -> tuple[DataFrame | None, DataFrame]:
    """Translate what is left against each state of the log in turn; stop when nothing is.

    Returns the resolved rows, with the ``round`` they were resolved in, and the rest.
    Each round is one set of jobs over all remaining entries.
    """
    return translate_in_rounds(
        entries,
        (lambda left, log=log: translate_offsets(left, log(), topic_prefix, width=width) for log in log_states),
    )


def translate_in_rounds(
    entries: DataFrame, rounds: Iterable[Callable[[DataFrame], DataFrame]]
) -> tuple[DataFrame | None, DataFrame]:
    """Give what is left to each of ``rounds``, which translate it, until nothing is."""
    remaining = staged(entries, "remaining")
    resolved: DataFrame | None = None
    for number, translate in enumerate(rounds, start=1):
        if remaining.isEmpty():
            break
        outcome = staged(translate(remaining), "round")
        done = outcome.where(F.col("case") != "pending").withColumn("round", F.lit(number))
        resolved = done if resolved is None else resolved.unionByName(done)
        remaining = staged(
            outcome.where(F.col("case") == "pending").select(*ENTRY, "offset", "target"), "remaining"
        )
    return resolved, remaining


def group_status(
    snapshot: DataFrame,
    pending: DataFrame,
    selected: DataFrame,
    translated: DataFrame,
    committed: DataFrame,
    group_prefix: str = "",
) -> DataFrame:
    """Status code per (group, topic) of the filtered snapshot.

    ``pending`` are the entries not restored before, ``selected`` those of them whose
    topic is neither excluded nor missing, ``translated`` their outcome.  Codes 3 and 4
    need all partitions of the topic.
    """
    pair = ["group_id", "topic"]
    pairs = snapshot.select("group_id", F.explode("topics.topic").alias("topic")).distinct()
    known = (
        committed.select(F.col("group_id").alias("_group")).distinct().withColumn("_known", F.lit(True))
    )
    counts = (
        pending.groupBy(*pair)
        .agg(F.count(F.lit(1)).alias("_pending"))
        .join(selected.groupBy(*pair).agg(F.count(F.lit(1)).alias("_selected")), pair, "left")
        .join(
            translated.groupBy(*pair).agg(F.count_if(F.col("case") != "pending").alias("_done")),
            pair,
            "left",
        )
    )
    status = (
        F.when(F.col("_pending").isNull(), F.when(F.col("_known"), ALREADY_RESTORED).otherwise(SCHEDULED))
        .when(F.col("_selected").isNull(), SKIPPED)
        .when(F.col("_done") == F.col("_selected"), RESTORED)
        .otherwise(IN_PROGRESS)
    )
    return (
        pairs.withColumn("_group", F.concat(F.lit(group_prefix), F.col("group_id")))
        .join(known, "_group", "left")
        .join(counts, pair, "left")
        .select(*pair, status.alias("status"))
    )
