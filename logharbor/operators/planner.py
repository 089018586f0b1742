"""From an object listing to an ordered, resumable restore plan.

Everything here works on names and sizes; no object body is read.  The topic list is
the only thing gathered into one row: a plan is defined by the ordered list of topic
names and its fingerprint, which is metadata of the archive and not data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logharbor.functions import paths as P
from logharbor.functions.text import first_match, matches_any, regex_list
from logharbor.schemas import LARGE_TOPIC_MB
from logharbor.shared import staged

# Digits of the first offset left out of a block of file names, see _path_blocks.
_BLOCK_DIGITS = 6


def parse_paths(objects: DataFrame) -> DataFrame:
    """Split object paths into topic, partition, file and first offset.

    Paths with fewer than three parts get ``parseable = false`` and nulls.
    """
    path = F.col("path")
    ok = P.is_parseable(path)
    empty = path == ""
    return objects.withColumns(
        {
            "parseable": ok,
            "topic": F.when(empty, "").when(ok, P.part_from_end(path, 3)),
            "partition": F.when(empty, "").when(ok, P.part_from_end(path, 2)),
            "file": F.when(empty, "").when(ok, P.part_from_end(path, 1)),
            "first_offset": F.when(ok, P.offset_in_name(path)),
        }
    )


def unparseable_keys(objects: DataFrame) -> DataFrame:
    return objects.where(~P.is_parseable(F.col("path")))


def list_objects(objects: DataFrame, prefix: str = "") -> DataFrame:
    """Objects below ``prefix`` that sit in a topic folder, with the folder as ``topic``."""
    prefix = P.normalize_prefix(prefix)
    below = F.substr(F.col("path"), F.lit(len(prefix) + 1))
    topic = F.substring_index(below, "/", 1)
    return (
        objects.where(F.col("path").startswith(prefix) & below.contains("/") & (topic != ""))
        .withColumn("topic", topic)
    )


def list_topics(objects: DataFrame, prefix: str = "") -> DataFrame:
    return list_objects(objects, prefix).select("topic").distinct()


def filter_topics(topics: DataFrame, include: str, exclude: str = "") -> DataFrame:
    """Topics found by an include and by no exclude regex; ``include_pos`` is the first one found."""
    name = F.col("topic")
    return topics.withColumn("include_pos", first_match(name, regex_list(include))).where(
        F.col("include_pos").isNotNull() & ~matches_any(name, regex_list(exclude))
    )


def inventory(listed: DataFrame) -> DataFrame:
    """File count and bytes per topic and partition folder; unparseable keys do not count."""
    return (
        listed.where(P.is_parseable(F.col("path")))
        .withColumn("partition", P.part_from_end(F.col("path"), 2))
        .groupBy("topic", "partition")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )


def topic_sizes(counted: DataFrame) -> DataFrame:
    return counted.groupBy("topic").agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))


def topic_order(
    filtered: DataFrame,
    sizes: DataFrame | None = None,
    large_last: bool = False,
    large_mb: int = LARGE_TOPIC_MB,
) -> DataFrame:
    """Rank the topics and fingerprint their order: topic, rank (0-based), topics_sha.

    Order: first matching include regex, then name.  With ``large_last`` topics above
    the threshold go to the end; an unknown size counts as small.
    """
    large = F.lit(False)
    if large_last:
        if sizes is None:
            raise ValueError("large_last needs the topic sizes")
        filtered = filtered.join(sizes.select("topic", "bytes"), "topic", "left")
        large = F.coalesce(F.col("bytes"), F.lit(0)) > F.lit(large_mb * 1024 * 1024)
    ordered = filtered.agg(
        F.sort_array(F.collect_list(F.struct(large.alias("large"), "include_pos", "topic"))).alias("all")
    )
    names = F.transform("all", lambda t: t["topic"])
    return staged(
        ordered.select(
            F.posexplode(names).alias("rank", "topic"),
            F.sha2(F.array_join(names, ","), 256).alias("topics_sha"),
        ),
        "topic-order",
    )


def topics_sha(order: DataFrame) -> DataFrame:
    return order.select("topics_sha").distinct()


def _path_blocks(files: DataFrame, prefix: str) -> DataFrame:
    """Cut the paths of a topic into runs that follow path order and stay small.

    A run is a partition folder plus the file name without its last digits, so it
    holds at most ``10 ** _BLOCK_DIGITS`` first offsets.  Both parts are prefixes of
    the remaining path, hence runs sort as the paths do, whatever the names are.
    """
    at = len(P.normalize_prefix(prefix)) + 2
    below = F.substr(F.col("path"), F.length("topic") + F.lit(at))
    part = F.when(below.contains("/"), F.concat(F.substring_index(below, "/", 1), F.lit("/"))).otherwise(below)
    kept = F.length("topic") + F.length("_part") + F.lit(1 + 19 - _BLOCK_DIGITS)
    return files.withColumn("_part", part).withColumn(
        "_block",
        F.substr(F.col("path"), F.length("topic") + F.length("_part") + F.lit(at), kept),
    )


@dataclass(frozen=True)
class ResumePoint:
    """Where an earlier plan ends."""

    topic: str
    rank: int
    file: str
    file_index: int
    topics_sha: str
    plan_seq: int


def plan_records(
    listed: DataFrame,
    order: DataFrame,
    prefix: str = "",
    resume: ResumePoint | None = None,
    tips: DataFrame | None = None,
) -> DataFrame:
    """Plan records in plan order; with ``resume`` only those behind the resume point.

    ``file_index`` is the 1-based number of the file in its partition, counted on from
    the resume point; ``plan_seq`` numbers the plan, counted on likewise.  With ``tips``
    (:func:`folder_tips` of the earlier plan) each folder goes on behind its own last
    planned file, so what a broken append lost before the resume point comes first.
    """
    files = (
        listed.where(P.is_parseable(F.col("path")))
        .withColumn("partition", P.part_from_end(F.col("path"), 2))
        .join(order, "topic")
    )
    seed = F.lit(0)
    first_seq = 0
    if resume is not None and tips is not None:
        # joined by the folder's names, one row each; a folder without a tip starts anew
        tips = staged(tips, "folder-tips")
        files = (
            files.join(tips, ["topic", "partition"], "left")
            .where(F.col("last_path").isNull() | (F.col("path") > F.col("last_path")))
            .withColumn("_seed", F.coalesce("last_index", F.lit(0)))
            .drop("last_path", "last_index")
        )
        seed = F.col("_seed")
        first_seq = resume.plan_seq + 1
    elif resume is not None:
        files = files.where(
            (F.col("rank") > resume.rank)
            | ((F.col("rank") == resume.rank) & (F.col("path") > resume.file))
        )
        resumed_partition = resume.file.split("/")[-2]
        seed = F.when(
            (F.col("topic") == resume.topic) & (F.col("partition") == resumed_partition),
            F.lit(resume.file_index),
        ).otherwise(F.lit(0))
        first_seq = resume.plan_seq + 1
    files = _path_blocks(files, prefix)
    run = ["rank", "topic", "_part", "_block"]

    def earlier(*keys: str):
        return W.partitionBy(*keys).orderBy("_part", "_block").rowsBetween(W.unboundedPreceding, -1)

    def before(counts: DataFrame, *keys: str):
        return F.coalesce(F.sum("_n").over(earlier(*keys)), F.lit(0))

    per_partition = staged(
        files.groupBy(*run, "partition").agg(F.count(F.lit(1)).alias("_n")), "run-counts"
    )
    per_run = per_partition.groupBy(*run).agg(F.sum("_n").alias("_n"))
    per_topic = per_run.groupBy("rank").agg(F.sum("_n").alias("_n"))
    # one row per topic, as many as the fingerprint's list already holds
    topics_before = W.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    per_topic = per_topic.select(
        "rank", F.coalesce(F.sum("_n").over(topics_before), F.lit(0)).alias("_topic_at")
    )
    per_partition = per_partition.withColumn("_file_at", before(per_partition, "topic", "partition")).drop("_n")
    per_run = (
        per_run.withColumn("_run_at", before(per_run, "topic"))
        .drop("_n")
        .join(per_topic, "rank")
        .withColumn("_run_at", F.col("_run_at") + F.col("_topic_at"))
        .drop("_topic_at")
    )
    starts = per_partition.join(per_run, run)
    in_run = F.row_number().over(W.partitionBy(*run).orderBy("path"))
    in_partition = F.row_number().over(W.partitionBy(*run, "partition").orderBy("path"))
    return (
        files.withColumn("_in_run", in_run)
        .withColumn("_in_partition", in_partition)
        .join(starts, [*run, "partition"])
        .select(
            (F.col("_run_at") + F.col("_in_run") - 1 + F.lit(first_seq)).cast("bigint").alias("plan_seq"),
            P.folder(F.col("path")).alias("key"),
            F.col("path").alias("value"),
            "topic",
            "partition",
            (F.col("_file_at") + F.col("_in_partition") + seed).cast("bigint").alias("file_index"),
            "topics_sha",
        )
    )


def latest_plan_records(plan: DataFrame) -> DataFrame:
    """Newest plan record of each plan key.

    Records of one key always land in one plan partition, so this holds the newest
    record of every plan partition, however many partitions the plan has.
    """
    newest = plan.groupBy("key").agg(F.max("plan_seq").alias("plan_seq"))
    return plan.join(newest, ["key", "plan_seq"])


def folder_tips(plan: DataFrame) -> DataFrame:
    """Last planned file of every topic partition and its number."""
    return plan.groupBy("topic", "partition").agg(
        F.max("value").alias("last_path"),
        F.max(F.coalesce(F.col("file_index"), F.lit(0))).alias("last_index"),
    )


def plan_holes(plan: DataFrame) -> DataFrame:
    """Folders whose plan records are numbered further than there are records: some were lost."""
    return (
        plan.groupBy("topic", "partition")
        .agg(
            F.count_distinct("value").alias("planned"), F.max("file_index").alias("last_index")
        )
        .where(F.col("last_index") > F.col("planned"))
    )


def resume_point(latest: DataFrame, order: DataFrame) -> DataFrame:
    """At most one row: the greatest file of the last topic, in current order, that was planned."""
    per_topic = (
        latest.withColumn("topic", P.part_from_end(F.col("value"), 3))
        .groupBy("topic")
        .agg(F.max("value").alias("value"))
    )
    ranked = per_topic.join(order.select("topic", "rank"), "topic")
    last = ranked.groupBy().agg(F.max(F.struct("rank", "topic", "value")).alias("last")).where("last is not null")
    return (
        last.select("last.topic", F.col("last.value").alias("file"))
        .join(
            latest.select(
                F.col("value").alias("file"),
                F.coalesce(F.col("file_index"), F.lit(0)).cast("bigint").alias("file_index"),
                F.coalesce(F.col("topics_sha"), F.lit("")).alias("topics_sha"),
                "plan_seq",
            ),
            "file",
        )
        .groupBy("topic", "file")
        .agg(
            F.max_by("file_index", "plan_seq").alias("file_index"),
            F.max_by("topics_sha", "plan_seq").alias("topics_sha"),
            F.max("plan_seq").alias("plan_seq"),
        )
        .select("topic", "file", "file_index", "topics_sha", "plan_seq")
    )


def checked_resume(plan: DataFrame | None, order: DataFrame) -> ResumePoint | None:
    """Resume point of an earlier plan; raises if that plan was made for other topics."""
    if plan is None:
        return None
    current = order.select("topic", "rank", F.col("topics_sha").alias("current_sha"))
    row = resume_point(latest_plan_records(plan), order).join(current, "topic").first()
    if row is None:
        if plan.isEmpty() or order.isEmpty():
            return None
        raise ValueError("cannot go on from this plan: no topic it names is selected any more")
    if row["topics_sha"] != row["current_sha"]:
        raise ValueError(
            f"cannot go on from this plan: it was made for a topic list with fingerprint "
            f"{row['topics_sha']}, the list selected now has {row['current_sha']}"
        )
    hole = plan_holes(plan).first()
    if hole is not None:
        raise ValueError(
            f"cannot go on from this plan: folder {hole['topic']}/{hole['partition']} has "
            f"{hole['planned']} records but is numbered up to {hole['last_index']}"
        )
    return ResumePoint(**{name: row[name] for name in ResumePoint.__dataclass_fields__})


def never_planned(listed: DataFrame, plan: DataFrame) -> DataFrame:
    """Parseable objects of planned topics that no plan record names (they came late)."""
    topics = staged(plan.select("topic").distinct(), "planned-topics")
    return (
        listed.where(P.is_parseable(F.col("path")))
        .join(topics, "topic", "left_semi")
        .join(plan.select(F.col("value").alias("path")), "path", "left_anti")
    )


def plan_progress(order: DataFrame, counted: DataFrame, plan: DataFrame) -> DataFrame:
    """Per topic partition: files to plan, files planned, and whether its topic is done (0/1)."""
    planned = plan.groupBy("topic", "partition").agg(F.count_distinct("value").alias("planned_files"))
    per_partition = (
        order.join(counted, "topic", "left")
        .join(planned, ["topic", "partition"], "left")
        .select(
            "topics_sha",
            "topic",
            "partition",
            F.coalesce("files", F.lit(0)).alias("total_files"),
            F.coalesce("planned_files", F.lit(0)).alias("planned_files"),
        )
    )
    open_files = F.sum(F.col("total_files") - F.col("planned_files")).over(W.partitionBy("topic"))
    return per_partition.withColumn("topic_done", F.when(open_files > 0, 0).otherwise(1))
