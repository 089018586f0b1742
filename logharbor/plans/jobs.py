"""The five jobs, each a composition of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.operators import archive as A
from logharbor.operators import groups as G
from logharbor.operators import planner as PL
from logharbor.operators import restore as R
from logharbor.operators.rolling import roll_segments
from logharbor.schemas import LARGE_TOPIC_MB, MIN_SEGMENT_BYTES, POLL_RECORDS
from logharbor.shared import staged
from logharbor.sources.journal import PlanJournal
from logharbor.streaming.jobs import refuse_existing_data, refuse_missing_files


@dataclass(frozen=True)
class Archived:
    rows: DataFrame
    manifest: DataFrame
    commits: DataFrame


def archive_log(
    rows: DataFrame,
    prefix: str = "",
    min_size: int = MIN_SEGMENT_BYTES,
    poll_records: int = POLL_RECORDS,
    flush: bool = False,
) -> Archived:
    """Cut a log into segments: rows with their segment, manifest, offsets to commit."""
    if "batch_no" not in rows.columns:
        rows = rows.selectExpr("*", f"offset div {int(poll_records)} AS batch_no")
    rolled = staged(roll_segments(A.poll_batches(rows), min_size), "rolled")
    manifest = A.segment_manifest(rolled, prefix, flush)
    return Archived(A.with_segments(rows, rolled, flush), manifest, A.committed_offsets(manifest))


@dataclass(frozen=True)
class Planned:
    plan: DataFrame
    order: DataFrame
    inventory: DataFrame
    #: objects that came after their place in the journal was planned
    late: DataFrame | None = None


def plan_restore(
    objects: DataFrame,
    prefix: str = "",
    include: str = ".*",
    exclude: str = "",
    large_last: bool = False,
    large_mb: int = LARGE_TOPIC_MB,
    previous_plan: DataFrame | None = None,
    journal: PlanJournal | None = None,
) -> Planned:
    """Order the objects of an archive into plan records, behind an earlier plan if there is one.

    Raises if the earlier plan was made for another list of topics.  A ``journal`` has no
    holes: the plan goes on behind its last closed page, whatever came in late before it is
    listed as ``late`` and not planned.  A ``previous_plan`` may have lost records, so there
    each folder goes on behind its own last file, and a file that arrives in a finished folder
    is planned; what arrives between planned files is not (``planner.never_planned``).
    """
    listed = PL.list_objects(objects, prefix)
    topics = PL.filter_topics(listed.select("topic").distinct(), include, exclude)
    counted = staged(PL.inventory(listed), "inventory")
    sizes = PL.topic_sizes(counted)
    order = PL.topic_order(topics, sizes, large_last, large_mb)
    if journal is not None:
        resume = journal.resume(order)
        late = journal.late_objects(listed, order)
        return Planned(PL.plan_records(listed, order, prefix, resume), order, counted, late)
    resume = PL.checked_resume(previous_plan, order)
    tips = None if resume is None else PL.folder_tips(previous_plan)
    return Planned(PL.plan_records(listed, order, prefix, resume, tips), order, counted)


def restore_log(
    plan: DataFrame,
    archive: DataFrame | Callable[[DataFrame], DataFrame],
    target: DataFrame | None = None,
    topic_prefix: str = "",
    exclude: str = "",
    fail_on_existing: bool = True,
    fail_on_missing: bool = True,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Rows to append to the target log.

    ``archive`` is the archive, or a function that reads only given files of it, such as
    ``lambda files: read_archive(spark, root, files=files)``.  With ``fail_on_existing``
    all planned partitions of the target are checked before anything is restored; one
    that ends with a foreign record stops the job.  With ``fail_on_missing`` so does a
    planned file that is absent or badly named; ``listing`` (paths) tells files
    without rows from absent ones.
    """
    if callable(archive):
        archive = archive(R.exclude_files(plan, exclude).select(F.col("value").alias("path")))
    if fail_on_missing:
        refuse_missing_files(plan, archive if listing is None else listing, exclude)
    progress = None
    if target is not None:
        target = R.planned_target(target, plan, topic_prefix, exclude)
        if fail_on_existing:
            refuse_existing_data(target)
        progress = staged(R.target_progress(target), "target-progress")
    return R.restore_rows(plan, archive, progress, topic_prefix, exclude)


def snapshot_groups(offsets: DataFrame, starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Nested snapshot of all committed group offsets."""
    return G.group_snapshot(offsets.select("group_id"), offsets, G.empty_partitions(starts, ends))


@dataclass(frozen=True)
class Translated:
    commits: DataFrame
    remaining: DataFrame
    status: DataFrame


def translate_groups(
    snapshot: DataFrame,
    restored: DataFrame,
    committed: DataFrame,
    topics: DataFrame,
    include: str = ".*",
    exclude: str = "",
    exclude_topics: str = "",
    group_prefix: str = "",
    topic_prefix: str = "",
) -> Translated:
    """One round of group translation: offsets to commit, entries to retry, status per (group, topic)."""
    chosen = G.filter_groups(snapshot, include, exclude)
    pending = staged(
        G.pending_groups(G.flatten_groups(chosen), committed, group_prefix, topic_prefix), "pending"
    )
    selected = staged(
        G.existing_group_topics(
            G.exclude_group_topics(pending, exclude_topics), topics, topic_prefix
        ),
        "selected",
    )
    translated = staged(G.translate_offsets(selected, restored, topic_prefix), "translated")
    return Translated(
        G.group_commits(translated, group_prefix, topic_prefix),
        translated.where("case = 'pending'").select(*selected.columns),
        G.group_status(chosen, pending, selected, translated, committed, group_prefix),
    )
