"""Archiving and restoring as Structured Streaming jobs.

Both jobs hand micro-batches to the batch operators through ``foreachBatch`` and keep
their state in small tables next to the data, one folder per micro-batch.  A
micro-batch that runs again after a failure replaces its own folders, so the outcome
is the same as if it had run once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.operators import archive as A
from logharbor.operators import restore as R
from logharbor.operators.rolling import CHUNK, roll_segments
from logharbor.schemas import MIN_SEGMENT_BYTES, PLAN, POLL_RECORDS, RECORD, TP
from logharbor.shared import remove_folder, staged, written_folders
from logharbor.sources import storage as S
from logharbor.streaming.folding import FoldedTable

_POLL = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("batch_no", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("first_offset", T.LongType()),
        T.StructField("last_offset", T.LongType()),
        T.StructField("round", T.LongType()),
    ]
)
_ROUND = T.StructField("round_no", T.LongType())
_OBSERVED = T.StructType(
    [
        _ROUND,
        T.StructField("plan_records", T.LongType()),
        T.StructField("last_plan_seq", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("last_timestamp", T.LongType()),
    ]
)


def _folder(root: str, name: str, round_no: int) -> str:
    return f"{root}/{name}/round_no={round_no}"


def _written_rounds(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the rounds a table has, ascending."""
    names = written_folders(spark, f"{root}/{name}")
    return sorted(int(n.removeprefix("round_no=")) for n in names if n.startswith("round_no="))


def _put(df: DataFrame, root: str, name: str, round_no: int) -> DataFrame:
    """Write a round's part of a table, replacing what an earlier try left, and read it back."""
    path = _folder(root, name, round_no)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class ArchiveStream:
    """Endless archive job: every micro-batch rolls its polls and publishes closed segments.

    Rows go once into a spool and once into their segment.  Between micro-batches only
    the *batch summaries* of open segments are carried (``state``), never rows.
    Micro-batch ``b`` writes round ``2b``, a flush after it round ``2b + 1``, so neither
    replaces what the other published.  Manifests of settled rounds are folded, ``fold`` at a
    time, so the number of folders does not grow with the age of the job.  With ``watch`` each
    round also writes what is open per partition, for ``idle.IdleWatch``.
    """

    root: str
    min_size: int = MIN_SEGMENT_BYTES
    poll_records: int = POLL_RECORDS
    prefix: str = ""
    fold: int = 16
    watch: bool = False

    @property
    def _manifests(self) -> FoldedTable:
        return FoldedTable(self.root, "manifest", self.fold)

    def run(self, records: DataFrame) -> None:
        """Archive all records available now, in as many micro-batches as the source cuts."""
        query = (
            records.writeStream.foreachBatch(self.archive_batch)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def archive_batch(self, rows: DataFrame, batch_id: int) -> None:
        """Spool one micro-batch, roll it behind the open polls, publish the closed segments."""
        spark, round_no = rows.sparkSession, 2 * batch_id
        spool = _put(rows.select(*RECORD.names), self.root, "spool", round_no)
        fresh = A.poll_batches(spool, self.poll_records).withColumn(
            "round", F.lit(round_no).cast("bigint")
        )
        polls = self._open_polls(spark, round_no).unionByName(fresh.select(*_POLL.names))
        self._publish(spark, staged(polls, "polls"), round_no, flush=False)
        self.drop_published_spool(spark)
        # a restart repeats the last micro-batch at most
        self._manifests.fold(spark, before=round_no - 2)

    def flush(self, spark: SparkSession, only: DataFrame | None = None) -> None:
        """Publish the open segments too, whatever their size.

        With ``only`` (topic, partition, first_offset, last_offset), such as the reports of an
        ``IdleWatch``, publish these, if they have not moved.  A flush replaces an earlier one after
        the same micro-batch, so ``only`` must hold what that was given, as all reports do.
        """
        spooled = _written_rounds(spark, self.root, "spool")
        if spooled:
            round_no = spooled[-1] + 1
            self._publish(spark, self._open_polls(spark, round_no), round_no, flush=True, only=only)

    def repeat_last_batch(self, spark: SparkSession) -> None:
        """Run the last micro-batch again, as a restart does when its commit got lost."""
        round_no = _written_rounds(spark, self.root, "spool")[-1]
        rows = spark.read.schema(RECORD).parquet(_folder(self.root, "spool", round_no))
        self.archive_batch(staged(rows, "again"), round_no // 2)

    def drop_published_spool(self, spark: SparkSession) -> None:
        """Remove spool rounds all of whose rows are published, and states that were superseded."""
        states = _written_rounds(spark, self.root, "state")
        if not states:
            return
        kept = self._open_polls(spark, states[-1] + 1).agg(F.min("round")).first()[0]
        for round_no in _written_rounds(spark, self.root, "spool")[:-1]:
            if kept is None or round_no < kept:
                remove_folder(spark, _folder(self.root, "spool", round_no))
        # a micro-batch that runs again needs the state before its own
        for round_no in states[:-3]:
            remove_folder(spark, _folder(self.root, "state", round_no))
        # a watch that missed some may report a segment that is closed by now: a flush passes over it
        for round_no in _written_rounds(spark, self.root, "open")[:-16]:
            remove_folder(spark, _folder(self.root, "open", round_no))

    def _publish(
        self, spark: SparkSession, batches: DataFrame, round_no: int, flush: bool, only: DataFrame | None = None
    ) -> None:
        # poll numbers may repeat across rounds when a poll was cut by a micro-batch
        numbered = batches.withColumn("poll", F.col("batch_no")).withColumn(
            "batch_no", F.col("first_offset")
        )
        span = CHUNK * self.poll_records
        rolled = staged(roll_segments(numbered, self.min_size, span), "rolled")
        manifest = A.segment_manifest(rolled, self.prefix, flush)
        if only is not None:
            chosen = manifest.where("NOT closed").join(only, [*TP, "first_offset", "last_offset"], "left_semi")
            manifest = manifest.where("closed").unionByName(chosen)
        manifest = staged(manifest, "manifest")
        ended = manifest.select(*TP, F.col("first_offset").alias("segment"))
        placed = rolled.join(ended, [*TP, "segment"], "left_semi")
        held = rolled.join(ended, [*TP, "segment"], "left_anti").select(*TP, "batch_no")
        if not manifest.isEmpty():
            S.write_archive(
                self._spooled(spark, batches, placed), _folder(self.root, "archive", round_no)
            )
        # the manifest publishes the segments, so it follows their rows
        _put(manifest, self.root, "manifest", round_no)
        open_batches = numbered.join(held, [*TP, "batch_no"], "left_semi").select(
            *[F.col("poll").alias("batch_no") if n == "batch_no" else F.col(n) for n in _POLL.names]
        )
        held_polls = _put(open_batches, self.root, "state", round_no)
        if self.watch:
            opened = held_polls.groupBy(*TP).agg(
                F.min("first_offset").alias("first_offset"),
                F.max("last_offset").alias("last_offset"),
                F.sum("rows").alias("rows"),
                F.sum("bytes").alias("bytes"),
            )
            touched = batches.select(*TP).distinct().join(opened, TP, "left")
            _put(touched.withColumn("round", F.lit(round_no).cast("bigint")), self.root, "open", round_no)

    def _spooled(self, spark: SparkSession, batches: DataFrame, placed: DataFrame) -> DataFrame:
        """Spooled rows of the given polls with their segment; only spool folders in use are read."""
        numbered = placed.select(*TP, F.col("batch_no").alias("first_offset"), "segment")
        wanted = staged(
            batches.join(numbered, [*TP, "first_offset"]).select(
                *TP, "segment", F.col("batch_no").alias("_poll"), F.col("round").alias("round_no")
            ),
            "wanted-polls",
        )
        first, last = wanted.agg(F.min("round_no"), F.max("round_no")).first()
        schema = T.StructType(RECORD.fields + [_ROUND])
        rows = (
            spark.read.schema(schema)
            .parquet(f"{self.root}/spool")
            .where(F.col("round_no").between(first, last))
            .withColumn("_poll", F.expr(f"offset div {int(self.poll_records)}"))
        )
        return rows.join(wanted, [*TP, "_poll", "round_no"])

    def _open_polls(self, spark: SparkSession, round_no: int) -> DataFrame:
        """Summaries of the polls that were unpublished before this round."""
        earlier = [r for r in _written_rounds(spark, self.root, "state") if r < round_no]
        if not earlier:
            return spark.createDataFrame([], _POLL)
        return spark.read.schema(_POLL).parquet(_folder(self.root, "state", earlier[-1]))

    def archive(self, spark: SparkSession) -> DataFrame:
        return S.read_archive(spark, f"{self.root}/archive", self.prefix)

    def manifest(self, spark: SparkSession) -> DataFrame:
        return self._manifests.read(spark)

    def commits(self, spark: SparkSession) -> DataFrame:
        return A.committed_offsets(self.manifest(spark))


@dataclass(frozen=True)
class RestoreStream:
    """Endless restore job over a plan stream; progress per partition is kept round by round.

    ``listing`` (paths, such as a manifest's) tells planned files without rows from absent
    ones; without it a file is known by its rows.  What a round has done is observed while its
    rows are written, without a job of its own (:meth:`observed`); the rows of settled
    rounds are folded, ``fold`` at a time.
    """

    root: str
    archive: Callable[[DataFrame], DataFrame]
    target: DataFrame | None = None
    topic_prefix: str = ""
    exclude: str = ""
    fail_on_existing: bool = True
    fail_on_missing: bool = True
    listing: DataFrame | None = None
    fold: int = 16

    @property
    def _observed(self) -> FoldedTable:
        return FoldedTable(self.root, "observed", self.fold)

    def run(self, plan: DataFrame) -> None:
        query = (
            plan.writeStream.foreachBatch(self.restore_round)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def restore_round(self, plan: DataFrame, round_no: int) -> None:
        spark = plan.sparkSession
        planned, done = Observation(), Observation()
        counted = F.count(F.lit(1)).alias("plan_records"), F.max("plan_seq").alias("last_plan_seq")
        plan = staged(plan.observe(planned, *counted), "plan-round")
        progress = self._progress(spark, plan, round_no)
        files = R.exclude_files(plan, self.exclude).select(F.col("value").alias("path"))
        archive = self.archive(files)
        if self.fail_on_missing:
            present = archive if self.listing is None else self.listing
            refuse_missing_files(plan, present, self.exclude)
        rows = R.restore_rows(plan, archive, progress, self.topic_prefix, self.exclude).drop("path")
        rows = rows.observe(
            done,
            F.count(F.lit(1)).alias("rows"),
            F.sum(A.row_bytes()).alias("bytes"),
            F.max("timestamp").alias("last_timestamp"),
        )
        written = _put(rows, self.root, "target", round_no)
        moved = R.restore_progress(written)
        if progress is not None:
            moved = (
                progress.unionByName(moved)
                .groupBy(*TP)
                .agg(
                    F.max("last_source_offset").alias("last_source_offset"),
                    F.max("next_offset").alias("next_offset"),
                )
            )
        _put(moved, self.root, "progress", round_no)
        seen = {**planned.get, **done.get}
        row = (round_no, *(seen[n] for n in _OBSERVED.names[1:]))
        _put(spark.createDataFrame([row], _OBSERVED), self.root, "observed", round_no)
        # a restart repeats the last micro-batch at most
        self._observed.fold(spark, before=round_no - 1)

    def observed(self, spark: SparkSession) -> DataFrame:
        """Per round: plan records taken and the last of them, rows and bytes written, newest record."""
        return self._observed.read(spark)

    def percent_done(self, spark: SparkSession, planned_records: int) -> DataFrame:
        """Plan records restored so far, their share of all that are planned, rows and bytes written."""
        sums = (F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("plan_records", "rows", "bytes"))
        share = F.expr(f"plan_records * 100 div nullif({int(planned_records)}, 0)").alias("percent_done")
        return self.observed(spark).agg(*sums).select("*", share)

    def _progress(self, spark: SparkSession, plan: DataFrame, round_no: int) -> DataFrame | None:
        """Progress of earlier rounds; partitions planned for the first time are read from the target."""
        earlier = [r for r in _written_rounds(spark, self.root, "progress") if r < round_no]
        known = spark.read.parquet(_folder(self.root, "progress", earlier[-1])) if earlier else None
        if self.target is None:
            return known
        mine = R.planned_target(self.target, plan, self.topic_prefix, self.exclude)
        if known is not None:
            mine = mine.join(known, TP, "left_anti")
        if self.fail_on_existing:
            refuse_existing_data(mine)
        fresh = staged(R.target_progress(mine), "target-progress")
        return fresh if known is None else known.unionByName(fresh)

    def restored(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/target").drop("round_no")


def refuse_existing_data(target: DataFrame) -> None:
    """Raise if a partition of this (part of a) target ends with a record that no restore has written."""
    found = R.existing_data_violations(target).select(*TP, "offset").first()
    if found is not None:
        raise ValueError(
            f"{found['topic']}/{found['partition']} holds other data: its newest record, at offset "
            f"{found['offset']}, has no source offset"
        )


def refuse_missing_files(plan: DataFrame, present: DataFrame, exclude: str = "") -> None:
    """Raise if the plan names files that are absent or badly named."""
    missing = staged(R.missing_files(plan, present, exclude), "missing-files")
    first = missing.orderBy("plan_seq").limit(1).collect()
    if first:
        raise ValueError(
            f"{missing.count()} planned files cannot be restored, the first of them is "
            f"{first[0]['path']} ({first[0]['reason']})"
        )


def plan_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A plan table as a stream of plan records."""
    return spark.readStream.schema(PLAN).options(**options).parquet(path)


def in_order(df: DataFrame, column: str, parts: int) -> Iterator[DataFrame]:
    """Cut a table into parts that follow a numeric column, to feed it to a stream in rounds."""
    stored = staged(df, "feed")
    low, high = stored.agg(F.min(column), F.max(column)).first()
    if low is None:
        return
    step = (high - low) // parts + 1
    for i in range(parts):
        yield stored.where(
            (F.col(column) >= low + i * step) & (F.col(column) < low + (i + 1) * step)
        )
