"""Committed group offsets as a table of append-only runs.

Every commit writes a run; a version is a small file that lists the runs that count, oldest
first.  A version's file is created only if its number is free, so of two writers that started
from one version the second is refused and can start again.  Reading takes the newest run's row
of each (group, topic, partition).  Compaction merges all runs to one and is a version like any
other: a commit that came in between makes it fail, not the commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.schemas import TP
from logharbor.shared import create_file, read_file, remove_folder, written_folders

COMMIT = "group_id string, topic string, partition int, offset bigint, leader_epoch int"
_KEY = ["group_id", *TP]


class LostRace(RuntimeError):
    """Another writer has made the next version."""


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _runs_of(self, number: int) -> list[str] | None:
        text = read_file(self.spark, f"{self.root}/versions/{number:012d}.json")
        try:
            return None if text is None else json.loads(text)
        except ValueError:
            return None  # its writer ended in the middle; the version before it stands

    def _numbers(self) -> list[int]:
        names = written_folders(self.spark, f"{self.root}/versions")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self) -> tuple[int, list[str]]:
        """Highest number in use, and the runs of the newest whole version."""
        numbers = self._numbers()
        for number in reversed(numbers):
            runs = self._runs_of(number)
            if runs is not None:
                return numbers[-1], runs
        return numbers[-1] if numbers else 0, []

    def _merged(self, runs: list[str]) -> DataFrame:
        """Newest row of each key; inside a run the greatest offset."""
        if not runs:
            return self.spark.createDataFrame([], COMMIT)
        parts = [
            self.spark.read.schema(COMMIT).parquet(f"{self.root}/runs/{run}").withColumn("run", F.lit(i))
            for i, run in enumerate(runs)
        ]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        newest = rows.groupBy(*_KEY).agg(
            F.max(F.struct("run", "offset", "leader_epoch")).alias("newest")
        )
        return newest.select(*_KEY, "newest.offset", "newest.leader_epoch")

    def read(self, version: int | None = None) -> DataFrame:
        """Committed offset of each (group, topic, partition), now or as of a version."""
        runs = self.version()[1] if version is None else self._runs_of(version)
        return self._merged(runs or [])

    def _publish(self, number: int, runs: list[str], new: str) -> int:
        if not create_file(self.spark, f"{self.root}/versions/{number:012d}.json", json.dumps(runs)):
            remove_folder(self.spark, f"{self.root}/runs/{new}")
            raise LostRace(f"version {number} was made by another writer")
        return number

    def append(self, commits: DataFrame, based_on: int | None = None) -> int:
        """Commit offsets; the new version.

        With ``based_on``, the version the caller has read, the commit is refused if there is
        a newer one by now.
        """
        number, runs = self.version()
        if based_on is not None:
            number, runs = based_on, self._runs_of(based_on) or []
        new = uuid.uuid4().hex
        epoch = F.col("leader_epoch") if "leader_epoch" in commits.columns else F.lit(-1)
        rows = commits.select(*_KEY, "offset", epoch.cast("int").alias("leader_epoch"))
        rows.write.parquet(f"{self.root}/runs/{new}")
        return self._publish(number + 1, [*runs, new], new)

    def compact(self) -> int:
        """Merge all runs to one; the new version. Raises LostRace if a commit came in between."""
        number, runs = self.version()
        if len(runs) < 2:
            return number
        new = uuid.uuid4().hex
        self._merged(runs).write.parquet(f"{self.root}/runs/{new}")
        return self._publish(number + 1, [new], new)

    def forget(self, keep: int = 2) -> int:
        """Remove all but the newest ``keep`` versions and the runs that only they name; their number."""
        numbers = self._numbers()
        old, kept = numbers[:-keep], numbers[-keep:]
        needed = {run for n in kept for run in self._runs_of(n) or []}
        gone = {run for n in old for run in self._runs_of(n) or []} - needed
        for number in old:
            remove_folder(self.spark, f"{self.root}/versions/{number:012d}.json")
        for run in gone:
            remove_folder(self.spark, f"{self.root}/runs/{run}")
        return len(gone)
