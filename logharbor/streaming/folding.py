"""A table that grows by one folder a round and is read as one version.

Rounds write folders of their own.  Folding merges the folders of settled rounds into a part
and then creates a version file that names the parts and the last round they hold; readers take
the newest whole version and the rounds behind it.  Until the version file is there nothing has
changed, and what it replaces is removed only afterwards.  When there are ``width`` parts they
are merged into one, so both folders and rewriting stay bounded.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from logharbor.shared import create_file, read_file, remove_folder, written_folders


@dataclass(frozen=True)
class Version:
    number: int
    upto: int
    parts: tuple[str, ...]


@dataclass(frozen=True)
class FoldedTable:
    """Rounds ``<root>/<name>/round_no=<n>``; parts and versions in ``<root>/<name>-folded``."""

    root: str
    name: str
    width: int = 16

    @property
    def _side(self) -> str:
        return f"{self.root}/{self.name}-folded"

    def _round(self, number: int) -> str:
        return f"{self.root}/{self.name}/round_no={number}"

    def rounds(self, spark: SparkSession) -> list[int]:
        names = written_folders(spark, f"{self.root}/{self.name}")
        return sorted(int(n.removeprefix("round_no=")) for n in names if n.startswith("round_no="))

    def _numbers(self, spark: SparkSession) -> list[int]:
        names = written_folders(spark, f"{self._side}/versions")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, spark: SparkSession) -> Version:
        for number in reversed(self._numbers(spark)):
            text = read_file(spark, f"{self._side}/versions/{number:012d}.json")
            try:
                held = json.loads(text)
                return Version(number, held["upto"], tuple(held["parts"]))
            except (ValueError, TypeError):
                continue  # its writer ended in the middle
        return Version(0, -1, ())

    def paths(self, spark: SparkSession) -> list[str]:
        now = self.version(spark)
        rounds = [self._round(r) for r in self.rounds(spark) if r > now.upto]
        return [*(f"{self._side}/parts/{p}" for p in now.parts), *rounds]

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(*self.paths(spark))

    def fold(self, spark: SparkSession, before: int) -> bool:
        """Fold the rounds below ``before``, which no micro-batch will write again, if there are enough."""
        now = self.version(spark)
        settled = [r for r in self.rounds(spark) if now.upto < r < before]
        if len(settled) < self.width:
            return False
        paths, kept = [self._round(r) for r in settled], list(now.parts)
        if len(kept) >= self.width:
            paths, kept = [*(f"{self._side}/parts/{p}" for p in kept), *paths], []
        part = uuid.uuid4().hex
        spark.read.parquet(*paths).write.parquet(f"{self._side}/parts/{part}")
        number = max([now.number, *self._numbers(spark)]) + 1
        held = {"upto": settled[-1], "parts": [*kept, part]}
        if not create_file(spark, f"{self._side}/versions/{number:012d}.json", json.dumps(held)):
            remove_folder(spark, f"{self._side}/parts/{part}")
            return False
        self.clean(spark)
        return True

    def clean(self, spark: SparkSession) -> None:
        """Remove what the newest version replaces; readers of the one before it start again."""
        now = self.version(spark)
        for number in self.rounds(spark):
            if number <= now.upto:
                remove_folder(spark, self._round(number))
        for number in self._numbers(spark):
            if number < now.number:
                remove_folder(spark, f"{self._side}/versions/{number:012d}.json")
        for part in written_folders(spark, f"{self._side}/parts"):
            if part not in now.parts:
                remove_folder(spark, f"{self._side}/parts/{part}")
