"""A sparse index of the offsets of a stored log.

For each file and block of offsets it holds the first and last offset and source offset, so a
lookup reads the files that can hold its answer and no others.  It is extended after each append
by the files it does not know yet; a file it does not know is read by every lookup, so results
never depend on how far it has come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.operators import asof
from logharbor.operators.positional import BLOCK, block_start
from logharbor.operators.restore import latest_records, source_offsets
from logharbor.schemas import TP
from logharbor.shared import staged, written_folders
from logharbor.sources.storage import below_root, list_objects, read_topics

INDEX = "file string, topic string, partition int, block bigint, rows bigint, first_offset bigint, last_offset bigint, first_source bigint, last_source bigint"


class IndexedLog:
    """A table at ``root`` of what the files of the log at ``log`` hold, one append after the other.

    The log is one that ``storage.write_topics`` writes.  Subclasses say what is kept of a file.
    """

    schema = ""

    def __init__(self, spark: SparkSession, log: str, root: str, width: int = BLOCK):
        self.spark, self.log, self.root, self.width = spark, log.rstrip("/"), root, width

    def entries(self, rows: DataFrame) -> DataFrame:
        """What the table keeps of log rows, which carry their ``file``."""
        raise NotImplementedError

    def rows(self) -> DataFrame:
        if not written_folders(self.spark, self.root):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.root)

    def write(self, entries: DataFrame) -> None:
        entries.write.mode("append").parquet(self.root)

    def unknown_files(self) -> list[str]:
        """Files of the log that are not indexed: those of the last appends."""
        if not written_folders(self.spark, self.log):
            return []
        there = list_objects(self.spark, self.log).where(F.col("path").endswith(".parquet"))
        known = self.rows().select(F.col("file").alias("path")).distinct()
        return sorted(r["path"] for r in there.select("path").join(known, "path", "left_anti").collect())

    def read(self, files: list[str]) -> DataFrame:
        """Log rows of some files."""
        return read_topics(self.spark, self.log, [f"{self.log}/{name}" for name in files])

    def extend(self) -> int:
        """Index the files that came since; their number."""
        new = self.unknown_files()
        if new:
            rows = source_offsets(self.read(new)).withColumn(
                # a file's own path is an escaped URI, listings have plain names
                "file",
                below_root(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), self.log),
            )
            self.write(self.entries(rows))
        return len(new)


class OffsetIndex(IndexedLog):
    """First and last offsets of each file and block of offsets."""

    schema = INDEX

    def entries(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("file", *TP, block_start(F.col("offset"), self.width).alias("block")).agg(
            F.count(F.lit(1)).alias("rows"),
            F.min("offset").alias("first_offset"),
            F.max("offset").alias("last_offset"),
            F.min("source_offset").alias("first_source"),
            F.max("source_offset").alias("last_source"),
        )

    def files_at(self, wanted: DataFrame) -> list[str]:
        """Files that can hold the first record at or after each (topic, partition, start_offset).

        Blocks are joined by equality: the block of the wanted offset, or, if that holds nothing
        behind it, the next first offset of any block.
        """
        rows = self.rows()
        wanted = staged(
            wanted.select(*TP, "start_offset")
            .distinct()
            .withColumn("block", block_start(F.greatest(F.col("start_offset"), F.lit(0)), self.width)),
            "wanted",
        )
        own = staged(
            wanted.join(rows, [*TP, "block"])
            .where(F.col("last_offset") >= F.col("start_offset"))
            .select(*TP, "start_offset", "file"),
            "own-block",
        )
        open_ = wanted.join(own, [*TP, "start_offset"], "left_anti")
        behind = asof.first_at_or_after(
            rows, open_, "first_offset", "first_offset", "start_offset", width=self.width
        )
        following = behind.where(F.col("found_pos").isNotNull()).select(
            *TP, F.col("found_pos").alias("first_offset")
        )
        beyond = rows.join(following.distinct(), [*TP, "first_offset"], "left_semi")
        found = own.select("file").unionByName(beyond.select("file")).distinct()
        return sorted(r["file"] for r in found.collect())  # what a scan of them lists anyway

    def records_at(self, wanted: DataFrame) -> DataFrame:
        """First record at or after ``start_offset`` for each (topic, partition, start_offset)."""
        files = sorted({*self.files_at(wanted), *self.unknown_files()})
        return asof.record_at_offset(self.read(files), wanted, self.width)

    def latest(self) -> DataFrame:
        """Newest record of each non-empty partition."""
        rows = self.rows()
        tips = rows.groupBy(*TP).agg(F.max("last_offset").alias("last_offset"))
        newest = rows.join(tips, [*TP, "last_offset"], "left_semi").select("file").distinct()
        files = {r["file"] for r in newest.collect()}  # one file a partition
        return latest_records(self.read(sorted({*files, *self.unknown_files()})))
