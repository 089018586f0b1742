"""A restore plan as a journal of pages.

Plan records are written in pages of consecutive numbers, many pages at once; then the pages are
closed one after the other, each by a commit record with its last plan record.  What counts is
the unbroken run of closed pages: it is a prefix of the plan without holes, however a write
ended.  So the last closed page alone tells where to go on, and every listed object before that
place that no closed page names came later than its place was planned.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.functions import paths as P
from logharbor.operators.planner import ResumePoint
from logharbor.schemas import PLAN
from logharbor.shared import create_file, read_file, remove_folder, staged, written_folders

PAGE = 10_000
_PAGED = T.StructType([*PLAN.fields, T.StructField("page", T.IntegerType())])


@dataclass(frozen=True)
class Page:
    """A closed page: its number, plan numbers, and the last record of its plan."""

    page: int
    first_seq: int
    last_seq: int
    topic: str
    file: str
    file_index: int
    topics_sha: str


class PlanJournal:
    def __init__(self, spark: SparkSession, root: str, page: int = PAGE):
        self.spark, self.root, self.size = spark, root.rstrip("/"), page

    def _page(self, number: int) -> Page | None:
        text = read_file(self.spark, f"{self.root}/closed/{number:012d}.json")
        try:
            return None if text is None else Page(**json.loads(text))
        except (ValueError, TypeError):
            return None  # its writer ended in the middle

    def last_page(self) -> Page | None:
        """Last page of the unbroken run of closed ones; reads a handful of small files."""
        names = set(written_folders(self.spark, f"{self.root}/closed"))
        numbers = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
        run = [n for i, n in enumerate(numbers) if i == n]
        while run:
            page = self._page(run[-1])
            if page is not None:
                return page
            run.pop()
        return None

    def read(self) -> DataFrame:
        """Records of the closed pages, with their ``page``."""
        last = self.last_page()
        if last is None:
            return self.spark.createDataFrame([], _PAGED)
        rows = self.spark.read.schema(_PAGED).parquet(f"{self.root}/pages")
        return rows.where(F.col("page") <= last.page)

    def resume(self, order: DataFrame) -> ResumePoint | None:
        """Where the plan goes on; raises if it was made for another list of topics."""
        last = self.last_page()
        if last is None:
            return None
        row = order.where(F.col("topic") == last.topic).select("rank", "topics_sha").first()
        if row is None:
            raise ValueError(f"cannot go on from this journal: topic {last.topic} is not selected any more")
        if row["topics_sha"] != last.topics_sha:
            raise ValueError(
                f"cannot go on from this journal: it was made for a topic list with fingerprint "
                f"{last.topics_sha}, the list selected now has {row['topics_sha']}"
            )
        return ResumePoint(
            last.topic, row["rank"], last.file, last.file_index, last.topics_sha, last.last_seq
        )

    def late_objects(self, listed: DataFrame, order: DataFrame) -> DataFrame:
        """Listed objects that lie before the end of the closed pages and are not in them."""
        last = self.resume(order)
        known = listed.where(P.is_parseable(F.col("path"))).join(order.select("topic", "rank"), "topic")
        if last is None:
            return known.drop("rank").limit(0)
        before = (F.col("rank") < last.rank) | (
            (F.col("rank") == last.rank) & (F.col("path") <= last.file)
        )
        planned = self.read().select(F.col("value").alias("path"))
        return known.where(before).drop("rank").join(planned, "path", "left_anti")

    def write_pages(self, plan: DataFrame) -> DataFrame:
        """Write the records that follow the closed pages, as open pages; a row per page.

        Open pages of a broken write are removed first.
        """
        last = self.last_page()
        first_seq, first_page = (0, 0) if last is None else (last.last_seq + 1, last.page + 1)
        for name in written_folders(self.spark, f"{self.root}/pages"):
            if name.startswith("page=") and int(name.removeprefix("page=")) >= first_page:
                remove_folder(self.spark, f"{self.root}/pages/{name}")
        for name in written_folders(self.spark, f"{self.root}/closed"):
            if name.endswith(".json") and int(name.removesuffix(".json")) >= first_page:
                remove_folder(self.spark, f"{self.root}/closed/{name}")
        number = F.floor((F.col("plan_seq") - first_seq) / self.size) + first_page
        paged = plan.select(*PLAN.names, number.cast("int").alias("page"))
        (
            paged.repartition("page")
            .sortWithinPartitions("page", "plan_seq")
            .write.mode("append")
            .partitionBy("page")
            .parquet(f"{self.root}/pages")
        )
        written = self.spark.read.schema(_PAGED).parquet(f"{self.root}/pages")
        tip = F.struct("plan_seq", "topic", F.col("value").alias("file"), "file_index", "topics_sha")
        return staged(
            written.where(F.col("page") >= first_page)
            .groupBy("page")
            .agg(
                F.count(F.lit(1)).alias("records"),
                F.min("plan_seq").alias("first_seq"),
                F.max(tip).alias("tip"),
            ),
            "pages",
        )

    def close_pages(self, pages: DataFrame) -> int:
        """Close written pages in order; the number of records closed.

        One small file a page is written, by the driver: the order is what makes it a journal.
        """
        last = self.last_page()
        expected, number = (0, 0) if last is None else (last.last_seq + 1, last.page + 1)
        closed = 0
        for row in pages.orderBy("page").toLocalIterator():
            tip = row["tip"]
            if (row["page"], row["first_seq"]) != (number, expected):
                raise ValueError(f"page {row['page']} does not follow the closed pages")
            if row["records"] != tip["plan_seq"] - row["first_seq"] + 1:
                raise ValueError(f"page {row['page']} has holes")
            page = Page(
                number, row["first_seq"], tip["plan_seq"], tip["topic"], tip["file"], tip["file_index"],
                tip["topics_sha"],
            )
            if not create_file(self.spark, f"{self.root}/closed/{number:012d}.json", json.dumps(page.__dict__)):
                raise ValueError(f"page {number} was closed by another writer")
            expected, number, closed = page.last_seq + 1, number + 1, closed + row["records"]
        return closed

    def append(self, plan: DataFrame) -> int:
        """Write and close the next records of the plan."""
        return self.close_pages(self.write_pages(plan))
