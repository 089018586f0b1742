"""Group translation that follows a growing log.

Beside the log a table keeps, for each file, a row per block of source offsets.  An append adds the
rows of its own files; the blocks of the whole log are merged from these small rows.  A lookup reads
the files that can hold its answer: those that reach into the block of a target at or behind it.
As source offsets rise along a restored log, an entry that was waiting for an append is
answered from the files of that append.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.operators import groups as G
from logharbor.operators.positional import block_start
from logharbor.schemas import TP
from logharbor.shared import staged
from logharbor.sources.offset_index import IndexedLog


class SourceBlocks(IndexedLog):
    """Blocks of source offsets of the log at ``log``, by file."""

    schema = "file string, topic string, partition int, _block bigint, _pos bigint, _last_pos bigint, _value bigint, _last_offset bigint, _last_source bigint"

    def entries(self, rows: DataFrame) -> DataFrame:
        return G.log_blocks(rows, self.width, "file")

    def named(self, topic_prefix: str) -> DataFrame:
        """The table's rows of restored topics, under their source names."""
        return self.rows().where(F.col("topic").startswith(topic_prefix)).withColumn(
            "topic", F.substr(F.col("topic"), F.lit(len(topic_prefix) + 1))
        )

    def files_at(self, parts: DataFrame, sought: DataFrame) -> list[str]:
        """Files with rows at or behind a target, in the block of that target."""
        place = block_start(F.greatest(F.col("target"), F.lit(0)), self.width)
        wanted = sought.groupBy(*TP, place.alias("_block")).agg(F.min("target").alias("_least"))
        found = (
            parts.join(staged(wanted, "wanted-blocks"), [*TP, "_block"])
            .where(F.col("_last_pos") >= F.col("_least"))
            .select("file")
            .distinct()
        )
        return sorted(r["file"] for r in found.collect())  # what a scan of them lists anyway

    def translate(self, entries: DataFrame, topic_prefix: str = "", floor: str = "zero") -> DataFrame:
        """``groups.translate_offsets`` on the log as it is now."""
        self.extend()
        parts = self.named(topic_prefix)
        blocks = staged(G.merged_blocks(parts), "log-blocks")

        def rows_for(sought: DataFrame) -> DataFrame:
            sought = staged(sought.select(*TP, "target").distinct(), "sought")
            files = self.files_at(parts, sought)
            return G.restored_log(self.read(files), sought, topic_prefix)

        return G.translate_by_blocks(entries, blocks, rows_for, floor, self.width)


def translate_followed(
    entries: DataFrame,
    table: SourceBlocks,
    appends: Iterable[object],
    topic_prefix: str = "",
    floor: str = "zero",
) -> tuple[DataFrame | None, DataFrame]:
    """Translate ``entries`` as the log grows: one round for each item that ``appends`` yields.

    ``appends`` waits for the next append, or makes it.  Returns the resolved rows with their
    ``round``, and the rest.  Appends that hold nothing of what is asked for cost one pass over
    their own files and no lookup.
    """

    def rounds() -> Iterable[Callable[[DataFrame], DataFrame]]:
        for _ in appends:
            yield lambda left: table.translate(left, topic_prefix, floor)

    return G.translate_in_rounds(entries, rounds())
