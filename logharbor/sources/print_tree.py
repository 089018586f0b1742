"""Fingerprint trees: two large logs compared without reading them.

Beside a log a table keeps, for each file and block of source offsets, the number of rows and four
sums (modulo 2^32) of the halves of two 64-bit words of each row's content, and above the blocks
the same for spans of ``fan``, ``fan``^2, ... blocks.  The sums add up, so an append writes the sums
of its own files on all levels and nothing is rewritten.  Two trees are compared from the
top; only below spans that differ is the next level looked at, and only files with rows of
differing blocks are read.  Equal trees cost no payload at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.operators import audit as C
from logharbor.operators.positional import BLOCK, block_start
from logharbor.schemas import TP
from logharbor.shared import staged, written_folders
from logharbor.sources.offset_index import IndexedLog

SUMS = ["rows", "s0", "s1", "s2", "s3"]
CONTENT = ["timestamp", "key", "value", "headers"]


def _added(column: str) -> Column:
    """Row counts in full, sums modulo 2^32."""
    total = F.sum(column)
    return (total if column == "rows" else total.bitwiseAND(F.lit(0xFFFFFFFF))).alias(column)


class PrintTree(IndexedLog):
    """Tree at ``root`` of the log at ``log``, with ``levels`` levels above its blocks.

    ``pos`` is the column with the source offset: ``offset`` in a source log, whose topics are
    kept under ``topic_prefix``, so that both sides have the same names.
    """

    schema = "file string, topic string, partition int, node bigint, rows bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, level int"

    def __init__(
        self,
        spark: SparkSession,
        log: str,
        root: str,
        pos: str = "source_offset",
        topic_prefix: str = "",
        width: int = BLOCK,
        fan: int = 64,
        levels: int = 3,
    ):
        super().__init__(spark, log, root, width)
        self.pos, self.topic_prefix, self.fan, self.levels = pos, topic_prefix, fan, levels

    def rows(self) -> DataFrame:
        """The lowest level, which knows the files."""
        return self.level(0)

    def level(self, number: int) -> DataFrame:
        if not written_folders(self.spark, self.root):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.root).where(F.col("level") == number)

    def span(self, level: int) -> int:
        return self.width * self.fan**level

    def side(self, rows: DataFrame) -> DataFrame:
        """Log rows as ``audit.differing_contents`` takes them."""
        topic = F.concat(F.lit(self.topic_prefix), "topic").alias("topic")
        place = F.col(self.pos).alias("source_offset")
        keep = ["file"] if "file" in rows.columns else []
        return rows.select(*keep, topic, "partition", place, *CONTENT).withColumn(
            "_block", block_start(F.col("source_offset"), self.width)
        )

    def entries(self, rows: DataFrame) -> DataFrame:
        words = [w.alias(f"_w{i}") for i, w in enumerate(C.content_words())]
        sums = [s.alias(n) for s, n in zip([h for w in ("_w0", "_w1") for h in C.halves(w)], SUMS[1:], strict=True)]
        each = self.side(rows).select("file", *TP, "_block", *words)
        each = each.select("file", *TP, F.col("_block").alias("node"), F.lit(1).cast("bigint").alias("rows"), *sums)
        # each level is added up from the one below it, in one write, so that an append counts whole
        lowest = staged(each.groupBy("file", *TP, "node").agg(*map(_added, SUMS)), "prints")
        below, out = lowest, lowest.withColumn("level", F.lit(0))
        for level in range(1, self.levels + 1):
            node = block_start(F.col("node"), self.span(level)).alias("node")
            below = below.groupBy(*TP, node).agg(*map(_added, SUMS))
            above = below.select(F.lit(None).cast("string").alias("file"), "*", F.lit(level).alias("level"))
            out = out.unionByName(above)
        return out

    def write(self, entries: DataFrame) -> None:
        ordered = entries.repartition("level", *TP, block_start(F.col("node"), self.span(2)))
        ordered.sortWithinPartitions("level", *TP, "node").write.mode("append").partitionBy("level").parquet(self.root)

    def files_of(self, blocks: DataFrame) -> list[str]:
        """Files with rows of the blocks (topic, partition, _block)."""
        hit = self.level(0).join(blocks.withColumnRenamed("_block", "node"), [*TP, "node"], "left_semi")
        return sorted(r["file"] for r in hit.select("file").distinct().collect())  # a scan lists them anyway

    def rows_of(self, blocks: DataFrame) -> DataFrame:
        """Rows of the files that hold something of the blocks."""
        return self.side(self.read(self.files_of(blocks)))


def differing_blocks(source: PrintTree, target: PrintTree) -> DataFrame:
    """Blocks (topic, partition, _block) whose prints differ, found from the top of both trees."""
    if (source.width, source.fan, source.levels) != (target.width, target.fan, target.levels):
        raise ValueError("the trees are cut differently")
    spans: DataFrame | None = None
    for level in range(source.levels, -1, -1):

        def sums(tree: PrintTree, level: int = level, spans: DataFrame | None = spans) -> DataFrame:
            nodes = tree.level(level)
            if spans is not None:
                nodes = nodes.withColumn("_above", block_start(F.col("node"), tree.span(level + 1)))
                nodes = nodes.join(spans, [*TP, "_above"], "left_semi")
            return nodes.groupBy(*TP, "node").agg(*map(_added, SUMS)).select(*TP, "node", F.struct(*SUMS).alias("_print"))

        left, right = sums(source), sums(target).withColumnRenamed("_print", "_other")
        differ = left.join(right, [*TP, "node"], "full_outer").where(~F.col("_print").eqNullSafe(F.col("_other")))
        spans = staged(differ.select(*TP, F.col("node").alias("_above")), "differing-spans")
        if spans.isEmpty():
            break
    return spans.withColumnRenamed("_above", "_block")


def tree_diff(source: PrintTree, target: PrintTree) -> DataFrame:
    """``audit.restore_content_diff`` of two stored logs: topic, partition, source_offset, verdict.

    Both trees are extended first, so files that came since take part.
    """
    source.extend()
    target.extend()
    blocks = differing_blocks(source, target)
    return C.differing_contents(source.rows_of(blocks), target.rows_of(blocks), blocks)
