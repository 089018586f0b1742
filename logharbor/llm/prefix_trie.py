"""Prefix trie of conversations in tables under minimal perfect hashes.

1. Turns are reduced to two 64-bit hashes and a word count where they lie; texts never travel.
   The digest of a prefix is the exclusive or, over its turns, of 128-bit hashes of (place,
   turn), so it comes from running totals over blocks of places: a conversation that holds a
   third of all turns is dealt like any other, and a parent's digest is one exclusive or away.
2. Nodes are the distinct digests, counted in every task before the shuffle.
3. The trie is cut into units.  A node's level is how often its number of members can be
   divided by ``FANOUT``; a unit is what hangs together on one level and in one band of
   ``BAND`` depths.  At each depth a unit has at most ``FANOUT`` nodes, so units are bounded
   however many conversations share a prefix.  Units are dealt to shards of about ``SHARD`` nodes.
4. A shard's digests get slots by a minimal perfect hash (levels of bit arrays and ranks);
   every slot is checked to be taken once, and a lookup compares the whole digest stored there.
   Counts are scattered into flat arrays by slot and added up along the array of parent
   slots, deepest nodes first.
5. Levels go from the lowest up, in a level the deepest band first; the tops of a round's units
   send their totals to the parents in later rounds.
6. Members that end at a node are sorted over ranges of (digest, id), joined to pieces of text
   in every range and hashed piece by piece, so the members of one node are never held at once.

Defined results: rows without conv_id are in no conversation; null roles and texts are empty;
turns order by turn (null first), equal ones by their hashes, so repeated rows are turns of their
own and reruns agree; a conversation whose turns all fall away is a member of the root
alone.  An empty table has no root and gives an empty result.  Only conv_id, turn, role and
text are read.  Equality of prefixes is that of 128-bit digests.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logharbor.llm.common import column_or_null, staged, table, union_all
from logharbor.llm.textcode import U, mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Members a unit's nodes may have at the lowest level; a level up, its square, and so on.
FANOUT = 4096
#: Depths a unit spans at most.
BAND = 1024
#: Nodes of a shard, about.
SHARD = 100_000
#: Turns of a block of places.
PLACES = 1 << 17
#: Bytes of member ids that are joined to one piece.
PIECE = 1 << 20
DIGEST, PARENT = ["d1", "d2"], ["p1", "p2"]


# --- rebuilt conversations -----------------------------------------------------------------


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two hashes of role and text, words of the text."""
    role = F.coalesce(column_or_null(conversations, "role", "string"), F.lit(""))
    text = F.coalesce(column_or_null(conversations, "text", "string"), F.lit(""))
    return conversations.select(
        column_or_null(conversations, "conv_id", "bigint").alias("conv_id"),
        column_or_null(conversations, "turn", "bigint").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.regexp_count(text, F.lit("[^ \\t-\\r]+")).cast("bigint").alias("words"),
    ).where(F.col("conv_id").isNotNull())


def numbered_turns(turns: DataFrame) -> DataFrame:
    """Each turn with its 0-based place in its conversation.

    Turns are sorted over ranges; a conversation that reaches over several ranges starts in
    each behind what the ranges before hold of it.
    """
    parts = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = (F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"))
    dealt = staged(
        turns.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "turns",
    )
    runs = dealt.groupBy("conv_id", "part").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n")
    )
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.select(
        "conv_id", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    )
    return dealt.join(starts, ["conv_id", "part"]).select(
        "conv_id", (F.col("at") + F.col("shift")).alias("place"), "a", "b", "words"
    )


def _taken(conv_id: Column) -> Column:
    """Turns that a conversation wants from the first of its twenty."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations with their depth, and conv_id with its depth in turns."""
    own = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = own.select(
        "conv_id",
        "n",
        (F.col("conv_id") - F.col("conv_id") % 20).alias("base"),
        _taken(F.col("conv_id")).alias("h"),
    )
    there = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = staged(
        wanted.join(there, "base", "left").select(
            "conv_id",
            "base",
            "h",
            F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent"),
            F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("kept"),
        ),
        "conversations",
    )
    tail = (
        placed.where(F.col("place") >= _taken(F.col("conv_id")))
        .join(convs.select("conv_id", (F.col("lent") - F.col("h")).alias("shift")), "conv_id")
        .select("conv_id", (F.col("place") + F.col("shift") + 1).alias("depth"), "a", "b", "words")
    )
    first = placed.where((F.col("place") < 3) & (F.col("conv_id") % 20 == 0)).withColumnRenamed(
        "conv_id", "base"
    )
    head = (
        first.join(convs.select("conv_id", "base", "lent"), "base")
        .where(F.col("place") < F.col("lent"))
        .select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "words")
    )
    return head.unionByName(tail), convs.select(
        "conv_id", (F.col("lent") + F.col("kept")).alias("turns")
    )


def prefixes(turns: DataFrame, places: int = PLACES) -> DataFrame:
    """conv_id, depth, digest, digest of the parent and words of each rebuilt turn."""
    hashed = turns.select(
        "conv_id",
        "depth",
        F.xxhash64(F.lit(3), "depth", "a", "b").alias("h1"),
        F.xxhash64(F.lit(4), "depth", "b", "a").alias("h2"),
        "words",
        F.floor(F.col("depth") / places).alias("block"),
    )
    inside = W.partitionBy("conv_id", "block").orderBy("depth")
    inside = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    running = staged(
        hashed.withColumn("r1", F.bit_xor("h1").over(inside)).withColumn(
            "r2", F.bit_xor("h2").over(inside)
        ),
        "running",
    )
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    long = running.where("block > 0").select("conv_id").distinct()
    before = staged(
        running.join(long, "conv_id", "left_semi")
        .groupBy("conv_id", "block")
        .agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
        .select(
            "conv_id",
            "block",
            F.bit_xor("t1").over(earlier).alias("b1"),
            F.bit_xor("t2").over(earlier).alias("b2"),
        )
        .where("block > 0"),
        "before",
    )
    zero = F.lit(0).cast("bigint")
    d1 = F.col("r1").bitwiseXOR(F.coalesce("b1", zero))
    d2 = F.col("r2").bitwiseXOR(F.coalesce("b2", zero))
    return running.join(before, ["conv_id", "block"], "left").select(
        "conv_id",
        "depth",
        d1.alias("d1"),
        d2.alias("d2"),
        d1.bitwiseXOR(F.col("h1")).alias("p1"),
        d2.bitwiseXOR(F.col("h2")).alias("p2"),
        "words",
    )


# --- node tables ---------------------------------------------------------------------------


class SlotTable:
    """Minimal perfect hash of distinct 128-bit digests, with the digest kept in each slot.

    On each level the remaining digests fall into a bit array; those alone in their cell
    take the next free slots in order of cells, the others go on.
    """

    def __init__(self, d1: np.ndarray, d2: np.ndarray):
        n = len(d1)
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.first, self.second = np.zeros(n, dtype=U), np.zeros(n, dtype=U)
        rest, used = np.arange(n), 0
        self.slots = np.full(n, -1, dtype=np.int64)
        while len(rest):
            if len(self.levels) == 64:
                raise ValueError("digests of a shard are not distinct")
            size = max(64, 2 * len(rest))
            cell = self._cell(d1[rest], d2[rest], len(self.levels), size)
            alone = np.bincount(cell, minlength=size) == 1
            rank = np.cumsum(alone) - 1
            hit = alone[cell]
            self.slots[rest[hit]] = used + rank[cell[hit]]
            self.levels.append((alone, rank, used))
            used += int(hit.sum())
            rest = rest[~hit]
        if n and not (np.bincount(self.slots, minlength=n) == 1).all():
            raise ValueError("two digests share a slot")
        self.first[self.slots], self.second[self.slots] = d1, d2

    @staticmethod
    def _cell(d1: np.ndarray, d2: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = mix(np.array([level + 1], dtype=U))[0]
        return (mix(mix(d1 ^ seed) + d2) % U(size)).astype(np.int64)

    def find(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 if it is not in the table."""
        out = np.full(len(d1), -1, dtype=np.int64)
        rest = np.arange(len(d1))
        for level, (alone, rank, used) in enumerate(self.levels):
            cell = self._cell(d1[rest], d2[rest], level, len(alone))
            hit = alone[cell]
            slot = used + rank[cell[hit]]
            at = rest[hit]
            same = (self.first[slot] == d1[at]) & (self.second[slot] == d2[at])
            out[at[same]] = slot[same]
            rest = rest[~hit]
        return out


_TOTALS = "d1 bigint, d2 bigint, p1 bigint, p2 bigint, conv_id bigint, depth bigint, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, top boolean"


def _totals(nodes: pd.DataFrame) -> pd.DataFrame:
    """Totals of the subtrees of one shard's nodes.

    ``children``, ``leaves`` and ``saved`` come from subtrees of earlier rounds.
    """
    keys = {c: nodes[c].to_numpy(np.int64).view(U) for c in (*DIGEST, *PARENT)}
    slots = SlotTable(keys["d1"], keys["d2"])
    slot = slots.slots

    def scattered(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), dtype=np.int64)
        out[slot] = values
        return out

    n = scattered(nodes["n_convs"].to_numpy(np.int64))
    depth = scattered(nodes["depth"].to_numpy(np.int64))
    conv = scattered(nodes["conv_id"].to_numpy(np.int64))
    children = scattered(nodes["children"].to_numpy(np.int64))
    leaves = scattered(nodes["leaves"].to_numpy(np.int64))
    saved = scattered(nodes["saved"].to_numpy(np.int64))
    saved += (n - 1) * scattered(nodes["words"].to_numpy(np.int64))
    parent = scattered(np.where(nodes["depth"] > 0, slots.find(keys["p1"], keys["p2"]), -1))
    inner = np.flatnonzero(parent >= 0)
    np.add.at(children, parent[inner], 1)
    leaves[children == 0] = 1
    by_depth = inner[np.argsort(-depth[inner], kind="stable")]
    for own in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        np.add.at(leaves, parent[own], leaves[own])
        np.add.at(saved, parent[own], saved[own])
    p = parent[slot]
    return pd.DataFrame(
        {
            **{c: nodes[c] for c in (*DIGEST, *PARENT, "conv_id", "depth")},
            "parent": pd.array(np.where(p >= 0, conv[np.maximum(p, 0)], 0), dtype="Int64"),
            "n_convs": nodes["n_convs"],
            "n_children": children[slot],
            "n_leaves": leaves[slot],
            "saved": saved[slot],
            "top": p < 0,
        }
    )


def leveled_nodes(paths: DataFrame, convs: DataFrame, fanout: int, band: int) -> DataFrame:
    """Nodes with level, band and the digest of their unit's top."""
    counted = paths.groupBy(*DIGEST, *PARENT, "depth", "words").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where(
        "n_convs > 0"
    )
    root = root.select(
        *(zero.alias(c) for c in (*DIGEST, *PARENT, "depth", "words")), "n_convs", "conv_id"
    )
    level: Column = F.lit(0)
    bound = fanout
    while bound < 1 << 62:
        level = level + (F.col("n_convs") > bound).cast("int")
        bound *= fanout
    nodes = staged(
        counted.unionByName(root)
        .withColumn("level", level)
        .withColumn("band", F.floor(F.col("depth") / band)),
        "nodes",
    )
    # few: their number is at most that of the turns divided by the fanout
    heavy = staged(nodes.where("level > 0").select(*DIGEST, "level"), "heavy-nodes")
    tops = (
        paths.join(heavy, DIGEST, "left")
        .select(
            "conv_id",
            F.coalesce("level", F.lit(0)).alias("level"),
            F.floor(F.col("depth") / band).alias("band"),
            "depth",
            *DIGEST,
        )
        .groupBy("conv_id", "level", "band")
        .agg(F.min(F.struct("depth", *DIGEST)).alias("top"))
    )
    at_root = int((nodes.where("depth = 0").select("level").first() or [0])[0])
    unit = (F.col("band") == 0) & (F.col("level") == at_root)
    placed = nodes.join(tops, ["conv_id", "level", "band"], "left")
    return placed.select(
        *nodes.columns,
        *(F.when(unit, zero).otherwise(F.col(f"top.{c}")).alias(f"u{c[1]}") for c in DIGEST),
    )


def subtree_totals(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes with the totals of their subtrees, round by round."""
    rounds = [
        (r["level"], r["band"], r["n"])
        for r in nodes.groupBy("level", "band").agg(F.count(F.lit(1)).alias("n")).collect()
    ]  # a row for each level (six at most) and band of depths
    done: list[DataFrame] = []
    sent: list[DataFrame] = []
    for level, band, n in sorted(rounds, key=lambda r: (r[0], -r[1])):
        own = nodes.where((F.col("level") == level) & (F.col("band") == band))
        if sent:
            got = union_all(sent).groupBy("d1", "d2").agg(
                *(F.sum(c).alias(c) for c in ("children", "leaves", "saved"))
            )
            own = own.join(got, DIGEST, "left")
        else:
            own = own.withColumns({c: F.lit(0) for c in ("children", "leaves", "saved")})
        zero = F.lit(0).cast("bigint")
        shards = F.lit(max(1, -(-n // shard))).cast("bigint")
        dealt = own.select(
            *DIGEST, *PARENT, "conv_id", "depth", "words", "n_convs",
            *(F.coalesce(F.col(c), zero).cast("bigint").alias(c) for c in ("children", "leaves", "saved")),
            F.pmod(F.xxhash64(F.lit(5), "u1", "u2"), shards).alias("shard"),
        )
        totals = staged(dealt.groupBy("shard").applyInPandas(_totals, _TOTALS), "totals")
        done.append(totals)
        tops = totals.where("top AND depth > 0")
        sent.append(
            tops.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(
                F.count(F.lit(1)).alias("children"),
                F.sum("n_leaves").alias("leaves"),
                F.sum("saved").alias("saved"),
            )
        )
    return union_all(done)


# --- ends ----------------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring ids of one digest joined by commas, up to ``limit`` bytes."""
    key, first, ids, held = None, 0, [], 0
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, [*DIGEST, "first", "ids"])

    for batch in batches:
        for d1, d2, c in zip(*(batch.column(x).to_pylist() for x in (*DIGEST, "conv_id")), strict=True):
            if key != (d1, d2) or held > limit:
                if key is not None:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids, held = (d1, d2), c, [], 0
            text = str(c)
            ids.append(text)
            held += len(text) + 1
        if out:
            yield batch_of(out)
            out = []
    if key is not None:
        yield batch_of([(*key, first, ",".join(ids))])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha = None, None
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, [*DIGEST, "ends_sha256"])

    for batch in batches:
        for d1, d2, ids in zip(*(batch.column(x).to_pylist() for x in (*DIGEST, "ids")), strict=True):
            if key == (d1, d2):
                sha.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, sha.hexdigest()))
            key, sha = (d1, d2), hashlib.sha256(ids.encode())
        if out:
            yield batch_of(out)
            out = []
    if key is not None:
        yield batch_of([(*key, sha.hexdigest())])


def end_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """SHA-256 of the ids that end at each digest."""
    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = staged(
        ends.repartitionByRange(parts, *DIGEST, "conv_id")
        .sortWithinPartitions(*DIGEST, "conv_id")
        .mapInArrow(lambda b: _pieces(b, piece), "d1 bigint, d2 bigint, first bigint, ids string"),
        "pieces",
    )
    return (
        pieces.repartition(*DIGEST)
        .sortWithinPartitions(*DIGEST, "first")
        .mapInArrow(_hashed, "d1 bigint, d2 bigint, ends_sha256 string")
    )


def prefix_trie(
    conversations: DataFrame,
    fanout: int = FANOUT,
    band: int = BAND,
    shard: int = SHARD,
    places: int = PLACES,
    piece: int = PIECE,
) -> DataFrame:
    """The contract's columns for every node of the trie of rebuilt conversations."""
    placed = staged(numbered_turns(turns_of(conversations)), "placed")
    turns, convs = rebuilt(placed)
    paths = staged(prefixes(turns, places), "paths")
    nodes = staged(leveled_nodes(paths, convs, fanout, band), "units")
    totals = staged(subtree_totals(nodes, shard), "trie") if not nodes.isEmpty() else None
    schema = (
        "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
        "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    )
    if totals is None:
        return conversations.sparkSession.createDataFrame([], schema)
    # a top's parent is heavier, or the last depth of the band above
    above = nodes.where(
        (F.col("level") > 0) | ((F.col("depth") + 1) % band == 0) | (F.col("depth") == 0)
    ).select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("above"))
    zero = F.lit(0).cast("bigint")
    last = paths.join(
        convs.select("conv_id", F.col("turns").alias("depth")), ["conv_id", "depth"], "left_semi"
    ).select(*DIGEST, "conv_id")
    ends = last.unionByName(
        convs.where("turns = 0").select(*(zero.alias(c) for c in DIGEST), "conv_id")
    )
    inner = totals.where("NOT top OR depth = 0").withColumn(
        "parent", F.when(F.col("depth") > 0, F.col("parent"))
    )
    tops = totals.where("top AND depth > 0").join(above, PARENT, "left")
    tops = tops.withColumn("parent", F.col("above")).select(*inner.columns)
    return (
        inner.unionByName(tops)
        .join(staged(end_digests(ends, piece), "ends"), DIGEST, "left")
        .select(
            "conv_id",
            "depth",
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
