"""Near-duplicate texts: Jaccard join over word shingles by MinHash banding.

1. Equal texts are one node, reduced map-side, so copies never meet each other.  A node's
   signature has ``TREES`` labels of ``DEPTH`` MinHash values each.
2. Nodes match on a prefix of the labels of a tree, by its hash; no trie is built.  The prefix
   is the same for all nodes: the longest whose chance to meet in some tree, 1 - (1 -
   s^d)^TREES at similarity s, reaches the target recall (4 of 5 for 0.8 and 0.9999).  Nodes
   that share a prefix form a bucket; buckets with the same members in several trees are
   kept once.
3. Buckets are verified whole and exactly, on 64-bit shingle hashes, in blocks: a bucket of
   m nodes is cut into pieces of about ``PIECE`` nodes and each pair of pieces is a group
   of its own.  A group counts links and returns, per node, its number of links and one
   edge towards a smaller node; pairs are never written out.  A pair that meets in several
   buckets counts in the one with the smallest number only.
4. Edges are closed to components by label propagation with pointer jumping; labels are
   written to the shared folder after every round.

Texts with fewer words than a shingle are one shingle.  Defined results: null and empty
texts and texts without words have no shingles, they link to nothing and are their own
class; rows without an id are returned without a class; rows that repeat an id stand for one
document if their texts are equal, and else link like any two texts.  An empty table gives
an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import column_or_null, staged, table
from logharbor.llm.textcode import U, Texts, distinct_by_text, mix
from logharbor.llm.tokens import blocks_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH, SIMILARITY = 5, 0.8
TREES, DEPTH, RECALL = 20, 5, 0.9999
PIECE = 256
#: Shingles compared at once.
SLAB = 8192


def _multipliers(seed: int) -> np.ndarray:
    return mix(np.arange(1, TREES * DEPTH + 1, dtype=U) + U(seed << 20)) | U(1)


def _signatures(
    batches: Iterator[pa.RecordBatch], width: int, seed: int
) -> Iterator[pa.RecordBatch]:
    factors = _multipliers(seed)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in blocks_of(texts, 1_000_000):
            own = texts[part]
            text, h = Texts(own).shingles(width)
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            full = text[starts]
            labels = np.zeros((len(own), TREES * DEPTH), dtype="<u4")
            if len(starts):
                for j, factor in enumerate(factors):
                    low = np.minimum.reduceat((h * factor) >> U(32), starts)
                    labels[full, j] = low.astype(np.uint32)
            has = np.zeros(len(own), dtype=bool)
            has[full] = True
            rows = [r.tobytes() if ok else None for r, ok in zip(labels, has, strict=True)]
            ids, node = (batch.column(c).slice(part.start, len(own)) for c in ("doc_id", "node"))
            yield pa.RecordBatch.from_arrays(
                [ids, node, pa.array(rows, pa.binary())], ["doc_id", "node", "labels"]
            )


def keyed_texts(docs: DataFrame, *beside: Column) -> DataFrame:
    """``beside``, doc_id, text and node (16 bytes of the text's SHA-256) of each row."""
    text = F.coalesce(column_or_null(docs, "text", "string"), F.lit(""))
    return docs.select(
        *beside,
        column_or_null(docs, "doc_id", "bigint").alias("doc_id"),
        text.alias("text"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("node"),
    )


def signatures(docs: DataFrame, width: int = WIDTH, seed: int = 2) -> DataFrame:
    """doc_id, node (digest of the text) and labels (null without shingles)."""
    return keyed_texts(docs).mapInArrow(
        lambda batches: _signatures(batches, width, seed),
        "doc_id bigint, node binary, labels binary",
    )


def prefix_depth(similarity: float, recall: float) -> int:
    """Longest prefix on which texts of this similarity still meet with this chance."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - similarity**depth) ** TREES < recall:
        depth -= 1
    return depth


def buckets(nodes: DataFrame, depth: int) -> DataFrame:
    """node, bucket, size: nodes that share a prefix; equal member sets only once."""
    label = 4 * DEPTH
    places = F.array(
        *(
            F.xxhash64(F.lit(t), F.substring(F.col("labels"), t * label + 1, 4 * depth))
            for t in range(TREES)
        )
    )
    spread = nodes.select("node", F.explode(places).alias("place"))
    shared = (
        spread.groupBy("place")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
        )
        .where(F.col("size") > 1)
    )
    # equal sizes and two equal 64-bit sums: the same members, kept under one number
    once = staged(
        shared.groupBy("size", "x", "y").agg(F.min("place").alias("place")).select("place", "size"),
        "buckets",
    )
    return staged(spread.join(once, "place").distinct(), "members")


def _shingle_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in blocks_of(texts, 1_000_000):
            own = texts[part]
            text, h = distinct_by_text(*Texts(own).shingles(width))
            cuts = np.searchsorted(text, np.arange(len(own) + 1))
            node = batch.column("node").slice(part.start, len(own))
            sets = [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [node, pa.array(sets, pa.binary())], ["node", "shingles"]
            )


def _shared(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of ``n`` owners share; values of one owner are distinct."""
    out = np.zeros((n, n), dtype=np.float32)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    common = times[column] > 1  # a value of one owner only cannot be shared
    owner, column = owner[common], number[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        own = slice(np.searchsorted(column, first), np.searchsorted(column, first + SLAB))
        grid = np.zeros((n, SLAB), dtype=np.float32)
        grid[owner[own], column[own] - first] = 1
        out += grid @ grid.T
    return out


def _links(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between the two pieces (or inside the one piece) of a bucket."""
    bucket = int(pdf["bucket"].iloc[0])
    pdf = pdf.sort_values(["node", "side"]).drop_duplicates("node")
    inner = pdf["inner"].iloc[0]
    sets = [np.frombuffer(s, dtype=U) for s in pdf["shingles"]]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    both = _shared(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets))
    linked = both >= similarity / (1 + similarity) * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(linked, False)
    if not inner:
        side = pdf["side"].to_numpy()
        linked &= side[:, None] != side[None, :]
    # a pair counts in the smallest bucket that holds both
    own = [np.asarray(b, dtype=np.int64) for b in pdf["all_buckets"]]
    smaller = [b[b < bucket] for b in own]
    owner = np.repeat(np.arange(len(own)), [len(b) for b in smaller])
    linked &= _shared(np.concatenate(smaller), owner, len(own)) == 0
    counts = linked.sum(axis=1)
    found = np.flatnonzero(counts)
    # smallest node each one reaches inside this group
    root = np.arange(len(sets))
    while True:
        low = np.where(linked, root[None, :], len(sets)).min(axis=1)
        now = np.minimum(root, low)
        now = now[now]
        if (now == root).all():
            break
        root = now
    nodes = pdf["node"].to_numpy()
    return pd.DataFrame(
        {"node": nodes[found], "n_links": counts[found], "root": nodes[root[found]]}
    )


def verify(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """node, n_links, root: exact links inside the buckets, piece by piece."""
    homes = members.groupBy("node").agg(F.sort_array(F.collect_set("place")).alias("all_buckets"))
    known = homes.join(sets, "node")
    pieces = F.ceil(F.col("size") / PIECE).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("pieces").cast("bigint")).cast("int")
    spread = (
        members.withColumn("pieces", pieces)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .select(
            "node",
            F.col("place").alias("bucket"),
            F.least("own", "other").alias("a"),
            F.greatest("own", "other").alias("b"),
            F.col("own").alias("side"),
            (F.col("pieces") == 1).alias("whole"),
        )
    )
    grouped = spread.join(known, "node").withColumn("inner", F.col("a") == F.col("b"))
    return grouped.groupBy("bucket", "a", "b").applyInPandas(
        lambda pdf: _links(pdf, similarity), "node binary, n_links bigint, root binary"
    )


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component of (node, root) edges."""
    both = staged(
        edges.select(F.col("node").alias("u"), F.col("root").alias("v"))
        .unionByName(edges.select(F.col("root").alias("u"), F.col("node").alias("v")))
        .where(F.col("u") != F.col("v"))
        .distinct(),
        "edges",
    )
    labels = staged(
        both.groupBy("u").agg(F.min("v").alias("v")).select(
            F.col("u").alias("node"), F.least("u", "v").alias("label")
        ),
        "labels",
    )
    while True:
        near = (
            both.join(labels, both["v"] == labels["node"])
            .groupBy("u")
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, labels["node"] == near["u"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        moved = staged(
            lower.join(jump, lower["label"] == jump["at"], "left").select(
                "node", "old", F.least("label", "beyond").alias("label")
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if not moved.where(F.col("label") != F.col("old")).limit(1).count():
            return labels


def _classed(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    width: int = WIDTH,
    recall: float = RECALL,
    seed: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and class and links of each text that has words and an id."""
    signed = staged(signatures(docs, width, seed), "signatures")
    nodes = staged(
        signed.where(F.col("doc_id").isNotNull() & F.col("labels").isNotNull())
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("copy_of"),
            F.count(F.lit(1)).alias("n_copies"),
            F.min("labels").alias("labels"),
        ),
        "nodes",
    )
    members = buckets(nodes, prefix_depth(similarity, recall))
    wanted = staged(
        nodes.join(members.select("node").distinct(), "node", "left_semi").select(
            F.col("copy_of").alias("wanted")
        ).distinct(),
        "wanted",
    )
    # sorted at every size: a plan that changes with the table would not scale as it is measured
    texts = keyed_texts(docs).join(
        wanted.hint("merge"), F.col("doc_id") == F.col("wanted"), "left_semi"
    )
    sets = (
        texts.select("text", "node")
        .mapInArrow(lambda b: _shingle_rows(b, width), "node binary, shingles binary")
        .dropDuplicates(["node"])
    )
    links = staged(verify(members, staged(sets, "sets"), similarity), "links")
    labels = components(links.select("node", "root").distinct())
    counts = links.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    placed = nodes.select("node", "copy_of", "n_copies").join(labels, "node", "left")
    placed = placed.withColumn("label", F.coalesce("label", "node"))
    placed = staged(placed, "placed")
    # written, so that the join with a label that many nodes share can be split
    classes = staged(placed.groupBy("label").agg(F.min("copy_of").alias("class_id")), "smallest")
    known = staged(
        placed.join(classes, "label")
        .join(counts, "node", "left")
        .select("node", "label", "class_id", "copy_of", "n_copies", "n_links"),
        "classes",
    )
    return signed, known


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    width: int = WIDTH,
    recall: float = RECALL,
    seed: int = 2,
) -> DataFrame:
    """doc_id, class_id, copy_of, n_copies, n_links of each row of ``docs``.

    ``class_id`` is the smallest id among all documents connected by links or equal texts,
    ``copy_of`` the smallest among equal texts, ``n_copies`` the number of rows with this text and
    ``n_links`` the number of other texts with at least ``similarity``.
    """
    signed, known = _classed(docs, similarity, width, recall, seed)
    # texts without words are not nodes: each is its own class
    return signed.select("doc_id", "node", F.col("labels").isNotNull().alias("has")).join(
        known.drop("label").withColumn("has", F.lit(True)), ["node", "has"], "left"
    ).select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("copy_of", "doc_id")).alias("copy_of"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` of each class: of its smallest id, and there of the smallest node.

    A row is known by id, node and its number among the rows that share both; of these one
    stays, whichever.  Rows without an id are in no class, one of each text stays; so does one
    row of each id and text without words.
    """
    signed, known = _classed(docs, **how)
    keys = staged(
        signed.groupBy("doc_id", "node").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.col("labels").isNotNull()).alias("has")
        ),
        "keys",
    )
    first = known.groupBy("label").agg(F.min(F.struct("copy_of", "node")).alias("first"))
    kept = first.select(F.col("first.copy_of").alias("doc_id"), F.col("first.node").alias("node"))
    others = keys.where("has AND doc_id IS NOT NULL").join(kept, ["doc_id", "node"], "left_anti")
    gone = staged(
        others.select(F.col("doc_id").alias("gone_id"), F.col("node").alias("gone_node")), "gone"
    )
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("node") == F.col("gone_node"))
    repeated = staged(
        keys.where("n > 1").join(gone, same, "left_anti").select(
            F.col("doc_id").alias("gone_id"), F.col("node").alias("gone_node")
        ),
        "repeated",
    )
    rows = keyed_texts(docs, F.struct("*").alias("row")).drop("text")
    if repeated.isEmpty():
        return rows.join(gone.hint("merge"), same, "left_anti").select("row.*")
    alone = rows.join(gone.unionByName(repeated).hint("merge"), same, "left_anti")
    # staged, so that the rows of a frequent key are reduced where they lie before they meet
    several = staged(rows.join(repeated, same, "left_semi"), "several")
    one = several.groupBy("doc_id", "node").agg(F.first("row").alias("row"))
    return alone.select("row.*").unionByName(one.select("row.*"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
