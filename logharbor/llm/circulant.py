"""Near-duplicate documents by circulant MinHash.

1. Two permutations of 32-bit numbers make all coordinates of a signature: the first scatters a
   text's shingle hashes, the second, shifted circularly by k, ranks them for coordinate k,
   h_k = min over x of second(first(x) + k mod 2**32).
2. Texts with equal shingle sets are one node, reduced in every task before the shuffle.
   ``BANDS`` bands of ``ROWS`` coordinates each put nodes into buckets; buckets with the same
   members are kept once.
3. Links are confirmed on whole sets, in two rounds.  First every member of a bucket meets
   the bucket's first node (its pivot); a pivot that very many share is copied to groups of
   ``STAR`` members.  What is linked then is one component, so a bucket of near copies is done
   with one comparison a member.
4. Only buckets whose members are still in several components are looked at again, whole: they
   are cut into pieces of about ``PIECE`` nodes by component and by length of the set, and
   pieces meet in pairs, unless they are of one component or of lengths that can't reach the
   similarity.  No pair that shares a bucket and might join two components is left out.
5. Components are closed by label propagation.

Two texts at the similarity asked for share a band with a chance of 1 - (1 - 0.8**4)**25, which
is 0.999998.  The second round's work in one bucket grows with the square of the members
that are near each other in length and yet not linked.

Defined results: texts are split at ASCII white space and lower-cased in A-Z only; a text with
fewer words than a shingle is one shingle; null and empty texts and texts without words
have no shingles and are linked with nothing, not even each other.  Every row is a document:
rows that repeat an id are linked by their texts only, and all of them are kept if their id
is the component's.  Rows without an id link nothing, have no component and are kept.  An empty
table gives an empty result.  Only doc_id and text are read.  Equality of shingles is that of
64-bit hashes.
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
from pyspark.sql import functions as F

from logharbor.llm.common import column_or_null, staged, table
from logharbor.llm.ngram_join import components
from logharbor.llm.textcode import U, Texts, distinct_by_text, mix
from logharbor.llm.tokens import blocks_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH, PERCENT = 4, 80
BANDS, ROWS = 25, 4
#: Members of a pivot's group, and nodes of a piece, about.
STAR, PIECE = 512, 256
#: Shingles compared at once.
SLAB = 8192
_U4 = np.uint32


# --- signatures ----------------------------------------------------------------------------


def first_permutation(h: np.ndarray, seed: int) -> np.ndarray:
    """32-bit places of 64-bit shingle hashes."""
    return (mix(h ^ U(seed)) >> U(32)).astype(_U4)


def second_permutation(x: np.ndarray) -> np.ndarray:
    """A permutation of all 32-bit numbers (odd factors and shifts can be undone)."""
    x = x ^ (x >> _U4(16))
    x *= _U4(0x85EBCA6B)
    x ^= x >> _U4(13)
    x *= _U4(0xC2B2AE35)
    x ^= x >> _U4(16)
    return x


def coordinates(text: np.ndarray, h: np.ndarray, n: int, count: int, seed: int) -> np.ndarray:
    """``count`` coordinates of each text that has shingles; ``text`` is sorted."""
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    placed = first_permutation(h, seed)
    out = np.zeros((n, count), dtype=_U4)
    for k in range(count if len(starts) else 0):
        out[text[starts], k] = np.minimum.reduceat(second_permutation(placed + _U4(k)), starts)
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit hash of each band of each signature."""
    out = np.empty((len(signature), bands), dtype=U)
    for b in range(bands):
        h = np.full(len(signature), U(b + 1))
        for r in range(rows):
            h = mix(h + signature[:, b * rows + r].astype(U))
        out[:, b] = h
    return out


def _sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text, and where each text's begin."""
    lower = [t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for t in texts]
    text, h = distinct_by_text(*Texts(lower).shingles(width))
    return text, h, np.searchsorted(text, np.arange(len(texts) + 1))


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signed_rows(
    docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS, seed: int = 11
) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set) and bands; the last two null without shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in blocks_of(texts, 1_000_000):
                own = texts[part]
                text, h, cuts = _sets(own, width)
                sizes = np.diff(cuts)
                keys = band_hashes(coordinates(text, h, len(own), bands * rows, seed), bands, rows)
                has = sizes > 0
                nodes = [_node(h[a:b]) if b > a else None for a, b in zip(cuts, cuts[1:], strict=False)]
                packed = [k.tobytes() if ok else None for k, ok in zip(keys, has, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, len(own)),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(nodes, pa.binary()),
                        pa.array(packed, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "node", "bands"],
                )

    return _texts(docs).mapInArrow(
        sign, "doc_id bigint, n_shingles bigint, node binary, bands binary"
    )


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        column_or_null(docs, "doc_id", "bigint").alias("doc_id"),
        F.coalesce(column_or_null(docs, "text", "string"), F.lit("")).alias("text"),
    )


# --- buckets -------------------------------------------------------------------------------


def buckets(nodes: DataFrame, bands: int) -> DataFrame:
    """node, n_shingles, bucket, pivot: nodes that share a band; equal member sets only once."""
    places = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.xxhash64(b, F.substring(F.col("bands"), b * 8 + 1, F.lit(8))),
    )
    spread = nodes.select("node", "n_shingles", F.explode(places).alias("bucket"))
    shared = (
        spread.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"),
        )
        .where(F.col("size") > 1)
    )
    once = staged(
        shared.groupBy("size", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"),
        "buckets",
    )
    members = staged(spread.join(once, "bucket").distinct(), "members")
    pivots = staged(members.groupBy("bucket").agg(F.min("node").alias("pivot")), "pivots")
    return members.join(pivots, "bucket")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and shingles (sorted 64-bit hashes) of one document of each wanted node.

    ``wanted`` has one doc_id a node.  The join is sorted at every size, so texts travel once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in blocks_of(texts, 1_000_000):
                _, h, cuts = _sets(texts[part], width)
                sets = [h[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_node(s) for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    ["node", "shingles"],
                )

    ids = wanted.select("doc_id").distinct()
    texts = _texts(docs).join(ids.hint("merge"), "doc_id", "left_semi").select("text")
    found = texts.mapInArrow(rows, "node binary, shingles binary")
    return found.dropDuplicates(["node"])


# --- confirmation --------------------------------------------------------------------------


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """100 * intersection >= percent * union, in whole numbers."""
    return (100 + percent) * common >= percent * (a + b)


def _against_pivot(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted runs: a pivot, then the members that meet it."""
    pivot, own = None, np.empty(0, dtype=U)
    for batch in batches:
        out: list[tuple[bytes, bytes]] = []
        names = ("pivot", "node", "shingles")
        for p, node, raw in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            s = np.frombuffer(raw, dtype=U)
            if node is None:
                pivot, own = p, s
                continue
            if p != pivot:
                raise ValueError("a group came without its pivot")
            if percent * max(len(s), len(own)) > 100 * min(len(s), len(own)):
                continue
            both = np.concatenate([own, s])
            both.sort(kind="stable")  # two sorted runs: merged
            common = np.int64((both[1:] == both[:-1]).sum())
            if linked(common, len(own), len(s), percent):
                out.append((node, p))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in out], pa.binary()) for i in range(2)], ["node", "root"]
        )


def star_links(members: DataFrame, sets: DataFrame, percent: int, star: int) -> DataFrame:
    """node, root: members linked with the pivot of one of their buckets."""
    pairs = staged(
        members.where(F.col("node") != F.col("pivot")).select("node", "pivot").distinct(), "pairs"
    )
    groups = staged(
        pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / star).cast("bigint").alias("groups")),
        "pivot-groups",
    )
    part = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("groups"))
    of_members = (
        pairs.join(groups, "pivot").withColumn("part", part).join(sets.hint("merge"), "node")
    )
    of_pivots = groups.withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1))
    ).join(sets.withColumnRenamed("node", "pivot").hint("merge"), "pivot")
    columns = ["pivot", "part", "node", "shingles"]
    both = of_members.select(*columns).unionByName(
        of_pivots.withColumn("node", F.lit(None).cast("binary")).select(*columns)
    )
    return (
        both.repartition("pivot", "part")
        .sortWithinPartitions("pivot", "part", F.col("node").asc_nulls_first())
        .select("pivot", "node", "shingles")
        .mapInArrow(lambda b: _against_pivot(b, percent), "node binary, root binary")
    )


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    number = np.cumsum(several) - 1
    common = several[column]
    owner, column = owner[common], number[column[common]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, SLAB):
        own = slice(np.searchsorted(column, first), np.searchsorted(column, first + SLAB))
        grid = np.zeros((n, SLAB), dtype=np.float32)
        grid[owner[own], column[own] - first] = 1
        out += grid @ grid.T
    return out.astype(np.int64)  # exact: sums of ones below 2**24


def _between(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """A tree of the links that join the components met in one group."""
    pdf = pdf.drop_duplicates("node")
    sets = [np.frombuffer(s, dtype=U) for s in pdf["shingles"]]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    ok = linked(_common(sets), sizes[:, None], sizes[None, :], percent)
    labels, names = pd.factorize(pdf["label"])
    ok &= labels[:, None] != labels[None, :]
    i, j = np.nonzero(np.triu(ok))
    root = list(range(len(names)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for at in range(len(i)):
        a, b = top(labels[i[at]]), top(labels[j[at]])
        if a != b:
            root[a] = b
            keep.append(at)
    nodes = pdf["node"].to_numpy()
    return pd.DataFrame({"node": nodes[i[keep]], "root": nodes[j[keep]]})


def residual_links(
    members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, piece: int
) -> DataFrame:
    """node, root: links between components that still share a bucket."""
    held = staged(
        members.select("bucket", "node", "n_shingles")
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node")),
        "labelled",
    )
    open_ = staged(
        held.groupBy("bucket")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low <> high")
        .select("bucket"),
        "open-buckets",
    )
    # lengths of one class or of neighbouring ones can be near enough: ratio 0.8 at least
    step = float(np.log(100 / percent)) if percent < 100 else 1e-9
    rows = held.join(open_, "bucket").withColumn(
        "length", F.floor(F.log("n_shingles") / step + 1e-9).cast("int")
    )
    large = staged(
        rows.groupBy("bucket", "length", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= piece),
        "large-components",
    )
    alone = rows.join(large.select("bucket", "length", "label", "n"), ["bucket", "length", "label"], "left")
    # a component that fills pieces has its own; the others of a length share theirs
    of = F.when(F.col("n").isNotNull(), F.col("label"))
    shares = staged(alone.withColumn("own", of), "shares")
    counts = shares.groupBy("bucket", "length", "own").agg(
        F.ceil(F.count(F.lit(1)) / piece).cast("bigint").alias("pieces"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
    )
    counts = staged(counts, "pieces")
    dealt = staged(
        shares.join(
            counts.select(
                F.col("bucket").alias("b"), F.col("length").alias("l"), F.col("own").alias("o"), "pieces"
            ),
            (F.col("bucket") == F.col("b"))
            & (F.col("length") == F.col("l"))
            & F.col("own").eqNullSafe(F.col("o")),
        ).select(
            "bucket",
            "node",
            "label",
            F.xxhash64(
                "length", "own", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("pieces"))
            ).alias("piece"),
        ),
        "dealt",
    )
    one = counts.withColumn("number", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    one = one.select("bucket", "length", "low", "high", F.xxhash64("length", "own", "number").alias("piece"))
    other = one.select(
        F.col("bucket"), *(F.col(c).alias(f"{c}2") for c in ("length", "low", "high", "piece"))
    )
    several = (F.col("low") != F.col("high")) | (F.col("low2") != F.col("high2")) | (
        F.col("low") != F.col("low2")
    )
    meetings = (
        one.join(other, "bucket")
        .where(
            (F.abs(F.col("length") - F.col("length2")) <= 1)
            & ((F.col("piece") < F.col("piece2")) | ((F.col("piece") == F.col("piece2")) & several))
            & several
        )
        .select("bucket", "piece", "piece2")
    )
    meetings = staged(meetings, "meetings")
    sides = meetings.select("bucket", "piece", "piece2", F.col("piece").alias("at")).unionByName(
        meetings.where("piece <> piece2").select("bucket", "piece", "piece2", F.col("piece2").alias("at"))
    )
    met = sides.join(
        dealt.select("bucket", F.col("piece").alias("at"), "node", "label"), ["bucket", "at"]
    )
    return (
        met.join(sets.hint("merge"), "node")
        .groupBy("bucket", "piece", "piece2")
        .applyInPandas(lambda pdf: _between(pdf, percent), "node binary, root binary")
    )


# --- components ----------------------------------------------------------------------------


def near_copies(
    docs: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 11,
    star: int = STAR,
    piece: int = PIECE,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs``."""
    signed = staged(signed_rows(docs, width, bands, rows, seed), "circulant")
    with_sets = signed.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = staged(
        with_sets.groupBy("node", "n_shingles").agg(
            F.min("doc_id").alias("first_id"), F.min("bands").alias("bands")
        ),
        "nodes",
    )
    members = staged(buckets(nodes, bands), "bucket-members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    sets = staged(
        shingle_sets(docs, wanted.select(F.col("first_id").alias("doc_id")), width), "sets"
    )
    links = staged(star_links(members, sets, percent, star), "star-links")
    labels = components(links)
    rest = staged(residual_links(members, labels, sets, percent, piece), "residual-links")
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))
    placed = staged(
        nodes.select("node", "first_id")
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node")),
        "placed",
    )
    smallest = staged(
        placed.groupBy("label").agg(F.min("first_id").alias("component_id")), "components"
    )
    known = staged(placed.join(smallest, "label").select("node", "component_id"), "known")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept: Column = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    return (
        signed.select("doc_id", "n_shingles", "node")
        .join(known, "node", "left")
        .select("doc_id", "n_shingles", own.alias("component_id"))
        .select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
    )


def op11_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return near_copies(table(spark, sf_dir, "documents"))
