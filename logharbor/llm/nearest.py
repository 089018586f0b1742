"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more coordinate, so that all have
norm 1 and the largest inner product is the smallest Euclidean distance.  Each table
projects them onto Gaussian (2-stable) directions and cuts every projection into slots of
width ``width``; the slots together name the bucket.  A query visits buckets in the order of
their estimated success: given that a neighbour has similarity s to the query, each of
its projections is normal with mean s times the query's and variance 1 - s * s.

s and the share of estimated success to visit are set per vector length from pilot queries
(``pilots`` of each length, a documented bound), whose true neighbours are found by brute
force over all rows: the share is the one that reaches ``recall`` of them, at every size of the
table.  Every row is indexed and every visited bucket is searched whole; candidates are reranked by the exact inner
product in double precision.  Queries that are left with fewer than ``k`` results search all
buckets in a second round.

Equal vectors form one class, reduced in every task before the shuffle to the smallest
``k + 1`` ids, which is all that ties to the smaller id can ever return; so a vector that
a third of all rows repeat is one entry.  Buckets with more than ``CELL`` classes are cut
into cells, and cells are dealt to blocks of bounded size.  A query reaches a block once,
with the list of cells to search there.  Queries are dealt to shares of about ``ASKING``, and
a block is searched for each share by itself, ``SCORES`` scores at a time, so neither the
queries nor the scores a task holds grow with the table.  As more than half of all buckets
are visited, the pairs scored grow with queries times classes, and so do the copies sent.

Defined results: vectors that are null, zero or hold null or non-finite components take no
part, nor do rows without an id; vectors of different lengths never meet; a query never
returns its own id; with ``k`` or fewer candidates all of them are returned.  Rows that repeat
an id with the same vector count once.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logharbor.llm.common import column_or_null, staged, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 20
TABLES, FUNCTIONS, SLOTS, WIDTH = 2, 6, 3, 1.2
#: Classes in a cell at most, and in a block about.
CELL, BLOCK = 4096, 16_384
#: Queries that search a block in one task, about.
ASKING = 4096
#: Scores a task holds at once.
SCORES = 1 << 20
#: Candidate pairs a task gathers before it keeps the best.
HELD = 200_000

_CLASS = "key binary, dim int, vector binary, ids array<bigint>"


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(
        "vector",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    return (
        vectors.select(column_or_null(vectors, "vec_id", "bigint").alias("vec_id"), v.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .where(finite & F.exists("vector", lambda x: x != 0.0))
    )


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for pdf in batches:
        blobs = [np.asarray(v, dtype="<f8").tobytes() for v in pdf["vector"]]
        yield pd.DataFrame(
            {
                "vec_id": pdf["vec_id"],
                "key": [hashlib.blake2b(b, digest_size=16).digest() for b in blobs],
                "vector": blobs,
            }
        )


def _local_classes(batches: Iterator[pd.DataFrame], keep: int) -> Iterator[pd.DataFrame]:
    held: dict[bytes, tuple[bytes, np.ndarray]] = {}
    for pdf in batches:
        for key, group in pdf.groupby("key", sort=False):
            vector, ids = held.get(key, (group["vector"].iloc[0], np.empty(0, dtype=np.int64)))
            held[key] = vector, np.unique(np.concatenate([ids, group["vec_id"].to_numpy()]))[:keep]
        if len(held) > 100_000:
            yield _class_rows(held)
            held = {}
    if held:
        yield _class_rows(held)


def _class_rows(held: dict[bytes, tuple[bytes, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "key": list(held),
            "dim": np.array([len(v) // 8 for v, _ in held.values()], dtype=np.int32),
            "vector": [v for v, _ in held.values()],
            "ids": [i.tolist() for _, i in held.values()],
        }
    )


def vector_classes(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector with its smallest ids."""
    local = rows.mapInPandas(lambda batches: _local_classes(batches, keep), _CLASS)
    return local.groupBy("key").agg(
        F.first("dim").alias("dim"),
        F.first("vector").alias("vector"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias(
            "ids"
        ),
    )


class Hashes:
    """The hash functions of all tables for vectors of one length."""

    def __init__(self, dim: int, seed: int, longest: float):
        rng = np.random.default_rng([seed, dim])
        self.longest = longest
        self.directions = rng.normal(size=(TABLES, dim + 1, FUNCTIONS))
        inner = (np.arange(SLOTS - 1) - (SLOTS - 2) / 2) * WIDTH
        shift = rng.uniform(-WIDTH / 6, WIDTH / 6, size=(TABLES, FUNCTIONS, 1))
        self.edges = inner + shift
        self.places = SLOTS ** np.arange(FUNCTIONS)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Scaled rows with the coordinate that makes their norm 1."""
        y = x / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", y, y)))
        return np.hstack([y, rest[:, None]])

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table."""
        y = self.lifted(x)
        out = np.empty((len(x), TABLES), dtype=np.int32)
        for t in range(TABLES):
            p = y @ self.directions[t]
            slots = (p[:, :, None] >= self.edges[t][None]).sum(axis=2)
            out[:, t] = slots @ self.places
        return out

    def success(self, queries: np.ndarray, similarity: float) -> np.ndarray:
        """Chance of each bucket of each table to hold a neighbour of each query."""
        norms = np.linalg.norm(queries, axis=1, keepdims=True)
        y = np.hstack([queries / norms, np.zeros((len(queries), 1))])
        spread = math.sqrt(max(1e-6, 1.0 - similarity * similarity))
        out = np.empty((TABLES, len(y), SLOTS**FUNCTIONS))
        cdf = np.vectorize(math.erf)
        for t in range(TABLES):
            p = y @ self.directions[t]
            edges = (self.edges[t][None] - similarity * p[:, :, None]) / spread
            below = 0.5 * (1 + cdf(edges / math.sqrt(2)))
            ends = np.zeros((*below.shape[:2], 1))
            slots = np.diff(np.concatenate([ends, below, ends + 1], axis=2), axis=2)
            chance = slots[:, 0]
            for j in range(1, FUNCTIONS):
                chance = (slots[:, j][:, :, None] * chance[:, None, :]).reshape(len(y), -1)
            out[t] = chance
        return out

    @staticmethod
    def visited_before(chance: np.ndarray) -> np.ndarray:
        """For each bucket, the estimated success of those visited before it."""
        order = np.argsort(-chance, axis=1, kind="stable")
        ranked = np.take_along_axis(chance, order, 1)
        before = np.cumsum(ranked, axis=1) - ranked
        out = np.empty_like(chance)
        np.put_along_axis(out, order, before, 1)
        return out


def _matrix(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)


def _pilot_search(
    batches: Iterator[pd.DataFrame], pilots: dict[int, np.ndarray], k: int
) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for dim, group in pdf.groupby("dim"):
            if dim not in pilots:
                continue
            scores = pilots[dim] @ _matrix(group["vector"]).T
            best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
            rows = np.repeat(np.arange(len(best)), best.shape[1])
            picked = group.iloc[best.ravel()]
            yield pd.DataFrame(
                {
                    "dim": np.full(len(rows), dim, dtype=np.int32),
                    "pilot": rows.astype(np.int32),
                    "score": scores[rows, best.ravel()],
                    "vector": picked["vector"].to_numpy(),
                    "ids": picked["ids"].to_numpy(),
                }
            )


def _first_of_length(batches: Iterator[pd.DataFrame], pilots: int) -> Iterator[pd.DataFrame]:
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf])
        held = held.sort_values("key").groupby("dim").head(pilots)
    if held is not None:
        yield held


def calibrate(
    classes: DataFrame, queries: DataFrame, longest: dict[int, float], k: int, seed: int,
    pilots: int, recall: float,
) -> dict[int, tuple[float, float]]:
    """Similarity of far neighbours and the share of success to visit, from pilot queries.

    ``queries`` has the lengths to calibrate; one without pilots is not in the result.
    """
    # keys are digests, so the smallest are drawn at random
    local = queries.select("key", "dim", "vector").mapInPandas(
        lambda batches: _first_of_length(batches, pilots), "key binary, dim int, vector binary"
    )
    drawn = F.row_number().over(W.partitionBy("dim").orderBy("key"))
    chosen = (
        local.withColumn("drawn", drawn)
        .where(F.col("drawn") <= pilots)
        .select("dim", "vector")
        .collect()  # ``pilots`` vectors a length
    )
    if not chosen:
        return {}
    by_dim: dict[int, list[bytes]] = {}
    for row in chosen:
        by_dim.setdefault(row["dim"], []).append(bytes(row["vector"]))
    known = {d: _matrix(pd.Series(v)) for d, v in by_dim.items()}
    found = classes.mapInPandas(
        lambda batches: _pilot_search(batches, known, k),
        "dim int, pilot int, score double, vector binary, ids array<bigint>",
    ).withColumn("vec_id", F.explode("ids"))
    place = F.row_number().over(W.partitionBy("dim", "pilot").orderBy(F.desc("score"), "vec_id"))
    best = (
        found.withColumn("place", place)
        .where(F.col("place") <= k + 1)
        .select("dim", "pilot", "score", "vector")
        .collect()  # k + 1 rows a pilot
    )
    of_dim: dict[int, list] = {}
    for r in best:
        of_dim.setdefault(r["dim"], []).append(r)
    out = {}
    for dim, own in of_dim.items():
        q = known[dim]
        who = np.array([r["pilot"] for r in own])
        score = np.array([r["score"] for r in own])
        ratio = score / (np.linalg.norm(q[who], axis=1) * longest[dim])
        similarity = float(np.clip(np.quantile(ratio, 0.1), 0.05, 0.95))
        hashes = Hashes(dim, seed, longest[dim])
        before = [Hashes.visited_before(c) for c in hashes.success(q, similarity)]
        at = hashes.buckets(_matrix(pd.Series([bytes(r["vector"]) for r in own])))
        needed = np.min([before[t][who, at[:, t]] for t in range(TABLES)], axis=0)
        out[dim] = similarity, min(1.0, float(np.quantile(needed, recall)) + 1e-9)
    return out


def _cells(
    batches: Iterator[pd.DataFrame], longest: dict[int, float], seed: int
) -> Iterator[pd.DataFrame]:
    hashes: dict[int, Hashes] = {}
    for pdf in batches:
        for dim, group in pdf.groupby("dim"):
            h = hashes.setdefault(dim, Hashes(dim, seed, longest[dim]))
            at = h.buckets(_matrix(group["vector"]))
            for t in range(TABLES):
                yield pd.DataFrame(
                    {
                        "dim": group["dim"],
                        "bucket": (at[:, t] * TABLES + t).astype(np.int32),
                        "vector": group["vector"],
                        "ids": group["ids"],
                    }
                )


def _probes(
    batches: Iterator[pd.DataFrame], longest: dict[int, float], seed: int,
    shares: dict[int, tuple[float, float]], cut: dict[tuple[int, int], int], blocks: int,
) -> Iterator[pd.DataFrame]:
    hashes: dict[int, Hashes] = {}
    for pdf in batches:
        for dim, group in pdf.groupby("dim"):
            h = hashes.setdefault(dim, Hashes(dim, seed, longest[dim]))
            for at in range(0, len(group), 256):
                part = group.iloc[at : at + 256]
                if dim in shares:
                    similarity, share = shares[dim]
                    chances = h.success(_matrix(part["vector"]), similarity)
                    visit = [Hashes.visited_before(c) <= share for c in chances]
                else:  # everything, and the first table holds every class
                    visit = [np.ones((len(part), SLOTS**FUNCTIONS), dtype=bool)]
                sent: list[tuple] = []
                for i in range(len(part)):
                    cells = [
                        (int(b) * TABLES + t, p)
                        for t in range(len(visit))
                        for b in np.flatnonzero(visit[t][i])
                        for p in range(cut.get((dim, int(b) * TABLES + t), 1))
                    ]
                    of_block: dict[int, list[tuple[int, int]]] = {}
                    for cell in cells:
                        of_block.setdefault(_block(dim, *cell, blocks), []).append(cell)
                    key, vector = part["key"].iloc[i], part["vector"].iloc[i]
                    sent += [
                        (block, dim, key, vector, np.array(own, dtype="<i4").tobytes())
                        for block, own in of_block.items()
                    ]
                yield pd.DataFrame(sent, columns=["block", "dim", "key", "vector", "cells"])


def _block(dim: int, bucket: int, piece: int, blocks: int) -> int:
    """Block of a cell; the same rule as the column :func:`_block_column`."""
    return (dim * 31 + bucket * 7919 + piece * 104_729) % blocks


def _block_column(blocks: int) -> Column:
    return (
        (F.col("dim") * 31 + F.col("bucket").cast("bigint") * 7919 + F.col("piece") * 104_729)
        % blocks
    ).cast("int")


def _best(i, j, q, matrix, first, k):
    """The k + 1 best classes of each query; a class met in several tables counts once.

    Scores are taken pair by pair, so they depend on the two vectors only.
    """
    order = np.lexsort((first[j], i))
    i, j = i[order], j[order]
    new = np.ones(len(i), dtype=bool)
    new[1:] = (i[1:] != i[:-1]) | (first[j[1:]] != first[j[:-1]])
    i, j = i[new], j[new]
    s = np.concatenate(
        [np.einsum("ij,ij->i", q[i[a : a + HELD]], matrix[j[a : a + HELD]]) for a in range(0, len(i), HELD)]
    )
    order = np.lexsort((first[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) <= k
    return i[keep], j[keep], s[keep]


def _kept(i, j, hits, q, matrix, first, k, limit):
    """The best of those kept so far and of ``hits``; raises the queries' limits."""
    i = np.concatenate([i, *(h[0] for h in hits)])
    j = np.concatenate([j, *(h[1] for h in hits)])
    i, j, s = _best(i, j, q, matrix, first, k)
    full = np.flatnonzero(np.bincount(i, minlength=len(limit)) > k)
    limit[full] = np.maximum(limit[full], s[np.searchsorted(i, full, "right") - 1])
    return i, j, s


def _search(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The nearest ids of each query among the cells of one block that it visits."""
    columns = ["key", "vec_id", "score"]
    if not len(rows) or not len(queries):
        return pd.DataFrame({"key": [], "vec_id": np.array([], np.int64), "score": np.array([], float)})
    found: list[pd.DataFrame] = []
    for dim, own in queries.groupby("dim"):
        q = _matrix(own["vector"])
        visits = [np.frombuffer(c, dtype="<i4").reshape(-1, 2) for c in own["cells"]]
        who = np.repeat(np.arange(len(own)), [len(v) for v in visits])
        cell = np.concatenate(visits)
        code = cell[:, 0].astype(np.int64) << 32 | cell[:, 1]
        order = np.argsort(code, kind="stable")
        code, who = code[order], who[order]
        limit = np.full(len(own), -np.inf)
        own_rows = rows[rows["dim"] == dim]
        if not len(own_rows):
            continue
        first = own_rows["ids"].map(lambda i: i[0]).to_numpy(dtype=np.int64)
        labels = own_rows["bucket"].to_numpy(np.int64) << 32 | own_rows["piece"].to_numpy(np.int64)
        matrix = _matrix(own_rows["vector"])
        order = np.argsort(labels, kind="stable")
        cells, begins = np.unique(labels[order], return_index=True)
        i, j, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for label, members in zip(cells, np.split(order, begins[1:]), strict=True):
            every = who[np.searchsorted(code, label) : np.searchsorted(code, label, "right")]
            step = max(1, SCORES // len(members))
            for at in range(0, len(every), step):
                asking = every[at : at + step]
                for part in range(0, len(members), SCORES):
                    own_part = members[part : part + SCORES]
                    scores = q[asking] @ matrix[own_part].T
                    if len(own_part) > k + 1:
                        kth = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)]
                        limit[asking] = np.maximum(limit[asking], kth)
                    # a little below the bound, as sums differ in their last bits
                    r, c = np.nonzero(scores >= limit[asking][:, None] - 1e-9)
                    hits.append((asking[r], own_part[c]))
                    held += len(r)
                    if held > HELD:
                        i, j, s = _kept(i, j, hits, q, matrix, first, k, limit)
                        hits, held = [], 0
        if hits:
            i, j, s = _kept(i, j, hits, q, matrix, first, k, limit)
        if not len(i):
            continue
        ids = own_rows["ids"].to_numpy()[j]
        counts = [len(x) for x in ids]
        found.append(
            pd.DataFrame(
                {
                    "key": own["key"].to_numpy()[np.repeat(i, counts)],
                    "vec_id": np.fromiter(itertools.chain.from_iterable(ids), np.int64),
                    "score": np.repeat(s, counts),
                }
            )
        )
    if not found:
        return pd.DataFrame({"key": [], "vec_id": np.array([], np.int64), "score": np.array([], float)})
    return pd.concat(found)[columns]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    seed: int = 9,
    pilots: int = 100,
    recall: float = 0.96,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row where ``is_query``.

    ``is_query`` is a condition on vec_id.
    """
    rows = staged(
        valid_vectors(vectors).mapInPandas(_keyed, "vec_id bigint, key binary, vector binary"),
        "vectors",
    )
    classes = staged(vector_classes(rows, k + 1), "classes")
    asked = staged(rows.where(is_query).select("vec_id", "key").distinct(), "queries")
    result = "query_id bigint, rank int, vec_id bigint, score double"
    queries = staged(
        classes.join(asked.select("key").distinct(), "key", "left_semi").select(
            "key", "dim", "vector"
        ),
        "query-classes",
    )

    def norms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length = [np.linalg.norm(np.frombuffer(v, dtype="<f8")) for v in pdf["vector"]]
            yield pd.DataFrame({"dim": pdf["dim"], "norm": length})

    lengths = (
        classes.mapInPandas(norms, "dim int, norm double")
        .groupBy("dim")
        .agg(F.max("norm").alias("longest"))
        .collect()  # one row per vector length
    )
    longest = {r["dim"]: r["longest"] * (1 + 1e-9) for r in lengths}
    if not longest:
        return vectors.sparkSession.createDataFrame([], result)
    shares = calibrate(classes, queries, longest, k, seed, pilots, recall)
    indexed = staged(
        classes.mapInPandas(
            lambda batches: _cells(batches, longest, seed),
            "dim int, bucket int, vector binary, ids array<bigint>",
        ),
        "buckets",
    )
    sizes = indexed.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n"))
    pieces = {
        (r["dim"], r["bucket"]): -(-r["n"] // CELL)
        for r in sizes.where(F.col("n") > CELL).collect()  # at most TABLES * SLOTS**FUNCTIONS a length
    }
    blocks = max(1, -(-indexed.count() // BLOCK))
    cut = F.lit(1)
    if pieces:
        known = F.create_map(*(F.lit(x) for (d, b), n in pieces.items() for x in (f"{d}:{b}", n)))
        cut = F.coalesce(
            F.try_element_at(known, F.concat_ws(":", F.col("dim").cast("string"), F.col("bucket").cast("string"))),
            F.lit(1),
        )
    placed = indexed.withColumn(
        "piece", F.pmod(F.xxhash64("vector"), cut.cast("bigint")).cast("int")
    ).withColumn("block", _block_column(blocks))

    def searched(asking: DataFrame, shares: dict[int, tuple[float, float]]) -> DataFrame:
        """key and the k + 1 nearest ids found by each of ``asking``."""
        dealt = max(1, -(-asking.count() // ASKING))
        probing = asking.mapInPandas(
            lambda batches: _probes(batches, longest, seed, shares, pieces, blocks),
            "block int, dim int, key binary, vector binary, cells binary",
        ).withColumn("asking", F.pmod(F.xxhash64("key"), F.lit(dealt).cast("bigint")).cast("int"))
        to_all = placed.withColumn("asking", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))
        found = (
            to_all.groupBy("block", "asking")
            .cogroup(probing.groupBy("block", "asking"))
            .applyInPandas(
                lambda r, q: _search(r, q, k), "key binary, vec_id bigint, score double"
            )
            .groupBy("key", "vec_id")
            .agg(F.max("score").alias("score"))
        )
        by_score = W.partitionBy("key").orderBy(F.desc("score"), "vec_id")
        return (
            found.withColumn("place", F.row_number().over(by_score))
            .where(F.col("place") <= k + 1)
            .groupBy("key")
            .agg(
                F.sort_array(
                    F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "score"))
                ).alias("near")
            )
        )

    best = searched(queries, shares)
    if shares:
        # k + 1 with the query's own id; whoever has fewer looks everywhere
        first = staged(best, "first-round")
        full = first.where(F.size("near") > k)
        short = staged(
            queries.where(F.col("dim").isin(list(shares))).join(
                full.select("key"), "key", "left_anti"
            ),
            "short",
        )
        if not short.isEmpty():
            again = searched(short, {})
            best = first.join(short.select("key"), "key", "left_anti").unionByName(again)
        else:
            best = first
    own = F.slice(
        F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), F.lit(1), F.lit(k)
    )
    return (
        asked.withColumnRenamed("vec_id", "query_id")
        .join(best, "key")
        .select("query_id", F.posexplode(own).alias("at", "n"))
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("n.vec_id").alias("vec_id"),
            F.col("n.score").alias("score"),
        )
    )


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
