"""Best-fit packing of tokenized documents into sequences.

A document is its token ids and a closing id.  One longer than a sequence is cut into
full pieces; what is left over comes first.  Hierarchical residual packing follows:

* each task tokenizes its documents and packs the pieces by best fit, longest first, into
  bins; full and nearly full bins leave at once;
* underfull bins become items: they are dealt to ``fan_in`` times fewer tasks and packed
  again by best fit, round after round, until one task's worth is left.  A round uses
  as many tasks as ``per_task`` items each require, so a corpus of items that cannot be
  combined stays spread out; the rounds end when they no longer combine anything.

A bin travels as one row with its pieces as a packed list, at most one piece per token of
capacity.  Every round is written to the shared folder before the next reads it, and
items are sorted before they are packed, so a lost executor changes nothing.

Defined results: a null or empty text is the closing id alone; rows with equal ids are
packed separately; an empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.llm.common import column_or_null, staged, table, union_all
from logharbor.llm.tokens import TOKENIZER, Encoder, blocks_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
CLOSING_ID = 0

#: Tokens a task gathers before it packs them and lets full bins go.
HELD = 1_500_000

#: Tokens a bin may lack to count as nearly full.
SLACK = 8

#: One piece of a document inside a bin.
MEMBER = [
    ("known", "u1"),
    ("doc_id", "<i8"),
    ("piece", "<i4"),
    ("start", "<i8"),
    ("length", "<i4"),
    ("crc", "<u4"),
]
BIN = "sequence_id bigint, closed boolean, fill int, members binary, tokens binary"
PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
    "sequence_id bigint, offset bigint"
)


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers, best fit, longest first (equal lengths in the given order).

    Open bins are kept by what room they have; a bit mask of occupied rooms finds the
    smallest room that holds an item.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        high = mask >> n
        if high:
            room = n + (high & -high).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, chosen = capacity, len(bins)
            bins.append([])
        bins[chosen].append(item)
        by_room[room - n].append(chosen)
        if room > n:
            mask |= 1 << (room - n)
    return bins


def _packed(
    fills: np.ndarray,
    members: list[bytes],
    tokens: list[bytes],
    capacity: int,
    slack: int,
    turn: int,
    made: int = 0,
) -> pd.DataFrame:
    bins = best_fit(fills, capacity)
    total = np.array([int(fills[b].sum()) for b in bins], dtype=np.int64)
    task = TaskContext.get().partitionId()
    first = (turn << 56) + (task << 32) + made
    return pd.DataFrame(
        {
            "sequence_id": first + np.arange(len(bins), dtype=np.int64),
            "closed": total >= capacity - slack,
            "fill": total.astype(np.int32),
            "members": [b"".join([members[i] for i in b]) for b in bins],
            "tokens": [b"".join([tokens[i] for i in b]) for b in bins],
        }
    )


def _tokenize_and_pack(
    batches: Iterator[pd.DataFrame], tokenizer: str, capacity: int, slack: int, with_ids: bool
) -> Iterator[pd.DataFrame]:
    import zlib

    encoder = Encoder(tokenizer)
    closing = np.array([CLOSING_ID], dtype="<u4").tobytes()
    found: list[tuple] = []
    tokens: list[bytes] = []
    held, made = 0, 0
    still_open: pd.DataFrame | None = None

    def flush() -> pd.DataFrame:
        items = np.array(found, dtype=MEMBER)
        size, raw = items.dtype.itemsize, items.tobytes()
        members = [raw[i : i + size] for i in range(0, len(raw), size)]
        fills, ids = items["length"].astype(np.int64), list(tokens)
        if still_open is not None:
            fills = np.concatenate([fills, still_open["fill"].to_numpy(dtype=np.int64)])
            members += still_open["members"].tolist()
            ids += still_open["tokens"].tolist()
        found.clear()
        tokens.clear()
        return _packed(fills, members, ids, capacity, slack, 0, made)

    for pdf in batches:
        texts, ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
        known = pdf["known"].tolist()
        for part in blocks_of(texts):
            encoded = encoder.encode(texts[part])
            for doc, has_id, raw in zip(ids[part], known[part], encoded, strict=True):
                raw += closing
                for i, (start, n) in enumerate(pieces_of(len(raw) // 4, capacity)):
                    own = raw[4 * start : 4 * (start + n)]
                    found.append((has_id, doc, i, start, n, zlib.crc32(own)))
                    tokens.append(own if with_ids else b"")
                    held += n
            if held >= HELD:
                bins = flush()
                yield bins[bins["closed"]]
                made, held = made + len(bins), 0
                still_open = bins[~bins["closed"]]
    if found or still_open is not None:
        yield flush()


def _pack_again(
    batches: Iterator[pd.DataFrame], capacity: int, slack: int, turn: int
) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if not parts:
        return
    pdf = pd.concat(parts).sort_values(["fill", "sequence_id"], ascending=[False, True])
    fills = pdf["fill"].to_numpy(dtype=np.int64)
    yield _packed(
        fills, pdf["members"].tolist(), pdf["tokens"].tolist(), capacity, slack, turn
    )


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            each = [np.frombuffer(m, dtype=MEMBER) for m in part["members"]]
            counts = [len(m) for m in each]
            all_of = np.concatenate(each)
            ends = np.cumsum(all_of["length"].astype(np.int64))
            starts = ends - all_of["length"]
            bases = np.repeat(starts[np.cumsum([0, *counts[:-1]])], counts)
            yield pd.DataFrame(
                {
                    "doc_id": pd.Series(all_of["doc_id"].astype(np.int64)).where(
                        all_of["known"] == 1
                    ).astype("Int64"),
                    "piece": all_of["piece"].astype(np.int32),
                    "start": all_of["start"].astype(np.int64),
                    "length": all_of["length"].astype(np.int64),
                    "ids_crc32": all_of["crc"].astype(np.int64),
                    "sequence_id": np.repeat(part["sequence_id"].to_numpy(), counts),
                    "offset": starts - bases,
                }
            )


def pack_bins(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    slack: int = SLACK,
    fan_in: int = 8,
    per_task: int = 20_000,
    with_ids: bool = False,
) -> DataFrame:
    """One row per sequence: sequence_id, fill, packed members and, if asked for, token ids."""
    narrow = docs.select(
        F.coalesce(column_or_null(docs, "doc_id", "bigint"), F.lit(0)).alias("doc_id"),
        column_or_null(docs, "doc_id", "bigint").isNotNull().alias("known"),
        F.coalesce(column_or_null(docs, "text", "string"), F.lit("")).alias("text"),
    )
    packed = staged(
        narrow.mapInPandas(
            lambda batches: _tokenize_and_pack(
                batches, tokenizer, capacity, slack, with_ids
            ),
            BIN,
        ),
        "bins",
    )
    done = [packed.where("closed")]
    open_bins = packed.where(~F.col("closed"))
    left, turn = open_bins.count(), 0
    tasks = max(1, packed.select(F.shiftrightunsigned("sequence_id", 32)).distinct().count())
    while left:
        turn += 1
        tasks = max(1, -(-tasks // fan_in), -(-left // per_task))
        packed = staged(
            open_bins.repartition(tasks, "sequence_id").mapInPandas(
                lambda batches, turn=turn: _pack_again(batches, capacity, slack, turn), BIN
            ),
            "bins",
        )
        done.append(packed.where("closed"))
        open_bins, before = packed.where(~F.col("closed")), left
        left = open_bins.count()
        if tasks == 1 or left > 0.98 * before:
            done.append(open_bins)
            break
    return union_all(done)


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    return pack_bins(docs, **how).select("sequence_id", "members").mapInPandas(_members, PIECES)


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = [np.frombuffer(t, dtype="<i4") for t in batch.column("tokens").to_pylist()]
        members = [np.frombuffer(m, dtype=MEMBER) for m in batch.column("members").to_pylist()]
        doc_ids = [
            [d if k else None for d, k in zip(m["doc_id"].tolist(), m["known"], strict=True)]
            for m in members
        ]
        columns = {
            "sequence_id": batch.column("sequence_id"),
            "n_tokens": batch.column("fill"),
            "ids": pa.array(tokens, pa.list_(pa.int32())),
            "doc_ids": pa.array(doc_ids, pa.list_(pa.int64())),
            "pieces": pa.array([m["piece"] for m in members], pa.list_(pa.int32())),
            "lengths": pa.array([m["length"] for m in members], pa.list_(pa.int32())),
        }
        yield pa.RecordBatch.from_pydict(columns)


def packed_sequences(docs: DataFrame, **how) -> DataFrame:
    """One row per sequence: its token ids, and the pieces they come from, in their order."""
    return pack_bins(docs, with_ids=True, **how).mapInArrow(
        _sequences,
        "sequence_id bigint, n_tokens int, ids array<int>, doc_ids array<bigint>, "
        "pieces array<int>, lengths array<int>",
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence."""
    return pack_documents(table(spark, sf_dir, "documents"))
