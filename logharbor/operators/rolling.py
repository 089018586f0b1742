"""Segment roll: append poll batches, close the segment once it reaches a size.

The roll is greedy with a reset, so each boundary depends on the one before.  To
keep a hot partition off a single task it runs in three distributed steps over
*batches* (never records), cut into chunks of ``CHUNK`` batch numbers:

1. per chunk, tabulate what the chunk does to the bytes it may inherit: a step
   function ``inherited bytes -> (bytes left open, first offset of the open segment)``.
   Different inherited sizes soon fall on the same boundaries, so few steps remain;
2. combine ``FAN`` neighbouring tables into one, level by level, until each partition has
   one; then go back down and thread the actual inherited bytes through the tables of each
   group.  A group holds ``FAN`` tables, and a table no more steps than there are batches
   in a segment, so no group grows with the partition;
3. per chunk, cut the segments, now that the inherited bytes are known.

Small chunks or groups that are neighbours share a Python call, up to ``CHUNK`` batch numbers
a call, so the number of calls follows the batches and not the size of a chunk.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.schemas import TP
from logharbor.shared import staged

# The functions below travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 8192
FAN = 16
_NONE = -1  # no segment is open

_STEPS = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("from_bytes", T.LongType()),
        T.StructField("left_bytes", T.LongType()),
        T.StructField("left_open", T.LongType()),
        T.StructField("chunk_bytes", T.LongType()),
        T.StructField("chunk_first", T.LongType()),
    ]
)

_ENTRY = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("open_bytes", T.LongType()),
        T.StructField("open_first", T.LongType()),
    ]
)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of every stretch of equal keys."""
    cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(keys)]))


def _steps(first: np.ndarray, sizes: np.ndarray, min_size: int) -> tuple:
    """The table of one chunk: ``from_bytes``, ``left_bytes``, ``left_open``, its bytes and first offset."""
    ends = sizes.cumsum()
    n = len(ends)
    starts = ends - sizes
    # batch that closes a segment begun at batch i (n: stays open)
    closes = np.searchsorted(ends, starts + min_size, side="left").tolist()
    first, ends, starts = first.tolist(), ends.tolist(), starts.tolist()
    # batch at which the segment left open begins, if some segment begins at batch i
    tail = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        tail[i] = i if closes[i] == n else tail[closes[i] + 1]
    # the first boundary falls at batch j for inherited bytes from min_size - ends[j] on
    rows = []
    for j in range(n - 1, -1, -1):
        start = max(min_size - ends[j], 0)
        t = tail[j + 1]
        left = (0, _NONE) if t == n else (ends[-1] - starts[t], first[t])
        if rows and rows[-1][0] == start:
            rows.pop()
        if not rows or rows[-1][1:] != left:
            rows.append((start, *left))
    return (*np.array(rows, dtype=np.int64).T, int(ends[-1]), int(first[0]))


def _frame(of: pd.DataFrame, numbered: list[tuple[int, tuple]]) -> pd.DataFrame:
    """Numbered tables of the partition of ``of`` as rows."""
    numbers, tables = zip(*numbered)
    bounds, left, opened, sizes, firsts = zip(*tables)
    lengths = [len(b) for b in bounds]
    out = pd.DataFrame(
        {
            "chunk": np.repeat(numbers, lengths),
            "from_bytes": np.concatenate(bounds),
            "left_bytes": np.concatenate(left),
            "left_open": np.concatenate(opened),
            "chunk_bytes": np.repeat(sizes, lengths),
            "chunk_first": np.repeat(firsts, lengths),
        }
    )
    out["topic"] = of["topic"].iloc[0]
    out["partition"] = of["partition"].iloc[0]
    return out[[f.name for f in _STEPS]]


def _tables(steps: pd.DataFrame) -> list[tuple[int, tuple]]:
    """Rows sorted by chunk and ``from_bytes`` as numbered tables."""
    chunk, *columns = (steps[f.name].to_numpy(dtype=np.int64) for f in _STEPS[2:])
    bounds, left, opened, sizes, firsts = columns
    return [
        (int(chunk[a]), (bounds[a:b], left[a:b], opened[a:b], int(sizes[a]), int(firsts[a])))
        for a, b in _runs(chunk)
    ]


def _chunk_steps(pdf: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """The tables of neighbouring chunks of one partition."""
    pdf = pdf.sort_values("batch_no")
    chunk, first, sizes = (pdf[c].to_numpy() for c in ("chunk", "first_offset", "bytes"))
    return _frame(pdf, [(int(chunk[a]), _steps(first[a:b], sizes[a:b], min_size)) for a, b in _runs(chunk)])


def _compose(a: tuple, b: tuple) -> tuple:
    """The table of two neighbouring stretches, as one stretch."""
    a_bounds, y, o, a_bytes, a_first = a
    bounds, left, opened, b_bytes, b_first = b
    # too few bytes for a boundary in the first stretch: all of it is inherited by the second
    early = np.maximum(bounds - a_bytes, 0)
    last = np.append(early[1:] != early[:-1], True) & (early < a_bounds[0])
    # else the second inherits what the first leaves open
    at = np.searchsorted(bounds, y, side="right") - 1
    closed = at >= 0
    late_left = np.where(closed, left[at], y + b_bytes)
    late_open = np.where(closed, opened[at], np.where(o == _NONE, b_first, o))
    from_bytes = np.concatenate([early[last], a_bounds])
    left_bytes = np.concatenate([left[last], late_left])
    left_open = np.concatenate([opened[last], late_open])
    new = np.append(True, (left_bytes[1:] != left_bytes[:-1]) | (left_open[1:] != left_open[:-1]))
    return from_bytes[new], left_bytes[new], left_open[new], a_bytes + b_bytes, a_first


def _combine(steps: pd.DataFrame) -> pd.DataFrame:
    """The tables of each group as one table, numbered by the group."""
    groups: list[tuple[int, tuple]] = []
    for chunk, table in _tables(steps.sort_values(["chunk", "from_bytes"])):
        number = chunk // FAN
        if groups and groups[-1][0] == number:
            groups[-1] = number, _compose(groups[-1][1], table)
        else:
            groups.append((number, table))
    return _frame(steps, groups)


def _thread(steps: pd.DataFrame) -> pd.DataFrame:
    """What each table of a group inherits, from what the group does; one group if none is named."""
    steps = steps.sort_values(["chunk", "from_bytes"])
    group = steps["group"].to_numpy() if "group" in steps else np.zeros(len(steps))
    open_bytes, open_first = steps["open_bytes"].to_numpy(), steps["open_first"].to_numpy()
    rows, at = [], 0
    for chunk, (bounds, left, opened, size, begin) in _tables(steps):
        if at == 0 or group[at] != group[at - 1]:
            carried, first = int(open_bytes[at]), int(open_first[at])
        rows.append((chunk, carried, first))
        at += len(bounds)
        i = int(np.searchsorted(bounds, carried, side="right")) - 1
        if i >= 0:
            carried, first = int(left[i]), int(opened[i])
        else:
            carried += size
            first = begin if first == _NONE else first
    out = pd.DataFrame(rows, columns=["chunk", "open_bytes", "open_first"])
    out["topic"] = steps["topic"].iloc[0]
    out["partition"] = steps["partition"].iloc[0]
    return out[[f.name for f in _ENTRY]]


def _together(width: int) -> int:
    """How many neighbours of ``width`` batch numbers one call takes: ``CHUNK`` batch numbers, at least one."""
    return max(CHUNK // width, 1)


def _entries(steps: DataFrame, chunk: int) -> DataFrame:
    """Open bytes and first offset that every chunk of ``chunk`` batch numbers inherits."""
    levels, widths = [staged(steps, "roll-steps")], [chunk * FAN]
    group = F.expr(f"chunk div {FAN}")

    def call(width: int) -> Column:
        return F.expr(f"chunk div {FAN * _together(width)}")

    top = levels[0].agg(F.max("chunk")).first()[0] or 0
    while top >= FAN:
        combined = levels[-1].groupBy(*TP, call(widths[-1])).applyInPandas(_combine, schema=_STEPS)
        levels.append(staged(combined, "roll-steps"))
        widths.append(widths[-1] * FAN)
        top //= FAN
    start = {"open_bytes": F.lit(0).cast("bigint"), "open_first": F.lit(_NONE).cast("bigint")}
    entries = None
    for level, width in zip(reversed(levels), reversed(widths)):
        grouped = level.withColumn("group", group)
        if entries is None:
            known = grouped.withColumns(start)
        else:
            known = grouped.join(entries.withColumnRenamed("chunk", "group"), [*TP, "group"])
        entries = known.groupBy(*TP, call(width)).applyInPandas(_thread, schema=_ENTRY)
    return entries


def _segments(
    offsets: np.ndarray, sizes: np.ndarray, carried: int, first: int, min_size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Segment of every batch of one chunk and whether the batch closes it."""
    ends = sizes.cumsum()
    n = len(ends)
    segment = np.empty(n, dtype=np.int64)
    closes = np.zeros(n, dtype=bool)
    i, before = 0, -carried
    while i < n:
        first = int(offsets[i]) if first == _NONE else first
        j = int(np.searchsorted(ends, before + min_size, side="left"))
        segment[i : j + 1] = first
        if j < n:
            closes[j] = True
            before = int(ends[j])
        first = _NONE
        i = j + 1
    return segment, closes


def _cut(pdf: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """Neighbouring chunks of one partition, each cut from what it inherits."""
    pdf = pdf.sort_values("batch_no")
    chunk, offsets, sizes, open_bytes, open_first = (
        pdf[c].to_numpy() for c in ("chunk", "first_offset", "bytes", "open_bytes", "open_first")
    )
    cuts = [
        _segments(offsets[a:b], sizes[a:b], int(open_bytes[a]), int(open_first[a]), min_size)
        for a, b in _runs(chunk)
    ]
    out = pdf.drop(columns=["open_bytes", "open_first", "chunk"])
    out["segment"], out["closes"] = (np.concatenate(parts) for parts in zip(*cuts))
    return out


def roll_segments(batches: DataFrame, min_size: int, chunk: int = CHUNK) -> DataFrame:
    """Assign every batch to a segment.

    ``batches`` has topic, partition, batch_no, rows, bytes, first_offset and
    last_offset, one row per poll batch, with ``batch_no`` rising along the log.
    ``chunk`` is the span of batch numbers that has one table.  Adds ``segment`` (first
    offset of the segment) and ``closes`` (this batch closes it).
    """
    if min_size < 1:
        raise ValueError("min_size must be at least 1")
    names = ["topic", "partition", "batch_no", "rows", "bytes", "first_offset", "last_offset"]
    numbered = batches.select(*names).withColumn("chunk", F.expr(f"batch_no div {int(chunk)}"))
    cut = numbered.where(F.col("chunk").isNotNull())
    call = F.expr(f"chunk div {_together(int(chunk))}")
    steps = cut.groupBy(*TP, call).applyInPandas(
        lambda pdf: _chunk_steps(pdf, min_size), schema=_STEPS
    )
    entries = _entries(steps, int(chunk))
    schema = T.StructType(
        [batches.schema[n] for n in names]
        + [T.StructField("segment", T.LongType()), T.StructField("closes", T.BooleanType())]
    )
    return (
        cut.join(entries, [*TP, "chunk"])
        .groupBy(*TP, call)
        .applyInPandas(lambda pdf: _cut(pdf, min_size)[[f.name for f in schema]], schema=schema)
    )
