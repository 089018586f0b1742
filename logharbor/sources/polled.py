"""A stored log as a stream whose rounds are bounded by records.

Spark's file source bounds a round by files or bytes.  This source has offsets of its own: the next
offset of each partition, as a broker's consumer would keep them.  A round takes at most ``limit``
offsets, shared between partitions in proportion to what they hold, so it has at most that many
records, whatever the files look like.

Where a round may end is read from an index beside the log, never from the log.  The index has one
row per file and block of offsets and grows by a folder an append; a folder counts once Spark has
committed it, so a round never sees a part of an append.  Records are read by tasks, each a run of
offsets of one file, with the run pushed into the Parquet scan.

Offsets of a partition must be appended in rising order, as in any log: what is appended below the
place the stream has reached is not read.  Holes in them are passed over.  Spark calls ``partitions``
with an empty range when a query restarts; that is how the source learns where to go on.

With ``Trigger.AvailableNow`` Spark asks for one end only, so such a run is a single bounded round;
:func:`drain` runs bounded rounds until the log is read.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from logharbor.operators.positional import BLOCK
from logharbor.schemas import RECORD
from logharbor.shared import written_folders
from logharbor.sources.objects import open_store
from logharbor.sources.offset_index import OffsetIndex

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_APPEND = "append-"


class PollIndex(OffsetIndex):
    """An offset index whose appends are folders that count once they are complete."""

    def _appends(self) -> list[str]:
        names = sorted(n for n in written_folders(self.spark, self.root) if n.startswith(_APPEND))
        return [n for n in names if "_SUCCESS" in written_folders(self.spark, f"{self.root}/{n}")]

    def rows(self) -> DataFrame:
        complete = [f"{self.root}/{name}" for name in self._appends()]
        if not complete:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*complete)

    def write(self, entries: DataFrame) -> None:
        """One writer at a time; a folder that a broken run has left is written over."""
        number = len(self._appends())
        entries.write.mode("overwrite").parquet(f"{self.root}/{_APPEND}{number:012d}")


def share_out(backlog: dict[str, int], limit: int) -> dict[str, int]:
    """How many offsets each partition may go on: in proportion to its backlog, ``limit`` in all."""
    total = sum(backlog.values())
    if total <= limit:
        return dict(backlog)
    taken = {key: limit * held // total for key, held in backlog.items()}
    left = limit - sum(taken.values())
    # the rest goes to those that lost most by rounding down, so that small partitions go on too
    for key in sorted(backlog, key=lambda k: (-(limit * backlog[k] % total), k))[:left]:
        taken[key] += 1
    return taken


@dataclass
class LogRun(InputPartition):
    """A run of offsets of one partition in one file."""

    file: str
    topic: str
    partition: int
    start: int
    end: int


def _key(topic: str, partition: int) -> str:
    return json.dumps([topic, partition])


class PolledReader(DataSourceStreamReader):
    """Offsets are {partition: next offset}; partitions that are not named stand at their start."""

    def __init__(self, log: str, index: str, limit: int, schema: StructType):
        if limit < 1:
            raise ValueError("limit must be at least 1")
        self.log, self.index, self.limit, self.schema = log.rstrip("/"), index.rstrip("/"), limit, schema
        self.at: dict[str, int] = {}  # where the newest round ends
        self.floor: dict[str, int] = {}  # where the newest round that was planned starts
        self.known: set[str] = set()
        self.entries: list[tuple[str, int, int, str]] = []  # key, first, last offset, file: not read yet

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        self._read_index()
        spans: dict[str, list[tuple[int, int]]] = {}
        for key, first, last, _ in self.entries:
            low = max(first, self.at.get(key, 0))
            if low <= last:
                spans.setdefault(key, []).append((low, last + 1))
        held = {key: _joined(runs) for key, runs in spans.items()}
        taken = share_out({key: sum(b - a for a, b in runs) for key, runs in held.items()}, self.limit)
        for key, count in taken.items():
            if count:
                self.at[key] = _behind(held[key], count)
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = {**self.at, **end}
        if start == end:  # a restart: ``end`` may be that of a round that is still to be run again
            return []
        self._read_index()
        self.floor = start
        self.entries = [e for e in self.entries if e[2] >= start.get(e[0], 0)]
        runs = []
        for key, first, last, file in self.entries:
            low, high = max(first, start.get(key, 0)), min(last + 1, end.get(key, 0))
            if low < high:
                topic, partition = json.loads(key)
                runs.append(LogRun(file, topic, partition, low, high))
        return _merged(runs)

    def read(self, partition: LogRun) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        store, base = open_store(self.log)
        wanted = to_arrow_schema(self.schema)
        field = ds.field
        rows = ds.dataset(f"{base}/{partition.file}", filesystem=store, format="parquet").scanner(
            columns=wanted.names,
            filter=(field("topic") == partition.topic)
            & (field("partition") == partition.partition)
            & (field("offset") >= partition.start)
            & (field("offset") < partition.end),
        )
        for batch in rows.to_batches():
            if batch.num_rows:
                yield pa.Table.from_batches([batch]).cast(wanted).combine_chunks().to_batches()[0]

    def commit(self, end: dict) -> None:
        """Nothing is kept outside Spark's own record of offsets."""

    def _read_index(self) -> None:
        """Take in the appends that came since; each is read once."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, base = open_store(self.index)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.base_name.startswith(_APPEND))
        for name in names:
            if name in self.known:
                continue
            if store.get_file_info(f"{base}/{name}/_SUCCESS").type == fs.FileType.NotFound:
                return  # later appends wait for this one
            self.known.add(name)
            columns = ["topic", "partition", "first_offset", "last_offset", "file"]
            for batch in ds.dataset(f"{base}/{name}", filesystem=store, format="parquet").to_batches(columns=columns):
                for topic, partition, first, last, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key = _key(topic, partition)
                    if last >= self.floor.get(key, 0):
                        self.entries.append((key, first, last, file))


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs without overlaps."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _behind(runs: list[tuple[int, int]], count: int) -> int:
    """The offset behind the first ``count`` offsets of the runs."""
    for low, high in runs:
        if count <= high - low:
            return low + count
        count -= high - low
    return runs[-1][1]


def _merged(runs: list[LogRun]) -> list[LogRun]:
    """Adjacent runs of one file as one, up to a block."""
    out: list[LogRun] = []
    for run in sorted(runs, key=lambda r: (r.file, r.topic, r.partition, r.start)):
        last = out[-1] if out else None
        same = last is not None and (last.file, last.topic, last.partition) == (run.file, run.topic, run.partition)
        if same and run.end - last.start <= BLOCK:
            last.end = max(last.end, run.end)
        else:
            out.append(run)
    return out


class PolledLog(DataSource):
    """``spark.readStream.format("logharbor-poll")`` with the options log, index and limit."""

    @classmethod
    def name(cls) -> str:
        return "logharbor-poll"

    def schema(self) -> StructType:
        return RECORD

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return PolledReader(self.options["log"], self.options["index"], int(self.options["limit"]), schema)


def poll_log(spark: SparkSession, log: str, index: str, limit: int) -> DataFrame:
    """Records of the log that ``storage.write_topics`` wrote at ``log``, at most ``limit`` a round.

    ``index`` is the folder of a :class:`PollIndex` of that log, extended after each append.
    """
    spark.dataSource.register(PolledLog)
    return (
        spark.readStream.format(PolledLog.name())
        .options(log=log, index=index, limit=str(limit))
        .load()
    )


def drain(rows: DataFrame, checkpoint: str, keep: Callable[[DataFrame, int], None]) -> None:
    """Run bounded rounds until all that is indexed is read; ``keep`` gets each with its number."""
    query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
