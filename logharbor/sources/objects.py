"""Archives with one object per closed segment, published whole.

Tasks write each segment they hold to a private place, and beside the segments a list of
them.  Spark's commit records which tasks' lists count; only then are the objects moved to
their names, by tasks again.  A write that breaks off before the commit leaves nothing a reader
sees, one that breaks off after it is finished by :func:`recover_objects`.

Objects hold Parquet; ``storage.read_objects`` and ``storage.list_objects`` read this
layout.  Folders that begin with an underscore are this module's own: ``_jobs`` while a write is
under way, ``_manifests`` for good, one list of objects per write.

The store is reached from tasks by Arrow's file systems (local or mounted paths, ``s3a``, ``gs``,
``hdfs``), with the credentials of the environment.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from logharbor.functions import paths as P
from logharbor.operators.archive import row_bytes
from logharbor.schemas import RECORD
from logharbor.shared import read_file, remove_folder, written_folders

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LISTED = "object string, draft string, topic string, partition int, rows bigint, bytes bigint, length bigint, first_offset bigint, last_offset bigint, task string"
_OBJECT = "object"


def open_store(root: str):
    """Arrow file system of a folder and the folder's path in it."""
    from pyarrow import fs

    scheme, _, path = root.partition(":")
    if not path or "/" in scheme:
        return fs.LocalFileSystem(), root
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(("s3" if scheme == "s3a" else scheme) + ":" + path)


@dataclass
class TaskObjects(WriterCommitMessage):
    """What one task has written: the name of its list, none if it had no rows."""

    listed: str | None
    objects: int


class _OpenObject:
    def __init__(self, store, base: str, name: str, draft: str, schema: pa.Schema):
        import pyarrow.parquet as pq

        self.name, self.draft, self.store, self.at = name, draft, store, f"{base}/{draft}"
        store.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.writer = pq.ParquetWriter(self.at, schema, filesystem=store, compression="zstd")
        self.rows = self.bytes = 0
        self.first, self.last = None, None
        self.topic, self.partition = None, None

    def add(self, part: pa.RecordBatch, sizes: pa.Array) -> None:
        import pyarrow.compute as pc

        self.writer.write_batch(part)
        self.rows += part.num_rows
        self.bytes += pc.sum(sizes).as_py()
        low, high = pc.min_max(part.column("offset")).as_py().values()
        self.first = low if self.first is None else min(self.first, low)
        self.last = high if self.last is None else max(self.last, high)
        self.topic, self.partition = part.column("topic")[0].as_py(), part.column("partition")[0].as_py()

    def close(self, task: str) -> tuple:
        self.writer.close()
        length = self.store.get_file_info(self.at).size
        return (self.name, self.draft, self.topic, self.partition, self.rows, self.bytes, length, self.first, self.last, task)


class SegmentWriter(DataSourceArrowWriter):
    """Writes runs of rows with one ``object`` to one object each; rows must come sorted by it."""

    def __init__(self, root: str, job: str, columns: list[str]):
        self.root, self.job, self.columns = root, job, columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, base = open_store(self.root)
        task = uuid.uuid4().hex
        entries: list[tuple] = []
        held: _OpenObject | None = None
        for batch in iterator:
            names = batch.column(_OBJECT)
            data = batch.select(self.columns)
            runs = pc.run_end_encode(names)
            start = 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if held is None or held.name != name:
                    if held is not None:
                        entries.append(held.close(task))
                    draft = f"_jobs/{self.job}/drafts/{task}/{name}"
                    held = _OpenObject(store, base, name, draft, data.schema)
                held.add(data.slice(start, end - start), batch.column("bytes").slice(start, end - start))
                start = end
        if held is None:
            return TaskObjects(None, 0)
        entries.append(held.close(task))
        names = [f.split()[0] for f in _LISTED.split(", ")]
        listed = pa.table({n: [e[i] for e in entries] for i, n in enumerate(names)})
        listed = listed.set_column(3, "partition", listed.column("partition").cast(pa.int32()))
        folder = f"{base}/_jobs/{self.job}/lists"
        store.create_dir(folder, recursive=True)
        pq.write_table(listed, f"{folder}/{task}.parquet", filesystem=store)
        return TaskObjects(f"{task}.parquet", len(entries))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """From here on the write counts."""
        store, base = open_store(self.root)
        lists = sorted(m.listed for m in messages if m is not None and m.listed)
        folder = f"{base}/_jobs/{self.job}"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/committing") as out:
            out.write(json.dumps(lists).encode())
        store.move(f"{folder}/committing", f"{folder}/committed")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = open_store(self.root)
        store.create_dir(f"{base}/_jobs/{self.job}", recursive=True)
        store.delete_dir(f"{base}/_jobs/{self.job}")


class SegmentObjects(DataSource):
    """Write-only source ``segment-objects`` with the options ``path`` and ``job``."""

    @classmethod
    def name(cls) -> str:
        return "segment-objects"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        own = [n for n in schema.names if n not in (_OBJECT, "bytes")]
        return SegmentWriter(self.options["path"], self.options["job"], own)


def _moved(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Move drafts to their names; one that is there already was moved by an earlier try."""
    from pyarrow import fs

    store, base = open_store(root)
    for batch in batches:
        for draft, name in zip(batch.column("draft").to_pylist(), batch.column(_OBJECT).to_pylist(), strict=True):
            source, target = f"{base}/{draft}", f"{base}/{name}"
            if store.get_file_info(source).type == fs.FileType.NotFound:
                if store.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"neither {source} nor {target} is there")
                continue
            store.create_dir(target.rpartition("/")[0], recursive=True)
            store.move(source, target)
        yield batch


def publish_objects(spark: SparkSession, root: str, job: str) -> None:
    """Give the objects of a committed write their names; may be repeated."""
    own = f"{root}/_jobs/{job}"
    lists = json.loads(read_file(spark, f"{own}/committed") or "[]")
    if lists:
        listed = spark.read.schema(_LISTED).parquet(*(f"{own}/lists/{name}" for name in lists))
        moved = listed.mapInArrow(lambda b: _moved(b, root), _LISTED)
        moved.drop("draft").write.mode("overwrite").parquet(f"{root}/_manifests/{job}")
    remove_folder(spark, own)


def recover_objects(spark: SparkSession, root: str) -> list[str]:
    """Finish the writes that were committed and forget the others; names of the finished ones.

    For the owner of the archive, while nobody writes to it.
    """
    finished = []
    for job in sorted(written_folders(spark, f"{root}/_jobs")):
        if read_file(spark, f"{root}/_jobs/{job}/committed") is None:
            remove_folder(spark, f"{root}/_jobs/{job}")
        else:
            publish_objects(spark, root, job)
            finished.append(job)
    return finished


def draft_objects(rows: DataFrame, root: str) -> str:
    """Write and commit the segments of ``rows`` (archive rows with ``segment``) without
    publishing them; the name of the write.

    Segments are dealt to tasks one by one, so a hot partition is written by many.
    """
    spark = rows.sparkSession
    spark.dataSource.register(SegmentObjects)
    job = uuid.uuid4().hex
    name = P.segment_path("", F.col("topic"), F.col("partition"), F.col("segment"))
    (
        rows.select(*RECORD.names, row_bytes().alias("bytes"), name.alias(_OBJECT))
        .repartition(_OBJECT)
        .sortWithinPartitions(_OBJECT, "offset")
        .write.format("segment-objects")
        .mode("append")
        .options(path=root, job=job)
        .save()
    )
    return job


def write_objects(rows: DataFrame, root: str, prefix: str = "") -> DataFrame:
    """Add the segments of ``rows`` to the archive at ``root``; the manifest of this write."""
    job = draft_objects(rows, root)
    publish_objects(rows.sparkSession, root, job)
    return written_objects(rows.sparkSession, root, prefix, [job])


def written_objects(
    spark: SparkSession, root: str, prefix: str = "", jobs: list[str] | None = None
) -> DataFrame:
    """Manifest of the published objects: path, topic, partition, rows, bytes (logical), length
    (stored), offsets, task.  Reads no object and lists no topic folder."""
    listed = [n for n in written_folders(spark, f"{root}/_manifests") if jobs is None or n in jobs]
    schema = _LISTED.replace("draft string, ", "")
    whole = [n for n in listed if "_SUCCESS" in written_folders(spark, f"{root}/_manifests/{n}")]
    if not whole:
        found = spark.createDataFrame([], schema)
    else:
        found = spark.read.schema(schema).parquet(*(f"{root}/_manifests/{n}" for n in whole))
    path = F.concat(F.lit(P.normalize_prefix(prefix)), F.col(_OBJECT))
    return found.select(path.alias("path"), *found.columns[1:])
