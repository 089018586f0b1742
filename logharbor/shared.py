"""Tables written to the cluster's shared folder.

A staged table serves two ends: its lineage survives the loss of executors, and
Catalyst knows its true size from the files, so a join against it is broadcast
only when it measures below ``spark.sql.autoBroadcastJoinThreshold`` and shuffled
otherwise.  No operator forces a broadcast by hint.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_local_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a scratch folder in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors can reach")
    app = context.applicationId
    if app not in _local_folder:
        _local_folder[app] = tempfile.mkdtemp(prefix="logharbor-")
    return _local_folder[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _open_jobs:
        _open_jobs[-1].append(path)
    return path


def written_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, none if it does not exist. Lists one folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    return [status.getPath().getName() for status in files.listStatus(folder)]


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file if there is none of this name; False if there is one already.

    The store decides who comes first, so of several writers of one name only one goes on.
    """
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(file):
        return False
    try:
        out = files.create(file, False)
    except Exception as error:  # the JVM's FileAlreadyExistsException, in a store's own wrapping
        if files.exists(file):
            return False
        raise error
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_file(spark: SparkSession, path: str) -> str | None:
    """Text of a small file; None if there is none."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(file):
        return None
    stream = files.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


_open_jobs: list[list[str]] = []


@contextmanager
def job_tables(spark: SparkSession) -> Iterator[None]:
    """Own the tables staged inside the block: they are removed when it ends.

    Results that read them must be written or counted before.
    """
    _open_jobs.append([])
    try:
        yield
    finally:
        for path in _open_jobs.pop():
            remove_folder(spark, path)


@contextmanager
def collected_tables() -> Iterator[list[str]]:
    """The folders staged inside the block, for whoever removes them later."""
    own: list[str] = []
    _open_jobs.append(own)
    try:
        yield own
    finally:
        _open_jobs.pop()
        if _open_jobs:
            _open_jobs[-1].extend(own)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_split(df: DataFrame, name: str, flag: str) -> tuple[DataFrame, DataFrame | None]:
    """Like :func:`staged`, as two tables: rows without and rows with ``flag``; none of these, None."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(flag).parquet(path)
    written = written_folders(spark, path)
    schema = T.StructType([f for f in df.schema if f.name != flag])

    def part(value: str) -> DataFrame | None:
        folder = f"{flag}={value}"
        return spark.read.schema(schema).parquet(f"{path}/{folder}") if folder in written else None

    unflagged = part("false")
    return spark.createDataFrame([], schema) if unflagged is None else unflagged, part("true")
