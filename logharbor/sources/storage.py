"""Reading and writing logs, archives, plans and snapshots.

Parquet is the default.  ``avro`` and ``kafka`` go through Spark's own connectors and
need their jars on the classpath.

An archive written here has a folder per topic and partition; a segment is a run of
rows with the same ``segment`` (its first offset), not a file of its own, so file count
and file size follow the data and not the roll size.  Its object path is kept: it is
derived from topic, partition and segment, and the manifest lists it with its size.
An archive of plain ``<topic>/<partition>/<file>`` objects is read with
``read_objects`` and listed with ``list_objects``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.functions import headers as H
from logharbor.functions import paths as P
from logharbor.functions.text import matches_any, regex_list, split_and_trim
from logharbor.operators.positional import BLOCK, block_start
from logharbor.schemas import (
    FILE_INDEX_HEADER,
    GROUPS,
    PLAN,
    RECORD,
    TOPICS_SHA_HEADER,
    TP,
)
from logharbor.shared import remove_folder, staged, written_folders

TIMESTAMP_HEADER = "logharbor.timestamp-ms"
_SEGMENT = T.StructField("segment", T.LongType())
_FOLDERS = [T.StructField("p_topic", T.StringType()), T.StructField("p_partition", T.StringType())]
_FOLDER_NAMES = [f.name for f in _FOLDERS]


def kafka_pattern(regexes: str) -> str:
    """Subscription pattern for a regex list; Kafka matches whole names, the list does not."""
    return "|".join(f".*(?:{regex}).*" for regex in split_and_trim(regexes) if regex)


def kafka_source_options(
    servers: str, include: str, poll_records: int | None = None, security: dict[str, str] | None = None
) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribePattern": kafka_pattern(include),
        "startingOffsets": "earliest",
        "includeHeaders": "true",
    }
    if poll_records is not None:
        options["maxOffsetsPerTrigger"] = str(poll_records)
    return options | (security or {})


def kafka_sink_options(servers: str, security: dict[str, str] | None = None) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "kafka.compression.type": "zstd",
        "kafka.enable.idempotence": "true",
    } | (security or {})


def read_log(
    spark: SparkSession, path: str = "", fmt: str = "parquet", schema: T.StructType = RECORD, **options: str
) -> DataFrame:
    """Log records as a batch DataFrame (files, or Kafka with ``fmt="kafka"``)."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load() if fmt == "kafka" else reader.schema(schema).load(path)


def stream_log(
    spark: SparkSession, path: str = "", fmt: str = "parquet", schema: T.StructType = RECORD, **options: str
) -> DataFrame:
    """Log records as a stream; ``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger`` bound a round."""
    reader = spark.readStream.format(fmt).options(**options)
    return reader.load() if fmt == "kafka" else reader.schema(schema).load(path)


def write_feed(part: DataFrame, path: str) -> None:
    """Append part of a log or plan, as many files as it has tasks."""
    part.write.mode("append").parquet(path)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with the folder columns of their topic and partition."""
    return rows.withColumns(
        {"p_topic": F.col("topic"), "p_partition": F.col("partition").cast("string")}
    )


def write_archive(
    rows: DataFrame, root: str, fmt: str = "parquet", compression: str = "zstd", run: int = BLOCK
) -> None:
    """Write archive rows with their ``segment``; what was at ``root`` is replaced.

    Rows are clustered by runs of ``run`` first offsets within a partition, so a hot
    partition is written by many tasks, a segment by one, in offset order.
    """
    order = [*_FOLDER_NAMES, "segment"]
    (
        _placed(rows.select(*RECORD.names, "segment"))
        .withColumn("_run", F.col("segment") - F.col("segment") % run)
        .repartition(*_FOLDER_NAMES, "_run")
        .drop("_run")
        .sortWithinPartitions(*order, "offset")
        .write.format(fmt)
        .mode("overwrite")
        .option("compression", compression)
        .partitionBy(*_FOLDER_NAMES)
        .save(root)
    )


def read_archive(
    spark: SparkSession,
    root: str,
    prefix: str = "",
    fmt: str = "parquet",
    files: DataFrame | None = None,
    exclude: str = "",
) -> DataFrame:
    """Archive rows with the object ``path`` of their segment.

    With ``files`` (a ``path`` column) only these segments are read: the folder columns
    are join keys, so Spark leaves out the folders of other partitions at run time.
    Folders of topics that match ``exclude`` are not listed for reading at all.
    """
    schema = T.StructType([*RECORD.fields, _SEGMENT, *_FOLDERS])
    rows = spark.read.format(fmt).schema(schema).load(root)
    if exclude:
        rows = rows.where(~matches_any(F.col("p_topic"), regex_list(exclude)))
    if files is not None:
        path = F.col("path")
        wanted = files.where(path != "").select(
            P.part_from_end(path, 3).alias("p_topic"),
            P.part_from_end(path, 2).alias("p_partition"),
            P.offset_in_name(path).alias("segment"),
        )
        # the filter loses nothing; Spark prunes at run time only by a side that has one
        listed = staged(wanted.distinct(), "wanted-segments").where(F.col("segment") >= 0)
        rows = rows.join(listed, [*_FOLDER_NAMES, "segment"])
    path = P.segment_path(
        prefix, F.col("p_topic"), F.col("p_partition").cast("int"), F.col("segment")
    )
    return rows.withColumn("path", path).select(*RECORD.names, "path")


def below_root(path: Column, root: str) -> Column:
    """Path below ``root``."""
    tail = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.element_at(F.split(path, "\\Q" + tail + "/\\E", 2), 2)


def _relative(path: Column, root: str, prefix: str) -> Column:
    """Path below ``root`` behind ``prefix``."""
    return F.concat(F.lit(P.normalize_prefix(prefix)), below_root(path, root))


def _topic_folders(spark: SparkSession, root: str, topics: set[str] | None = None) -> list[str]:
    """Topic folders below ``root``, or those of them that are asked for."""
    there = [n for n in written_folders(spark, root) if not n.startswith((".", "_"))]
    return [f"{root.rstrip('/')}/{n}" for n in there if topics is None or n in topics]


def read_objects(
    spark: SparkSession, root: str, prefix: str = "", fmt: str = "avro", files: DataFrame | None = None
) -> DataFrame:
    """Rows of an archive of plain objects, with the ``path`` of their object.

    With ``files`` only the folders of their topics are listed and read; the topic names,
    which every plan's fingerprint holds as one list, are gathered for that.
    """
    if files is not None:
        files = staged(files.select("path").distinct(), "files")
        names = files.select(P.part_from_end(F.col("path"), 3).alias("topic")).distinct().collect()
        folders = _topic_folders(spark, root, {r["topic"] for r in names})
        if not folders:
            schema = T.StructType([*RECORD.fields, T.StructField("path", T.StringType())])
            return spark.createDataFrame([], schema)
    rows = (
        spark.read.format(fmt)
        .schema(RECORD)
        .option("recursiveFileLookup", "true")
        .load(root if files is None else folders)
        .withColumn("path", _relative(F.col("_metadata.file_path"), root, prefix))
    )
    return rows if files is None else rows.join(files, "path", "left_semi")


def list_objects(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Objects below ``root``: path and length. Names and sizes only, no content is read.

    Each topic folder is a path of its own, so Spark spreads a long listing over tasks.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(_topic_folders(spark, root) or root)
        .select(_relative(F.col("path"), root, prefix).alias("path"), "length")
    )


def manifest_objects(manifest: DataFrame) -> DataFrame:
    """The listing a planner needs, taken from a manifest instead of a file system."""
    return manifest.select("path", F.col("bytes").alias("length"))


def write_plan(plan: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Append plan records; records of one key stay together and in order."""
    ordered = plan.repartition("key").sortWithinPartitions("plan_seq")
    if fmt == "kafka":
        plan_to_wire(ordered).write.format("kafka").options(**options).save()
    else:
        ordered.write.format(fmt).mode("append").save(path)


def plan_headers() -> Column:
    """Plan headers as Kafka carries them."""
    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("key"), value.cast("string").cast("binary").alias("value"))

    return F.array(
        entry(FILE_INDEX_HEADER, F.col("file_index")), entry(TOPICS_SHA_HEADER, F.col("topics_sha"))
    ).alias("headers")


def plan_to_wire(plan: DataFrame) -> DataFrame:
    """Plan records as Kafka carries them: key, value and the two headers."""
    return plan.select(
        F.col("key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        plan_headers(),
    )


def plan_from_wire(records: DataFrame) -> DataFrame:
    """Plan records read back from Kafka rows (key, value, headers, partition, offset).

    Records of one key share a partition of the plan topic, so offset and then partition
    order every folder's files as they were planned.  A header that is absent or not a
    number gives null.
    """
    value = F.col("value").cast("string")
    index = H.first_value_of(F.col("headers"), FILE_INDEX_HEADER).cast("string")
    places = 1 << 16
    return records.select(
        (F.col("offset") * places + F.col("partition")).cast("bigint").alias("plan_seq"),
        F.col("key").cast("string").alias("key"),
        value.alias("value"),
        P.part_from_end(value, 3).alias("topic"),
        P.part_from_end(value, 2).alias("partition"),
        index.try_cast("bigint").alias("file_index"),
        H.first_value_of(F.col("headers"), TOPICS_SHA_HEADER).cast("string").alias("topics_sha"),
    )


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PLAN).parquet(path)


def kafka_rows(restored: DataFrame) -> DataFrame:
    """Restored rows as Spark's Kafka sink takes them.

    The sink has no timestamp column, so the original time travels as a header.
    """
    stamped = F.map_concat(
        "headers",
        F.create_map(F.lit(TIMESTAMP_HEADER), F.col("timestamp").cast("string").cast("binary")),
    )
    return restored.select("topic", "partition", "key", "value", H.as_list(stamped).alias("headers"))


def write_topics(
    restored: DataFrame,
    path: str = "",
    fmt: str = "parquet",
    mode: str = "append",
    run: int = BLOCK,
    **options: str,
) -> None:
    """Write restored rows: into folders per topic and partition, or to Kafka.

    Files are clustered by runs of target offsets, so their number follows the data and
    not the tasks, and a hot partition is written by many tasks.  Kafka appends in arrival order, so there a partition's rows
    must come from one task, in order.
    """
    if fmt == "kafka":
        ordered = restored.repartition(*TP).sortWithinPartitions(*TP, "offset")
        kafka_rows(ordered).write.format("kafka").options(**options).save()
        return
    (
        _placed(restored)
        .withColumn("_run", block_start(F.col("offset"), run))
        .repartition(*_FOLDER_NAMES, "_run")
        .drop("_run")
        .sortWithinPartitions(*_FOLDER_NAMES, "offset")
        .write.format(fmt)
        .mode(mode)
        .option("compression", "zstd")
        .options(**options)
        .partitionBy(*_FOLDER_NAMES)
        .save(path)
    )


def read_topics(spark: SparkSession, path: str, files: list[str] | None = None) -> DataFrame:
    """A restored log as :func:`write_topics` wrote it, or some of its files."""
    schema = T.StructType([*RECORD.fields, T.StructField("source_offset", T.LongType()), *_FOLDERS])
    if files is not None and not files:
        return spark.createDataFrame([], schema).drop(*_FOLDER_NAMES)
    reader = spark.read.schema(schema).option("basePath", path)
    return reader.parquet(*(files or [path])).drop(*_FOLDER_NAMES)


def _snapshot_versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of a snapshot, oldest first."""
    names = sorted(n for n in written_folders(spark, path) if n.startswith("version-"))
    return [n for n in names if "_SUCCESS" in written_folders(spark, f"{path}/{n}")]


def write_snapshot(snapshot: DataFrame, path: str, fmt: str = "parquet", keep: int = 2) -> None:
    """Write a new version of the group snapshot; an empty one is valid too.

    A version counts once Spark has committed it, so there is a whole snapshot at any
    time.  The newest ``keep`` versions stay.
    """
    spark = snapshot.sparkSession
    before = [n for n in written_folders(spark, path) if n.startswith("version-")]
    number = max((int(n.removeprefix("version-")) for n in before), default=0) + 1
    snapshot.write.format(fmt).option("compression", "zstd").save(f"{path}/version-{number:012d}")
    for name in _snapshot_versions(spark, path)[:-keep]:
        remove_folder(spark, f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The newest complete version."""
    versions = _snapshot_versions(spark, path)
    if not versions:
        raise ValueError(f"no complete snapshot below {path}")
    return spark.read.format(fmt).schema(GROUPS).load(f"{path}/{versions[-1]}")
