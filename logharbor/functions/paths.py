"""Object names of archived segments: ``<prefix><topic>/<partition>/<topic>-<partition>-<19 digits>.avro``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_prefix(prefix: str) -> str:
    """A non-empty prefix ends with a slash."""
    return prefix if prefix == "" or prefix.endswith("/") else prefix + "/"


def segment_file(topic: Column, partition: Column, first_offset: Column) -> Column:
    return F.format_string("%s-%d-%019d.avro", topic, partition, first_offset)


def segment_path(prefix: str, topic: Column, partition: Column, first_offset: Column) -> Column:
    return F.concat(
        F.lit(normalize_prefix(prefix)),
        topic,
        F.lit("/"),
        partition.cast("string"),
        F.lit("/"),
        segment_file(topic, partition, first_offset),
    )


def part_from_end(path: Column, n: int) -> Column:
    """n-th part of the path counted from its end; null if there are fewer."""
    return F.try_element_at(F.split(path, "/"), F.lit(-n))


def is_parseable(path: Column) -> Column:
    """At least topic, partition and file; the empty path counts as parseable and empty."""
    return (path == "") | (F.size(F.split(path, "/")) >= 3)


def folder(path: Column) -> Column:
    """Text up to and including the last slash; the whole path without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise(path)


def offset_in_name(path: Column) -> Column:
    """Number behind the last dash of a segment file name, null if it is none."""
    return F.regexp_extract(path, r"-[^-/]*-([0-9]+)\.avro$", 1).try_cast("bigint")
