"""Record headers: raw lists (order and repeats matter) and archived maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logharbor.schemas import SOURCE_OFFSET_HEADER


def collapse(headers: Column) -> Column:
    """Header list -> map; of a repeated key the last value stays, null becomes empty.

    No list at all, as Kafka gives for a record without headers, becomes an empty map.
    """
    last_only = F.filter(
        headers,
        lambda entry, i: ~F.exists(
            F.slice(headers, i + 2, F.size(headers)),
            lambda later: later["key"] == entry["key"],
        ),
    )
    collapsed = F.map_from_entries(
        F.transform(
            last_only,
            lambda e: F.struct(e["key"], F.coalesce(e["value"], F.lit(b""))),
        )
    )
    return F.coalesce(collapsed, F.create_map().cast("map<string,binary>"))


def has_repeats(headers: Column) -> Column:
    keys = F.transform(headers, lambda e: e["key"])
    return F.size(keys) > F.size(F.array_distinct(keys))


def as_list(headers: Column) -> Column:
    """Header map -> list sorted by key."""
    return F.sort_array(F.map_entries(headers))


def value_of(headers: Column, name: str) -> Column:
    """Value of a header in a map, null if absent."""
    return F.try_element_at(headers, F.lit(name))


def first_value_of(headers: Column, name: str) -> Column:
    """Value of the first header with this key in a list, null if absent."""
    return F.try_element_at(F.filter(headers, lambda e: e["key"] == name), F.lit(1))["value"]


def source_offset(headers: Column) -> Column:
    """Offset the record had in the source log; -1 without the header, error if not a number."""
    text = value_of(headers, SOURCE_OFFSET_HEADER).cast("string")
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return (
        F.when(text.isNull(), F.lit(-1).cast("bigint"))
        .when(number.isNull(), F.raise_error(F.concat(F.lit("bad source offset header: "), text)).cast("bigint"))
        .otherwise(number)
    )


def stamp(headers: Column, offset: Column) -> Column:
    """Set or replace the source-offset header."""
    return F.map_concat(
        without_stamp(headers),
        F.create_map(F.lit(SOURCE_OFFSET_HEADER), offset.cast("string").cast("binary")),
    )


def without_stamp(headers: Column) -> Column:
    return F.when(
        F.map_contains_key(headers, SOURCE_OFFSET_HEADER),
        F.map_filter(headers, lambda k, _: k != SOURCE_OFFSET_HEADER),
    ).otherwise(headers)


def byte_size(headers: Column) -> Column:
    return F.aggregate(
        F.map_entries(headers),
        F.lit(0).cast("bigint"),
        lambda total, e: total + F.octet_length(e["key"]) + F.octet_length(e["value"]),
    )
