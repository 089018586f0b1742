"""Comma-separated lists and unanchored regex matching."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def split_and_trim(text: str, sep: str = ",") -> list[str]:
    """Parts of ``text`` without surrounding blanks; empty parts are kept."""
    return [part.strip() for part in text.split(sep)]


def regex_list(text: str) -> list[str]:
    """Regexes of a comma-separated list; empty parts are left out, bad ones raise."""
    regexes = [part for part in split_and_trim(text) if part]
    spark = SparkSession.getActiveSession()
    if spark is not None:
        for regex in regexes:
            try:
                spark.sql("SELECT '' RLIKE :regex", args={"regex": regex}).collect()
            except Exception as exc:
                raise ValueError(f"not a regular expression: {regex}") from exc
    return regexes


def matches_any(text: Column, regexes: list[str]) -> Column:
    """True where any regex is found in ``text``; an empty list matches nothing."""
    found = F.lit(False)
    for regex in regexes:
        found = found | text.rlike(regex)
    return found


def first_match(text: Column, regexes: list[str]) -> Column:
    """Index of the first regex found in ``text``, null if none is.

    The list is an argument, so it becomes one CASE expression and needs no join.
    """
    position = F.lit(None).cast("int")
    for index in reversed(range(len(regexes))):
        position = F.when(text.rlike(regexes[index]), F.lit(index)).otherwise(position)
    return position
