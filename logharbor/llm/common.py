"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.shared import staged

#: White space of the contracts, ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\f\r"

__all__ = ["SPACES", "bind", "column_or_null", "staged", "table", "words_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or typed nulls where the table lacks it."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``, also below lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != F.lit(""))


def total(values: Column, kind: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
