"""The dialect's four types and how Spark's map to them."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import types as T


class Kind(Enum):
    INT64 = "INT64"
    DOUBLE = "DOUBLE"
    BOOL = "BOOL"
    TEXT = "TEXT"
    #: Passes through SELECT *, but no expression may use it.
    OPAQUE = "unsupported type"

    @property
    def numeric(self) -> bool:
        return self in (Kind.INT64, Kind.DOUBLE)


def kind_of(spark_type: T.DataType) -> Kind:
    if isinstance(spark_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Kind.INT64
    if isinstance(spark_type, T.DoubleType):
        return Kind.DOUBLE
    if isinstance(spark_type, T.BooleanType):
        return Kind.BOOL
    if isinstance(spark_type, T.StringType):
        return Kind.TEXT
    return Kind.OPAQUE


def widened(column: Column, spark_type: T.DataType) -> Column:
    """Integers are 64 bits wide; comparisons with literals are still pushed to the narrow column by Catalyst."""
    return column.cast("bigint") if kind_of(spark_type) is Kind.INT64 and not isinstance(spark_type, T.LongType) else column
