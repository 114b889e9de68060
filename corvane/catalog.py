"""Named tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField

from .types import Kind, kind_of


@dataclass(frozen=True)
class Table:
    name: str
    frame: DataFrame
    #: Where its Parquet files are, if it was read from files.
    path: str | None = None
    columns: tuple[tuple[str, Kind], ...] = field(default=())
    fields: tuple[StructField, ...] = field(default=())

    @property
    def kinds(self) -> dict[str, Kind]:
        return dict(self.columns)


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}

    def add(self, name: str, source: DataFrame | str) -> Table:
        """A DataFrame, or the path of Parquet files. A name that is taken keeps its first table."""
        if name not in self.tables:
            frame = self.spark.read.parquet(source) if isinstance(source, str) else source
            fields = tuple(frame.schema.fields)
            columns = tuple((f.name, kind_of(f.dataType)) for f in fields)
            self.tables[name] = Table(name, frame, source if isinstance(source, str) else None, columns, fields)
        return self.tables[name]

    def get(self, name: str) -> Table | None:
        return self.tables.get(name)
