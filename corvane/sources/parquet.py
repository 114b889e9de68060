"""Tables as Parquet files in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHUNK_ROWS = 2048


def write_table(frame: DataFrame, path: str, chunk_rows: int = CHUNK_ROWS, sort_by: str | list[str] | None = None) -> None:
    """Files of at most chunk_rows rows, a row group each, so that footers can rule chunks out; sort_by makes their
    ranges narrow. Text is dictionary- and run-length-encoded by the format where that pays."""
    if sort_by:
        frame = frame.orderBy(sort_by)
    frame.write.mode("errorifexists").option("maxRecordsPerFile", chunk_rows).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
