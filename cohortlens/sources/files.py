"""CSV in and out, with declared types and quoted fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    *,
    null_value: str = "NA",
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header row and a declared schema; no inference pass over the data.

    Quoted fields may hold commas and doubled quotes, and a large file is read by many tasks. Fields with line breaks
    need ``multi_line=True``; a file cannot be split then, so such inputs should come as many files.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("nullValue", null_value)
        .option("encoding", "UTF-8")
        .option("enforceSchema", True)
        .csv(path)
    )


def write_csv(
    df: DataFrame,
    path: str,
    *,
    null_value: str = "NA",
    max_rows_per_file: int = 5_000_000,
    mode: str = "errorifexists",
) -> None:
    """One logical table as a folder of CSV part files, each with the header row.

    Every task writes its own files. Nothing is gathered into one file.
    """
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", null_value)
        .option("maxRecordsPerFile", max_rows_per_file)
        .csv(path)
    )
