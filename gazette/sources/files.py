"""Pages of unknown encoding, files of an experiment by glob, and rows appended to a table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(data: Column) -> Column:
    """Text of bytes: the first encoding of UTF-8, CP949 and EUC-KR that reads them, else UTF-8 with replacements; null for null."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ("utf-8", "cp949", "euc-kr"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("utf-8", "replace")

    @F.pandas_udf("string")
    def read(column: pd.Series) -> pd.Series:
        return column.map(one)

    return read(data)


def eval_files(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON files of an evaluation, a row each, with the arm (folder) and name of the file they are from."""
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(schema).option("multiLine", True).json(glob).select("*", F.element_at(F.split(path, "/"), -2).alias("arm"), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.json$", "").alias("name"))
    return rows


def append_rows(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Insert rows into a Parquet table; its columns must be those of the table."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)
