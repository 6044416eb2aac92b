"""Reading the shared tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows, and bytes, of whole pages that go to a Python worker at once; a page larger than that is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def modest_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and in bytes, unless the session already asks for smaller ones: a worker's memory then does not grow with its partition."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b"))
        if now > most or now <= 0:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def dealt(df: DataFrame) -> DataFrame:
    """For narrow rows and work that is heavy for each: dealt to all cores whatever the scan's splits and row groups are. Select the columns needed first."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy for each row: a scan of fewer splits than there are cores is dealt to all of them; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
