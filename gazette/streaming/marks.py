"""High-water marks per key over a stream, and a debounce by the last accepted trigger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gazette.operators.ingest import above_marks, advance_marks


def start_marked_intake(stream: DataFrame, key: str, value: str, rows_path: str, marks_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the posts above their key's mark to rows_path and the marks of each batch to marks_path/batch=n.

    Marks are one row a key. A batch that runs again reads the marks of the batch before it and overwrites
    its own output, so a restart neither loses nor doubles posts.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # read once: rows and marks are of the same read
        marks = spark.createDataFrame([], batch.select(key, F.col(value).alias("mark")).schema) if n == 0 else spark.read.parquet(f"{marks_path}/batch={n - 1}")
        above_marks(batch, marks, key, value).write.mode("overwrite").parquet(f"{rows_path}/batch={n}")
        advance_marks(batch, marks, key, value).write.mode("overwrite").parquet(f"{marks_path}/batch={n}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def debounce(df: DataFrame, key: str, at: str, gap_seconds: int = 10) -> DataFrame:
    """key, at of accepted triggers. A trigger is compared with the last accepted one, so keys are folded in order.

    Rows are dealt by key and sorted by Spark; a worker reads them as a stream and keeps one timestamp, so a
    key with any number of triggers needs no more memory than another.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for frame in frames:
            out = []
            for k, t in zip(frame["key"], frame["at"], strict=True):
                if k != current:
                    current, last = k, None
                if last is None or (t - last).total_seconds() >= gap_seconds:
                    last = t
                    out.append((k, t))
            yield pd.DataFrame(out, columns=["key", "at"]).astype({"key": frame["key"].dtype})

    rows = df.select(F.col(key).alias("key"), F.col(at).alias("at")).where("key is not null and at is not null")
    dealt = rows.repartition("key").sortWithinPartitions("key", "at")
    return dealt.mapInPandas(run, dealt.schema).select(F.col("key").alias(key), F.col("at").alias(at))
