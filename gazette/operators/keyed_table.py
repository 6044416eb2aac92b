"""A keyed Parquet table with versions: upsert, insert-if-absent, range replacement and diff replacement as sinks.

Rows lie in buckets by a hash of their key. A change reads and writes the buckets that it touches only, into a new folder; a
manifest names the folder of each bucket; a rename that never overwrites makes the next manifest current. Until then
readers see the version before, so a job that dies leaves at most files that no manifest names (``expire`` removes
them). Of two jobs that start from one version, the second rename fails, and that job is to be run again.

A change may name its writer and batch: a batch that is not above the writer's last one is skipped, so a stream
that repeats a batch after a restart writes it once.

Keys may be null (null is a key like others). Of rows that repeat a key within one change, the one of greatest ``order`` counts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.operators import writes

_BUCKET = "bucket_"


class Conflict(RuntimeError):
    """Another change became current first."""


@dataclass
class KeyedTable:
    """keys: the natural key. buckets: fixed when the table is made; a bucket should hold some 100 MB."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: list[str]
    buckets: int

    # Files

    def _path(self, name: str) -> Any:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self) -> Any:
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files = self._files()
        return [s.getPath().getName() for s in files.listStatus(self._path(folder))] if files.exists(self._path(folder)) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": {}, "writers": {}}
        stream = self._files().open(self._path(f"versions/{known[-1] if version is None else version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict[str, Any]) -> None:
        draft, goal = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{manifest['version']}.json")
        out = self._files().create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs
        plain = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(goal.toUri() if goal.toUri().getScheme() else self._files().getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, goal, plain)
        except Exception as e:
            self._files().delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} of {self.path} exists already") from e
            raise

    # Reading

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """Rows of a version (the current one), or of some of its buckets."""
        return self._rows(self.manifest(version), only)

    def _rows(self, manifest: dict[str, Any], only: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, f in manifest["buckets"].items() if only is None or int(b) in set(only)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    # Writing

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of some rows: as many as the table has at most."""
        return sorted(r[0] for r in rows.select(self._bucket().alias(_BUCKET)).distinct().collect())

    def _change(self, touched: Callable[[dict[str, Any]], list[int]], change: Callable[[DataFrame], DataFrame], writer: str | None, batch: int | None) -> int:
        """The version that holds the change: its number, or the current one's if the batch is there already."""
        now = self.manifest()
        if writer is not None and batch is not None and now["writers"].get(writer, -1) >= batch:
            return now["version"]
        some = touched(now)
        if some:
            folder = f"data/{uuid.uuid4().hex}"
            rows = change(self._rows(now, some)).select(*self.schema.names).withColumn(_BUCKET, self._bucket())
            rows.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
            made = {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{_BUCKET}=")}
            now["buckets"] = {b: f for b, f in now["buckets"].items() if int(b) not in set(some)} | made
        if writer is not None and batch is not None:
            now["writers"][writer] = batch
        now["version"] += 1
        self._commit(now)
        return now["version"]

    def _newest(self, rows: DataFrame, order: str | None) -> DataFrame:
        """One row of each key of a change."""
        if order is None:
            return rows.select(*self.schema.names).dropDuplicates(self.keys)
        rest = [c for c in self.schema.names if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_r")).select(*self.keys, *(F.col(f"_r.{c}").alias(c) for c in rest))

    def upsert(self, rows: DataFrame, order: str, keep_first: list[str] | None = None, writer: str | None = None, batch: int | None = None) -> int:
        """Insert rows, or overwrite the row of their key if theirs is of greater order; columns in keep_first keep their oldest value."""
        return self._change(lambda _: self._touched(rows), lambda old: writes.upsert(old, rows.select(*self.schema.names), self.keys, order, keep_first), writer, batch)

    def insert_absent(self, rows: DataFrame, order: str | None = None, writer: str | None = None, batch: int | None = None) -> int:
        """Insert rows whose key is not there; the others change nothing."""
        new = self._newest(rows, order)

        def change(old: DataFrame) -> DataFrame:
            there = old.select(*(F.col(k).alias(f"_k_{k}") for k in self.keys), F.lit(True).alias("_there"))
            same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.keys]
            on = same[0]
            for s in same[1:]:
                on = on & s
            return old.unionByName(new.join(there, on, "left_anti").select(*self.schema.names))

        return self._change(lambda _: self._touched(rows), change, writer, batch)

    def replace_range(self, rows: DataFrame, within: Column, order: str | None = None, writer: str | None = None, batch: int | None = None) -> int:
        """Delete the rows for which within holds, then insert rows; the buckets touched are those of either."""
        new = self._newest(rows, order)

        def touched(now: dict[str, Any]) -> list[int]:
            return sorted({*self._touched(rows), *self._touched(self._rows(now).where(within))})

        return self._change(touched, lambda old: writes.replace_range(old, new, within), writer, batch)

    def diff_replace(self, rows: DataFrame, scope: list[str], order: str | None = None, writer: str | None = None, batch: int | None = None, emptied: DataFrame | None = None) -> int:
        """rows become all that there is of their scopes (and of those in emptied): rows of the key are overwritten, those of other keys deleted."""
        scopes = rows.select(*scope) if emptied is None else rows.select(*scope).unionByName(emptied.select(*scope))
        scopes, new = scopes.distinct(), self._newest(rows, order)

        def touched(now: dict[str, Any]) -> list[int]:
            return sorted({*self._touched(rows), *self._touched(self._rows(now).join(scopes, scope, "left_semi"))})

        return self._change(touched, lambda old: old.join(scopes, scope, "left_anti").unionByName(new.select(*self.schema.names)), writer, batch)

    def expire(self, keep: int = 2) -> int:
        """Remove all but the last ``keep`` versions and the data that only they, or none, name; the number of folders removed.

        Not while a change is under way: its folder is named by no version yet.
        """
        files, known = self._files(), self.versions()
        named = {f.split("/")[1] for v in known[-keep:] for f in self.manifest(v)["buckets"].values()}
        for v in known[:-keep]:
            files.delete(self._path(f"versions/{v}.json"), False)
        gone = [n for n in self._names("data") if n not in named]
        for n in gone:
            files.delete(self._path(f"data/{n}"), True)
        return len(gone)
