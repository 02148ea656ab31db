"""The last row of each key as a keyed, bucketed dataset that micro-batches update in place.

Layout below a folder: `data/bucket=<b>/batch=<n>/*.parquet` holds a bucket's whole state as of a
batch, `commits/<n>` says that batch n is complete, `streams/` where a stream's numbers begin. A batch rewrites the buckets that its keys
hash to and no others; readers take each bucket's newest version among the complete batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.operators.logs import latest

BUCKETS = 64


class KeyedState:
    """State of `path`: one row of `columns` a key, the one with the greatest `order`.

    Exactly once: a batch that is run again replaces what it left (its folder, its number), as
    it merges with the version before its own; a crash before the commit leaves the old versions
    in use. Two versions of a bucket are kept, so a reader that has listed the files can finish.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, order: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.schema = schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def committed(self) -> set[int]:
        return {int(n) for n in self._names("commits")}

    def versions(self, before: int | None = None) -> dict[int, int]:
        """bucket -> its newest complete batch (before a given one): one entry a bucket."""
        done = {n for n in self.committed() if before is None or n < before}
        out = {}
        for name in self._names("data"):
            if name.startswith("bucket="):
                b = int(name.split("=")[1])
                found = [n for v in self._names(f"data/{name}") if v.startswith("batch=") and (n := int(v.split("=")[1])) in done]
                if found:
                    out[b] = max(found)
        return out

    def read(self, only: set[int] | None = None, before: int | None = None) -> DataFrame:
        """The state, or that of some buckets."""
        paths = [f"{self.path}/data/bucket={b}/batch={n}" for b, n in self.versions(before).items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Takes a batch in. Rows of a key are reduced to one before anything is shuffled."""
        if number in self.committed():
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = latest(batch.select(*self.schema.names), [self.key], self.order).withColumn("bucket", bucket).persist()
        try:
            touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # a number a bucket
            if touched:
                old = self.read(touched, before=number).withColumn("bucket", bucket)
                merged = latest(old.unionByName(new), [self.key, "bucket"], self.order)
                for b in touched:
                    self._fs.delete(self._path(f"{self.path}/data/bucket={b}/batch={number}"), True)
                # one task writes a bucket: its state must fit a file, so buckets grow with the keys
                out = merged.withColumn("batch", F.lit(number)).repartition(len(touched), "bucket")
                out.write.mode("append").partitionBy("bucket", "batch").parquet(f"{self.path}/data")
        finally:
            new.unpersist()
        self._fs.create(self._path(f"{self.path}/commits/{number}"), True).close()
        self._tidy(touched)

    def _tidy(self, touched: set[int]) -> None:
        done = self.committed()
        for b in touched:
            numbers = sorted(int(v.split("=")[1]) for v in self._names(f"data/bucket={b}") if v.startswith("batch="))
            for n in [n for n in numbers if n in done][:-2]:
                self._fs.delete(self._path(f"{self.path}/data/bucket={b}/batch={n}"), True)

    def _base(self, checkpoint: str) -> int:
        """The number of a checkpoint's first batch here: each stream counts from 0, so a second
        one goes on after the batches that were there when it began."""
        name = hashlib.sha256(checkpoint.encode()).hexdigest()[:32]
        known = [n.split("-")[1] for n in self._names("streams") if n.startswith(name)]
        if known:
            return int(known[0])
        base = max(self.committed(), default=-1) + 1
        self._fs.create(self._path(f"{self.path}/streams/{name}-{base}"), True).close()
        return base

    def follow(self, stream: DataFrame, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Merges everything the stream has now, batch by batch, then stops. `each` prepares a
        batch."""
        take, base = each or (lambda df: df), self._base(checkpoint)
        query = stream.writeStream.foreachBatch(lambda df, n: self.merge(take(df), base + n))
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
