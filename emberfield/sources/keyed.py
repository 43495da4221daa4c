"""A keyed table as a log: appended batches, and buckets that compaction rewrites only where keys changed."""

from __future__ import annotations

import json
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns beside the table's own: the batch that a row came with.
BATCH = "_batch"


def merged(rows: DataFrame, keys: list[str], changing: tuple[str, ...] | None = None, time: str | None = None, batch: str = BATCH) -> DataFrame:
    """One row per key: the columns in ``changing`` (all, if None) from its last row, the others from its first.

    Rows count in the order of their batch, within one by ``time``, then by their other columns.  Partial
    aggregates keep at most two rows per key and task, so a key that comes very often is no hot spot.
    """
    values = [c for c in rows.columns if c not in (*keys, batch)]
    row, order = F.struct(*values), F.struct(batch, *sorted(values, key=lambda c: c != time))
    ends = rows.groupBy(*keys).agg(F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"))
    pick = lambda c: "last" if changing is None or c in changing else "first"
    return ends.select(*keys, *(F.col(f"{pick(c)}.{c}").alias(c) for c in values))


class KeyedTable:
    """A folder with one row per key, for streams and batches.

    ``delta/batch=n`` holds each appended batch by bucket of its keys; ``snapshot/<name>/bucket=b`` the merged
    rows of a bucket.  A manifest names, for each bucket, the snapshot in force and the last batch that
    is in it.  Compaction merges what was appended since, writes new snapshots of the buckets that got
    rows, and the manifest last: if it ends before, nothing has changed for readers, and it is done anew.
    A read is the snapshots and at most ``every`` batches, however many there were before.  A batch that
    is repeated replaces itself, or is passed over if it is in a snapshot already.
    """

    def __init__(
        self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], changing: tuple[str, ...] | None = None,
        time: str | None = None, buckets: int = 16, every: int = 8,
    ):
        self.spark, self.folder, self.schema, self.keys = spark, folder.rstrip("/"), schema, keys
        self.changing, self.time, self.buckets, self.every = changing, time, buckets, every
        found = self.manifest()
        if found:
            # The buckets of a table are those that it was made with.
            self.buckets = found["buckets"]
        else:
            self._publish({"version": 0, "buckets": buckets, "upto": -1, "snapshots": {}})

    @cached_property
    def _fs(self):
        jvm = self.spark._jvm
        return jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json"))

    def manifest(self) -> dict | None:
        """What is in force: the manifest with the highest number."""
        versions = self._versions()
        if not versions:
            return None
        lines = self.spark.read.text(f"{self.folder}/manifest/{versions[-1]:09d}.json").collect()
        return json.loads("".join(r[0] for r in lines))

    def _publish(self, manifest: dict) -> None:
        """Writes a manifest under another name and renames it, so that none is seen in part."""
        part = self._path(f"manifest/{uuid.uuid4().hex}.part")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(part, self._path(f"manifest/{manifest['version']:09d}.json")):
            raise RuntimeError(f"manifest {manifest['version']} is there already: another writer is at work")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def append(self, batch: DataFrame, number: int) -> None:
        """Adds a batch; every ``every`` batches the table is compacted."""
        now = self.manifest()
        if number <= now["upto"]:
            return
        rows = batch.select(*self.schema.names).withColumns({BATCH: F.lit(number).cast("long"), "bucket": self.bucket()})
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/delta/batch={number}")
        if len(self._waiting(now)) >= self.every:
            self.compact()

    def upsert(self, batch: DataFrame) -> None:
        """Adds a batch and merges it at once: only the buckets of its keys are written again."""
        now = self.manifest()
        self.append(batch, max([now["upto"], *self._waiting(now)]) + 1)
        self.compact()

    def _waiting(self, now: dict) -> list[int]:
        """Batches that are in no snapshot."""
        numbers = sorted(int(n.removeprefix("batch=")) for n in self._names("delta") if n.startswith("batch="))
        return [n for n in numbers if n > now["upto"]]

    def _stored(self, now: dict, buckets: list[str] | None = None) -> DataFrame:
        """Rows of the snapshots in force (of some buckets) and of the batches since, with their batch."""
        with_batch = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType())])
        held = {b: n for b, n in now["snapshots"].items() if buckets is None or b in buckets}
        paths = [f"{self.folder}/snapshot/{n}/bucket={b}" for b, n in held.items()]
        for n in self._waiting(now):
            own = {x.removeprefix("bucket=") for x in self._names(f"delta/batch={n}") if x.startswith("bucket=")}
            paths += [f"{self.folder}/delta/batch={n}/bucket={b}" for b in own if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], with_batch)
        return self.spark.read.schema(with_batch).parquet(*paths)

    def read(self) -> DataFrame:
        return merged(self._stored(self.manifest()), self.keys, self.changing, self.time).select(*self.schema.names)

    def compact(self) -> None:
        now = self.manifest()
        waiting = self._waiting(now)
        if not waiting:
            return
        names = [self._names(f"delta/batch={n}") for n in waiting]
        touched = sorted({x.removeprefix("bucket=") for own in names for x in own if x.startswith("bucket=")}, key=int)
        name = uuid.uuid4().hex
        if touched:
            rows = merged(self._stored(now, touched), self.keys, self.changing, self.time)
            # A snapshot's rows come before those of any later batch.
            rows = rows.withColumns({BATCH: F.lit(waiting[-1]).cast("long"), "bucket": self.bucket()})
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/snapshot/{name}")
        snapshots = now["snapshots"] | dict.fromkeys(touched, name)
        self._publish({"version": now["version"] + 1, "buckets": self.buckets, "upto": waiting[-1], "snapshots": snapshots})
        self._clear(now)

    def _clear(self, before: dict) -> None:
        """Removes what neither the manifest in force nor the one before names; readers of these two go on."""
        for version in self._versions():
            if version < before["version"]:
                self._fs.delete(self._path(f"manifest/{version:09d}.json"), False)
        used = {*before["snapshots"].values(), *self.manifest()["snapshots"].values()}
        for name in self._names("snapshot"):
            if name not in used:
                self._fs.delete(self._path(f"snapshot/{name}"), True)
        for name in self._names("delta"):
            if name.startswith("batch=") and int(name.removeprefix("batch=")) <= before["upto"]:
                self._fs.delete(self._path(f"delta/{name}"), True)
