"""Tables that are updated in place of being rewritten: key buckets and numbered segments behind a manifest.

A store is a folder. Rows lie in hash buckets of their key; an update writes the buckets that it touches anew, beside the old
ones, and then a manifest that says which version of each bucket counts. A reader sees the last whole manifest, so a write that
fails leaves the version before it, and two writers of one version cannot both succeed. An event log is a store of the last
event of each identity, beside segments of JSON lines in order: an append reads the buckets of its own identities and the
manifest, never the log.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.events import dedupe_consecutive, with_rank
from ..operators.graph import reliable

#: Buckets of a new store, and manifests that are kept.
BUCKETS, KEPT = 64, 8


class _Files:
    """A folder in whatever store its path names, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self.folder = folder.rstrip("/")
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, below: str) -> list[str]:
        at = self._path(f"{self.folder}/{below}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def any(self) -> bool:
        at = self._path(self.folder)
        return self._fs.exists(at) and len(self._fs.listStatus(at)) > 0

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return self._text.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A file that must not be there yet."""
        stream = self._fs.create(self._path(f"{self.folder}/{name}"), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)


class Conflict(RuntimeError):
    """Another writer took the version first; nothing of this write counts, and it can be tried again."""


class BucketStore:
    """Rows with one row a ``key`` (a column), in hash buckets."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self._files = spark, path.rstrip("/"), key, _Files(spark, path)
        self._new = {"version": 0, "count": buckets, "buckets": {}, "schema": None, "extra": {}}

    def state(self) -> dict:
        """The last whole manifest; one that is cut short does not count."""
        for name in reversed(self._files.names("manifests")):
            try:
                return json.loads(self._files.read(f"manifests/{name}"))
            except json.JSONDecodeError:
                continue
        return self._new

    def bucket(self, count: int):
        return F.pmod(F.xxhash64(self.key), F.lit(count)).cast("int")

    def read(self, buckets: list[int] | None = None, state: dict | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; nothing if the store has never been written."""
        state = state or self.state()
        if not state["schema"]:
            return None
        schema = T.StructType.fromJson(state["schema"])
        wanted = [b for b in (map(str, buckets) if buckets is not None else state["buckets"]) if b in state["buckets"]]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{state['buckets'][b]}/_bucket={b}" for b in wanted])

    def upsert(self, rows: DataFrame, extra: dict | None = None, state: dict | None = None) -> list[int]:
        """Put ``rows`` (one a key) in place of those of their keys; the buckets that were written anew.

        The columns stay those of the first write. A row that repeats a key within ``rows`` is an error.
        """
        state = state or self.state()
        count, version = state["count"], state["version"] + 1
        schema = T.StructType.fromJson(state["schema"]) if state["schema"] else rows.schema
        rows = reliable(rows.select(*schema.names).withColumn("_bucket", self.bucket(count)))
        repeated = rows.groupBy(self.key).count().where("count > 1").first()
        if repeated:
            raise ValueError(f"{self.key} {repeated[0]} is repeated")
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # no more than there are buckets
        folder = f"{version:08d}-{uuid.uuid4().hex[:8]}"
        if touched:
            old = self.read(touched, state)
            merged = rows if old is None else rows.unionByName(old.withColumn("_bucket", self.bucket(count)).join(rows.select(self.key), self.key, "left_anti").select(rows.columns))
            merged.repartition(min(count, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        self._commit(state, {"version": version, "count": count, "buckets": state["buckets"] | {str(b): folder for b in touched}, "schema": json.loads(schema.json()), "extra": state["extra"] | (extra or {})})
        return touched

    def _commit(self, before: dict, after: dict) -> None:
        name = f"{after['version']:08d}.json"
        try:
            self._files.create(f"manifests/{name}", json.dumps(after))
        except Exception as error:
            if "FileAlreadyExists" in str(error) or "already exists" in str(error):
                raise Conflict(f"version {after['version']} of {self.path} is taken") from error
            raise
        for old in self._files.names("manifests")[:-KEPT]:
            self._files.remove(f"manifests/{old}")

    def vacuum(self) -> list[str]:
        """Remove the bucket folders that no kept manifest names; those of a running write are in none yet, so run it alone."""
        named = set()
        for name in self._files.names("manifests"):
            named |= set(json.loads(self._files.read(f"manifests/{name}"))["buckets"].values())
        gone = [x for x in self._files.names("data") if x not in named]
        for x in gone:
            self._files.remove(f"data/{x}")
        return gone


class EventLog:
    """Numbered segments of JSON lines, and a store of what each identity's last event was."""

    def __init__(self, spark: SparkSession, path: str, same: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.same = spark, path.rstrip("/"), same
        self.index = BucketStore(spark, f"{self.path}/index", "identity", buckets)

    @staticmethod
    def segments(spark: SparkSession, path: str) -> list[str] | None:
        """The folders of a log's segments in order; nothing if ``path`` holds no such log."""
        state = BucketStore(spark, f"{path.rstrip('/')}/index", "identity").state()
        return [f"{path.rstrip('/')}/segments/{name}" for name in state["extra"]["segments"]] if state["version"] else None

    def append(self, events: DataFrame, deduped: bool = True) -> int:
        """Append ``events`` (with ``seq``, their order, and identity) behind the log; how many.

        Those that equal the event of their identity before them, in the log or among themselves, are left out, unless
        ``deduped`` is false. Appended events are numbered on from the log's last ``seq``. A log of plain files is taken in
        as the first segment.
        """
        state = self.index.state()
        if not state["version"] and self.index._files.__class__(self.spark, self.path).any():
            from .readers import read_events

            self._write(read_events(self.spark, self.path)[0], state, {"segments": [], "next": 0})
            state = self.index.state()
        extra = state["extra"] or {"segments": [], "next": 0}
        fresh = events
        if deduped:
            touched = sorted(r[0] for r in events.select(self.index.bucket(state["count"])).distinct().collect())
            last = self.index.read(touched, state)
            columns = ["identity", *self.same]
            given = events.select(*columns, "seq", F.lit(True).alias("_new"))
            if last is not None:
                known = last.join(events.select("identity").distinct(), "identity", "left_semi")
                given = known.select(*columns, F.lit(None).cast(events.schema["seq"].dataType).alias("seq"), F.lit(False).alias("_new")).unionByName(given)
            kept = dedupe_consecutive(given, self.same).where("_new").select("seq")
            fresh = events.join(kept, "seq", "left_semi")
        return self._write(fresh, state, extra)

    def _write(self, fresh: DataFrame, state: dict, extra: dict) -> int:
        numbered = reliable(with_rank(fresh, ["seq"]).withColumn("seq", F.col("rank") + extra["next"]).drop("rank"))
        n = numbered.count()
        if not n:
            return 0
        name = f"{len(extra['segments']) + 1:08d}-{uuid.uuid4().hex[:8]}"
        numbered.orderBy("seq").write.json(f"{self.path}/segments/{name}")
        named = numbered.where("identity is not null") if "identity" in numbered.columns else numbered.limit(0).withColumn("identity", F.lit(None).cast("string"))
        missing = {c: F.lit(None).cast("string") for c in self.same if c not in named.columns}
        last = named.withColumns(missing).groupBy("identity").agg(F.max_by(F.struct(*self.same), "seq").alias("_last")).select("identity", *[F.col(f"_last.{c}").alias(c) for c in self.same])
        self.index.upsert(last, {"segments": [*extra["segments"], name], "next": extra["next"] + n}, state)
        return n


def update_rows(rows: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> list[int]:
    """Put rows of a plan or a history (one a key) in place of those of their keys; the buckets that were rewritten."""
    return BucketStore(rows.sparkSession, path, key, buckets).upsert(rows)


def read_rows(spark: SparkSession, path: str, key: str = "id") -> DataFrame | None:
    """All rows of a store that ``update_rows`` wrote; nothing if there is none."""
    return BucketStore(spark, path, key).read()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all machines share."""
    if spark.sparkContext.getCheckpointDir() is None:
        reliable(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
