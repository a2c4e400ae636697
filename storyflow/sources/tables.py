"""Sinks: plain partitioned append, and keyed tables with published snapshots.

A keyed table is a folder with immutable data files and manifests. A manifest lists the live segments (one folder per hash bucket,
and per partition value where the table has a partition column). An upsert writes the merged rows of the buckets
that hold changed keys to new segments and then publishes a manifest, one file that appears at once by rename. So a reader sees
the table before or after, never half; a failed write leaves no trace in it; and what is rewritten follows the
changed keys. Buckets split one by one as rows come (linear hashing), so their size stays bounded and a split touches only its own bucket.
One writer at a time; the second of two that meet fails before it publishes.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from storyflow.session import materialize

_BUCKET, _PART, _HASH = "_bucket", "_part", "_hash"
_WHOLE = "all"
_MANIFEST = "part string, bucket int, buckets int, segment string, rows long, keys array<string>, partition_by string, schema string"


def write_table(df: DataFrame, path: str, partition_cols: list[str] | None = None) -> None:
    """Append rows. The rebalance hint gathers each partition value into few files, while the
    adaptive planner still splits a dominant value over many tasks."""
    if partition_cols:
        df = df.hint("rebalance", *partition_cols)
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_cols) if partition_cols else writer).parquet(path)


def readable(spark: SparkSession, path: str, schema: str | None = None) -> bool:
    """Whether Spark's reader finds a table at ``path``, in whatever store. With a schema no file is opened."""
    try:
        (spark.read if schema is None else spark.read.schema(schema)).parquet(path).schema  # noqa: B018
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def exists(spark: SparkSession, path: str) -> bool:
    return readable(spark, f"{path}/manifest", _MANIFEST) or readable(spark, path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions, from the list of manifest files."""
    if not readable(spark, f"{path}/manifest", _MANIFEST):
        return []
    files = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").inputFiles()
    return sorted({int(f.rsplit("/version=", 1)[1].split("/")[0]) for f in files})


class Snapshot:
    """One published state of a keyed table: its version and live segments."""

    def __init__(self, spark: SparkSession, path: str, version: int, rows: list):
        self.spark, self.path, self.version = spark, path, version
        head = rows[0]
        self.keys, self.partition_by, self.schema = head["keys"], head["partition_by"], StructType.fromJson(json.loads(head["schema"]))
        self.segments = {(r["part"], r["bucket"]): r for r in rows if r["segment"] is not None}
        self.buckets = {r["part"]: r["buckets"] for r in rows if r["segment"] is not None}

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
        """The newest published state, or an older one that is still kept."""
        versions = _versions(spark, path)
        if not versions:
            return None
        version = versions[-1] if version is None else version
        return Snapshot(spark, path, version, spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/version={version}").collect())

    def read(self, places=None) -> DataFrame:
        """Rows of the whole table, or of some (part, bucket) places."""
        wanted = self.segments if places is None else [p for p in places if p in self.segments]
        paths = [f"{self.path}/{self.segments[p]['segment']}" for p in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> int:
        return sum(r["rows"] for r in self.segments.values())


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    snapshot = Snapshot.load(spark, path, version)
    return snapshot.read() if snapshot is not None else spark.read.parquet(path)


def read_since(spark: SparkSession, path: str, first_part: str, last_part: str | None = None) -> tuple[DataFrame, int] | None:
    """Rows of the partitions from ``first_part`` on (to ``last_part``), and their number as the manifest has it; None
    where no table is. Other partitions are not opened."""
    s = Snapshot.load(spark, path)
    if s is None:
        return None
    places = [p for p in s.segments if p[0] >= first_part and (last_part is None or p[0] <= last_part)]
    return s.read(places), sum(s.segments[p]["rows"] for p in places)


def _bucket_of(buckets: dict[str, int]) -> Column:
    """Linear hashing: of n buckets, those that the doubled modulus does not reach yet take the plain one."""
    n = F.lit(1)
    if buckets:
        n = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv]), F.col(_PART)), n)
    low = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double")) + 1e-9)).cast("bigint")
    wide = F.pmod(F.col(_HASH), low * 2)
    return F.when(wide >= n, F.pmod(F.col(_HASH), low)).otherwise(wide).cast("int")


def bucket_column(buckets: dict[str, int], keys: list[str]) -> Column:
    """The bucket of a row, for tables without a partition column."""
    n = buckets.get(_WHOLE, 1)
    low = 1 << (n.bit_length() - 1)
    wide = F.pmod(F.xxhash64(*keys), F.lit(2 * low))
    return F.when(wide >= n, F.pmod(F.xxhash64(*keys), F.lit(low))).otherwise(wide).cast("int")


def _parent(bucket: int, n: int) -> int:
    """The bucket among ``n`` whose rows a new bucket takes over."""
    while bucket >= n:
        bucket -= 1 << (bucket.bit_length() - 1)
    return bucket


def _placed(df: DataFrame, keys: list[str], partition_by: str | None) -> DataFrame:
    part = F.coalesce(F.col(partition_by).cast("string"), F.lit("none")) if partition_by else F.lit(_WHOLE)
    return df.withColumns({_PART: part, _HASH: F.xxhash64(*keys)})


def _write_segments(df: DataFrame, path: str, buckets: dict[str, int]) -> list[dict]:
    """Store placed rows in new segments; one manifest entry per segment."""
    folder = f"data/{uuid.uuid4().hex}"
    placed = df.withColumn(_BUCKET, _bucket_of(buckets)).drop(_HASH)
    placed.hint("rebalance", _PART, _BUCKET).write.partitionBy(_PART, _BUCKET).parquet(f"{path}/{folder}")
    # Partition values come from the paths and counts from the files' footers.
    stored = df.sparkSession.read.schema(f"{_PART} string, {_BUCKET} int").parquet(f"{path}/{folder}")
    return [{"part": r[_PART], "bucket": r[_BUCKET], "buckets": buckets.get(r[_PART], 1), "segment": f"{folder}/{_PART}={r[_PART]}/{_BUCKET}={r[_BUCKET]}", "rows": r["n"]}
            for r in stored.groupBy(_PART, _BUCKET).agg(F.count("*").alias("n")).collect()]


def _publish(spark: SparkSession, path: str, version: int, segments: list[dict], keys: list[str], partition_by: str | None, schema: StructType) -> None:
    """One file, which a rename puts in place; an existing version is never replaced."""
    common = {"keys": keys, "partition_by": partition_by, "schema": schema.json()}
    head = {"part": None, "bucket": None, "buckets": None, "segment": None, "rows": 0}
    names = [c.split()[0] for c in _MANIFEST.split(", ")]
    rows = [tuple((s | common)[c] for c in names) for s in [head, *segments]]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("error").parquet(f"{path}/manifest/version={version}")


def _entry(r) -> dict:
    return {k: r[k] for k in ("part", "bucket", "buckets", "segment", "rows")}


def _latest(df: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row per key: the one with the largest ``order``, or the largest by the other columns in turn."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = F.max(F.struct(*([order] if order else []), *[c for c in rest if c != order])).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, "r.*").select(*df.columns)


def upsert(df: DataFrame, path: str, keys: list[str], buckets: int = 1, order: str | None = None, partition_by: str | None = None,
           bucket_rows: int = 1_000_000) -> dict[str, int]:
    """Insert new keys, replace known ones, count both; repeating the call gives the same table, which makes it safe for
    retried stream batches.

    ``partition_by`` names a column that a key never changes (a day, say); ``bucket_rows`` is the size at which buckets split, and
    ``buckets`` the least number of them in a new table. The columns, keys and partition column of a table are those of its first call."""
    spark = df.sparkSession
    snapshot = Snapshot.load(spark, path)
    if snapshot is not None:
        keys, partition_by = snapshot.keys, snapshot.partition_by
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in snapshot.schema])
    new = materialize(_placed(_latest(df, keys, order), keys, partition_by), "upsert")
    places = new.groupBy(_PART, _bucket_of(snapshot.buckets if snapshot is not None else {}).alias(_BUCKET)).agg(F.count("*").alias("n")).collect()  # one row per bucket
    added = defaultdict(int)
    for r in places:
        added[r[_PART]] += r["n"]
    total = sum(added.values())
    if total == 0:
        return {"created": 0, "updated": 0}
    schema = new.drop(_PART, _HASH).schema if snapshot is None else snapshot.schema
    if snapshot is None:
        grown = {p: max(buckets, math.ceil(n / bucket_rows)) for p, n in added.items()}
        _publish(spark, path, 1, _write_segments(new, path, grown), keys, partition_by, schema)
        return {"created": total, "updated": 0}

    held = defaultdict(int)
    for (p, _), r in snapshot.segments.items():
        held[p] += r["rows"]
    now = {p: snapshot.buckets.get(p, 1) for p in added}
    touched = {(r[_PART], r[_BUCKET]) for r in places}
    old = _placed(snapshot.read(touched), keys, partition_by)
    same = [*keys, _PART]
    known = {r[_PART]: r["n"] for r in old.join(new.select(*same), same, "left_semi").groupBy(_PART).agg(F.count("*").alias("n")).collect()}
    merged = old.join(new.select(*same), same, "left_anti").unionByName(new)
    grown = {p: max(now[p], math.ceil((held[p] + added[p] - known.get(p, 0)) / bucket_rows)) for p in added}
    split = {(p, _parent(b, now[p])) for p in added for b in range(now[p], grown[p])} - touched
    if split:
        merged = merged.unionByName(_placed(snapshot.read(split), keys, partition_by))
    fresh = _write_segments(merged, path, grown)
    rest = [_entry(r) | {"buckets": grown.get(p, r["buckets"])} for (p, b), r in snapshot.segments.items() if (p, b) not in touched | split]
    _publish(spark, path, snapshot.version + 1, rest + fresh, keys, partition_by, schema)
    updated = sum(known.values())
    return {"created": total - updated, "updated": updated}


def delete_before(spark: SparkSession, path: str, column: str, limit: Column, last_part: str) -> dict[str, int]:
    """Delete the rows whose ``column`` lies before ``limit`` from a table partitioned by day (as text that sorts by time).

    Partitions before ``last_part``, the day of the limit, leave the manifest unread; that one day is rewritten; later ones are not touched.
    Undated rows stay."""
    s = Snapshot.load(spark, path)
    whole = {p for p in s.segments if p[0] < last_part}
    edge = {p for p in s.segments if p[0] == last_part}
    gone = sum(s.segments[p]["rows"] for p in whole)
    keep = [_entry(r) for p, r in s.segments.items() if p not in whole | edge]
    if edge:
        left = s.read(edge).filter(~F.coalesce(F.col(column) < limit, F.lit(False)))
        fresh = _write_segments(_placed(left, s.keys, s.partition_by), path, {last_part: s.buckets[last_part]})
        gone += sum(s.segments[p]["rows"] for p in edge) - sum(e["rows"] for e in fresh)
        keep += fresh
    if gone:
        _publish(spark, path, s.version + 1, keep, s.keys, s.partition_by, s.schema)
    return {"deleted": gone, "segments_dropped": len(whole), "segments_rewritten": len(edge), "segments_untouched": len(s.segments) - len(whole) - len(edge)}


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove manifests but the newest ``keep`` and the data that no kept one lists; the number of removed folders.
    Readers of older states must have ended."""
    every = spark.read.schema(_MANIFEST + ", version int").parquet(f"{path}/manifest")
    versions = _versions(spark, path)
    old, kept = versions[:-keep], versions[-keep:]
    if not old:
        return 0
    listed = every.filter("segment is not null").select("segment", F.col("version").isin(kept).alias("live")).groupBy("segment").agg(F.max("live").alias("live"))
    dead = [r[0] for r in listed.filter("not live").collect()]
    jvm = spark.sparkContext._jvm
    for name in [*dead, *(f"manifest/version={v}" for v in old)]:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(dead) + len(old)
