"""A persisted index of the fingerprints of the non-duplicate history, for batches that are small beside it.

Entries ``(layer, key, canonical_id)`` lie in a keyed table whose buckets split as it grows. Every segment has a filter:
a Bloom filter in words of 64 bits, one word per five keys, each key with four bits of one word. A lookup probes the filters
of the buckets that its keys fall into, which is an equi-join on (bucket, word), and opens only the segments where a key
passed. So what a batch reads of the entries follows its hits, and of the filters about two bytes per entry.

A segment without a filter (a writer that stopped in between) is opened for every key of its bucket; the next ``add`` writes the filter.
Null and empty keys are no fingerprints and match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.functions.text import entity_fingerprint
from storyflow.operators.dedup import HASH_LAYERS
from storyflow.session import materialize
from storyflow.sources.tables import Snapshot, bucket_column, readable, upsert

ENTITY_LAYER = "entity_fingerprint"
LAYERS = (*HASH_LAYERS, ENTITY_LAYER)
_KEYS_PER_WORD, _BITS_PER_KEY = 5, 4
_FILTER = "word int, bits bigint"


def entries(rows: DataFrame, id_alias: str = "canonical_id", **layers: Column) -> DataFrame:
    """``(layer, key, id)``: one row per article and layer; ``layers`` are columns by layer name."""
    listed = F.array(*[F.struct(F.lit(LAYERS.index(name)).alias("layer"), key.alias("key")) for name, key in layers.items()])
    return (rows.select(F.col("article_id").alias(id_alias), F.explode(listed).alias("e")).select("e.layer", "e.key", id_alias)
            .where(F.col("key").isNotNull() & (F.col("key") != "")))


def hash_entries(rows: DataFrame, id_alias: str = "canonical_id") -> DataFrame:
    """Entries of rows that ``with_fingerprints`` has completed."""
    return entries(rows, id_alias, url=F.col("normalized_url"), title_hash=F.col("title_fingerprint"), content_hash=F.col("content_fingerprint"))


def entity_entries(rows: DataFrame, id_alias: str = "canonical_id") -> DataFrame:
    """Entries of enriched rows (companies, product, event_type)."""
    return entries(rows, id_alias, entity_fingerprint=entity_fingerprint(F.col("companies"), F.col("product"), F.col("event_type")))


def _words(rows: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / _KEYS_PER_WORD)).cast("int")


def _word(words: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("word"), "layer", "key"), words).cast("int").alias("word")


def _mask() -> Column:
    h, mask = F.xxhash64(F.lit("bits"), "layer", "key"), F.lit(0).cast("bigint")
    for i in range(_BITS_PER_KEY):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask.alias("mask")


def _written(segment: str) -> str:
    """The write that a segment belongs to."""
    return segment.split("/")[1]


def _ready(spark: SparkSession, path: str) -> set[str]:
    """Writes whose filters are complete."""
    if not readable(spark, f"{path}/ready", "write string"):
        return set()
    return {r.write for r in spark.read.schema("write string").option("recursiveFileLookup", "true").parquet(f"{path}/ready").collect()}


def _add_filters(spark: SparkSession, path: str) -> None:
    """Filters of the live segments that have none, all in one job per write; ready once the job has ended."""
    snapshot = Snapshot.load(spark, path)
    ready, missing = _ready(spark, path), {}
    for place, r in snapshot.segments.items():
        if _written(r["segment"]) not in ready:
            missing.setdefault(_written(r["segment"]), []).append((place, r))
    for write, segments in missing.items():
        sizes = spark.createDataFrame([(bucket, r["rows"]) for (_, bucket), r in segments], "bucket int, rows long")
        rows = snapshot.read([place for place, _ in segments]).withColumn("bucket", bucket_column(snapshot.buckets, snapshot.keys))
        placed = rows.join(F.broadcast(sizes), "bucket").select("bucket", _word(_words(F.col("rows"))), _mask())
        bits = placed.groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
        bits.hint("rebalance", "bucket").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/filter/{write}")
        spark.createDataFrame([(write,)], "write string").coalesce(1).write.mode("overwrite").parquet(f"{path}/ready/{write}")


def add(found: DataFrame, path: str, bucket_rows: int = 200_000) -> dict[str, int]:
    """Take entries into the index; of several articles with a key the smallest id is canonical. Repeating it changes nothing."""
    spark = found.sparkSession
    new = materialize(found.groupBy("layer", "key").agg(F.min("canonical_id").alias("canonical_id")), "entries")
    if Snapshot.load(spark, path) is not None:
        known = lookup(new.select("layer", "key"), path)[0].withColumnRenamed("canonical_id", "known_id")
        # Only keys that are new or get a smaller id; buckets of the others stay as they are.
        new = new.join(known, ["layer", "key"], "left").where("known_id IS NULL OR canonical_id < known_id").select("layer", "key", "canonical_id")
    counts = upsert(new, path, ["layer", "key"], bucket_rows=bucket_rows)
    if Snapshot.load(spark, path) is not None:
        _add_filters(spark, path)
    return counts


def lookup(keys: DataFrame, path: str) -> tuple[DataFrame, dict[str, int]]:
    """``(layer, key, canonical_id)`` of the distinct ``keys`` that the index holds, and what was opened: segments and rows
    read, and those of the whole index."""
    spark = keys.sparkSession
    snapshot = Snapshot.load(spark, path)
    empty = spark.createDataFrame([], "layer int, key string, canonical_id long")
    if snapshot is None:
        return empty, {"segments_read": 0, "rows_read": 0, "segments": 0, "rows": 0}
    ready = _ready(spark, path)
    # One row per bucket, as the manifest has it.
    listed = [(bucket, r["rows"], _written(r["segment"]) in ready) for (_, bucket), r in snapshot.segments.items()]
    sizes = F.broadcast(spark.createDataFrame(listed, "bucket int, rows long, filtered boolean"))
    placed = keys.select("layer", "key").distinct().withColumn("bucket", bucket_column(snapshot.buckets, snapshot.keys)).join(sizes, "bucket")
    probes = materialize(placed.select("layer", "key", "bucket", "filtered", _word(_words(F.col("rows"))), _mask()), "probes")
    asked = {r.bucket for r in probes.select("bucket").distinct().collect()}
    passed = probes.where(~F.col("filtered")).select("layer", "key", "bucket")
    by_write: dict[str, list[int]] = {}
    for (_, bucket), r in snapshot.segments.items():
        if bucket in asked and _written(r["segment"]) in ready:
            by_write.setdefault(_written(r["segment"]), []).append(bucket)
    paths = [f"{path}/filter/{write}/bucket={b}" for write, buckets in by_write.items() for b in buckets]
    if paths:
        bits = spark.read.schema(_FILTER).parquet(*paths).withColumn("bucket", F.regexp_extract(F.input_file_name(), r"/bucket=(\d+)/", 1).cast("int"))
        hit = probes.where("filtered").join(bits, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        passed = passed.unionByName(hit.select("layer", "key", "bucket"))
    passed = materialize(passed, "passed")
    places = [p for p in snapshot.segments if p[1] in {r.bucket for r in passed.select("bucket").distinct().collect()}]
    opened = {"segments_read": len(places), "rows_read": sum(snapshot.segments[p]["rows"] for p in places), "segments": len(snapshot.segments), "rows": snapshot.rows()}
    return (snapshot.read(places).join(passed.select("layer", "key"), ["layer", "key"], "left_semi") if places else empty), opened


def duplicates(batch: DataFrame, path: str) -> DataFrame:
    """First layer of the index that an entry of ``batch`` (layer, key, article_id) hits: ``(article_id, canonical_id, layer, score)``."""
    batch = materialize(batch, "batch")
    hits = batch.join(lookup(batch, path)[0], ["layer", "key"])
    names = F.array(*map(F.lit, LAYERS))
    return hits.groupBy("article_id").agg(F.min(F.struct("layer", "canonical_id")).alias("m")).select(
        "article_id", F.col("m.canonical_id").alias("canonical_id"), F.element_at(names, F.col("m.layer") + 1).alias("layer"), F.lit(1.0).alias("score"))
