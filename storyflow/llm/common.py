"""Shared helpers of the training-data operators: tables, scratch folders, word hashing, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.session import prepare, scratch_root

# ---- tables and scratch


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the operators. Texts go to Python in small batches, so that workers, which live on between stages, stay small."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables of one operator run in the shared checkpoint folder.

    ``keep`` writes a table and reads it back: lineage ends there and a lost executor re-reads files.
    ``drop`` deletes a table that later tables no longer need. What a table's making shuffled goes from the executors' disks once the table is written.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = ready(spark)
        self.root = f"{scratch_root(spark)}/storyflow/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> Kept:
        path = self.path(label)
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return Kept(self.spark.read.schema(df.schema).parquet(path), path)


class Kept:
    """A stored intermediate table."""

    def __init__(self, df: DataFrame, path: str):
        self.df, self.path = df, path

    def drop(self) -> None:
        where, name = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        where.delete_dir(name)


def uri(path: str) -> str:
    """A path as a URI that pyarrow's file systems take (file:/x and /x become file:///x)."""
    if path.startswith("/"):
        return f"file://{path}"
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


# ---- words as byte spans and 64-bit hashes, without a Python object per word

#: Bytes that end a word of the class [^\x20\x09-\x0D]+.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

_random = np.random.Generator(np.random.PCG64(20240607))
_EXACT = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_RATIO = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
#: A text longer than this is hashed piece by piece, cut between words.
PIECE = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64), _RATIO, np.uint64))])
    return _powers


class Words:
    """Words of some texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray):
        self.starts, self.ends, self.hashes, self.first = starts, ends, hashes, first


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool = False, blank: np.ndarray = BLANK) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i+1]]``; ``fold`` hashes A-Z as a-z."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[n] = True
    solid = ~blank[data]
    before = np.concatenate([[True], ~solid[:-1]]) | cut[:n] if n else solid
    after = np.concatenate([~solid[1:], [True]]) | cut[1:] if n else solid
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    hashes = np.empty(len(starts), np.uint64)
    table_ = _FOLDED if fold else _EXACT
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + PIECE)))
        s, e = starts[lo:hi], ends[lo:hi]
        size = e - s
        at = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(int(size.sum())) - np.repeat(at, size)
        part = table_[data[place + np.repeat(s, size)]] * _power(int(size.max()))[place]
        hashes[lo:hi] = np.add.reduceat(part, at) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        lo = hi
    return Words(starts, ends, mix(hashes), np.searchsorted(starts, offsets))


def text_chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column of texts (null: empty) into runs of about ``limit`` bytes: first row, end row, bytes, offsets."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit))))
        yield lo, hi, whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` with a generator of column dictionaries; ``schema`` is a DDL text with the same columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type, from_pandas=False) for f, c in ((f, columns[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(run, struct)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---- connected components


def _only_stars(edges: DataFrame) -> bool:
    """Whether no node has two edges to smaller ids, or one besides edges to larger ones."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 or (up = 1 and down = 1)").isEmpty()


def components(scratch: Scratch, edges: DataFrame) -> Kept:
    """Connected components of ``edges`` (a, b): one row (id, component) per node, component = smallest id.

    Alternates the large-star and small-star steps on stored edge tables until every edge leads to a root; rounds grow
    with the logarithm of the longest chain. Each step is a minimum per node, which combines before the
    shuffle, and a join with one row per node on the other side. That side is stored first: only a join of two plain
    exchanges can be split by adaptive execution when one node is a hub.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now = scratch.keep(ordered, "edges")
    while not _only_stars(now.df):
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least.df, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        step = scratch.keep(large, "large")
        now.drop()
        least.drop()
        # Every edge now points from a smaller id a to a larger id b.
        least = scratch.keep(step.df.groupBy("b").agg(F.min("a").alias("m")), "least")
        joined = step.df.join(least.df, "b")
        small = joined.select(F.col("m").alias("a"), "b").unionByName(
            joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        now = scratch.keep(small, "small")
        step.drop()
        least.drop()
    labels = now.df.select(F.col("b").alias("id"), F.col("a").alias("component"))
    roots = now.df.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    out = scratch.keep(labels.unionByName(roots), "components")
    now.drop()
    return out
