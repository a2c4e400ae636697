"""Importance resampling of documents towards a target text set.

Features of a text are its words and neighbouring word pairs, hashed (crc32) into buckets. One pass counts the buckets of all
documents and one those of the target; the log ratio of both is an array with one gain per bucket, which goes to the tasks
that score the documents: a document's weight is the mean gain of its features, and Gumbel noise from its id
makes the highest scores a sample without replacement.

The k-th highest score is found by distributed quickselect over composite keys (score, id, a number that parts equal
rows): random pivot keys are drawn from the rows that are left, one aggregation counts the rows between and equal to
them exactly, and only the rows between the two pivots around the k-th go on, as a stored table. Each round leaves
about one in ``pivots`` rows. The rows up to that key alone are sorted (by ranges) and ranked.

Defined results: a null or empty text has no features and weight 0; a null id draws its noise from the empty text and
comes last among ties; rows that share an id are documents of their own with equal noise, and where they tie altogether the
order of the stored rows decides; empty tables give an empty result; other columns are ignored. A text of any length is read in one
task, in memory of a fixed multiple of its length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyflow.llm.common import Scratch, per_batch, text_chunks

LAST = 2**63 - 1


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    #: Fewest words of a document that can be drawn, and the share of those that is.
    min_words: int = 20
    percent: int = 25
    seed: int = 7
    #: Pivot keys of a round of the selection.
    pivots: int = 32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_CRC = _crc_table()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: ASCII other than letters and digits ends a word.
_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Words with more bytes than this are hashed one by one.
_LONG = 48


def _extended(data: np.ndarray, starts: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 registers after each word's bytes, from the registers before. Words come longest first."""
    state = state.copy()
    long = int(np.searchsorted(-size, -_LONG))
    for i in range(long):
        at = int(starts[i])
        state[i] = ~np.uint32(zlib.crc32(data[at : at + int(size[i])].tobytes(), int(~state[i])))
    n = np.searchsorted(-size, -np.arange(_LONG))  # words with more than 0, 1, 2 ... bytes
    for j in range(_LONG):
        if n[j] <= long:
            break
        now = state[long : n[j]]
        state[long : n[j]] = _CRC[(now ^ data[starts[long : n[j]] + j]) & np.uint32(255)] ^ (now >> np.uint32(8))
    return state


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and text number and bucket of every word and every neighbouring pair of words."""
    data = _FOLD[data]
    n = len(data)
    solid = ~_GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[n] = True
    before = np.concatenate([[True], ~solid[:-1]]) | edge[:n] if n else solid
    after = np.concatenate([~solid[1:], [True]]) | edge[1:] if n else solid
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(owner, minlength=len(offsets) - 1)[: len(offsets) - 1]
    order = np.argsort(starts - ends, kind="stable")
    s, size = starts[order], (ends - starts)[order]
    one = np.empty(len(starts), np.uint32)
    one[order] = _extended(data, s, size, np.full(len(s), 0xFFFFFFFF, np.uint32))
    # A pair goes on from the register of its first word.
    blank = _CRC[(one ^ np.uint32(32)) & np.uint32(255)] ^ (one >> np.uint32(8))
    two = np.empty(len(starts), np.uint32)
    two[order] = _extended(data, s, size, np.concatenate([[np.uint32(0)], blank[:-1]])[order] if len(blank) else blank)
    second = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    return counts, np.concatenate([owner, owner[second]]), ~np.concatenate([one, two[second]]) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket: every task sends one row for a bucket it has."""
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                total += np.bincount(features(data, offsets, buckets)[2], minlength=buckets)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    s, t, size = documents.astype(float), target.astype(float), float(len(documents))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row."""
    buckets = len(gain)

    def work(batch: pa.RecordBatch):
        ids = batch.column("doc_id")
        for lo, hi, data, offsets in text_chunks(batch.column("text")):
            words, owner, bucket = features(data, offsets, buckets)
            n = np.bincount(owner, minlength=hi - lo)
            low = int(gain.min())
            # Sums of whole numbers from zero up stay exact in doubles.
            total = np.bincount(owner, (gain[bucket] - low).astype(float), hi - lo).astype(np.int64) + low * n
            yield {"doc_id": ids.slice(lo, hi - lo), "n_words": words, "n_features": n, "weight": np.where(n > 0, total // np.maximum(n, 1), 0)}

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the id's sha256."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


# ---- selection

#: Parts of a composite key in order: the score turned round, the id (null: largest), features, and the row's number.
KEY = ("k1", "k2", "k3", "k4")


def _literal(key: tuple) -> str:
    return "named_struct(" + ", ".join(f"'{c}', cast({v} as bigint)" for c, v in zip(KEY, key)) + ")"


def kth_key(scratch: Scratch, rows: DataFrame, k: int, pivots: int) -> tuple:
    """The k-th smallest composite key (k from 1) of ``rows``, which have at least k rows and no key twice."""
    key, round_, before = F.struct(*KEY), 0, None
    while True:
        round_ += 1
        drawn = rows.select(*KEY).orderBy(F.xxhash64(F.lit(round_), *KEY), *KEY).limit(pivots).collect()
        pivot = sorted(tuple(r) for r in drawn)
        marks = F.expr("array(" + ", ".join(map(_literal, pivot)) + ")")
        # Slot 2i: between pivots i - 1 and i; slot 2i + 1: equal to pivot i.
        slot = F.size(F.filter(marks, lambda p: p < key)) * 2 + F.exists(marks, lambda p: p == key).cast("int")
        slots = sorted(tuple(r) for r in rows.groupBy(slot.alias("slot")).count().collect())
        for at, n in slots:
            if k <= n:
                break
            k -= n
        if at % 2:
            if before is not None:
                before.drop()
            return pivot[at // 2]
        i = at // 2
        left = rows
        if i > 0:
            left = left.where((F.col("k1") >= pivot[i - 1][0]) & (key > F.expr(_literal(pivot[i - 1]))))
        if i < len(pivot):
            left = left.where((F.col("k1") <= pivot[i][0]) & (key < F.expr(_literal(pivot[i]))))
        kept = scratch.keep(left, f"between{round_}")
        if before is not None:
            before.drop()
        rows, before = kept.df, kept


def ranked(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` by composite key: sorted by ranges, numbered inside each and shifted by the ranges before."""
    inside = scratch.keep(rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("place", F.monotonically_increasing_id()), "sorted").df
    part = F.shiftright("place", 33).alias("part")
    sizes = inside.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    shift = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    return inside.withColumn("part", part).join(F.broadcast(shift), "part").withColumn("rank", F.col("ahead") + F.col("place").bitwiseAND(F.lit(2**33 - 1)) + 1)


def resampled(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, and rank among the drawn (null: not drawn)."""
    s, scratch = settings, Scratch(docs.sparkSession, "resampling")
    gain = gains(bucket_counts(docs, s.buckets), bucket_counts(target, s.buckets))
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), s.seed)).withColumns({
        "k1": -F.col("score"), "k2": F.coalesce("doc_id", F.lit(LAST)), "k3": F.col("n_features"), "k4": F.monotonically_increasing_id()})
    every = scratch.keep(scored, "scored").df
    able = every.where(F.col("n_words") >= s.min_words)
    k = able.count() * s.percent // 100
    out = ("doc_id", "n_features", "weight", "score")
    if k == 0:
        return every.select(*out, F.lit(None).cast("long").alias("rank"))
    last = F.expr(_literal(kth_key(scratch, able, k, s.pivots)))
    drawn = (F.col("n_words") >= s.min_words) & (F.struct(*KEY) <= last)
    return ranked(scratch, every.where(drawn)).select(*out, "rank").unionByName(every.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
