"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashed words, neighbouring word pairs and word pairs with one word between them,
over its whole length. Training streams a bounded sample of labelled texts through one task, coordinate by
coordinate with its own learning rate. The L1 bound lies above the number of epochs, so what a single text shows
keeps a weight of zero; only weights other than zero travel to the tasks that score.

Defined results: a null or empty text has no features and scores the base rate alone; a null label is not used; a
null id is scored as any row; repeated rows are scored each; without any label the score is 0.5; other columns are
ignored by the scores and kept by ``reject``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyflow.llm.common import mix, text_chunks, words_of

#: Everything in ASCII that is neither letter nor digit ends a word.
SPLIT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    #: Bound on the labelled texts that the fit reads (a sample by hash of the id).
    max_labelled: int = 20_000
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    threshold: float = 0.7


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every word, neighbouring pair and skip pair, repeats included."""
    words = words_of(data, offsets, fold=True, blank=SPLIT)
    h, owner = words.hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    rows, keys = [owner], [h]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        same = owner[gap:] == owner[:-gap]
        rows.append(owner[gap:][same])
        keys.append(mix(h[:-gap][same] * np.uint64(salt) + h[gap:][same]))
    return np.concatenate(rows), (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)


def distinct(rows: np.ndarray, buckets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows << bits) | buckets)
    return both >> bits, both & ((1 << bits) - 1)


class Ftrl:
    """Per-coordinate FTRL-proximal state over ``2**bits`` buckets and a bias that no penalty touches."""

    def __init__(self, s: Settings):
        self.s, size = s, (1 << s.bits) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z = self.s, self.z[at]
        l1 = np.where(at == 1 << s.bits, 0.0, s.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(self.n[at])) / s.alpha + np.where(l1 > 0, s.l2, 0.0)))

    def learn(self, buckets: np.ndarray, label: int) -> None:
        at = np.append(buckets, 1 << self.s.bits)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def fit(texts: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights other than zero, learnt from ``texts`` (text, label 0/1, place): rows in the order of ``place``, which the caller bounds."""
    s = settings

    def hashed(batches):
        for batch in batches:
            kept = []
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                rows, buckets = distinct(*features(data, offsets, s.bits), s.bits)
                kept += np.split(buckets.astype(np.int32), np.searchsorted(rows, np.arange(1, hi - lo)))
            offsets = np.cumsum([0, *map(len, kept)])
            found = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), found], names=["place", "label", "buckets"])

    # Texts become buckets where they lie; the one task that learns reads those, once an epoch.
    ordered = (texts.select("place", F.col("label").cast("int").alias("label"), "text").mapInArrow(hashed, "place long, label int, buckets array<int>")
               .select("place", "label", "buckets", F.explode(F.sequence(F.lit(1), F.lit(s.epochs))).alias("epoch")).repartition(1).sortWithinPartitions("epoch", "place"))

    def learn(batches):
        model = Ftrl(s)
        for batch in batches:
            for label, buckets in zip(batch.column("label").to_pylist(), batch.column("buckets")):
                model.learn(buckets.values.to_numpy(zero_copy_only=False), label)
        w = model.weights(np.arange((1 << s.bits) + 1))
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(w[kept])], names=["bucket", "weight"])

    found = ordered.mapInArrow(learn, "bucket long, weight double").toPandas()
    return found["bucket"].to_numpy(np.int64), found["weight"].to_numpy(float)


def labelled_sample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(text, label, place): at most ``max_labelled`` labelled texts outside the held-out third, chosen by hash of the id.

    The sample's ids have that bound, so they are sent to the tasks that read the texts.
    """
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("label")).withColumn("place", F.xxhash64("doc_id"))
              .orderBy("place", "doc_id").limit(settings.max_labelled))
    # One text per id, the smallest, so that an id shared by many rows stays one of the sample's texts.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("place").alias("place")).select("text", "label", "place")


def held_out(doc_id):
    """The third of the ids that the fit never sees: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], settings: Settings = Settings()) -> DataFrame:
    """``docs`` with a column ``score``: the chance that the text is toxic. Existing columns of that name are replaced."""
    buckets, weights = model
    top = 1 << settings.bits

    @F.pandas_udf("double")
    def score(texts):
        dense = np.zeros(top + 1, np.float64)
        dense[buckets] = weights
        out = np.empty(len(texts))
        for lo, hi, data, offsets in text_chunks(pa.array(texts, pa.string())):
            rows, at = features(data, offsets, settings.bits)
            hit = dense[at] != 0
            rows, at = distinct(rows[hit], at[hit], settings.bits)
            out[lo:hi] = np.bincount(rows, dense[at], hi - lo) + dense[top]
        import pandas as pd

        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -30, 30))))

    return docs.withColumn("score", score(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    rows = scored(docs.select("doc_id", "text"), fit(labelled_sample(docs, labels, settings), settings), settings)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the texts that score at or above the threshold; columns as before."""
    model = fit(labelled_sample(docs, labels, settings), settings)
    rows = scored(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, settings)
    return rows.where(F.col("score") < settings.threshold).select("row.*")
