"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that follows from its code point, the gap between words too. A run of three letters is bound
into one vector: the element-wise product of its letters' vectors, permuted (rolled) by their distance from the end. A text's vector
bundles (sums) those of all its runs; a language's prototype bundles the vectors of all its training texts, less the mean direction of
all prototypes, which says nothing about a language. A text gets the language whose prototype has the largest cosine
with it.

Bundling is linear, so tasks first count equal runs and then add each vector once, times its count. Prototypes are summed by Spark from
one partial sum per task and language; all texts outside the held-out third are read.

Defined results: upper case counts as lower case; a null text or one without a letter is ``und`` with score 0, and so is
every text if no language can be learnt; a null language is not learnt from; a null id is not held out; ties go to
the smallest name; repeated rows are judged each; a very long text is counted in pieces; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyflow.llm.common import mix, per_batch, ready, text_chunks

UNKNOWN = "und"
GAP = 32
#: Places of a text whose runs are counted at once, and runs whose vectors are made at once.
PIECE, BLOCK = 1 << 20, 2048


@dataclass(frozen=True)
class Settings:
    dimensions: int = 1024
    seed: int = 2016
    #: Most languages: their prototypes are sent to all tasks.
    max_languages: int = 4096


_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _letters


def letter_vectors(codes: np.ndarray, s: Settings) -> np.ndarray:
    """One row of +1 and -1 for each code point, the same in every task."""
    words = -(-s.dimensions // 64)
    at = np.arange(words, dtype=np.uint64) + mix(codes.astype(np.uint64) + (np.uint64(s.seed) << np.uint64(32)))[:, None]
    bits = np.unpackbits(mix(mix(at)).view(np.uint8).reshape(len(codes), -1), axis=1)[:, : s.dimensions]
    return bits.astype(np.int8) * 2 - 1


def runs(data: np.ndarray, offsets: np.ndarray):
    """Code points (letters, and one gap around words) of some texts, their text numbers, and where the middle of a run is.

    Each text begins with a gap, which also ends the text before."""
    string = data.tobytes().decode("utf-8")
    codes = np.frombuffer(string.encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    codes = np.insert(codes, at, GAP)  # one gap more at the end
    owner = np.repeat(np.arange(len(offsets)), np.diff(np.append(at, at[-1])) + 1)
    solid = letters()[codes]
    keep = solid | np.concatenate([[True], solid[:-1]])
    codes, owner, solid = np.where(solid, codes, GAP)[keep], owner[keep], solid[keep]
    middle = np.flatnonzero(solid[1:-1] | (owner[2:] == owner[:-2])) + 1
    return codes, owner, solid, middle


def counted(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray | None = None):
    """(runs as three columns of code points, run number, label, count) of the texts, by run number; ``labels``: one small number per text (None: its place)."""
    codes, owner, solid, middle = runs(data, offsets)
    groups = int(labels.max(initial=0)) + 1 if labels is not None else len(offsets)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    n, size = number[codes], len(alphabet)
    keys, counts = [], []
    for lo in range(0, len(middle), PIECE):
        m = middle[lo : lo + PIECE]
        # A gap belongs to the text of the words on its sides; the middle tells.
        who = owner[m] if labels is None else labels[owner[m]]
        k, c = np.unique((((n[m - 1] * size) + n[m]) * size + n[m + 1]) * groups + who, return_counts=True)
        keys.append(k)
        counts.append(c)
    if len(keys) > 1:
        every, which = np.unique(np.concatenate(keys), return_inverse=True)
        keys, counts = [every], [np.bincount(which, np.concatenate(counts)).astype(np.int64)]
    key, count = (keys[0], counts[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    run, label = key // groups, key % groups
    new = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    distinct = run[new]
    abc = alphabet[np.stack([distinct // size // size, distinct // size % size, distinct % size], axis=1)] if len(distinct) else np.zeros((0, 3), np.int64)
    return abc, np.cumsum(new) - 1, label, count


def run_vectors(abc: np.ndarray, s: Settings) -> np.ndarray:
    codes, which = np.unique(abc, return_inverse=True)
    v, which = letter_vectors(codes, s), which.reshape(abc.shape)
    return np.roll(v, 2, axis=1)[which[:, 0]] * np.roll(v, 1, axis=1)[which[:, 1]] * v[which[:, 2]]


def bundled(abc: np.ndarray, run: np.ndarray, label: np.ndarray, count: np.ndarray, groups: int, s: Settings) -> np.ndarray:
    """The vector of each label: counts times the vectors of the runs, a block of runs at a time."""
    out = np.zeros((groups, s.dimensions))
    exact = np.float32 if count.sum() < 1 << 24 else np.float64
    for lo in range(0, len(abc), BLOCK):
        hi = min(len(abc), lo + BLOCK)
        a, b = np.searchsorted(run, lo), np.searchsorted(run, hi)
        times = np.zeros((groups, hi - lo), exact)
        times[label[a:b], run[a:b] - lo] = count[a:b]
        out += times @ run_vectors(abc[lo:hi], s).astype(exact)
    return out


def held_out(doc_id):
    """The third of the ids that is never learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def prototypes(texts: DataFrame, settings: Settings = Settings()) -> tuple[list[str], np.ndarray]:
    """Names and vectors of length one of the languages in ``texts`` (text, lang)."""
    s = settings

    def learn(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            of, known = names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
            for lo, hi, data, offsets in text_chunks(pc.utf8_lower(batch.column("text"))):
                here = np.append(of[lo:hi], 0)  # the last gap has no text, and no run
                vectors = bundled(*counted(data, offsets, here), len(known), s)
                for i in np.unique(of[lo:hi]):
                    sums[known[i]] = sums.get(known[i], 0) + vectors[i]
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([np.rint(v).astype(np.int64)], pa.list_(pa.int64()))], names=["lang", "v"])

    texts = texts.where("lang is not null and text is not null").select("text", "lang")
    partial = texts.mapInArrow(learn, "lang string, v array<bigint>")
    total = partial.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    most = s.max_languages * s.dimensions
    rows = total.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {s.max_languages} languages")
    names = sorted(rows["lang"].unique())
    place = {name: i for i, name in enumerate(names)}
    out = np.zeros((len(names), s.dimensions))
    out[rows["lang"].map(place).to_numpy(np.int64), rows["i"].to_numpy(np.int64)] = rows["x"].to_numpy(float)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = unit(out)
    return names, unit(out - out.mean(axis=0)) if len(names) > 1 else out


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], settings: Settings = Settings()) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of ``docs`` (doc_id, text)."""
    names, vectors = model
    s = settings
    weights = vectors.T.astype(np.float64)

    def work(batch: pa.RecordBatch):
        ids, column = batch.column("doc_id"), pc.utf8_lower(batch.column("text"))
        for lo, hi, data, offsets in text_chunks(column):
            n = hi - lo
            text = bundled(*counted(data, offsets), n + 1, s)[:n]
            lettered = np.zeros(n + 1, bool)
            codes, owner, solid, _ = runs(data, offsets)
            lettered[owner[solid]] = True
            cosine = np.round((text @ weights) / np.maximum(np.linalg.norm(text, axis=1, keepdims=True), 1e-300), 12)  # the same in batches of any size
            best = cosine.argmax(axis=1) if names else np.zeros(n, int)
            known = lettered[:n] if names else np.zeros(n, bool)
            score = np.where(known, np.clip(cosine.max(axis=1, initial=0.0), 0, 1), 0.0)
            yield {"doc_id": ids.slice(lo, n), "lang_pred": pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()), "score": score}

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score; learnt from the rows outside the held-out third."""
    ready(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    model = prototypes(docs.where(~held_out(F.col("doc_id"))), settings)
    return identified(docs, model, settings).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
