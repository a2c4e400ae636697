"""Benchmark decontamination by latent semantic retrieval.

The vocabulary is that of the benchmark items. One pass over all documents counts document frequencies and multiplies the
passage-by-word matrix A with a random sign matrix twice (A' A R, whole numbers, so sums do not depend on their order);
Spark adds these up per word. The driver, with one row per benchmark word, weights them by idf and takes the right
singular vectors from the sketch (Nystroem form of the randomised SVD). The latent space is spanned by these and by the items.
A second pass compares every window of every document with every item of that length by their product in the latent
space. As it holds the items, the product is exact: a window with ``reworded`` of the item's words in order has at
least the sum of so many of the item's smallest squared weights, and only windows below that are passed over. Each candidate is
checked: the longest common subsequence of item and window must hold ``copied`` of the item's words, or ``reworded`` of
them together with ``answered`` of the words of the item's last sentence. The cosine that is given counts words outside
the vocabulary in the window's norm.

Items come in parts of bounded size, each with its own passes, so a long benchmark costs more passes, not more memory.

Defined results: a null or empty text, match nothing; an item with fewer than ``min_words`` words is found
where all its words follow one another; rows that repeat an
id give one result per document and item id, the best; a null id is kept as null; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyflow.llm.common import mix, text_chunks, words_of

#: Everything in ASCII that is neither letter nor digit ends a word.
SPLIT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

#: Products up to this are rounding. Left out, they change the product of a window of a thousand words by less than ``least_products`` allows.
ROUNDING = 1e-10
#: Products of words with items that are added up at once.
ENTRIES = 1 << 18
#: Window starts that are looked at together first.
STARTS = 4

FOUND = "doc_id long, item_id long, common double, answer double, cosine double, word long"


@dataclass(frozen=True)
class Settings:
    min_words: int = 8
    #: Words of a block; windows are as many blocks as hold the item wherever it starts.
    block: int = 8
    #: Words of a passage (a row of A).
    passage: int = 64
    rank: int = 32
    copied: float = 0.8
    reworded: float = 0.6
    answered: float = 0.8
    #: Each item is a direction of the latent space of its pass.
    items_per_pass: int = 256
    seed: int = 11


class Vocabulary:
    """Distinct word hashes with their places."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for one that is not in it."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.marks[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        out[maybe[hit]] = at[hit]
        return out


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]), fold=True, blank=SPLIT).hashes


def last_sentence(text: str) -> str:
    parts = [p for p in re.split(r"[.!?\n]+", text) if p.strip()]
    return parts[-1] if parts else ""


class Sequence:
    """Bit patterns of a word sequence for longest common subsequences."""

    def __init__(self, hashes: np.ndarray):
        self.size, self.at = len(hashes), {}
        for i, h in enumerate(hashes.tolist()):
            self.at[h] = self.at.get(h, 0) | 1 << i

    def common(self, hashes: list[int]) -> int:
        full = (1 << self.size) - 1
        rows = full
        for h in hashes:
            hit = rows & self.at.get(h, 0)
            if hit:
                rows = ((rows + hit) | (rows - hit)) & full
        return self.size - rows.bit_count()


def _owner(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return owner, np.arange(first[-1] - first[0]) - first[:-1][owner]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its size says, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _sketch(vocabulary: Vocabulary, signs: np.ndarray, s: Settings):
    def run(batches):
        size, rank = signs.shape
        total, seen, sketch = 0, np.zeros(size, np.int64), np.zeros((size, rank))
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                words = words_of(data, offsets, fold=True, blank=SPLIT)
                total += hi - lo
                owner, place = _owner(words.first)
                at = vocabulary.places(words.hashes)
                row = np.cumsum((place % s.passage == 0)) - 1
                known = at >= 0
                at, row, owner = at[known], row[known], owner[known]
                if not len(at):
                    continue
                seen += np.bincount(np.unique(owner * size + at) % size, minlength=size)
                heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                passage = np.add.reduceat(signs[at], heads, axis=0, dtype=np.float64)
                of = np.cumsum(np.append(False, row[1:] != row[:-1]))
                for c in range(rank):
                    sketch[:, c] += np.bincount(at, passage[of, c], size)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], total)), pa.array([*sketch[used].astype(np.int64), np.zeros(rank, np.int64)], pa.list_(pa.int64()))], names=["word", "seen", "g"])
    return run


def latent(seen: np.ndarray, total: int, sketch: np.ndarray, signs: np.ndarray, items: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(idf, orthonormal basis): singular vectors of the weighted corpus from its sketch, and the items' own directions.

    ``sketch`` = A' A R for counts A. With idf weights D, D A' A D (R / D) = D sketch: a sketch of the weighted matrix for the test matrix R / D.
    """
    idf = np.log((1 + total) / (1 + seen)) + 0.1
    c, test = sketch * idf[:, None], signs / idf[:, None]
    core = test.T @ c
    value, vector = np.linalg.eigh((core + core.T) / 2)
    good = value > max(value.max(initial=0.0), 0.0) * 1e-9
    root = c @ (vector[:, good] / np.sqrt(value[good]))
    left = np.linalg.svd(root, full_matrices=False)[0] if root.size else np.zeros((len(idf), 0))
    rows = items * idf
    rows /= np.maximum(np.sqrt((rows * rows).sum(1)), 1e-12)[:, None]
    basis, triangle = np.linalg.qr(np.concatenate([rows.T, left], axis=1))
    return idf, basis[:, np.abs(np.diag(triangle)) > 1e-9]


class Items:
    """Benchmark items of one pass."""

    def __init__(self, rows: list, s: Settings):
        kept = [(i, t, h) for i, t in rows if len(h := word_hashes(t or "")) >= s.min_words]
        self.ids = [i for i, _, _ in kept]
        self.words = [h for _, _, h in kept]
        self.answers = [word_hashes(last_sentence(t)) for _, t, _ in kept]
        self.vocabulary = Vocabulary(np.concatenate(self.words)) if kept else None
        self.blocks = np.array([-(-len(h) // s.block) + 1 for h in self.words])

    def counts(self) -> np.ndarray:
        return np.stack([np.bincount(self.vocabulary.places(h), minlength=len(self.vocabulary.hashes)) for h in self.words]).astype(float)


def least_products(items: Items, idf: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Per item: words that a match has in order, and the least product with a window that has so many."""
    need = np.array([math.ceil(len(h) * s.reworded - 1e-9) for h in items.words])
    least = [np.sort(idf[items.vocabulary.places(h)] ** 2)[:n].sum() for h, n in zip(items.words, need)]
    return need, np.array(least) * (1 - 1e-9) - 1e-6


class Products:
    """Products of the vocabulary's words with the items in the latent space, none negative, without those that are zero but for rounding: few items hold a word."""

    def __init__(self, dense: np.ndarray):
        word, self.item = np.nonzero(dense > ROUNDING)
        self.value, self.first = dense[word, self.item], np.searchsorted(word, np.arange(len(dense) + 1))
        self.items = dense.shape[1]

    def of_blocks(self, at: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
        """(n, items): sums over the words ``at`` of each of ``n`` blocks, -1 for words outside; ``block`` does not fall."""
        use = np.flatnonzero(at >= 0)
        at, block, out = at[use], block[use], np.zeros((n, self.items))
        size = self.first[at + 1] - self.first[at]
        end = np.cumsum(size)
        lo = 0
        while lo < len(at):
            # Whole blocks with about ENTRIES products, so that memory does not grow with the items that share a word.
            hi = max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + ENTRIES)))
            hi = int(np.searchsorted(block, block[hi - 1], "right"))
            some, base = size[lo:hi], block[lo]
            place = _ranges(self.first[at[lo:hi]], some)
            rows = int(block[hi - 1] - base) + 1
            key = np.repeat((block[lo:hi] - base) * self.items, some) + self.item[place]
            out[base : base + rows] = np.bincount(key, self.value[place], rows * self.items).reshape(rows, -1)
            lo = hi
        return out


def windows_with_enough(at: np.ndarray, a: np.ndarray, z: np.ndarray, item: np.ndarray, held: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Numbers of the windows ``at[a:z]`` that hold as many words of their item as a match has in order, a word at most as often as the item
    has it. ``held`` has the items' counts of words, and a column of zeros for words outside the vocabulary (-1)."""
    size, width, out, lo = z - a, held.shape[1], [], 0
    end = np.cumsum(size)
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + ENTRIES)))
        of, own = np.repeat(np.arange(hi - lo), size[lo:hi]), item[lo:hi]
        word = at[_ranges(a[lo:hi], size[lo:hi])]
        shared = np.flatnonzero(held[own[of], word])
        of, word = of[shared], word[shared]
        many = (np.bincount(of, minlength=hi - lo) >= needed[own])[of]
        key, times = np.unique(of[many] * width + word[many], return_counts=True)
        of, word = key // width, key % width
        out.append(lo + np.flatnonzero(np.bincount(of, np.minimum(times, held[own[of], word]), hi - lo) >= needed[own]))
        lo = hi
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _matches(items: Items, idf: np.ndarray, basis: np.ndarray, outside: float, s: Settings):
    vectors = (items.counts() * idf) @ basis
    weighted, square = basis * idf[:, None], idf * idf
    # Items of equal windows side by side, so that a window length is a slice of columns.
    order = np.argsort(items.blocks, kind="stable")
    products = Products((weighted @ vectors.T)[:, order])
    lengths = np.maximum(np.sqrt((vectors * vectors).sum(1)), 1e-12)
    needed, least = least_products(items, idf, s)
    counted = np.pad(items.counts().astype(np.int32), ((0, 0), (0, 1)))

    def run(batches):
        sequences = [Sequence(h) for h in items.words]
        answers = [Sequence(h) for h in items.answers]
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, _, data, offsets in text_chunks(batch.column("text"), 1 << 18):
                words = words_of(data, offsets, fold=True, blank=SPLIT)
                if not len(words.hashes):
                    continue
                owner, place = _owner(words.first)
                at = items.vocabulary.places(words.hashes)
                head = np.flatnonzero(place % s.block == 0)
                block = np.cumsum(place % s.block == 0) - 1
                n = len(head)
                of = owner[head]
                first, last = np.searchsorted(of, of), np.searchsorted(of, of, "right")  # the text's blocks
                inside = np.append(0, np.cumsum(np.add.reduceat(np.where(at >= 0, square[at], 0.0), head)))
                found: dict = {}
                sums = np.zeros((n + 1, products.items))
                np.cumsum(products.of_blocks(at, block, n), axis=0, out=sums[1:])
                start = np.arange(n)
                # A block more on each side, for words that were moved or put in.
                low = np.maximum(start - 1, first)
                for size, begin, count in zip(*np.unique(items.blocks[order], return_index=True, return_counts=True)):
                    own = order[begin : begin + count]
                    part = sums[:, begin : begin + count]
                    end = np.minimum(start + size, last)
                    high = np.minimum(end + 1, last)
                    # First a few starts at once: a window within a stretch has no greater product than the stretch.
                    heads = np.arange(0, n, STARTS)
                    tails = np.minimum(heads + STARTS, n) - 1
                    some = np.flatnonzero(inside[high[tails]] - inside[low[heads]] >= least[own].min())
                    wide, column = np.nonzero((part[high[tails[some]]] - part[low[heads[some]]]) >= least[own])
                    from_, to = heads[some[wide]], tails[some[wide]] + 1
                    w, column = _ranges(from_, to - from_), np.repeat(column, to - from_)
                    enough = np.flatnonzero((part[high[w], column] - part[low[w], column]) >= least[own[column]])
                    w, item_of = w[enough], own[column[enough]]
                    ends = np.append(head, len(at))
                    enough = windows_with_enough(at, head[low[w]], ends[high[w]], item_of, counted, needed)
                    for w, item in zip(w[enough].tolist(), item_of[enough].tolist()):
                        doc, a, z = of[w], head[low[w]], ends[high[w]]
                        shared = counted[item, at[a:z]] > 0
                        text = words.hashes[a:z][shared].tolist()
                        common = sequences[item].common(text) / sequences[item].size
                        if common < s.reworded:
                            continue
                        answer = answers[item].common(text) / max(1, answers[item].size)
                        if common >= s.copied or answer >= s.answered:
                            inner = at[head[w] : ends[end[w]]]
                            x, held = weighted[inner[inner >= 0]].sum(0), square[inner[inner >= 0]].sum()
                            norm = math.sqrt(max(held, x @ x) + outside * np.count_nonzero(inner < 0))
                            row = (common, answer, float(x @ vectors[item] / lengths[item] / max(norm, 1e-12)), -int(a - words.first[doc]))
                            found[doc, item] = max(found.get((doc, item), row), row)
                if found:
                    values = list(found.values())
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([lo + d for d, _ in found])), pa.array([items.ids[i] for _, i in found], pa.int64()), *[pa.array([v[c] for v in values], pa.float64()) for c in range(3)], pa.array([-v[3] for v in values], pa.int64())],
                        names=["doc_id", "item_id", "common", "answer", "cosine", "word"])
    return run


def _one_pass(docs: DataFrame, rows: list, s: Settings) -> DataFrame | None:
    items = Items(rows, s)
    if not items.ids:
        return None
    size = len(items.vocabulary.hashes)
    signs = np.random.Generator(np.random.PCG64(s.seed)).integers(0, 2, (size, s.rank)).astype(np.int8) * 2 - 1
    parts = docs.select(F.lower("text").alias("text")).mapInArrow(_sketch(items.vocabulary, signs, s), "word long, seen long, g array<bigint>")
    sums = parts.groupBy("word").agg(F.sum("seen").alias("seen"), *[F.sum(F.get("g", F.lit(c))).alias(f"g{c}") for c in range(s.rank)]).toPandas()
    total = int(sums.loc[sums["word"] == -1, "seen"].sum())
    sums = sums[sums["word"] >= 0]
    seen, sketch = np.zeros(size), np.zeros((size, s.rank))
    seen[sums["word"]] = sums["seen"]
    sketch[sums["word"]] = sums[[f"g{c}" for c in range(s.rank)]].to_numpy(float)
    idf, basis = latent(seen, total, sketch, signs.astype(float), items.counts(), s)
    # A word outside the vocabulary weighs as the items' words do on average.
    counts = items.counts()
    outside = float((counts * idf**2).sum() / counts.sum())
    return docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).mapInArrow(_matches(items, idf, basis, outside, s), FOUND)


def _whole(rows: list):
    """Items of few words, found where all their words follow one another."""
    kept = [(i, h) for i, h in rows if len(h)]

    def code(h: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            out = mix(out + h[j : j + len(out)])
        return out

    def run(batches):
        of_size: dict = {}
        for i, h in kept:
            of_size.setdefault(len(h), {}).setdefault(int(code(h, len(h))[0]), []).append((i, h))
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, _, data, offsets in text_chunks(batch.column("text"), 1 << 18):
                words = words_of(data, offsets, fold=True, blank=SPLIT)
                owner, _ = _owner(words.first)
                found = {}
                for size, wanted in of_size.items():
                    if len(words.hashes) < size:
                        continue
                    codes = code(words.hashes, size)
                    at = np.flatnonzero(np.isin(codes, np.array(list(wanted), np.uint64)) & (owner[: len(codes)] == owner[size - 1 :]))
                    for p in at[np.unique(np.stack([owner[at].astype(np.uint64), codes[at]]), axis=1, return_index=True)[1]].tolist() if len(at) else []:
                        for i, h in wanted[int(codes[p])]:
                            if (words.hashes[p : p + size] == h).all():
                                found[int(owner[p]), i] = p - int(words.first[owner[p]])
                if found:
                    one = pa.array([1.0] * len(found))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([lo + d for d, _ in found])), pa.array([i for _, i in found], pa.int64()), one, one, one, pa.array(list(found.values()), pa.int64())],
                                                     names=["doc_id", "item_id", "common", "answer", "cosine", "word"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, common, answer, cosine, word (where the window starts)."""
    s, spark = settings, docs.sparkSession
    parts = -(-benchmark.count() // s.items_per_pass)
    found = []
    for part in range(parts):
        own = benchmark if parts == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        # About items_per_pass rows: the benchmark is read part by part.
        rows = [(r.item_id, r.text) for r in own.select(F.col("item_id").cast("long"), "text").collect()]
        short = [(i, h) for i, t in rows if 0 < len(h := word_hashes(t or "")) < s.min_words]
        if short:
            found.append(docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).mapInArrow(_whole(short), FOUND))
        if (df := _one_pass(docs, rows, s)) is not None:
            found.append(df)
    if not found:
        return spark.createDataFrame([], FOUND)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("common", "answer", "cosine", (-F.col("word")).alias("w"))).alias("m"))
    return best.select("doc_id", "item_id", "m.common", "m.answer", "m.cosine", (-F.col("m.w")).alias("word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; columns as before."""
    bad = contaminated(docs, benchmark, settings).select(F.col("doc_id").alias("_doc")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("_doc")), "left_anti").select("_row.*")
