"""Substring dedup by recompression.

Rounds rename runs of equal symbols and then pairs (left-type symbol, right-type symbol); a symbol's type in a round is
a bit of its name. Names are hashes of what they stand for, so all tasks give equal strings equal names and a round
needs no exchange. Whether two neighbours join depends on these two alone. So a window of words knows its own
interior symbols: in each round it gives up the first symbol if that could join something before the window, and the
last if it could join something behind. Equal windows keep equal symbols, whatever surrounds them.

Every window of ``window`` words is filed under the longest interior symbol of its highest round that has one, and
neighbouring windows under the same symbol make one block. Only blocks whose symbol occurs twice go on. Equal
blocks (128-bit hash) settle all their windows at once, so a passage that a third of the documents share costs one row per
copy. Blocks that share a symbol but differ are verified window by window, each distinct block once.

Defined results: a null or empty text has no words; a null id counts as larger than every other; rows that share an id
are judged each, and not against each other; texts with fewer words than the window are kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyflow.llm.common import Scratch, mix, signed, text_chunks, words_of


@dataclass(frozen=True)
class Settings:
    window: int = 50
    rounds: int = 6
    #: Rounds that name runs before they name pairs.
    run_rounds: int = 2


U = np.uint64
#: Odd multipliers. Fixed values.
A, B, C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
RATIOS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(ratio: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if ratio not in _tables or len(_tables[ratio][0]) <= n:
        size = max(n + 1, 1 << 18)
        back = pow(ratio, -1, 1 << 64)
        _tables[ratio] = tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(size, r, U))]) for r in (ratio, back))
    return _tables[ratio]


class RangeHash:
    """128-bit hashes of any range of a sequence of word hashes, from running sums."""

    def __init__(self, words: np.ndarray):
        self.sums, self.back = [], []
        for ratio, w in zip(RATIOS, (words, mix(words + C))):
            forth, back = _powers(ratio, len(words))
            self.sums.append(np.concatenate([np.zeros(1, U), np.cumsum(w * forth[: len(words)])]))
            self.back.append(back)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = (hi - lo).astype(U) * C
        return tuple(mix((s[hi] - s[lo]) * b[lo] + size) for s, b in zip(self.sums, self.back))


class _Best:
    """Place of the largest value in any range, by doubling."""

    def __init__(self, value: np.ndarray, longest: int):
        self.value, self.levels = value, [np.arange(len(value))]
        step = 1
        while 2 * step <= longest and 2 * step <= len(value):
            a, b = self.levels[-1][:-step], self.levels[-1][step:]
            self.levels.append(np.where(value[b] > value[a], b, a))
            step *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        out = np.empty(len(lo), np.int64)
        level = np.minimum(np.log2(np.maximum(hi - lo, 1)).astype(int), len(self.levels) - 1)
        for k in range(len(self.levels)):
            m = level == k
            if m.any():
                a, b = self.levels[k][lo[m]], self.levels[k][hi[m] - (1 << k)]
                out[m] = np.where(self.value[b] > self.value[a], b, a)
        return out


def anchors(words: np.ndarray, first: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window start, symbol name, symbol start) of every window in some texts; text i's words are ``words[first[i]:first[i+1]]``."""
    n, w = len(words), s.window
    ends = np.repeat(first[1:], np.diff(first))
    start = np.flatnonzero(np.arange(n) + w <= ends)
    name_of, place_of = np.zeros(len(start), U), np.zeros(len(start), np.int64)
    alive, lo, hi = np.arange(len(start)), start.copy(), start + w
    names, begin = words, np.arange(n)
    fence = np.zeros(n + 1, bool)  # no symbol crosses the border of two texts
    fence[first] = True

    def file(which: np.ndarray, lo: np.ndarray, hi: np.ndarray, round_: int) -> None:
        """File windows under the longest symbol (ties: by name, then the first) between their interior borders."""
        if not len(which):
            return
        size = np.diff(np.append(begin, n))
        value = (np.minimum(size, 1023).astype(U) << U(52)) | (mix(names + A) >> U(12))
        number = np.zeros(n + 1, np.int64)
        number[begin] = np.arange(len(begin))
        number[n] = len(begin)
        best = _Best(value, w).of(number[lo], number[hi])
        name_of[which], place_of[which] = mix(names[best] + U(round_ * int(B) % 2**64)), begin[best]

    for r in range(s.rounds):
        for runs in (True, False):
            if runs and r >= s.run_rounds or not len(alive):
                continue
            close = np.append(begin[1:], n)  # where each symbol ends
            number = np.cumsum(np.bincount(begin, minlength=n + 1)) - 1  # symbol at each word
            inner = ~fence[begin[1:]]
            if runs:
                head = np.append(True, (names[1:] != names[:-1]) | ~inner)
                heads = np.flatnonzero(head)
                length = np.diff(np.append(heads, len(names)))
                run = np.cumsum(head) - 1
                new_lo = close[heads + length - 1][run[number[lo]]]
                new_hi = begin[heads[run[number[hi - 1]]]]
                new_names = np.where(length > 1, mix(names[heads] * C + length.astype(U)), names[heads])
                new_begin = begin[heads]
            else:
                right = (mix(names + U((r + 1) * int(C) % 2**64)) >> U(63)).astype(bool)
                joins = ~right[:-1] & right[1:] & inner
                at_lo, at_hi = number[lo], number[hi - 1]
                new_lo = np.where(right[at_lo], close[at_lo], lo)
                new_hi = np.where(right[at_hi], hi, begin[at_hi])
                new_names = names.copy()
                j = np.flatnonzero(joins)
                new_names[j] = mix(names[j] * A + names[j + 1] * B + U(r + 1))
                keep = np.append(True, ~joins)
                new_names, new_begin = new_names[keep], begin[keep]
            gone = new_lo >= new_hi
            file(alive[gone], lo[gone], hi[gone], r)
            alive, lo, hi = alive[~gone], new_lo[~gone], new_hi[~gone]
            names, begin = new_names, new_begin
    file(alive, lo, hi, s.rounds)
    return start, name_of, place_of


def _blocks(s: Settings):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column("d").to_numpy(), batch.column("t").to_numpy()
            for a, _, data, offsets in text_chunks(batch.column("text")):
                words = words_of(data, offsets)
                start, name, place = anchors(words.hashes, words.first, s)
                if not len(start):
                    continue
                new = np.append(True, (place[1:] != place[:-1]) | (name[1:] != name[:-1]) | (start[1:] != start[:-1] + 1))
                at = np.flatnonzero(new)
                count = np.diff(np.append(at, len(start)))
                lo = start[at]
                b1, b2 = RangeHash(words.hashes).of(lo, lo + count + s.window - 1)
                text = np.searchsorted(words.first, lo, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (signed(name[at]), signed(b1), signed(b2), ids[a + text], keys[a + text], (lo - words.first[text]).astype(np.int32), count.astype(np.int32))],
                    names=["name", "b1", "b2", "d", "t", "pos", "m"])
    return run


def _cover(spans: np.ndarray, n: int, window: int) -> np.ndarray:
    """Words covered by ``spans`` (first window << 32 | windows)."""
    change = np.zeros(n + 1, np.int64)
    lo, m = spans >> 32, spans & 0xFFFFFFFF
    np.add.at(change, lo, 1)
    np.add.at(change, lo + m + window - 1, -1)
    return np.cumsum(change[:n]) > 0


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """Kept words joined by one space."""
    starts, ends = starts[~gone], ends[~gone]
    if not len(starts):
        return b""
    size = ends - starts + 1
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at - starts, size)
    out = data[np.minimum(place, len(data) - 1)].copy()
    out[at + size - 1] = 32
    return out[:-1].tobytes()


def _spans(column: pa.Array, i: int) -> np.ndarray:
    value = column[i]
    return np.zeros(0, np.int64) if not value.is_valid else np.asarray(value.values, np.int64)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _finish(s: Settings, columns: list[str], texts: bool):
    """Results of texts whose covered spans are known. With a column ``needed``, texts that have such spans pass on unfinished."""
    wait = "needed" in columns

    def run(batches):
        for batch in batches:
            n_words, n_removed, digest, kept = [], [], [], []
            open_ = np.zeros(batch.num_rows, bool)
            for a, b, data, offsets in text_chunks(batch.column("text")):
                words = words_of(data, offsets)
                for i in range(b - a):
                    lo, hi = words.first[i], words.first[i + 1]
                    n_words.append(hi - lo)
                    if wait and len(_spans(batch.column("needed"), a + i)):
                        open_[a + i] = True
                        n_removed.append(0), digest.append(None), kept.append(None)
                        continue
                    gone = np.zeros(hi - lo, bool)
                    for c in columns:
                        if len(x := _spans(batch.column(c), a + i)):
                            gone |= _cover(x, hi - lo, s.window)
                    text = _kept(data, words.starts[lo:hi], words.ends[lo:hi], gone)
                    n_removed.append(int(gone.sum()))
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode() if texts else None)
            done = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
            if wait:
                mask = pa.array(~open_)
                blank = lambda c: pc.if_else(pc.invert(mask), batch.column(c), pa.nulls(batch.num_rows, batch.column(c).type))
                done += [batch.column("d"), batch.column("t"), blank("text"), blank("covered"), blank("needed")]
                names += ["d", "t", "text", "covered", "needed"]
            yield pa.RecordBatch.from_arrays(done, names=names)
    return run


def _windows(s: Settings):
    def run(batches):
        for batch in batches:
            ids, keys = batch.column("d").to_numpy(), batch.column("t").to_numpy()
            for a, b, data, offsets in text_chunks(batch.column("text")):
                words = words_of(data, offsets)
                hashes = RangeHash(words.hashes)
                at, row = [], []
                for i in range(b - a):
                    spans = _spans(batch.column("needed"), a + i)
                    size = spans & 0xFFFFFFFF
                    own = np.repeat(spans >> 32, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                    at.append(own + words.first[i])
                    row.append(np.full(len(own), a + i))
                at, row = np.concatenate(at), np.concatenate(row)
                if not len(at):
                    continue
                w1, w2 = hashes.of(at, at + s.window)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(w1), signed(w2), ids[row], keys[row], (at - words.first[row - a]).astype(np.int32))], names=["w1", "w2", "d", "t", "pos"])
    return run


def dedup_substrings(docs: DataFrame, settings: Settings = Settings(), texts: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and with ``texts`` the kept words as ``kept``.

    A word goes if a window of ``settings.window`` words that covers it also starts in a document with a smaller id.
    """
    s, scratch = settings, Scratch(docs.sparkSession, "recompression")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({
        "d": F.coalesce("doc_id", F.lit(2**63 - 1)), "t": F.xxhash64("text")})
    block = "name long, b1 long, b2 long, d long, t long, pos int, m int"
    every = scratch.keep(keyed.select("d", "t", "text").mapInArrow(_blocks(s), block), "blocks")
    # The sides with one row per key are stored before the joins: adaptive execution splits a hot symbol only between plain exchanges.
    twice = scratch.keep(every.df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "twice")
    shared = scratch.keep(every.df.join(twice.df, "name"), "shared")
    every.drop()
    twice.drop()
    owners = scratch.keep(shared.df.groupBy("name", "b1", "b2").agg(F.min("d").alias("owner")), "owners")
    mixed = scratch.keep(owners.df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit(True).alias("mixed")), "mixed")
    # Who owns a block (the smallest id) verifies its windows if other blocks share the symbol; in every other document all of them go.
    judged = shared.df.join(owners.df, ["name", "b1", "b2"]).join(mixed.df, "name", "left").where("d > owner or mixed")
    span = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("m").cast("long"))
    marks = judged.groupBy("d", "t").agg(F.collect_list(F.when(F.col("d") > F.col("owner"), span)).alias("covered"), F.collect_list(F.when(F.col("d") == F.col("owner"), span)).alias("needed"))
    both = f"{RESULT}, d long, t long, text string, covered array<bigint>, needed array<bigint>"
    first = scratch.keep(keyed.join(marks, ["d", "t"], "left").select("doc_id", "text", "d", "t", "covered", "needed").mapInArrow(_finish(s, ["covered", "needed"], texts), both), "first")
    for done in (shared, owners, mixed):
        done.drop()
    waiting = first.df.where("kept_sha256 is null")
    windows = scratch.keep(waiting.select("d", "t", "text", "needed").mapInArrow(_windows(s), "w1 long, w2 long, d long, t long, pos int"), "windows")
    least = scratch.keep(windows.df.groupBy("w1", "w2").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most").select("w1", "w2", "least"), "least").df
    later = windows.df.join(least, ["w1", "w2"]).where("d > least")
    found = later.groupBy("d", "t").agg(F.collect_set(F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.lit(1).cast("long"))).alias("verified"))
    rest = waiting.select("doc_id", "text", "d", "t", "covered").join(found, ["d", "t"], "left").mapInArrow(_finish(s, ["covered", "verified"], texts), RESULT)
    out = first.df.where("kept_sha256 is not null").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").unionByName(rest)
    return out if texts else out.drop("kept")
