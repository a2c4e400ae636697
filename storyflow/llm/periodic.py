"""Periodic runs of words in documents, found on a grammar.

The words of a document are numbered and compressed by Re-Pair: in rounds, repeated neighbours become one symbol, the most
frequent first (to within a factor of two; equal ones in random order), all places of a round at once. What is left at
the end is joined in a balanced tree. So every stretch of words lies in a smallest node X = Y Z, whose inner boundary it crosses. For each
distinct symbol the periodic stretches inside its words that cross the boundary are computed once, from common extensions
to both sides (hashes of ranges modulo two primes), then carried to every place of the symbol; of the intervals with one
period those inside another go. A run crosses only places whose two words stand side by side elsewhere in the
document too, and at other places the start rule is cut before any pair is named; stretches below the shortest run need no grammar.

Defined results: a null or empty text has no words and no run; a null id leaves the text as it is; repeated rows are
judged each; a very long text is one task's work, in memory of a fixed multiple of its length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyflow.llm.common import mix, per_batch, text_chunks, words_of

SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


@dataclass(frozen=True)
class Settings:
    #: A run has at least so many words, and so many periods.
    min_words: int = 24
    min_periods: int = 3


#: Candidates (symbol, period) that are compared at once.
BLOCK = 1 << 20
#: Moduli of the range hashes and their bases.
PRIMES = ((2147483647, 1340287193), (2147483629, 998244353))
_powers: dict[int, np.ndarray] = {}


def _power(p: int, base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo p."""
    have = _powers.get(p)
    if have is None or len(have) <= n:
        have = np.ones(1, np.int64)
        while len(have) <= max(n, 4096):
            have = np.concatenate([have, have * (have[-1] * base % p) % p])
        _powers[p] = have
    return have


class Extensions:
    """Common extensions of two places of a sequence, for arrays of places."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.sums = symbols, []
        for p, base in PRIMES:
            value = (mix(symbols.astype(np.uint64) + np.uint64(p)) % np.uint64(p)).astype(np.int64)
            self.sums.append(np.concatenate([[0], np.cumsum(value * _power(p, base, len(symbols))[: len(symbols)] % p)]))

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` symbols from i and from j (i < j) are the same."""
        same = np.ones(len(i), bool)
        for (p, base), sums in zip(PRIMES, self.sums):
            shift = _power(p, base, len(self.symbols))[j - i]
            same &= (sums[i + n] - sums[i]) % p * shift % p == (sums[j + n] - sums[j]) % p
        return same

    def longest(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """Most symbols, up to ``most``, that agree from i and j on (step 1) or before them (step -1)."""
        low, high = np.zeros_like(most), most.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            n = (low[open_] + high[open_] + 1) >> 1
            back = n if step < 0 else 0
            same = self.equal(i[open_] - back, j[open_] - back, n)
            low[open_[same]] = n[same]
            high[open_[~same]] = n[~same] - 1


class Nodes:
    """Nodes of the derivation with at least ``least`` words: symbol, first word, words of the left child, words."""

    def __init__(self, least: int):
        self.least, self.parts = least, []

    def add(self, symbol, at, left, size) -> None:
        big = size >= self.least
        self.parts.append(np.stack([symbol[big], at[big], left[big], size[big]]))

    def all(self) -> np.ndarray:
        return np.concatenate(self.parts, axis=1) if self.parts else np.zeros((4, 0), np.int64)


def _plateaus(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the stretch of equal values around each place."""
    n = len(x)
    new = np.concatenate([[True], x[1:] != x[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ends = np.concatenate([new[1:], [True]])
    last = np.minimum.accumulate(np.where(ends, np.arange(n), n)[::-1])[::-1]
    return first, last


def grammar(symbols: np.ndarray, part: np.ndarray, least: int, seed: int = 13) -> np.ndarray:
    """Re-Pair of the parts (stretches of one value of ``part``); the nodes with at least ``least`` words."""
    random = np.random.Generator(np.random.PCG64(seed))
    sym, size, at = symbols.astype(np.int64), np.ones(len(symbols), np.int64), np.arange(len(symbols))
    nodes, free = Nodes(least), int(sym.max(initial=-1)) + 1
    keys, names = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def join(here: np.ndarray, name: np.ndarray) -> None:
        nonlocal sym, size, at, part
        nodes.add(name, at[here], size[here], size[here] + size[here + 1])
        sym[here] = name
        size[here] += size[here + 1]
        keep = np.ones(len(sym), bool)
        keep[here + 1] = False
        sym, size, at, part = sym[keep], size[keep], at[keep], part[keep]

    while len(sym) > 1:
        together = part[1:] == part[:-1]
        pair = np.where(together, (sym[:-1] << 32) | sym[1:], -1)
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        count = np.where(together, count[which], 0)
        if not (count >= 2).any():
            break
        tie = random.permutation(int(which.max()) + 1)[which]
        rank = np.where(count >= 2, (np.frexp(count)[1].astype(np.int64) << 32) | tie, -1)
        first, last = _plateaus(rank)
        edged = np.concatenate([[-1], rank, [-1]])
        top = (rank >= 0) & (rank > edged[first]) & (rank > edged[last + 2])
        here = np.flatnonzero(top & ((np.arange(len(rank)) - first) % 2 == 0))
        fresh = np.setdiff1d(pair[here], keys)
        order = np.argsort(np.concatenate([keys, fresh]), kind="stable")
        keys, names = np.concatenate([keys, fresh])[order], np.concatenate([names, free + np.arange(len(fresh))])[order]
        free += len(fresh)
        join(here, names[np.searchsorted(keys, pair[here])])
    while len(sym) > 1:
        first, last = _plateaus(part)
        place = np.arange(len(sym))
        here = np.flatnonzero(((place - first) % 2 == 0) & (place < last))
        if not len(here):
            break
        join(here, free + np.arange(len(here)))
        free += len(here)
    return nodes.all()


def _crossing(ext: Extensions, at, left, size, s: Settings) -> tuple[np.ndarray, ...]:
    """(number of the node, start, end, period) of the stretches inside each node that cross its inner boundary."""
    periods = size // s.min_periods
    owner = np.repeat(np.arange(len(at)), periods)
    q = np.arange(len(owner)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    low, cut = at[owner], at[owner] + left[owner]
    high, w = low + size[owner], ext.symbols
    found = []
    # A stretch of three periods reaches a whole period beyond the boundary, or begins one before it.
    ahead = np.flatnonzero(cut + q <= high)
    ahead = ahead[w[cut[ahead] - 1] == w[cut[ahead] + q[ahead] - 1]]
    behind = np.flatnonzero(cut - q >= low)
    behind = behind[w[cut[behind] - q[behind]] == w[cut[behind]]]
    for here, i in ((ahead, cut[ahead]), (behind, cut[behind] - q[behind])):
        j = i + q[here]
        before = ext.longest(i, j, i - low[here], -1)
        after = ext.longest(i, j, high[here] - j, 1)
        long = before + after + q[here] >= np.maximum(s.min_words, s.min_periods * q[here])
        found.append([x[long] for x in (owner[here], i - before, j + after, q[here])])
    node, start, end, period = (np.concatenate(x) for x in zip(*found))
    # A stretch that has a period has its multiples too: the smallest counts.
    order = np.lexsort((period, end, start, node))
    node, start, end, period = node[order], start[order], end[order], period[order]
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return node[new], start[new], end[new], period[new]


def runs_of(symbols: np.ndarray, part: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in ``symbols``, none of which passes from one part to another."""
    nothing = (np.zeros(0, np.int64),) * 3
    symbol, at, left, size = grammar(symbols, part, s.min_words)
    if not len(symbol):
        return nothing
    ext = Extensions(symbols)
    _, one = np.unique(symbol, return_index=True)
    total = np.cumsum(size[one] // s.min_periods)
    found, lo = [], 0
    while lo < len(one):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + BLOCK)))
        here = one[lo:hi]
        node, start, end, period = _crossing(ext, at[here], left[here], size[here], s)
        found.append((symbol[here][node], start - at[here][node], end - start, period))
        lo = hi
    of, offset, length, period = (np.concatenate(x) for x in zip(*found))
    # ``of`` ascends, as the symbols of ``one`` do. Every place of a symbol has its stretches.
    first, last = np.searchsorted(of, symbol), np.searchsorted(of, symbol, "right")
    each = np.repeat(np.arange(len(symbol)), last - first)
    which = np.arange(len(each)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[each]
    start, period = at[each] + offset[which], period[which]
    end = start + length[which]
    order = np.lexsort((-end, start, period, part[start]))
    start, end, period = start[order], end[order], period[order]
    owner = part[start]
    group = np.cumsum(np.concatenate([[0], (owner[1:] != owner[:-1]) | (period[1:] != period[:-1])])) if len(start) else start
    reach = np.maximum.accumulate(group * (len(symbols) + 1) + end) if len(start) else start
    whole = np.ones(len(start), bool)
    whole[1:] = (group[1:] != group[:-1]) | (group[1:] * (len(symbols) + 1) + end[1:] > reach[:-1])
    return start[whole], end[whole], period[whole]


def _stretches(h: np.ndarray, part: np.ndarray, least: int) -> np.ndarray:
    """Places of words in stretches of at least ``least`` words whose neighbours all stand side by side twice in their part."""
    place = np.arange(len(h))
    for _ in range(3):  # only work depends on the number of passes
        if len(place) < least:
            return place[:0]
        w, p = h[place], part[place]
        beside = (place[1:] == place[:-1] + 1) & (p[1:] == p[:-1])
        pair = mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + mix(w[1:] + p[1:].astype(np.uint64)))
        _, which, count = np.unique(np.where(beside, pair, np.arange(len(pair), dtype=np.uint64)), return_inverse=True, return_counts=True)
        linked = beside & (count[which] >= 2)
        number = np.concatenate([[0], np.cumsum(~linked)])
        keep = np.bincount(number)[number] >= least
        if keep.all():
            break
        place = place[keep]
    return place


def rewritten(ids: list, first: np.ndarray) -> np.ndarray:
    """For each word of the texts, the word that stands in its place once the tails of some texts repeat (the contract's rule)."""
    take = np.arange(int(first[-1]))
    for i, d in enumerate(ids):
        lo, n = int(first[i]), int(first[i + 1] - first[i])
        if d is None or not n:
            continue
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            take[lo + a : lo + n] = lo + a + np.arange(n - a) % p
    return take


def _greater(x, y) -> int:
    """Order of (start, length, period): greatest length / period first, then smallest start and period."""
    a, b = x[1] * y[2], y[1] * x[2]
    return -1 if a > b else 1 if a < b else -1 if (x[0], x[2]) < (y[0], y[2]) else 1


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The words as bytes with a blank behind each, and where each begins."""
    size = ends - starts + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(at[-1]), np.uint8)
    lo = 0
    while lo < len(starts):
        hi = min(len(starts), max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20)))))
        n = size[lo:hi]
        out[at[lo] : at[hi]] = data[np.minimum(np.arange(int(at[lo]), int(at[hi])) + np.repeat(starts[lo:hi] - at[lo:hi], n), len(data) - 1)]
        lo = hi
    out[at[1:] - 1] = 32
    return out, at


def periodic_runs(docs: DataFrame, settings: Settings = Settings(), rewrite: Callable | None = rewritten) -> DataFrame:
    """Per row of ``docs``: doc_id, n_runs, the run with the greatest exponent, and digests of all runs and of the text without repetitions.

    ``rewrite`` gives the word that stands in each word's place (None: the words as they are).
    """
    def work(batch: pa.RecordBatch):
        ids = batch.column("doc_id").to_pylist()
        for lo, hi, data, offsets in text_chunks(batch.column("text")):
            words = words_of(data, offsets)
            first, total = words.first, int(words.first[-1])
            take = np.arange(total) if rewrite is None else rewrite(ids[lo:hi], first)
            h, doc = words.hashes[take], np.repeat(np.arange(hi - lo), np.diff(first))
            place = _stretches(h, doc, settings.min_words)
            # Words of different stretches or documents get different numbers, so that no symbol passes between them.
            stretch = np.cumsum(np.concatenate([[0], (np.diff(place) > 1) | (np.diff(doc[place]) > 0)])) if len(place) else place
            _, number = np.unique(mix(h[place] + mix(stretch.astype(np.uint64))), return_inverse=True)
            start, end, period = runs_of(number.astype(np.int64), stretch, settings)
            of = doc[place[start]]
            begin, length = place[start], end - start
            gone = np.zeros(total + 1, np.int64)
            np.add.at(gone, begin + period, 1)
            np.add.at(gone, begin + length, -1)
            kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
            out, at = _joined(data, words.starts[take[kept]], words.ends[take[kept]])
            cuts = at[np.searchsorted(kept, first)]
            runs: dict[int, list] = {}
            for d, b, n, q in zip(of.tolist(), (begin - first[of]).tolist(), length.tolist(), period.tolist()):
                runs.setdefault(d, []).append((b, n, q))
            columns = {name.split()[0]: [] for name in SCHEMA.split(", ")}
            for i in range(hi - lo):
                own = sorted(runs.get(i, ()), key=lambda r: (r[0], r[2]))
                best = min(own, key=cmp_to_key(_greater)) if own else None
                row = (ids[lo + i], len(own), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                       hashlib.sha256("".join(f"{b},{n},{q}\n" for b, n, q in own).encode()).hexdigest(),
                       hashlib.sha256(out[cuts[i] : max(cuts[i], cuts[i + 1] - 1)]).hexdigest())
                for c, v in zip(columns, row):
                    columns[c].append(v)
            yield columns

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), work, SCHEMA)
