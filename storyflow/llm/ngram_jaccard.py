"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct word n-grams as 64-bit hashes. Sets are ordered by one global order (hashes, with the
most widespread n-grams last), and two similar sets must share a token of their prefixes. Documents with equal sets
become one class; classes with equal prefixes and sizes become one group; groups meet on prefix tokens, pass the
length, position and prefix-overlap filters, and only then are expanded to classes and verified on whole texts.

Links serve to find connected components, so not every pair of a large group of near copies is verified. First each
group is compared with its best neighbour in the token lists (sorted by size), with the hub of its lists (the set with
the fewest n-grams that no other set has, most likely the common original), and each class with the next one of its
group; what that connects is one component. Then only pairs of different components are generated, filtered and
verified, so no link between components is lost while a group of near copies costs one pair a member.

Defined results: a null or empty text has an empty set and is linked with nothing; a text shorter than n words is one
token; rows with equal ids are one document (a null id is an id like any other and comes last); other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyflow.llm.common import Kept, Scratch, components, mix, signed, text_chunks, words_of

LAST = 2**63 - 1


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    #: Length of the list of the most widespread n-grams that the order puts last, and the share of documents from which
    #: an n-gram may be on it (which bounds what is sorted). Both steer cost, not results.
    widespread: int = 65_536
    share: float = 1e-4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; the words of a text with fewer than n are one token."""
    words = words_of(data, offsets, fold=True)
    h, out = words.hashes, []
    grams = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        grams = mix(grams + h[i : i + len(grams)]) * np.uint64(0x9E3779B97F4A7C15)
    for lo, hi in zip(words.first[:-1], words.first[1:]):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            x = np.full(1, hi - lo, np.uint64)
            for v in h[lo:hi]:
                x = mix(x * np.uint64(0xC2B2AE3D27D4EB4F) + v)
            out.append(x)
        else:
            out.append(h[lo:hi])
    return out


class Order:
    """The global order: n-grams outside the list by hash, then those of the list from rare to frequent."""

    def __init__(self, listed: np.ndarray):
        self.sort = np.argsort(listed)
        self.known = listed[self.sort]

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
        return np.where(self.known[at] == tokens, self.sort[at] + 1, 0)

    def prefix(self, tokens: np.ndarray, size: int) -> np.ndarray:
        """``tokens`` sorted by hash -> the first ``size`` in the global order."""
        rank = self.rank(tokens)
        return tokens[np.argsort(rank, kind="stable")[:size]]

    def bound(self, a: np.ndarray, b: np.ndarray, na: int, nb: int) -> int:
        """Most tokens that two sets can share, given their prefixes: both are known up to the earlier prefix's end."""
        ra, rb = self.rank(a), self.rank(b)
        if (ra[-1], a[-1]) > (rb[-1], b[-1]):
            a, b, ra, rb, na, nb = b, a, rb, ra, nb, na
        known = int(((rb < ra[-1]) | ((rb == ra[-1]) & (b <= a[-1]))).sum())
        return len(np.intersect1d(a, b[:known], assume_unique=True)) + min(na - len(a), nb - known)


def least_overlap(na, nb, percent: int):
    """Smallest intersection of sizes na, nb with 100 * intersection >= percent * union (integers or numpy)."""
    return -(-percent * (na + nb) // (100 + percent))


def widespread(docs: DataFrame, s: Settings) -> np.ndarray:
    """The ``s.widespread`` n-grams that most documents hold, from rare to frequent.

    A task counts the n-grams of its documents, about four million at a time, and passes on those that at least three hold.
    """
    def counted(sets):
        tokens, n = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(tokens[n >= 3])), pa.array(n[n >= 3])], names=["token", "n"])

    def count(batches):
        sets, size = [], 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                for x in shingle_sets(data, offsets, s.words):
                    sets.append(x)
                    size += len(x)
            if size >= 4_000_000:
                yield counted(sets)
                sets, size = [], 0
        if sets:
            yield counted(sets)

    least = s.share * docs.count()
    top = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(s.widespread)
    return top.toPandas()["token"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


def _sets(s: Settings, listed: np.ndarray):
    def run(batches):
        order = Order(listed)
        for batch in batches:
            n, s1, s2, prefix = [], [], [], []
            for _, _, data, offsets in text_chunks(batch.column("text")):
                for x in shingle_sets(data, offsets, s.words):
                    n.append(len(x))
                    m = mix(x + np.uint64(0x165667B19E3779F9))
                    s1.append(m.sum(dtype=np.uint64))
                    s2.append(mix(m).sum(dtype=np.uint64))
                    prefix.append(signed(order.prefix(x, len(x) - -(-s.percent * len(x) // 100) + 1 if len(x) else 0)))
            hashes = [pa.array(signed(np.array(v, np.uint64))) for v in (s1, s2)]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(n, pa.int32()), *hashes, pa.array(prefix, pa.list_(pa.int64()))], names=["d", "n", "s1", "s2", "prefix"])
    return run


def _possible(s: Settings, listed: np.ndarray):
    """Keep pairs whose prefixes allow the threshold."""
    def run(batches):
        order = Order(listed)
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = [order.bound(np.asarray(a.values).view(np.uint64), np.asarray(b.values).view(np.uint64), int(x), int(y)) >= least_overlap(int(x), int(y), s.percent)
                    for a, b, x, y in zip(batch.column("pa"), batch.column("pb"), na, nb)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
    return run


def _fetched(s: Settings):
    def run(batches):
        for batch in batches:
            k, want = batch.column("k").to_numpy(), batch.column("s1").to_numpy()
            for lo, _, data, offsets in text_chunks(batch.column("text")):
                ks, tokens = [], []
                for i, x in enumerate(shingle_sets(data, offsets, s.words)):
                    if signed(mix(x + np.uint64(0x165667B19E3779F9)).sum(dtype=np.uint64, keepdims=True))[0] == want[lo + i]:
                        ks.append(k[lo + i])
                        tokens.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(tokens, pa.binary())], names=["k", "tokens"])
    return run


def _linked(s: Settings):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("ta"), batch.column("tb")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= s.percent * (len(a) + len(b) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
    return run


def _verify(scratch: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame, s: Settings) -> Kept:
    """Pairs of classes (a, b) that link, by their whole sets, which are built from one text of each class."""
    pairs = scratch.keep(pairs.distinct(), "pairs")
    ids = scratch.keep(pairs.df.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(classes.select("k", "d", "s1"), "k"), "ids")
    # A sort-merge join at every size: the texts are never matched against a table that was sent whole.
    sets = scratch.keep(docs.join(ids.df.hint("merge"), "d").select("k", "s1", "text").mapInArrow(_fetched(s), "k long, tokens binary"), "sets")
    side = lambda c, t: sets.df.select(F.col("k").alias(c), F.col("tokens").alias(t))
    joined = pairs.df.join(side("a", "ta"), "a").join(side("b", "tb"), "b")
    out = scratch.keep(joined.mapInArrow(_linked(s), "a long, b long"), "links")
    for kept in (pairs, ids, sets):
        kept.drop()
    return out


def near_copies(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    s, scratch = settings, Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), "text")
    listed = widespread(docs, s)
    sets = scratch.keep(docs.mapInArrow(_sets(s, listed), "d long, n int, s1 long, s2 long, prefix array<bigint>"), "prefixes")
    classes = scratch.keep(
        sets.df.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("d").alias("d"), F.first("prefix").alias("prefix")).withColumn("k", F.monotonically_increasing_id()), "classes")
    members = classes.df.withColumns({"p1": F.xxhash64("prefix"), "p2": F.xxhash64(F.lit(1), "prefix")})
    groups = members.groupBy("n", "p1", "p2").agg(F.min("k").alias("g"), F.first("prefix").alias("prefix"))
    grouped = scratch.keep(members.select("k", "d", "s1", "n", "p1", "p2").join(groups.select("n", "p1", "p2", "g"), ["n", "p1", "p2"]).select("k", "d", "s1", "g"), "groups")
    # Token lists. A 32-bit token may join two n-grams; the filters and the check behind it are exact.
    lists = groups.select("g", "n", F.size("prefix").alias("p"), F.posexplode("prefix").alias("pos", "t")).select("g", "n", "p", "pos", F.hash("t").alias("token"))
    by_size = Window.partitionBy("token").orderBy("n", "g")
    here = F.struct("g", "n", "pos")
    met = scratch.keep(lists.withColumns({"before": F.lag(here).over(by_size), "after": F.lead("g").over(by_size)}).where("before is not null or after is not null").drop("after"), "lists")

    need = lambda a, b: F.ceil((F.col(a) + F.col(b)) * s.percent / (100 + s.percent) - 1e-9)
    fits = lambda na, nb: F.least(na, nb) * 100 >= F.greatest(na, nb) * s.percent
    # No other set has the prefix tokens that stand in no list: ``most`` bounds any intersection of the set.
    # ``held`` and ``past`` number the tokens that do: all of the prefix, and those before this one.
    numbered = met.df.withColumns({"held": F.count(F.lit(1)).over(Window.partitionBy("g")).cast("int"), "past": (F.row_number().over(Window.partitionBy("g").orderBy("pos")) - 1)})
    shared = scratch.keep(numbered.withColumn("most", F.col("n") - F.col("p") + F.col("held")).where(F.col("most") * 100 >= F.col("n") * s.percent), "shared")
    met.drop()

    # First: the neighbour that stands before a group in most of its lists, the hub of most of its lists, and the class before a class in its group.
    hubs = scratch.keep(shared.df.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("most")).alias("own"), "g", "n")).alias("hub")), "hubs")
    beside = shared.df.select(F.col("before.g").alias("a"), F.col("g").alias("b"), F.col("before.n").alias("na"), F.col("n").alias("nb"), "most")
    central = shared.df.join(hubs.df, "token").select(F.col("hub.g").alias("a"), F.col("g").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"), "most")

    def best(pairs: DataFrame) -> DataFrame:
        able = pairs.where("a <> b").where(fits("na", "nb")).where(F.col("most") >= need("na", "nb"))
        counted = able.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        return counted.groupBy("b").agg(F.max(F.struct("c", "a", "na", "nb")).alias("m")).select("m.a", "b", "m.na", "m.nb")

    prefixes = classes.df.select("k", "prefix")
    side = lambda c, p: prefixes.select(F.col("k").alias(c), F.col("prefix").alias(p))
    possible = lambda pairs: pairs.join(side("a", "pa"), "a").join(side("b", "pb"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_possible(s, listed), "a long, b long")
    inside = grouped.df.select(F.lag("k").over(Window.partitionBy("g").orderBy("k")).alias("a"), F.col("k").alias("b")).where("a is not null")
    near = best(beside).unionByName(best(central)).distinct()
    links = _verify(scratch, docs, grouped.df, possible(near).unionByName(inside), s)

    # Rows that share an id are one document, whatever their texts.
    held = sets.df.where("n > 0").join(classes.df.select("n", "s1", "s2", "k"), ["n", "s1", "s2"]).select("d", "k")
    same = held.groupBy("d").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a < z").select("d", "a").join(held, "d").select("a", F.col("k").alias("b"))
    first = scratch.keep(links.df.unionByName(same), "first")
    found = components(scratch, first.df)

    # Then: groups of different components that share tokens.
    labelled = grouped.df.join(found.df, F.col("k") == F.col("id"), "left").select("k", "g", F.coalesce("component", "k").alias("c"))
    parts = scratch.keep(labelled.groupBy("g", "c").agg(F.count(F.lit(1)).alias("size")), "parts")
    rows = shared.df.select("token", "g", "n", "p", "held", "past", "most").join(parts.df.select("g", "c"), "g")
    spread = scratch.keep(rows.groupBy("token").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("token"), "spread").df
    open_ = scratch.keep(rows.join(spread, "token"), "open")
    left, right = (open_.df.select("token", *[F.col(c).alias(c + e) for c in ("g", "c", "n", "p", "held", "past", "most")]) for e in ("a", "b"))
    # A pair that links shares at least ``common`` prefix tokens. Its first one has that many less one behind it on both sides, so
    # only such places give a row; what can stand before and behind it on both sides must reach the threshold.
    common = need("na", "nb") - F.greatest(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    behind = F.least(F.col("helda") - F.col("pasta"), F.col("heldb") - F.col("pastb"))
    bound = F.least("pasta", "pastb") + F.least(F.col("mosta") - F.col("pasta"), F.col("mostb") - F.col("pastb"))
    meet = left.join(right, "token").where("ca <> cb and ga <> gb and (na < nb or (na = nb and ga < gb))").where(fits("na", "nb") & (behind >= common) & (bound >= need("na", "nb")))
    pairs = scratch.keep(meet.select(F.col("ga").alias("a"), F.col("gb").alias("b"), "ca", "cb", "na", "nb").distinct(), "candidates")
    passed = possible(pairs.df.select("a", "b", "na", "nb").distinct())
    between = pairs.df.join(passed, ["a", "b"]).select(F.col("a").alias("ga"), "ca", F.col("b").alias("gb"), "cb")
    twin, other = (parts.df.select("g", F.col("c").alias(x)) for x in ("ca", "cb"))
    within = twin.join(other, "g").where("ca < cb").select(F.col("g").alias("ga"), "ca", F.col("g").alias("gb"), "cb")
    own = lambda e: labelled.select(F.col("g").alias("g" + e), F.col("c").alias("c" + e), F.col("k").alias(e))
    rest = between.unionByName(within).join(own("a"), ["ga", "ca"]).join(own("b"), ["gb", "cb"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = _verify(scratch, docs, grouped.df, rest, s)
    # The components so far stand for the links that made them.
    final = components(scratch, found.df.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more.df))

    smallest = classes.df.select("k", "d").join(final.df, F.col("k") == F.col("id")).groupBy("component").agg(F.min("d").alias("smallest"))
    labels = final.df.join(smallest, "component").select("id", "smallest")
    of_class = classes.df.select("n", "s1", "s2", "d", "k").join(labels, F.col("k") == F.col("id"), "left").select("n", "s1", "s2", F.coalesce("smallest", "d").alias("smallest"))
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return (
        sets.df.select("d", "n", "s1", "s2").join(of_class, ["n", "s1", "s2"], "left").withColumn("component", F.coalesce("smallest", "d"))
        .select(null("d").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), null("component").alias("component_id")))
