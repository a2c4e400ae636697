"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence per group.

A line is normalised to its lower-case words; in scripts without spaces each character is a word. Equal lines are one node from the start
(128-bit hash of the words), so a line that a third of the documents carry costs one row per occurrence and no pair. A line's SimHash has 64
bits, each the majority of that bit over the hashes of its words of four letters and more. Texts are read once for hashes, SimHashes and anchors.

Lines of ``min_words`` words and more meet where one of eight SimHash blocks agrees (which two hashes that differ in at most seven bits always have)
and they have an anchor in common: the run of three words that comes first in one of six orders. Anchors part lines that share a block
by chance; lines whose anchors no other line has go no further. Pairs that meet and differ in at most ``bits`` bits are verified by the edit
distance of their word sequences. One edit in ten words changes a seventh of the bits, so no number of blocks makes this lossless at a similarity of
0.8: see the shares measured against brute force in tests/llm (at least 0.9 of the similar pairs in each class of lengths from 13 words on, with edits
spread over the whole range). Lines of up to 12 words, where one word moves very many bits, also meet on every run of words that two similar ones must share,
which finds all of them. With a ``distance``, lines meet on blocks alone, and all pairs within that many bits are found: two hashes that differ in at most
``distance`` bits agree in some choice of blocks.

First each line is compared with its neighbour and the hub under a key, and what that connects is one component;
then pairs of different components meet. So a group of near copies does not give all its pairs; under keys of ``CROWD`` lines and more only links are written. Keys that a very large number of lines
hold are found on a sample of the nodes and dealt over several tasks; results do not depend on that. DataFrame functions only.

Defined results: lines of fewer than ``min_words`` words are compared for equality only, and those with fewer than
``min_chars`` characters in their words besides (empty ones too) are never removed; a null or empty text has no
lines; the first occurrence by (doc_id, line number) stays, a null id coming last; rows that share an id and a line
number share its fate; very long lines are hashed and compared whole; other columns are ignored and kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyflow.llm.common import Kept, Scratch, components

LAST = 2**63 - 1


@dataclass(frozen=True)
class Settings:
    #: Fewest words of a line that is compared by similarity; shorter ones are removed only when equal.
    min_words: int = 8
    #: Fewest characters in the words of a line with fewer words.
    min_chars: int = 12
    #: Only pairs whose SimHashes differ in at most so many bits, all of them; None: pairs under a common anchor and block.
    distance: int | None = None
    similarity: float = 0.8
    #: Most bits in which the SimHashes of a pair that is verified differ (one word in five changes 13 of 64 on average, give or take 3).
    bits: int = 20
    #: Longest lines that also meet on runs of words.
    short: int = 12


#: Orders of the word runs: the smallest hash after a mask, whose first three bits differ from order to order.
ORDERS = [(i << 61 | 0x0123456789ABCDEF >> i) - (1 << 64 if i > 3 else 0) for i in range(6)]
#: A key that so many nodes of one in ``SAMPLE`` hold is dealt over ``DEALT`` tasks; at most ``HOTTEST`` keys are.
SAMPLE, HOT, DEALT, HOTTEST = 64, 256, 64, 4096
#: Under a key of so many lines no pairs are written: their edit distances are asked where they meet.
CROWD = 64
#: ASCII characters other than letters and digits part words. A fixed value.
#: Thai, Lao, Burmese, Khmer, Kana and Han: scripts that put no spaces between words.
UNSPACED = r"([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}])"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Features that two-byte counters hold with a margin of as many, below the sign bit. Longer lines are counted in chunks.
MOST = 16_383
CHUNK = 63
PARITIES = [f"p{i}" for i in range(4)]
ONES, WIDE = 0x0101010101010101, 0x0001000100010001


def words(line: Column) -> Column:
    low = F.lower(line)
    apart = F.when(F.octet_length(line) == F.length(line), low).otherwise(F.regexp_replace(low, UNSPACED, " $1 "))  # ASCII needs no look
    return F.array_remove(F.split(apart, GAP), "")


def feature(word: Column) -> Column:
    """Hash of a word for the SimHash. Very short words, which most lines share, are none."""
    return F.when(F.length(word) > 3, F.xxhash64(word))


def _lanes(features: Column) -> Column:
    """Eight longs of eight byte-wide counters: lane k counts bits k, k + 8, ... of at most CHUNK hashes."""
    return F.array(*[_lane(features, k) for k in range(8)])


def _lane(features: Column, k: int) -> Column:
    return F.aggregate(features, F.lit(0).cast("long"), lambda t, x: t + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(ONES)))


def long_simhash(features: Column) -> Column:
    """SimHash of very many hashes: the byte-wide counters of chunks are added up bit by bit."""
    n = F.size(features)
    chunks = F.transform(F.sequence(F.lit(1), n, F.lit(CHUNK)), lambda at: F.get(F.transform(F.array(F.slice(features, at, F.lit(CHUNK))), _lanes), F.lit(0)))

    def bit(chunks: Column, b: Column) -> Column:
        count = F.aggregate(chunks, F.lit(0), lambda t, lanes: t + F.call_function("shiftrightunsigned", F.get(lanes, b % 8), (b / 8).cast("int") * 8).bitwiseAND(F.lit(255)).cast("int"))
        return F.when(count * 2 > n, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.get(F.transform(F.array(chunks), lambda c: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(bit(c, b)))), F.lit(0))


def signed_lines(docs: DataFrame, min_words: int = 1, most: int = MOST, min_chars: int | None = None, short: int = 0, similarity: float = 0.8) -> DataFrame:
    """(d, line, l1, l2, n, runs, sig, p0..p3, a0..a5): place, hashes of the words, their number, runs (up to ``short`` words), SimHash, parities and anchors of
    every line with ``min_words`` words; lines with fewer, but ``min_chars`` characters in at least one, have the first five only. ``docs`` has d and text.

    Bit k of every second byte is counted in sum k, so sixteen sums of a combining aggregate hold all 64 counters of a
    line of up to ``most`` features, and one addition compares four of them with half the number. Longer lines are counted in chunks in their row.
    Bit b of the 256 parities tells whether an odd number of words has it, so an edit changes two at most.
    Texts are dealt by a hash of id and text, so that a line's words meet in its own task and only texts are shuffled; words are exploded as
    they are and hashed in columns, which compiled code does, not in lambdas. Rows that come twice are counted together.
    """
    dealt = docs.withColumn("row", F.xxhash64("d", "text")).repartition("row")
    lines = dealt.select("row", "d", F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))
    # The words are bound once per line, behind a generator, so that no later expression splits the line again.
    enough = lambda w: F.size(w) >= min_words
    if min_chars is not None:
        enough = lambda w: (F.size(w) >= min_words) | (F.length(F.array_join(w, "")) >= F.lit(max(1, min_chars)))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    parts = F.transform(F.filter(F.array(words(F.col("body"))), enough), lambda w: F.struct(
        F.xxhash64(w).alias("l1"), F.xxhash64(F.lit(1), w).alias("l2"), F.size(w).alias("n"),
        F.when(F.size(w) >= min_words, w).otherwise(F.array(F.lit(None).cast("string"))).alias("w"),
        F.when(F.size(w) > most, F.filter(F.transform(w, feature), lambda x: x.isNotNull())).alias("many"),
        F.when(F.size(w).between(min_words, short), run_keys(w, F.size(w), similarity, short)).alias("runs")))
    keys = ["d", "line", "l1", "l2", "n", "runs"]
    bound = lines.select("row", "d", "line", F.inline(parts)).select("row", *keys, "w", F.when(F.col("n") > most, long_simhash(F.col("many"))).alias("long"))
    each = bound.select("row", *keys, "long", "w", F.posexplode("w").alias("i", "word"))
    i, n, word = F.col("i"), F.col("n"), F.col("word")
    run = F.when(((i > 1) | (n < 3)) & word.isNotNull(), F.xxhash64(F.when(i > 1, F.get("w", i - 2)), F.when(i > 0, F.get("w", i - 1)), word))
    hashed = each.select("row", *keys, "long", F.when(n <= most, feature(word)).alias("x"), F.when(word.isNotNull(), F.xxhash64(word)).alias("y"), run.alias("g"))
    sums = hashed.groupBy("row", *keys, "long").agg(
        *[F.sum(F.shiftrightunsigned(F.coalesce("x", F.lit(0)), k).bitwiseAND(F.lit(WIDE))).alias(f"s{k}") for k in range(16)], F.count("x").alias("m"), F.count("g").alias("any"),
        *[F.bit_xor(F.when(F.col("y").bitwiseAND(F.lit((len(PARITIES) - 1) * 64)) == 64 * i, bit(F.col("y").bitwiseAND(F.lit(63))))).alias(p) for i, p in enumerate(PARITIES)],
        *[F.min(F.col("g").bitwiseXOR(F.lit(mask))).alias(f"a{i}") for i, mask in enumerate(ORDERS)])
    margin = (F.lit(MOST) - F.least((F.col("m") / 2).cast("int"), F.lit(MOST))).cast("long") * F.lit(WIDE)
    sig = F.lit(0).cast("long")
    for k in range(16):
        sig = sig.bitwiseOR(F.shiftleft(F.shiftrightunsigned((F.col(f"s{k}") + margin).bitwiseAND(F.lit((MOST + 1) * WIDE)), 14), k))
    return sums.select(*keys, F.when(F.col("any") > 0, F.coalesce("long", sig, F.lit(0))).alias("sig"), *[F.coalesce(p, F.lit(0)).alias(p) for p in PARITIES], *[f"a{i}" for i in range(len(ORDERS))])


def block_plan(lines: int, distance: int) -> tuple[int, int]:
    """(blocks, blocks that must agree): more bits a key for more lines; the pairs found are the same for every choice."""
    agree = 1
    while (64 * agree // (distance + agree)) < 26 and lines > 1 << (22 if agree == 1 else 32):
        agree += 1
    return distance + agree, agree


def anchored_key(anchor_key: Column, j: int) -> Column:
    return F.xxhash64(anchor_key, F.lit(j), F.shiftrightunsigned("sig", 8 * j).bitwiseAND(F.lit(255)))


def first_common() -> Column:
    """For a pair of lines, the number of the first anchor and block that agree, as ``repeated_lines`` counts its keys: under that key the pair
    is written, under others not again."""
    chosen = lambda tests: F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)])
    anchor = chosen([F.col(f"a{i}a") == F.col(f"a{i}b") for i in range(len(ORDERS))])
    block = chosen([F.shiftrightunsigned(F.col("siga").bitwiseXOR(F.col("sigb")), 8 * j).bitwiseAND(F.lit(255)) == 0 for j in range(8)])
    return anchor * 8 + block + 1


def block_keys(sig: Column, blocks: int, agree: int) -> Column:
    """One key for each choice of ``agree`` blocks of the 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(masks[i] for i in chosen)
        keys.append(F.xxhash64(F.lit(number), sig.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def edits(n: Column, similarity: float) -> Column:
    """Most edits that the similarity allows when the longer line has ``n`` words."""
    return F.floor(n * F.lit(1 - similarity) + 1e-9).cast("int")


def run_length(n: Column, similarity: float) -> Column:
    """Words of a run that a line of ``n`` words shares with every similar line that is not longer: ``n`` words with e edits fall into at
    most e + 1 pieces."""
    e = edits(n, similarity)
    return F.greatest(F.lit(1), F.ceil((n - e) / (e + 1))).cast("int")


def run_keys(w: Column, n: Column, similarity: float, longest: int) -> Column:
    """Hashes of all runs of the lengths at which the line meets longer lines up to ``longest`` words, and lines that are not longer."""
    lengths = F.array_distinct(F.transform(F.sequence(n, F.least(F.lit(longest), F.floor(n / similarity + 1e-9).cast("int"))), lambda m: run_length(m, similarity)))
    starts = lambda q: F.when(q <= n, F.sequence(F.lit(1), n - q + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(lengths, lambda q: F.transform(starts(q), lambda i: F.xxhash64(q, F.slice(w, i, q))))))


def coded(w: Column) -> Column:
    """One letter (a hash into the code points 0x100 to 0xD7FF) for each word, for the edit distance of word sequences."""
    code = F.transform(w, lambda x: F.lpad(F.hex(F.pmod(F.xxhash64(x), F.lit(0xD700)) + 0x100), 4, "0"))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")


def _place() -> Column:
    """(d, line) as one number, whose order is theirs: a minimum that a hash aggregate can hold."""
    return F.expr("cast(d as decimal(20, 0)) * 2147483648BD + line")


def _of_place(m: str, d: str, line: str) -> list[Column]:
    return [F.expr(f"cast(({m} - pmod({m}, 2147483648BD)) div 2147483648BD as bigint)").alias(d), F.expr(f"cast(pmod({m}, 2147483648BD) as int)").alias(line)]


def _read(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(k, w): words of the lines at the places (k, d, line, l1, l2), read again from the texts; rows that share an id may give a line twice."""
    of_doc = places.groupBy("d").agg(F.collect_list(F.struct("k", "line", "l1", "l2")).alias("wanted"))
    # A hash join at every size, built from the places of a task: the texts are neither sorted nor matched against a table that was sent whole.
    found = docs.join(of_doc.hint("shuffle_hash"), "d").select(F.split("text", "\n", -1).alias("all"), F.explode("wanted").alias("x")).select("x.*", F.get("all", F.col("x.line")).alias("body"))
    bound = found.select("k", "l1", "l2", F.explode(F.array(words(F.col("body")))).alias("w"))  # bound once, as in signed_lines
    return bound.where("xxhash64(w) = l1 and xxhash64(1, w) = l2").select("k", "w")


def _with_neighbours(rows: DataFrame) -> DataFrame:
    """``rows`` (key, k, ...) whose key several lines hold, with the line before under the key.

    One exchange by key. Keys that very many lines hold, as a sample of the lines tells, are cut into parts in the same exchange."""
    sample = rows.where(F.pmod(F.xxhash64("k"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= HOT)
    hot = [r["key"] for r in sample.orderBy(F.desc("c"), "key").limit(HOTTEST).collect()]
    part = F.when(F.col("key").isin(hot), F.pmod(F.hash("k"), F.lit(DEALT))).otherwise(F.lit(0)) if hot else F.lit(0)
    order = Window.partitionBy("key", "part").orderBy("k")
    placed = rows.withColumn("part", part.cast("int")).withColumns({"before": F.lag("k").over(order), "after": F.lead("k").over(order)})
    return placed.where("before is not null or after is not null").drop("after", "part")


def _similar(a: str, b: str, s: Settings) -> Column:
    most = f"cast(greatest(length({a}), length({b})) * {1 - s.similarity} + 1e-9 as int)"
    return F.expr(f"levenshtein({a}, {b}, {most}) >= 0")


def _verify(scratch: Scratch, codes: DataFrame, pairs: DataFrame, s: Settings) -> Kept:
    """Pairs of nodes (a, b) whose lines are similar enough."""
    pairs = scratch.keep(pairs.distinct(), "pairs")
    side = lambda c, t: codes.select(F.col("k").alias(c), F.col("code").alias(t))
    out = scratch.keep(pairs.df.join(side("a", "ca"), "a").join(side("b", "cb"), "b").where(_similar("ca", "cb", s)).select("a", "b"), "links")
    pairs.drop()
    return out


def repeated_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no): every line that repeats an earlier one, exactly or nearly; lines count from 0."""
    s, scratch = settings, Scratch(docs.sparkSession, "lines")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.col("text")).where("text is not null and text <> ''")
    short = s.short if s.distance is None else 0
    every = scratch.keep(signed_lines(docs, s.min_words, min_chars=s.min_chars, short=short, similarity=s.similarity), "lines").df
    anchors = [f"a{i}" for i in range(len(ORDERS))]
    nodes = scratch.keep(every.groupBy("l1", "l2").agg(F.min(_place()).alias("m"), F.count(F.lit(1)).alias("many"), *[F.first(c).alias(c) for c in ("n", "sig", *anchors)],
                                                              # A row that comes twice cancels its parities: those of other places count.
                                                              *[F.bit_or(c).alias(c) for c in PARITIES])
                         .withColumn("k", F.monotonically_increasing_id()), "nodes").df
    fuzzy = nodes.where(F.col("n") >= s.min_words)
    apart = lambda c: F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b")))
    # An edit distance is at least the difference in length, and half the number of parities that differ.
    able = (F.abs(F.col("na") - F.col("nb")) <= F.greatest("na", "nb") * (1 - s.similarity) + 1e-9) & (sum(map(apart, PARITIES[1:]), apart(PARITIES[0])) <= 2 * edits(F.greatest("na", "nb"), s.similarity))
    if s.distance is None:
        anchored = scratch.keep(_with_neighbours(fuzzy.select("k", "sig", F.posexplode(F.array(*[F.xxhash64(F.lit(i), a) for i, a in enumerate(anchors)])).alias("anchor", "key"))), "anchored")
        blocks = F.array(*[anchored_key(F.col("key"), j) for j in range(8)])
        # ``at``: which anchor and block make the key; 0 for other keys.
        number = (F.col("anchor") * 8 + F.col("block") + 1).cast("byte").alias("at")
        runs = every.where("runs is not null").dropDuplicates(["l1", "l2"]).join(fuzzy.select("l1", "l2", "k"), ["l1", "l2"]).select("k", F.explode("runs").alias("key"), F.lit(0).cast("byte").alias("at"))
        filed = anchored.df.select("k", "anchor", F.posexplode(blocks).alias("block", "key")).select("k", "key", number).unionByName(runs)
        possible = able & ((apart("sig") <= s.bits) | (F.greatest("na", "nb") <= short))
    else:
        blocks, agree = block_plan(fuzzy.count(), s.distance)
        filed = fuzzy.select("k", F.explode(block_keys(F.col("sig"), blocks, agree)).alias("key"), F.lit(0).cast("byte").alias("at"))
        possible = able & (apart("sig") <= s.distance)
    shared = scratch.keep(_with_neighbours(filed), "shared")
    if s.distance is None:
        anchored.drop()
    # Of a pair only the lengths, SimHashes and parities of lines that share a key are looked up. ``held`` counts a line's shared keys.
    facts = ("n", "sig", *PARITIES, *anchors)
    lines = scratch.keep(shared.df.groupBy("k").agg(F.count(F.lit(1)).alias("held")).join(fuzzy.select("k", "l1", "l2", *_of_place("m", "d", "line"), *facts), "k"), "sides")
    # Lines that share a key are read again once, for the edit distance; rows that share an id may give a line twice.
    codes = scratch.keep(_read(docs, lines.df).select("k", coded(F.col("w")).alias("code")).groupBy("k").agg(F.first("code").alias("code")), "codes")
    side = lambda k, e: lines.df.select(F.col("k").alias(k), *[F.col(c).alias(c + e) for c in facts])

    # The hub of a key is the line with most shared keys: of a group of variants most likely the one they come from.
    hubs = scratch.keep(shared.df.select("key", "k").join(lines.df.select("k", "held"), "k").groupBy("key").agg(F.max(F.expr("cast(held as decimal(10, 0)) * 9223372036854775808BD + k")).alias("m")).select("key", F.expr("cast(pmod(m, 9223372036854775808BD) as bigint)").alias("hub")), "hubs")
    central = shared.df.select("key", "k").join(hubs.df, "key").select(F.col("hub").alias("a"), F.col("k").alias("b")).where("a <> b")
    beside = shared.df.where("before is not null").select(F.col("before").alias("a"), F.col("k").alias("b")).unionByName(central)
    beside = beside.distinct().join(side("a", "a"), "a").join(side("b", "b"), "b").where(possible).select("a", "b")
    first = _verify(scratch, codes.df, beside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), s)
    found = components(scratch, first.df)

    # Keys inside one component have nothing more to tell.
    named = scratch.keep(shared.df.select("key", "k", "at").join(found.df, F.col("k") == F.col("id"), "left").select("key", "k", "at", F.coalesce("component", "k").alias("c")), "named")
    shared.drop()
    hubs.drop()
    between = named.df.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), (F.count(F.lit(1)) >= CROWD).alias("crowd")).where("c1 <> c2").select("key", "crowd")
    open_ = scratch.keep(named.df.join(between, "key").join(lines.df.select("k", *facts), "k"), "open")
    named.drop()

    def meet(rows: DataFrame, *more: str) -> DataFrame:
        # Both sides have the same columns, so that they are shuffled once; a key is made by one anchor and block.
        left, right = (rows.select("key", *[F.col(c).alias(c + e) for c in ("k", "c", "at", *more, *facts)]) for e in ("a", "b"))
        return left.join(right, "key").where(F.expr("ka < kb and ca <> cb and ata = atb") & possible & ((F.col("ata") == 0) | (F.col("ata") == first_common())))

    ends = (F.col("ka").alias("a"), F.col("kb").alias("b"))
    more = _verify(scratch, codes.df, meet(open_.df.where("not crowd")).select(*ends), s)
    # Lines that share a passage, but too little besides, meet in pairs without being similar: of a crowd only links are written.
    crowds = scratch.keep(meet(open_.df.where("crowd").join(codes.df, "k"), "code").where(_similar("codea", "codeb", s)).select(*ends).distinct(), "links")
    for kept in (open_, codes):
        kept.drop()
    # The components so far stand for the links that made them.
    final = components(scratch, found.df.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more.df).unionByName(crowds.df))

    of_node = nodes.select("l1", "l2", "m", "many", "k").join(final.df, F.col("k") == F.col("id"), "left").where("many > 1 or id is not null").select("l1", "l2", "m", "many", F.coalesce("component", "k").alias("c"))
    kept = of_node.groupBy("c").agg(F.min("m").alias("m"), F.sum("many").alias("many")).where("many > 1").select("c", *_of_place("m", "kd", "kl"))
    judged = of_node.select("l1", "l2", "c").join(kept, "c").select("l1", "l2", "kd", "kl")
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))
    gone = every.select("d", "line", "l1", "l2").join(judged, ["l1", "l2"]).where("d <> kd or line <> kl")
    # Rows that share an id, a line number and the line give it once.
    return gone.select(null("d").alias("doc_id"), F.col("line").alias("line_no"), null("kd").alias("kept_doc_id"), F.col("kl").alias("kept_line_no")).distinct()


def without_repeated_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``; a text that had lines and lost them all goes. Columns as before."""
    gone = repeated_lines(docs, settings).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("line_no").alias("_gone"))
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    joined = row.join(gone, F.col("_id").eqNullSafe(F.col("_doc")), "left")
    rest = F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i))
    cut = joined.withColumn("_rest", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(rest, "\n")))
    left = cut.where("_gone is null or trim(_rest) <> ''")
    return left.select(*[(F.col("_rest") if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
