"""Similarity joins of token sets by prefix filter.

Tokens are ordered rarest first; two sets of sizes n <= m reach Jaccard t only when they
share at least ceil(t/(1+t)*(n+m)) tokens, so each must expose a shared token early in that
order. Candidates meet on one token, are pruned by size, position and signature while joining,
counted per pair, and verified exactly.

A signature has one bit per hash bucket: the parity of the set's tokens in it. Two signatures differ in
no more bits than the sets differ in tokens, so most sets that only share a frequent token are told
apart before a pair is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPS = 1e-9
#: Longs of a signature.
_LONGS = 8
_SIGNATURE = [f"s{i}" for i in range(_LONGS)]


def order_tokens(sets: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """``(rank, tok)`` -> ``(rank, sorted, signature)`` with tokens rarest first.

    The frequency side has one row per token; a hot token's rows are split by the
    adaptive skew join because only that side is large."""
    long = sets.select("rank", F.explode("tok").alias("t"))
    freq = token_frequency(sets) if frequency is None else frequency
    bucket = F.pmod(F.xxhash64("t"), F.lit(64 * _LONGS)).cast("int")
    parity = [F.bit_xor(F.when(F.floor(bucket / 64) == i, F.call_function("shiftleft", F.lit(1).cast("long"), bucket % 64)).otherwise(F.lit(0).cast("long"))).alias(c)
              for i, c in enumerate(_SIGNATURE)]
    ordered = (
        long.join(freq, "t", "left")
        .groupBy("rank")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t"))).alias("s"), *parity)
        .select("rank", F.transform("s", lambda x: x["t"]).alias("sorted"), *_SIGNATURE)
    )
    return ordered


def token_frequency(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("tok").alias("t")).groupBy("t").agg(F.count("*").alias("df"))


def _ceil(c: Column) -> Column:
    return F.ceil(c - F.lit(_EPS)).cast("int")


def _long_prefix(n: Column, t: float) -> Column:
    return n - _ceil(n * F.lit(t)) + 1


def _short_prefix(n: Column, t: float) -> Column:
    return n - _ceil(n * F.lit(2 * t / (1 + t))) + 1


def prefix_rows(sets: DataFrame, t: float, short: bool) -> DataFrame:
    """One row per prefix token: ``(rank, n, signature, pos, token)``."""
    n = F.size("sorted")
    k = _short_prefix(n, t) if short else _long_prefix(n, t)
    return sets.select("rank", n.alias("n"), *_SIGNATURE, F.posexplode(F.slice("sorted", F.lit(1), k)).alias("pos", "token"))


def token_loads(sets: DataFrame, t: float, cuts: list[int]) -> list[int]:
    """Upper bound on token matches among sets with rank <= cut, for every cut."""
    both = prefix_rows(sets, t, True).select("rank", "token", F.lit(1).alias("s"), F.lit(0).alias("l")).unionByName(
        prefix_rows(sets, t, False).select("rank", "token", F.lit(0).alias("s"), F.lit(1).alias("l")))
    aggs = []
    for i, c in enumerate(cuts):
        inside = F.col("rank") <= c
        aggs += [F.sum(F.when(inside, F.col("s"))).alias(f"s{i}"), F.sum(F.when(inside, F.col("l"))).alias(f"l{i}")]
    per_token = both.groupBy("token").agg(*aggs)
    row = per_token.agg(*[
        F.sum(F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("double") * F.coalesce(F.col(f"l{i}"), F.lit(0)))
        .alias(f"c{i}") for i in range(len(cuts))
    ]).first()
    return [int(v or 0) for v in row]


def _verify(pairs: DataFrame, left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """Exact Jaccard on ``(a, b)`` candidates."""
    lt = left.select(F.col("rank").alias("a"), F.col("sorted").alias("ta"))
    rt = right.select(F.col("rank").alias("b"), F.col("sorted").alias("tb"))
    inter = F.size(F.array_intersect("ta", "tb"))
    jac = inter / (F.size("ta") + F.size("tb") - inter)
    return (
        pairs.join(lt, "a").join(rt, "b").withColumn("jaccard", jac)
        .filter(F.col("jaccard") >= t).select("a", "b", "jaccard")
    )


def _prune(joined: DataFrame, t: float) -> DataFrame:
    """Count shared prefix tokens per pair and drop pairs that cannot reach the overlap."""
    need = _ceil((F.col("n1") + F.col("n2")) * F.lit(t / (1 + t)))
    rest = F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) - 1
    return (
        joined.groupBy("a", "b", "n1", "n2")
        .agg(F.count("*").alias("shared"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
        .filter(F.col("shared") + rest >= need)
        .select("a", "b")
    )


def _meet(x: DataFrame, y: DataFrame, t: float, condition: Column) -> DataFrame:
    """Equi-join two prefix tables on the token, with size, position and signature bounds inside the join."""
    n1, n2 = F.col("x.n"), F.col("y.n")
    need = _ceil((n1 + n2) * F.lit(t / (1 + t)))
    # Tokens up to this match can contribute at most min(p1, p2) + 1 more, later ones min(rest).
    upper = F.least(F.col("x.pos"), F.col("y.pos")) + F.least(n1 - F.col("x.pos"), n2 - F.col("y.pos"))
    size_ok = (n1 * F.lit(t) <= n2 + F.lit(_EPS)) & (n2 * F.lit(t) <= n1 + F.lit(_EPS))
    # Sets that share ``need`` tokens differ in at most the others.
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in _SIGNATURE[1:]),
                F.bit_count(F.col(f"x.{_SIGNATURE[0]}").bitwiseXOR(F.col(f"y.{_SIGNATURE[0]}"))))
    return (
        x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & condition)
        .filter(size_ok & (upper >= need) & (apart <= n1 + n2 - need * 2))
        .select(F.col("x.rank").alias("a"), F.col("y.rank").alias("b"), n1.alias("n1"), n2.alias("n2"),
                F.col("x.pos").alias("p1"), F.col("y.pos").alias("p2"))
    )


def self_pairs(sets: DataFrame, t: float) -> DataFrame:
    """All pairs ``a < b`` (by rank) of distinct token sets with Jaccard >= t."""
    short, long = prefix_rows(sets, t, True), prefix_rows(sets, t, False)
    cond = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rank") < F.col("y.rank")))
    cand = _prune(_meet(short, long, t, cond), t).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return _verify(cand, sets, sets, t)


def cross_pairs(left: DataFrame, right: DataFrame, t: float, condition: Column | None = None) -> DataFrame:
    """All pairs of a left and a right set with Jaccard >= t; tokens share one order.
    ``condition`` may compare ``x.rank`` with ``y.rank``."""
    condition = F.lit(True) if condition is None else condition
    cand = _prune(_meet(prefix_rows(left, t, False), prefix_rows(right, t, False), t, condition), t)
    return _verify(cand, left, right, t)
