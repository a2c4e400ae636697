"""Greedy leader clustering and story events.

The definition: walk the rows in a total order; the first unassigned row becomes a leader
and takes every unassigned row whose token set is similar enough. This equals the
lexicographically first maximal independent set of the similarity graph, with every other
row attached to its earliest leader, which is what the rounds below compute.

Two things keep it linear where data is skewed. Rows with the same token set collapse to
one node first, so copies never meet each other. And the full edge set is never needed: a
step enumerates edges only inside a rank prefix whose token matches fit ``pair_budget``;
its leaders then absorb their neighbours from the whole remainder, so a dense group of
similar titles vanishes at the first step that sees one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyflow.config import DEFAULT, EngineConfig
from storyflow.functions import scores as S
from storyflow.functions.dates import hours_before, ts
from storyflow.functions.text import normalize_title, tokens
from storyflow.operators.vectors import cosine_join
from storyflow.operators.similarity import (
    cross_pairs, order_tokens, self_pairs, token_frequency, token_loads,
)
from storyflow.session import materialize
from storyflow import constants as K


def _set_key(tok_col: str) -> Column:
    """Short key of a token set (tokens hold no blanks); keeps long titles out of shuffles."""
    return F.sha2(F.array_join(F.array_sort(tok_col), " "), 256)


def _nodes(rows: DataFrame, id_col: str, tok_col: str, ord_col: str) -> DataFrame:
    """Distinct token sets with an increasing ``rank`` that follows the order column.

    Ranks come from a range-partitioned sort, so no single task orders everything."""
    sets = (
        rows.filter(F.size(tok_col) > 0)
        .groupBy(_set_key(tok_col).alias("k"))
        .agg(F.min(F.struct(F.col(ord_col).alias("o"), F.col(id_col).alias("id"))).alias("first"),
             F.any_value(tok_col).alias("tok"))
        .select("k", "tok", "first.o", "first.id")
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        sets.repartitionByRange(parts, "o", "id").sortWithinPartitions("o", "id")
        .select(F.monotonically_increasing_id().alias("rank"), "id", "k", "tok")
    )


def _leader_rounds(edges: DataFrame) -> DataFrame:
    """``edges(a < b)`` -> ``(b)`` rows that are members; every other node is a leader."""
    members = None
    live = edges.select("a", "b")
    while True:
        heads = live.select("a").distinct().join(live.select(F.col("b").alias("a")), "a", "left_anti")
        taken = live.join(heads, "a", "left_semi").select("b").distinct()
        taken = materialize(taken, "taken")
        if taken.isEmpty():
            break
        members = taken if members is None else members.unionByName(taken)
        gone = taken.select(F.col("b").alias("a"))
        live = materialize(live.join(taken, "b", "left_anti").join(gone, "a", "left_anti"), "live")
        if live.isEmpty():
            break
    return edges.select("b").limit(0) if members is None else members


def leader_edges(nodes: DataFrame, threshold: float, pair_budget: int) -> DataFrame:
    """``nodes(rank, id, tok)`` (materialized) -> ``(b, a, jaccard)``: member, leader, similarity."""
    frequency = token_frequency(nodes)
    rest = materialize(order_tokens(nodes, frequency), "ordered")
    found: list[DataFrame] = []
    while True:
        cut = _choose_cut(rest, threshold, pair_budget)
        head = rest if cut is None else rest.filter(F.col("rank") <= cut)
        edges = materialize(self_pairs(head, threshold), "edges")
        members = _leader_rounds(edges)
        inside = edges.join(members.select(F.col("b").alias("a")), "a", "left_anti")
        found.append(_earliest(inside))
        if cut is None:
            break
        leaders = materialize(head.join(members.select(F.col("b").alias("rank")), "rank", "left_anti"), "leaders")
        tail = rest.filter(F.col("rank") > cut)
        outside = materialize(_earliest(cross_pairs(leaders, tail, threshold)), "outside")
        found.append(outside)
        rest = materialize(tail.join(outside.select(F.col("b").alias("rank")), "rank", "left_anti"), "rest")
        if rest.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _earliest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("b").agg(F.min(F.struct("a", "jaccard")).alias("m")).select("b", "m.a", "m.jaccard")


def _choose_cut(rest: DataFrame, threshold: float, budget: int) -> int | None:
    """Largest tested rank prefix whose token matches fit the budget; None means all of it."""
    fractions = [0.5**i for i in range(1, 25)]
    bounds = rest.agg(F.percentile_approx("rank", fractions, 100_000).alias("q"),
                      F.min("rank").alias("lo"), F.max("rank").alias("hi")).first()
    if bounds["hi"] is None:
        return None
    cuts = sorted(set(bounds["q"]) | {bounds["lo"], bounds["hi"]}, reverse=True)
    for cut, load in zip(cuts, token_loads(rest, threshold, cuts)):
        if load <= budget:
            return None if cut == bounds["hi"] else cut
    return bounds["lo"]


def leader_clusters(rows: DataFrame, id_col: str, tok_col: str, ord_col: str, threshold: float,
                    pair_budget: int | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Adds ``leader_id`` and ``similarity`` to every row. Rows without tokens lead themselves."""
    nodes = materialize(_nodes(rows, id_col, tok_col, ord_col), "nodes")
    if pair_budget is None:
        pair_budget = _budget(nodes, cfg)
    edges = leader_edges(nodes, threshold, pair_budget)
    ids = nodes.select(F.col("rank").alias("a"), F.col("id").alias("leader_id"))
    placed = (
        nodes.join(edges, nodes["rank"] == edges["b"], "left")
        .select("k", F.coalesce("a", "rank").alias("a"), F.coalesce("jaccard", F.lit(1.0)).alias("similarity"))
        .join(ids, "a").select(F.col("k").alias("_k"), "leader_id", "similarity")
    )
    return (
        rows.withColumn("_k", F.when(F.size(tok_col) > 0, _set_key(tok_col))).join(placed, "_k", "left").drop("_k")
        .withColumn("leader_id", F.coalesce("leader_id", F.col(id_col)))
        .withColumn("similarity", F.coalesce("similarity", F.lit(1.0)))
    )


def _budget(nodes: DataFrame, cfg: EngineConfig) -> int:
    """Token matches of one step: by the cores, or by the tokens where those are many. Only pairs that pass the signature are written."""
    held = nodes.agg(F.sum(F.size("tok")).alias("n")).first()["n"] or 0
    return max(cfg.pair_budget_per_core * nodes.sparkSession.sparkContext.defaultParallelism, cfg.pair_budget_per_token * held)


def story_order() -> Column:
    """Official first, newest first, undated last, then input order."""
    return F.struct((~F.col("is_official")).alias("x"), F.coalesce(-F.unix_micros("published_at"), F.lit(0)).alias("y"),
                    F.col("article_id").alias("z"))


def cluster_articles(articles: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``(article_id, leader_id, similarity)`` for one batch."""
    rows = articles.select(
        "article_id", tokens(normalize_title(F.col("title")), K.STOP_WORDS).alias("tok"), story_order().alias("ord"))
    return leader_clusters(rows, "article_id", "tok", "ord", cfg.title_jaccard, cfg=cfg).select(
        "article_id", "leader_id", "similarity")


def group_stories(articles: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Corroboration grouping: input order, stop words kept, blank titles left out."""
    rows = articles.select(
        "article_id", tokens(normalize_title(F.col("title"))).alias("tok"), F.struct("article_id").alias("ord"),
    ).filter(F.size("tok") > 0)
    return leader_clusters(rows, "article_id", "tok", "ord", cfg.title_jaccard, cfg=cfg).select(
        "article_id", F.col("leader_id").alias("story_id"))


def roll_up(articles: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row per cluster. Domains go through a distinct step first, so the list gathered
    per cluster holds domains, not articles."""
    joined = articles.join(assignment.select("article_id", "leader_id"), "article_id")
    per_domain = joined.groupBy("leader_id", "source_domain").agg(
        F.min("published_at").alias("first"), F.count("*").alias("n"))
    return per_domain.groupBy("leader_id").agg(
        F.array_sort(F.collect_list("source_domain")).alias("source_domains"),
        F.count("*").cast("int").alias("source_count"),
        F.min("first").alias("earliest_published"),
        F.sum("n").alias("size"),
    )


def match_events(clusters: DataFrame, events: DataFrame, as_of, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``clusters(leader_id, url, title)`` against events of the last 72 h:
    ``(leader_id, event_id, match, jaccard)``.

    Same primary url wins (newest event); the rest takes the best headline similarity, then
    the newest event. All recent events compete. Headlines with equal token sets collapse to
    their newest event first, because any other copy would lose the tie. Where both sides carry an ``embedding``, clusters
    that are still open take the event with the best cosine of at least ``cfg.event_vector`` (match ``vector``, with the cosine as its similarity)."""
    recent = events.filter((F.col("created_at") >= hours_before(as_of, cfg.event_window_hours))
                           & (F.col("created_at") <= ts(as_of)))
    recency = F.struct(F.unix_micros("created_at").alias("t"), F.col("event_id").alias("i"))
    by_url = (
        recent.groupBy(F.col("primary_source_url").alias("url")).agg(F.max_by("event_id", recency).alias("event_id"))
    )
    exact = clusters.join(by_url, "url").select("leader_id", "event_id", F.lit("url").alias("match"),
                                                F.lit(1.0).alias("jaccard"))
    open_clusters = clusters.join(exact.select("leader_id"), "leader_id", "left_anti")

    tok = lambda c: F.array_sort(tokens(normalize_title(F.col(c)), K.STOP_WORDS))
    # Both sides feed several steps below; writing them once avoids re-reading the events.
    heads = materialize(
        recent.select(tok("headline").alias("tok"), "event_id", "created_at").filter(F.size("tok") > 0)
        .groupBy("tok").agg(F.max(recency).alias("r"), F.max_by("event_id", recency).alias("rank")), "heads")
    left = materialize(open_clusters.select(F.col("leader_id").alias("rank"), tok("title").alias("tok"))
                       .filter(F.size("tok") > 0), "open")
    left_sets = left.groupBy("tok").agg(F.min("rank").alias("rank"))
    freq = token_frequency(heads.select("tok").unionByName(left_sets.select("tok")))
    pairs = cross_pairs(order_tokens(left_sets, freq), order_tokens(heads.select("rank", "tok"), freq),
                        cfg.title_jaccard)
    best = (
        pairs.join(heads.select(F.col("rank").alias("b"), "r"), "b")
        .groupBy("a").agg(F.max(F.struct("jaccard", "r", "b")).alias("m"))
    )
    by_title = (
        left.join(left_sets.select("tok", F.col("rank").alias("a")), "tok").join(best, "a")
        .select(F.col("rank").alias("leader_id"), F.col("m.b").alias("event_id"), F.lit("title").alias("match"),
                F.col("m.jaccard").alias("jaccard"))
    )
    found = exact.unionByName(by_title)
    if "embedding" not in clusters.columns or "embedding" not in events.columns:
        return found
    found = materialize(found, "matched")
    still = open_clusters.join(found.select("leader_id"), "leader_id", "left_anti")
    near = cosine_join(still.select(F.col("leader_id").alias("id"), F.col("embedding").alias("v")),
                       recent.select(F.col("event_id").alias("id"), F.col("embedding").alias("v")), cfg.event_vector, cfg)
    return found.unionByName(near.select(F.col("left_id").alias("leader_id"), F.col("right_id").alias("event_id"), F.lit("vector").alias("match"), F.col("score").alias("jaccard")))


def new_event_id(url: Column, as_of) -> Column:
    return F.sha2(F.concat_ws("|", url, F.date_format(ts(as_of), "yyyy-MM-dd")), 256)


def create_events(clusters: DataFrame, as_of) -> DataFrame:
    """Clusters without a match become events. Input: roll-up columns plus the canonical
    article's title, description, url and domain."""
    p = S.priority_record(as_of, F.col("earliest_published"), F.col("source_domains"), F.col("source_count"))
    return clusters.withColumn("p", p).select(
        new_event_id(F.col("url"), as_of).alias("event_id"),
        "leader_id",
        F.col("title").alias("headline"),
        F.when(F.col("description") != "", F.col("description")).alias("summary"),
        F.lit("General AI").alias("category"),
        "p.priority_score", "p.freshness_score", "p.trust_score", "p.impact_score", "p.is_breaking",
        "source_domains", "source_count",
        F.col("source_domain").alias("primary_source_domain"),
        F.col("url").alias("primary_source_url"),
        F.col("earliest_published").alias("published_at"),
        ts(as_of).alias("first_seen_at"),
    )


def merge_same_url(clusters: DataFrame) -> DataFrame:
    """Clusters whose canonical articles share a url become one: the first in story order leads,
    domains are united. ``clusters`` carries ``canonical_at``, the leader's own date."""
    order = F.struct((~F.col("is_official")).alias("x"), F.coalesce(-F.unix_micros("canonical_at"), F.lit(0)).alias("y"), "leader_id")
    rest = [c for c in clusters.columns if c not in ("url", "source_domains", "source_count")]
    first = clusters.groupBy("url").agg(F.min_by(F.struct(*rest), order).alias("r")).select("url", "r.*")
    domains = (
        clusters.select("url", F.explode("source_domains").alias("d")).distinct()
        .groupBy("url").agg(F.array_sort(F.collect_list("d")).alias("source_domains"))
    )
    return first.join(domains, "url").withColumn("source_count", F.size("source_domains"))


_AUTHORITATIVE = ["openai", "anthropic", "deepmind"]


def update_events(events: DataFrame, matched: DataFrame, as_of) -> DataFrame:
    """``matched``: clusters with ``event_id``. Several clusters may hit one event: domains are
    united, and among official clusters the first leader takes the headline over."""
    domains = (
        matched.select("event_id", F.explode("source_domains").alias("d")).distinct()
        .groupBy("event_id").agg(F.collect_list("d").alias("new_domains"))
    )
    takeover = matched.filter("is_official").groupBy("event_id").agg(
        F.min_by(F.struct("title", "source_domain", "url"), "leader_id").alias("official"))
    merged = F.array_sort(F.array_union(F.coalesce("source_domains", F.array().cast("array<string>")), "new_domains"))
    strong = F.lit(False)
    for word in _AUTHORITATIVE:
        strong = strong | F.contains(F.coalesce("primary_source_domain", F.lit("")), F.lit(word))
    replace = F.col("official").isNotNull() & ~strong
    rec = S.priority_record(as_of, F.col("published_at"), F.col("merged"), F.size("merged"),
                            event_type=F.col("event_type"), companies=F.col("companies"), funding=F.col("funding_amount"))
    pick = lambda new, old: F.when(replace, new).otherwise(F.col(old)).alias(old)
    return (
        events.join(domains, "event_id").join(takeover, "event_id", "left")
        .withColumn("merged", merged).withColumn("p", rec)
        .select(
            "event_id",
            pick(F.col("official.title"), "headline"),
            pick(F.col("official.source_domain"), "primary_source_domain"),
            pick(F.col("official.url"), "primary_source_url"),
            F.col("merged").alias("source_domains"), F.size("merged").alias("source_count"),
            "p.priority_score", "p.freshness_score", "p.trust_score", "p.is_breaking",
            ts(as_of).alias("last_updated_at"),
        )
    )


def link_articles(assignment: DataFrame, matched: DataFrame, created: DataFrame) -> DataFrame:
    """Article -> event with the event's priority. ``matched`` and ``created`` carry
    ``(leader_id, event_id, priority_score)``."""
    cols = ["leader_id", F.col("event_id").cast("string").alias("event_id"), "priority_score"]
    target = matched.select(*cols).unionByName(created.select(*cols))
    return assignment.select("article_id", "leader_id").join(target, "leader_id")


def batch_counts(clusters: DataFrame, matched: DataFrame) -> DataFrame:
    hit = matched.select("leader_id").distinct().withColumn("hit", F.lit(True))
    return clusters.join(hit, "leader_id", "left").agg(
        F.count_if(F.col("hit").isNull()).alias("events_created"),
        F.count_if(F.col("hit")).alias("events_updated"))
