"""Reader profiles and personalised scores.

Profiles are sparse ``(user, term, weight)`` rows and meet articles on the term. Articles without
a common term have one default score for all readers, which is kept once; users x articles is never built."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.config import DEFAULT, EngineConfig
from storyflow.functions.dates import exponential_freshness, start_of_day, ts
from storyflow.functions.text import hash_bucket, normalize_term, py_round
from storyflow.operators.pairs import by_reader, scored_sums, tag_sums, whole
from storyflow.session import materialize

_SCALARS = ["category", "subcategory", "event_type"]
_ARRAYS = ["tags", "keywords", "companies", "products_mentioned", "technologies_mentioned",
           "models_mentioned", "programming_languages"]


def strings() -> Column:
    return F.array().cast("array<string>")


def _field(df: DataFrame, name: str, array: bool = False) -> Column:
    if name not in df.columns:
        return strings() if array else F.lit(None).cast("string")
    return F.coalesce(F.col(name), strings()) if array else F.col(name)


def with_tags(df: DataFrame) -> DataFrame:
    """``df`` = articles left-joined to analyses. Adds ``tag_set`` and ``primary_tag``."""
    raw = F.concat(
        F.array(*[_field(df, c) for c in _SCALARS], _field(df, "source_domain")),
        *[_field(df, c, True) for c in _ARRAYS])
    tags = F.array_distinct(F.filter(F.transform(raw, normalize_term), lambda t: t != ""))
    category = F.col("category")
    primary = (
        F.when(category.isNotNull() & (category != ""), normalize_term(category))
        .otherwise(F.coalesce(F.array_min("tag_set"), F.lit("general ai")))
    )
    return df.withColumn("tag_set", tags).withColumn("primary_tag", primary)


def explicit_affinity(preferences: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Weights of stated interests: ``(user_id, term, weight)``."""
    w = K.AFFINITY_WEIGHTS
    expansions = F.create_map(*[
        x for k, v in K.TOPIC_EXPANSIONS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])

    def rows(c: str, weight: float) -> Column:
        return F.transform(F.coalesce(F.col(c), strings()),
                           lambda t: F.struct(normalize_term(t).alias("term"), F.lit(weight).alias("weight")))

    expanded = F.flatten(F.transform(
        F.coalesce("favorite_topics", strings()),
        lambda t: F.transform(
            F.coalesce(F.try_element_at(expansions, normalize_term(t)), strings()),
            lambda e: F.struct(e.alias("term"), F.lit(w["topic"] * K.EXPANSION_FACTOR).alias("weight")))))
    out = preferences.select("user_id", F.explode(F.concat(
        rows("favorite_categories", w["category"]), rows("favorite_companies", w["company"]),
        rows("favorite_topics", w["topic"]), expanded)).alias("r")).select("user_id", "r.*")
    if profiles is not None:
        out = out.unionByName(profiles.select("user_id", F.explode("profile_terms").alias("t")).select(
            "user_id", normalize_term(F.col("t")).alias("term"), F.lit(w["profile"]).alias("weight")))
    return out.filter(F.col("term") != "").groupBy("user_id", "term").agg(F.sum("weight").alias("weight"))


def bookmark_affinity(bookmarks: DataFrame, tagged: DataFrame, as_of, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Decayed bookmark weight per tag; every bookmark of the retention period counts.

    A bookmark goes to its reader once, with its tags in one array; all later sums are by reader, where the rows already lie."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(ts(as_of)) - F.unix_micros("created_at")) / F.lit(86_400e6))
    recent = bookmarks.select("user_id", "article_id", age.alias("age")).filter(F.col("age") <= cfg.telemetry_days)
    decay = F.pow(F.lit(0.5), F.col("age") / cfg.half_life_days) * K.AFFINITY_WEIGHTS["bookmark"]
    return (
        recent.join(tagged.select("article_id", "tag_set"), "article_id")
        .select("user_id", decay.alias("weight"), "tag_set").transform(by_reader)
        .select("user_id", "weight", F.explode("tag_set").alias("term"))
        .groupBy("user_id", "term").agg(F.sum("weight").alias("weight"))
    )


def affinity_vectors(*parts: DataFrame) -> DataFrame:
    # Parts that lie by reader are united and summed where they lie. Spark sees that if the first is the one whose readers may be null, bookmarks.
    out = parts[-1]
    for p in parts[-2::-1]:
        out = out.unionByName(p)
    return out.groupBy("user_id", "term").agg(F.sum("weight").alias("weight"))


def brief_pool(articles: DataFrame, analyses: DataFrame, as_of, cfg: EngineConfig = DEFAULT,
               limit: int | None = None) -> DataFrame:
    """Today's verified, processed, unique, trusted articles: all of them, or the best ``limit``."""
    today = articles.filter(
        F.col("is_verified") & F.col("ai_processed") & ~F.col("is_duplicate")
        & (F.col("trust_score") >= cfg.min_trust) & F.col("created_at").between(start_of_day(as_of), ts(as_of)))
    pool = today.join(analyses, "article_id", "left")
    return pool if limit is None else pool.orderBy(F.desc("priority_score"), F.desc("final_score"), "article_id").limit(limit)


def with_quality(df: DataFrame, as_of) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    trend = F.greatest(zero("priority_score"), zero("final_score"))
    recency = F.when(F.col("published_at").isNull(), 0.5).otherwise(exponential_freshness(as_of, F.col("published_at")))
    return df.withColumn("base_trend", trend).withColumn(
        "quality_raw", F.col("base_trend") * F.lit(0.52) + zero("trust_score") * F.lit(0.20)
        + zero("importance_score") * F.lit(0.18) + recency * 100.0 * F.lit(0.10))


def pool_affinity(vectors: DataFrame, pool: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``(user_id, article_id, affinity)`` of pairs with a common term (see operators/pairs.py)."""
    return tag_sums(vectors, pool, cfg.pair_block_mb).select("user_id", "article_id", _affinity())


def _affinity() -> Column:
    return py_round(1.0 - F.exp(-F.col("s") / 4.0), 4).alias("affinity")


def blocked_hits(topics: DataFrame, pool: DataFrame) -> DataFrame:
    """``(term, article_id)`` where a topic (distinct ``term``) equals a tag or occurs in the title.

    Topics meet titles on their first letters (three at most), by ids alone; titles are read again where they meet. Neither side is sent
    whole: Spark knows a pool's size but not that of its letters and tags, so the joins with these are merges."""
    title = normalize_term(F.col("title"))
    grams = lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - (g - 1), F.lit(1))), lambda i: F.substring(F.col("t"), i, F.lit(g)))
    heads = topics.withColumn("head", F.substring("term", 1, 3))
    # A character is looked for from the start of its string, so titles come in pieces.
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length("t") - 1, F.lit(0)), F.lit(256)), lambda at: F.substring(F.col("t"), at + 1, F.lit(258)))
    shown = pool.select("article_id", title.alias("t")).select("article_id", F.explode(pieces).alias("t")).select("article_id", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[grams(g) for g in (1, 2, 3)]))).alias("head"))
    maybe = heads.join(shown.hint("merge"), "head").select("term", F.col("article_id").alias("_id")).distinct()
    inside = maybe.hint("merge").join(pool.select("article_id", title.alias("t")), F.col("article_id").eqNullSafe(F.col("_id"))).filter(F.contains(F.col("t"), F.col("term"))).select("term", "article_id")
    tagged = topics.join(pool.select("article_id", F.explode("tag_set").alias("term")).hint("merge"), "term").select("term", "article_id")
    return inside.unionByName(tagged).distinct()


def _topic_sets(preferences: DataFrame) -> DataFrame:
    """``(user_id, topics)``: the blocked topics of each user that has any, as a sorted array. Topics of several rows of a user are united."""
    return (preferences.select("user_id", F.explode("blocked_topics").alias("b")).select("user_id", normalize_term(F.col("b")).alias("term"))
            .groupBy("user_id").agg(F.array_sort(F.collect_set("term")).alias("topics")))


def _hits_of_sets(wants: DataFrame, pool: DataFrame) -> DataFrame:
    """Distinct ``(topics, article_id)`` of the distinct sets of topics."""
    sets = wants.select("topics").distinct().select("topics", F.explode("topics").alias("term"))
    return sets.join(blocked_hits(sets.select("term").distinct(), pool), "term").select("topics", "article_id").distinct()


def blocked_pairs(preferences: DataFrame, pool: DataFrame, share: int = 1 << 20) -> DataFrame:
    """``(user_id, article_id)`` where a blocked topic equals a tag or occurs in the title.

    Users with the same topics share one list of articles, so pairs are distinct as they are made and never shuffled. The users of a
    set of topics are dealt over parts with about ``share`` pairs each."""
    wants = materialize(_topic_sets(preferences), "topics")
    hits = materialize(_hits_of_sets(wants, pool), "blocked")
    parts = hits.groupBy("topics").agg(F.count("*").alias("h")).join(wants.groupBy("topics").agg(F.count("*").alias("u")), "topics").select(
        "topics", F.least(F.col("u"), F.floor(F.col("h") * F.col("u") / share) + 1).cast("int").alias("parts"))
    parts = materialize(parts, "parts")
    dealt = wants.join(parts, "topics").select("user_id", "topics", F.pmod(F.xxhash64("user_id"), F.col("parts")).cast("int").alias("part"))
    lists = hits.join(parts, "topics").select("topics", "article_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(lists, ["topics", "part"]).select("user_id", "article_id")


def blocked_counts(preferences: DataFrame, pool: DataFrame) -> DataFrame:
    """``(user_id, lost)``: how many articles ``blocked_pairs`` has per user. Users with the same topics share one count, so pairs are never built."""
    wants = _topic_sets(preferences)
    counts = _hits_of_sets(wants, pool).groupBy("topics").agg(F.count("*").alias("lost"))
    return wants.join(counts, "topics").select("user_id", "lost")


def score_columns(cfg: EngineConfig = DEFAULT) -> dict[str, Column]:
    a, q, t = F.col("affinity"), F.col("quality_raw"), F.col("base_trend")
    raw = q * (F.lit(0.70) + F.lit(0.30) * a) + F.lit(12.0) * a
    major = t >= cfg.major_trend
    raw = F.when(major, F.greatest(raw, t * F.lit(0.72))).otherwise(raw)
    return {
        "personalized_score": py_round(F.least(F.lit(100.0), raw), 2),
        "quality_score": py_round(F.least(F.lit(100.0), q), 2),
        "base_trend_score": py_round(t, 2),
        "reason": F.when(a == 0, "quality threshold").when(major, "global trend override").otherwise("profile affinity"),
    }


def default_scores(pool: DataFrame, as_of, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Scores of the pool's articles for a reader without a common term; ``user_id`` is added by the caller."""
    return with_quality(pool, as_of).withColumn("affinity", F.lit(0.0)).withColumns(score_columns(cfg))


def score_pairs(users: DataFrame, pool: DataFrame, vectors: DataFrame, preferences: DataFrame, as_of,
                cfg: EngineConfig = DEFAULT, tags: bool = False) -> DataFrame:
    """Scores of unblocked articles for the users who share a term with them. ``pool`` carries tags; with ``tags`` the pairs have
    ``primary_tag`` and ``tag_set`` too, the latter as numbers."""
    topics = preferences.select("user_id", F.transform(F.coalesce("blocked_topics", strings()), normalize_term).alias("topics"))
    rated = with_quality(pool, as_of).withColumn("title", normalize_term(F.col("title")))
    pairs = scored_sums(vectors.join(users.select("user_id").hint("shuffle_hash"), "user_id", "left_semi"), rated, topics, cfg.pair_block_mb, tags)
    return pairs.withColumn("affinity", _affinity()).drop("s").filter("affinity > 0").withColumns(score_columns(cfg))


def eligible(scored: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return scored.filter((F.col("personalized_score") >= cfg.brief_quality)
                         | (F.col("base_trend_score") >= cfg.major_trend))


def brief_targets(users: DataFrame, pool: DataFrame, vectors: DataFrame, preferences: DataFrame, as_of,
                  cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per user: eligible count, brief size and how many picks one tag may take.

    Affinity only raises a score, so a user's count is that of the default scores, less blocked
    articles, plus those that only the own affinity lifts over the bar."""
    shared = eligible(default_scores(pool, as_of, cfg), cfg).select("article_id")
    lost = blocked_counts(preferences, pool.join(shared, "article_id", "left_semi"))
    # Scores are asked only where they decide: of articles that the default score leaves out.
    others = pool.join(shared, "article_id", "left_anti")
    won = eligible(score_pairs(users, others, vectors, preferences, as_of, cfg), cfg).groupBy("user_id").agg(F.count("*").alias("won"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n = F.col("eligible")
    target = F.when(n > cfg.brief_soft_max, F.least(n, F.lit(cfg.brief_hard_max))).otherwise(n)
    return (
        users.select("user_id").join(lost, "user_id", "left").join(won, "user_id", "left")
        .select("user_id", (F.lit(shared.count()) - zero("lost") + zero("won")).alias("eligible")).filter("eligible > 0")
        .withColumn("target", target)
        .withColumn("tag_quota", F.greatest(F.lit(1), F.ceil(F.col("target") * F.lit(cfg.brief_tag_share)).cast("int")))
    )


def diversity(picks: DataFrame) -> DataFrame:
    """Per user: tag entropy in bits, distinct tags, picks, surprise picks."""
    per_tag = picks.groupBy("user_id", "primary_tag").agg(
        F.count("*").alias("n"), F.count_if("is_serendipity").alias("s"))
    total = per_tag.groupBy("user_id").agg(
        F.sum("n").alias("selected_count"), F.count("*").alias("category_coverage"),
        F.sum("s").alias("serendipity_count"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    # -sum(p log2 p) = log2(N) - sum(n log2 n)/N
    entropy = F.log2("selected_count") - F.col("x") / F.col("selected_count")
    return total.select("user_id", "selected_count", "category_coverage", "serendipity_count",
                        (py_round(entropy, 3) + 0.0).alias("tag_entropy"))


def seed_topics(job_title: Column, tech_stack: Column, onboarding: Column) -> Column:
    """Sign-up interests in given order without repeats."""
    return F.array_distinct(F.filter(
        F.concat(F.array(job_title), F.coalesce(tech_stack, strings()), F.coalesce(onboarding, strings())),
        lambda t: t.isNotNull() & (t != "")))


def fallback_brief(articles: DataFrame, limit: int = 8) -> DataFrame:
    return (articles.filter(F.col("is_verified") & ~F.col("is_duplicate"))
            .orderBy(F.desc("final_score"), F.desc("priority_score"), F.desc("created_at"), "article_id").limit(limit))


def hydrate(briefs: DataFrame, articles: DataFrame) -> DataFrame:
    """Brief ids back to articles, position kept."""
    ids = briefs.select("user_id", F.posexplode("article_ids").alias("pos", "article_id"))
    return ids.join(articles, "article_id")


def suggestion_inputs(users: DataFrame, preferences: DataFrame, bookmarks: DataFrame, briefs: DataFrame,
                      articles: DataFrame, analyses: DataFrame, top: int = 15, marks: int = 10) -> DataFrame:
    """One row per user: profile, newest bookmark titles, brief titles, and the top articles."""
    news = (articles.filter(F.col("is_verified") & ~F.col("is_duplicate"))
            .orderBy(F.desc("final_score"), F.desc("created_at"), "article_id").limit(top)
            .join(analyses, "article_id", "left"))
    context = news.agg(F.transform(F.array_sort(F.collect_list(F.struct(
        -F.col("final_score"), -F.unix_micros("created_at"), "article_id", "title",
        F.coalesce("category", F.lit("General")).alias("category"), F.coalesce("companies", strings()).alias("companies"),
        F.coalesce("keywords", strings()).alias("keywords")))),
        lambda s: F.struct(s["title"].alias("title"), s["category"].alias("category"),
                           s["companies"].alias("companies"), s["keywords"].alias("keywords"))).alias("recent_news")
    ).withColumn("_k", F.lit(1))
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "article_id")
    titles = articles.select("article_id", "title")
    saved = (
        bookmarks.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= marks)
        .join(titles, "article_id").groupBy("user_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"]).alias("bookmarked"))
    )
    todays = hydrate(briefs, titles).groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda s: s["title"]).alias("brief_titles"))
    return (
        users.select("user_id").join(preferences, "user_id", "left").join(saved, "user_id", "left")
        .join(todays, "user_id", "left").withColumn("_k", F.lit(1)).join(F.broadcast(context), "_k").drop("_k")
    )


def suggestion_context(inputs: DataFrame) -> DataFrame:
    profile = F.struct("favorite_categories", "favorite_companies", "favorite_topics",
                       F.coalesce("bookmarked", strings()).alias("bookmarked_articles"),
                       F.coalesce("brief_titles", strings()).alias("today_brief_articles"))
    return inputs.select("user_id", F.to_json(F.struct(profile.alias("profile"), "recent_news")).alias("context"))


# -------------------------------------------------------------- mentor pick

#: Distinct blocked topics up to which a mentor's articles keep only keys that are among them.
_TOPICS = 1 << 20


def _asked_keys(entries: DataFrame, preferences: DataFrame) -> DataFrame:
    """``entries`` with those of their keys that somebody blocks; no other is ever looked at. Where too many topics are blocked for a task, all keys stay."""
    topics = preferences.select(F.explode("blocked_topics").alias("t")).select(F.xxhash64(F.lower("t")).alias("k")).distinct()
    few = topics.limit(_TOPICS + 1).toArrow().column("k").to_numpy()
    if len(few) > _TOPICS:
        return entries
    few = np.sort(few)

    def run(batches):
        for batch in batches:
            keys = batch.column("keys")
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(few, flat), max(len(few) - 1, 0))
            kept = few[at] == flat if len(few) else np.zeros(len(flat), bool)
            ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False)))
            offsets = np.append(0, np.cumsum(kept))[ends].astype(np.int32)
            columns = {n: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[kept], pa.int64())) if n == "keys" else batch.column(n) for n in batch.schema.names}
            yield pa.RecordBatch.from_pydict(columns)

    return entries.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema))


class _MentorPool:
    """Articles from the best base score down, as arrays: categories and companies by number, rows by key."""

    def __init__(self, table: pa.Table):
        coded = lambda column: pc.dictionary_encode(column)
        ends = lambda lists: np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))).astype(np.int64)
        self.ids, self.base = whole(table, "article_id"), whole(table, "base").to_numpy(zero_copy_only=False)
        category, companies, keys = coded(whole(table, "category")), whole(table, "companies"), whole(table, "keys")
        firms = coded(companies.flatten())
        self.category, self.categories = self._codes(category)
        self.firm, self.firms = self._codes(firms)
        self.first = ends(companies)
        flat, owner = keys.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(self.base), dtype=np.int32), np.diff(ends(keys)))
        order = np.argsort(flat, kind="stable")
        self.keys, self.rows = flat[order], owner[order]

    @staticmethod
    def _codes(column) -> tuple[np.ndarray, dict]:
        """Numbers from 1, 0 for null, and the numbers by name."""
        return pc.fill_null(pc.add(column.indices, 1), 0).to_numpy(zero_copy_only=False).astype(np.int32), {v: i for i, v in enumerate(column.dictionary.to_pylist(), 1)}

    @staticmethod
    def _marks(names: dict, wanted) -> np.ndarray:
        marks = np.zeros(len(names) + 1, bool)
        marks[[names[w] for w in wanted if w in names]] = True
        return marks

    def best(self, liked: set, firms: set, blocked: set, least: float):
        """The unblocked article with the best score, the smallest id among equal ones, if it reaches ``least``. Reads until no further one can win."""
        barred = np.zeros(len(self.base), bool)
        for key in blocked:
            barred[self.rows[np.searchsorted(self.keys, key, "left"):np.searchsorted(self.keys, key, "right")]] = True
        liked, firms = self._marks(self.categories, liked), self._marks(self.firms, firms)
        top, found, begin, step = least, [], 0, 256
        while begin < len(self.base) and self.base[begin] + 14.0 >= top:
            end = min(len(self.base), begin + step)
            score = self.base[begin:end] + np.where(liked[self.category[begin:end]], 8.0, 0.0)
            owner = np.repeat(np.arange(end - begin), np.diff(self.first[begin:end + 1]))
            score = score + np.where(np.bincount(owner, firms[self.firm[self.first[begin]:self.first[end]]], end - begin) > 0, 6.0, 0.0)
            score[barred[begin:end]] = -np.inf
            here = score.max()
            if here >= top:
                found = (found if here == top else []) + (begin + np.flatnonzero(score == here)).tolist()
                top = here
            begin, step = end, 2 * step
        return min((self.ids[i].as_py() for i in found), key=lambda a: (a is None, a)) if found else None, bool(found)


def _best_mentor_articles(users: DataFrame, preferences: DataFrame, entries: DataFrame, cfg: EngineConfig) -> DataFrame:
    """``(user_id, article_id)``: each user's best unblocked article, if any reaches the bar.

    Articles are read from the best base score down, until no further one can win even with both bonuses."""
    entries = _asked_keys(entries.select("article_id", "base", "category", "companies", "keys"), preferences)
    size = entries.agg(F.sum(60 + F.size("keys") * 8 + F.size("companies") * 40).alias("bytes")).first()["bytes"] or 0
    if size > cfg.pool_mb << 20:
        raise ValueError(f"the pool of one day takes {size >> 20} MB, more than pool_mb = {cfg.pool_mb}; give brief_pool a limit")
    pool = _MentorPool(entries.orderBy(F.desc("base"), "article_id").toArrow())

    def best(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                liked, firms, blocked = (set(x) - {None} for x in (row.favorite_categories, row.favorite_companies, row.blocked))
                article, any_ = pool.best(liked, firms, blocked, cfg.mentor_min)
                if any_:
                    out.append((row.user_id, article))
            yield pd.DataFrame(out, columns=["user_id", "article_id"])

    prefs = preferences.select(
        "user_id", *[F.coalesce(c, strings()).alias(c) for c in ("favorite_categories", "favorite_companies")],
        F.transform(F.coalesce("blocked_topics", strings()), lambda t: F.xxhash64(F.lower(t))).alias("blocked"))
    empty = F.array().cast("array<bigint>")
    readers = users.select("user_id").join(prefs, "user_id", "left").withColumns(
        {c: F.coalesce(c, strings()) for c in ("favorite_categories", "favorite_companies")} | {"blocked": F.coalesce("blocked", empty)})
    uid, aid = users.schema["user_id"].dataType.simpleString(), entries.schema["article_id"].dataType.simpleString()
    return readers.mapInPandas(best, f"user_id {uid}, article_id {aid}")


def mentor_picks(users: DataFrame, preferences: DataFrame, pool: DataFrame, day: str,
                 cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One grounded suggestion per user from the pool, or a fixed fallback."""
    low = lambda c: F.lower(F.trim(c))
    meta_scalars = ["title", "description", "source_domain", "summary", "category", "subcategory", "event_type", "why_it_matters"]
    meta_arrays = ["tags", "keywords", "companies", "products_mentioned", "technologies_mentioned", "models_mentioned"]
    metadata = F.array_distinct(F.filter(F.concat(
        F.array(*[low(_field(pool, c)) for c in meta_scalars]),
        *[F.transform(_field(pool, c, True), low) for c in meta_arrays]), lambda x: x.isNotNull() & (x != "")))
    first = lambda c: F.nullif(F.try_element_at(_field(pool, c, True), F.lit(1)), F.lit(""))
    tool = F.coalesce(first("products_mentioned"), first("technologies_mentioned"), first("models_mentioned"),
                      first("keywords"), F.lit("a small prototype"))
    summary = F.coalesce(_field(pool, "summary"), F.lit(""))
    reason = (
        F.when(summary != "", F.substring(summary, 1, 180))
        .when(first("tags").isNotNull(), F.concat(F.lit("the article is tagged "), first("tags")))
        .otherwise(F.substring("title", 1, 120))
    )
    actions = F.create_map(*[F.lit(x) for kv in K.MENTOR_ACTIONS.items() for x in kv])
    action = F.coalesce(F.try_element_at(actions, F.coalesce(_field(pool, "event_type"), F.lit(""))), F.lit(K.MENTOR_ACTION))
    entries = pool.select(
        "article_id", F.greatest(F.coalesce("final_score", F.lit(0.0)), F.coalesce("priority_score", F.lit(0.0))).alias("base"),
        _field(pool, "category").alias("category"), _field(pool, "companies", True).alias("companies"),
        metadata.alias("metadata"), F.transform(metadata, lambda x: F.xxhash64(x)).alias("keys"),
        F.coalesce(F.nullif(_field(pool, "category"), F.lit("")), F.lit("AI practice")).alias("topic"),
        tool.alias("tool"), reason.alias("reason"), action.alias("action"))
    picked = _best_mentor_articles(users, preferences, entries, cfg).join(
        entries.select("article_id", F.struct("article_id", "metadata", "topic", "tool", "reason", "action").alias("p")), "article_id")
    best = users.select("user_id").join(picked.select("user_id", "p"), "user_id", "left")
    r = F.lower("p.reason")
    grounded = F.exists("p.metadata", lambda m: F.contains(r, m) | F.contains(m, F.substring(r, 1, 60)))
    ok = F.coalesce(grounded, F.lit(False))
    uid = F.col("user_id").cast("string")
    n = len(K.MENTOR_BACKLOG)
    backlog = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("topic", "tool", "action"), item)])
                        for item in K.MENTOR_BACKLOG])
    spare = F.element_at(backlog, hash_bucket(F.concat(F.lit("fallback:"), uid, F.lit(f":{day}")), n) + 1)
    template = F.element_at(F.array(*[F.lit(t) for t in K.MENTOR_TEMPLATES]),
                            hash_bucket(F.concat(uid, F.lit(f":{day}")), len(K.MENTOR_TEMPLATES)) + 1)
    out = best.select(
        "user_id", F.when(ok, F.col("p.article_id")).alias("article_id"),
        *[F.when(ok, F.col(f"p.{c}")).otherwise(spare[c]).alias(c) for c in ("topic", "tool", "action")],
        F.when(ok, F.col("p.reason")).otherwise(K.MENTOR_FALLBACK_REASON).alias("reason"),
        (~ok).alias("fallback"), template.alias("message"))
    message = F.col("message")
    for c in ("topic", "tool", "reason", "action"):
        message = F.replace(message, F.lit("{" + c + "}"), F.col(c))
    return out.withColumn("message", message)
