"""Acceptance rules, trust scoring and source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.config import DEFAULT, EngineConfig
from storyflow.functions.dates import raw_age_hours
from storyflow.functions.scores import is_trusted_domain, trust_result
from storyflow.functions.text import contains_any, contains_any_word
from storyflow.operators.feeds import on_text


def is_relevant(text: Column, domain: Column, official: Column, whole_word: bool = False) -> Column:
    """``text`` is the lower-cased title and description."""
    match = contains_any_word if whole_word else contains_any
    return official | F.lower(domain).isin(K.OFFICIAL_DOMAINS) | match(text, K.RELEVANCE_KEYWORDS)


def has_content(title: Column) -> Column:
    return F.length(F.trim(F.coalesce(title, F.lit("")))) >= 15


def acceptance_reason(as_of, published: Column, cfg: EngineConfig = DEFAULT, strict_future: bool = True) -> Column:
    """``accepted``/``no_date_assumed_recent`` or the reason for refusal. Articles dated in the
    future beyond the tolerance are refused; ``strict_future=False`` lets them pass."""
    age = raw_age_hours(as_of, published)
    reason = F.when(published.isNull(), "no_date_assumed_recent")
    if strict_future:
        reason = reason.when(age < -cfg.future_tolerance_hours, F.concat(
            F.lit("future_dated_"), F.format_string("%.1f", age), F.lit("h_ahead")))
    return reason.when(
        age > cfg.max_age_hours, F.concat(F.lit("too_old_"), F.rint(age).cast("long").cast("string"), F.lit("h"))
    ).otherwise("accepted")


def is_accepted(reason: Column) -> Column:
    return reason.isin("accepted", "no_date_assumed_recent")


def first_failure(as_of, text: Column, cfg: EngineConfig = DEFAULT, strict_future: bool = True) -> Column:
    """First failing rule of relevance, content, freshness; ``accepted`` when none fails."""
    fresh = acceptance_reason(as_of, F.col("published_at"), cfg, strict_future)
    return (
        F.when(~is_relevant(text, F.col("source_domain"), F.col("is_official")), "not_ai_relevant")
        .when(~has_content(F.col("title")), "insufficient_content")
        .when(~is_accepted(fresh), fresh).otherwise("accepted")
    )


def validated(articles: DataFrame, as_of, cfg: EngineConfig = DEFAULT, strict_future: bool = True) -> DataFrame:
    return articles.withColumn("reason", on_text(lambda text: first_failure(as_of, text, cfg, strict_future)))


def rejection_breakdown(checked: DataFrame) -> DataFrame:
    """Counts per reason, with the hour figures folded away."""
    kind = F.regexp_replace("reason", r"_-?[0-9.]+h(_ahead)?$", "")
    return checked.groupBy(kind.alias("reason")).agg(F.count("*").alias("articles"))


def corroboration(stories: DataFrame) -> DataFrame:
    """``(article_id, story_id, source_domain)`` -> trusted domain count per story, at least 1.

    Two-level distinct: a hot story first spreads over its domains, and only trusted
    domains (a fixed list) survive, so the last step sees a handful of rows per story."""
    per_domain = (stories.filter(is_trusted_domain(F.col("source_domain")))
                  .groupBy("story_id", F.lower("source_domain").alias("d")).agg(F.lit(1).alias("x")))
    return per_domain.groupBy("story_id").agg(F.count("*").alias("corroboration"))


def with_corroboration(articles: DataFrame, stories: DataFrame) -> DataFrame:
    counts = corroboration(stories)
    assigned = stories.select("article_id", "story_id").join(counts, "story_id", "left")
    return articles.join(assigned, "article_id", "left").withColumn(
        "corroboration", F.greatest(F.lit(1), F.coalesce(F.col("corroboration"), F.lit(1))))


def with_trust(df: DataFrame, as_of, corroboration_col: Column = None) -> DataFrame:
    corr = F.lit(1) if corroboration_col is None else corroboration_col
    t = trust_result(as_of, F.col("source_domain"), F.col("is_official"), F.col("published_at"), corr)
    return df.withColumn("_t", t).select("*", "_t.*").drop("_t")


def verify_batch(articles: DataFrame, as_of, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Validation, story grouping, corroboration and trust for one batch; every accepted
    article comes back with its ``is_verified`` flag."""
    from storyflow.operators.cluster import group_stories
    from storyflow.session import materialize

    good = materialize(validated(articles, as_of, cfg).filter(F.col("reason") == "accepted"), "accepted")
    stories = group_stories(good, cfg)
    stories = stories.join(good.select("article_id", "source_domain"), "article_id")
    return with_trust(with_corroboration(good, stories), as_of, F.col("corroboration"))


def source_health(attempts: DataFrame, limit: int = 5) -> DataFrame:
    """Attempt log ``(source, ts, attempt_id, ok)`` -> failures since the last success,
    last success, and whether the source stays active.

    The streak needs no per-source sort: it is the number of failures after the latest
    success, so two partial aggregations replace an ordered window over a hot source."""
    key = F.struct("ts", "attempt_id")
    last_ok = attempts.groupBy("source").agg(F.max(F.when(F.col("ok"), key)).alias("last_ok"))
    joined = attempts.join(last_ok, "source")
    return (
        joined.groupBy("source").agg(
            F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (key > F.col("last_ok")))).alias("consecutive_failures"),
            F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_successful_fetch_at"),
            F.count("*").alias("attempts"),
        )
        .withColumn("is_active", F.col("consecutive_failures") < limit)
    )
