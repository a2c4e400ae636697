"""Platform counts, per-source counts, run metrics and request limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from storyflow.functions.dates import start_of_day, ts
from storyflow.session import materialize


def platform_stats(articles: DataFrame, users: DataFrame, briefs: DataFrame, sources: DataFrame, as_of) -> DataFrame:
    """One conditional aggregate per table; the four one-row results are put side by side."""
    today = F.col("created_at").between(start_of_day(as_of), ts(as_of))
    a = articles.agg(
        F.count("*").alias("total_articles"), F.count_if(today).alias("articles_today"),
        F.count_if("is_verified").alias("verified_articles"), F.count_if("is_duplicate").alias("duplicate_articles"),
        F.count_if("ai_processed").alias("ai_processed"))
    u = users.agg(F.count("*").alias("total_users"), F.count_if("is_active").alias("active_users"))
    b = briefs.agg(F.count_if("notification_sent").alias("total_briefs_sent"))
    s = sources.agg(F.count_if("is_active").alias("sources_active"),
                    F.count_if(F.col("consecutive_failures") >= 5).alias("sources_failed"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(a).join(one(u), "_k").join(one(b), "_k").join(one(s), "_k").drop("_k")


def articles_per_source(articles: DataFrame, analyses: DataFrame) -> DataFrame:
    joined = articles.select("article_id", "source_name").join(analyses.select("article_id", "category"), "article_id", "left")
    return joined.rollup("category", "source_name").agg(
        F.count("*").alias("articles"), F.grouping_id().cast("int").alias("level"))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with metrics that are taken while it runs."""
    obs = Observation(name)
    return df.observe(obs, *[c.cast("long").alias(k) for k, c in metrics.items()]), obs


def ingest_run(checked: DataFrame, verify: Callable[[DataFrame], DataFrame], dedup: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Run the stages of one ingest and count their rows on the way: the deduplicated rows, and one row per
    stage (fetched, accepted, verified, duplicates, saved). Each stage runs once; its counts come with that run."""
    reason = F.col("reason")
    first, fetched = observed(checked, "fetched", fetched=F.count(F.lit(1)), accepted=F.count_if(reason == "accepted"))
    second, trusted = observed(verify(first.filter(reason == "accepted")), "verified", verified=F.count_if("is_verified"))
    kept = materialize(second, "verified")
    third, judged = observed(dedup(kept.filter("is_verified")), "dedup", duplicates=F.count_if("is_duplicate"), saved=F.count_if(~F.col("is_duplicate")))
    out = materialize(third, "deduplicated")
    counts = fetched.get | trusted.get | judged.get
    return out, checked.sparkSession.createDataFrame(list(counts.items()), "stage string, rows long")


def request_counts(requests: DataFrame, limit_authenticated: int = 100, limit_anonymous: int = 20,
                   seconds: int = 60) -> DataFrame:
    """Requests per identity and tumbling window with the limit that applies. Works on a batch or,
    behind a watermark, on a stream."""
    limit = F.when(F.col("authenticated"), limit_authenticated).otherwise(limit_anonymous)
    return (
        requests.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "identity", "authenticated")
        .agg(F.count("*").alias("requests"))
        .select(F.col("w.start").alias("window_start"), "identity", "requests", limit.alias("request_limit"))
        .withColumn("over_limit", F.col("requests") > F.col("request_limit"))
    )


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Reader sessions of a batch: events less than the gap apart belong together.

    Events first shrink to one row per user and gap-wide bucket (inside a bucket nothing can
    split), combined before the shuffle. What is ordered per user is then bounded by the
    time range over the gap, however many events one user has."""
    gap = gap_minutes * 60_000_000
    t = F.unix_micros("ts")
    buckets = events.groupBy("user_id", F.floor(t / F.lit(gap)).alias("b")).agg(
        F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy("b")
    fresh = F.coalesce((F.col("first") - F.lag("last").over(w) > gap).cast("int"), F.lit(1))
    return (
        buckets.withColumn("fresh", fresh).withColumn("sid", F.sum("fresh").over(w))
        .groupBy("user_id", "sid").agg(F.min("first").alias("a"), F.max("last").alias("z"), F.sum("n").alias("events"))
        .select("user_id", F.timestamp_micros("a").alias("session_start"),
                F.timestamp_micros(F.col("z") + gap).alias("session_end"), "events")
    )
