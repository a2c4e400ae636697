"""Periodic updates of stored scores. Each returns changed rows only, ready for an upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyflow.config import DEFAULT, EngineConfig
from storyflow.functions.dates import hours_before, start_of_day, ts
from storyflow.functions.scores import event_freshness, final_score, freshness_analysis


def refresh_freshness(events: DataFrame, as_of, min_change: float = 0.5) -> DataFrame:
    """Events of the last 168 h whose freshness moved by more than ``min_change``."""
    new = event_freshness(as_of, F.col("published_at"))
    return (
        events.filter(F.col("published_at") >= hours_before(as_of, 168)).withColumn("_new", new)
        .filter(F.abs(F.col("_new") - F.col("freshness_score")) > min_change)
        .withColumn("freshness_score", F.col("_new")).drop("_new")
        .withColumn("is_breaking", freshness_analysis(as_of, F.col("published_at"), F.col("priority_score"))["is_breaking"])
    )


def clear_breaking(events: DataFrame, as_of, max_age_hours: float = 4.0) -> DataFrame:
    return events.filter(F.col("is_breaking") & (F.col("published_at") < hours_before(as_of, max_age_hours))).withColumn(
        "is_breaking", F.lit(False))


def rerank_today(articles: DataFrame, as_of) -> DataFrame:
    today = articles.filter(F.col("ai_processed") & F.col("is_verified") & ~F.col("is_duplicate")
                            & F.col("created_at").between(start_of_day(as_of), ts(as_of)))
    return today.withColumn("final_score", final_score(
        as_of, F.col("importance_score"), F.col("trust_score"), F.col("published_at"), F.col("is_official")))


def eligible_sorted(articles: DataFrame, limit: int | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Articles at or above the minimum score, best first."""
    out = articles.filter(F.col("final_score") >= cfg.min_final).orderBy(F.desc("final_score"), "article_id")
    return out if limit is None else out.limit(limit)
