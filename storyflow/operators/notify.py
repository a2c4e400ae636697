"""Notification data sets: alert candidates, texts, affected users, daily sends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.config import DEFAULT, EngineConfig
from storyflow.functions.dates import ts
from storyflow.session import bounded, materialize


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def alert_candidates(events: DataFrame, threshold: float = DEFAULT.interrupt_priority,
                     limit: int | None = DEFAULT.alert_cap) -> DataFrame:
    """Unsent events that interrupt, best first; a run alerts at most ``limit``. The test comes before
    the limit, so events that never interrupt cannot hold back others."""
    out = events.filter(is_interrupt(F.col("priority_score"), F.col("event_type"), threshold) & ~F.col("notification_sent"))
    return out if limit is None else out.orderBy(F.desc("priority_score"), "event_id").limit(limit)


def is_interrupt(priority: Column, event_type: Column, threshold: float = DEFAULT.interrupt_priority) -> Column:
    return (priority >= threshold) & (
        (priority >= 95) | F.coalesce(event_type.isin(K.INTERRUPT_TYPES), F.lit(False)))


def alert_title(events_priority: Column, event_type: Column, companies: Column, amount: Column) -> Column:
    et = F.coalesce(event_type, F.lit(""))
    company = F.coalesce(F.try_element_at(companies, F.lit(1)), F.lit("AI"))
    money = F.when(amount.isNotNull() & (amount != 0),
                   F.concat(F.lit(" $"), F.rint(amount).cast("long").cast("string"), F.lit("M"))).otherwise("")
    emoji = F.coalesce(F.try_element_at(_map(K.ALERT_EMOJI), et), F.lit(K.DEFAULT_EMOJI))
    return (
        F.when(events_priority >= 95, "🚨 Breaking AI News")
        .when(et == "model_release", F.concat(F.lit("🤖 New "), company, F.lit(" Model")))
        .when(et == "funding", F.concat(F.lit("💰 AI Funding"), money))
        .otherwise(F.coalesce(F.try_element_at(_map(K.ALERT_PREFIX), et), F.concat(emoji, F.lit(" AI News"))))
    )


def alert_body(headline: Column, summary: Column) -> Column:
    long = F.length(F.coalesce(summary, F.lit(""))) > 20
    return F.when(long, F.concat(F.substring(headline, 1, 120), F.lit(". "), F.substring(summary, 1, 100))).otherwise(
        F.substring(headline, 1, 200))


def alert_messages(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        alert_title(F.col("priority_score"), F.col("event_type"), F.col("companies"), F.col("funding_amount")).alias("title"),
        alert_body(F.col("headline"), F.col("summary")).alias("body"),
        F.coalesce("event_type", F.lit("news")).alias("event_type"),
        F.floor("priority_score").cast("int").alias("priority"), "category",
        F.coalesce("primary_source_url", F.lit("")).alias("url"),
    )


def _lower(c: str) -> Column:
    return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lower)


def preference_terms(preferences: DataFrame) -> DataFrame:
    return preferences.select("user_id", F.explode(F.array_distinct(F.concat(
        _lower("favorite_categories"), _lower("favorite_topics"), _lower("favorite_companies")))).alias("term"))


def event_terms(events: DataFrame) -> DataFrame:
    scalar = F.array(F.lower(F.coalesce("category", F.lit(""))), F.lower(F.coalesce("event_type", F.lit(""))))
    return events.select("event_id", F.explode(F.array_distinct(F.concat(
        scalar, _lower("tags"), _lower("companies"), _lower("models_mentioned")))).alias("term"))


def affected_users(events: DataFrame, users: DataFrame, preferences: DataFrame,
                   max_alerts: int = DEFAULT.alert_cap) -> DataFrame:
    """``(event_id, user_id, why)``. A term join finds interested users. Users without
    preference terms, and everybody for priority 95 and above, take every alert: those rows are
    the audience itself. One run alerts at most ``max_alerts`` events (checked), so the list
    travels with each user as a short array."""
    events = bounded(materialize(events, "alerts"), max_alerts, "the alert list")
    active = users.filter("is_active").select("user_id")
    terms = preference_terms(preferences)
    by_term = (
        event_terms(events.filter(F.col("priority_score") < 95)).join(terms, "term")
        .select("event_id", "user_id").distinct().join(active, "user_id", "left_semi")
        .withColumn("why", F.lit("term"))
    )
    lists = events.agg(
        F.array_sort(F.collect_list("event_id")).alias("all_ids"),
        F.array_sort(F.collect_list(F.when(F.col("priority_score") >= 95, F.col("event_id")))).alias("major_ids"),
    ).withColumn("_k", F.lit(1))
    has_terms = terms.select("user_id").distinct().withColumn("has_terms", F.lit(True))
    everyone = (
        active.join(has_terms, "user_id", "left").withColumn("_k", F.lit(1)).join(F.broadcast(lists), "_k")
        .select("user_id", F.explode(F.when(F.col("has_terms"), F.col("major_ids")).otherwise(F.col("all_ids"))).alias("event_id"),
                F.when(F.col("has_terms"), "major").otherwise("no_preferences").alias("why"))
    )
    return by_term.select("event_id", "user_id", "why").unionByName(everyone.select("event_id", "user_id", "why"))


def daily_sends(users: DataFrame, briefs: DataFrame, day: str, as_of) -> DataFrame:
    """Active users with a token whose brief of the day is unsent -> notification rows."""
    due = briefs.filter((F.col("brief_date") == F.lit(day).cast("date")) & ~F.col("notification_sent"))
    return (
        users.filter(F.col("is_active") & F.col("push_token").isNotNull()).join(due, "user_id")
        .select("user_id", "push_token", F.lit(K.BRIEF_ALERT_TITLE).alias("title"),
                F.concat(F.lit("Today's top "), F.col("total_articles").cast("string"),
                         F.lit(" AI stories — personalized for you.")).alias("body"),
                F.lit("daily_brief").alias("notification_type"), "brief_id", ts(as_of).alias("sent_at"))
    )


def in_quiet_hours(hour: Column, start: int = 22, end: int = 7) -> Column:
    """Wraps around midnight when the start lies after the end."""
    inside = (hour >= start) & (hour < end) if start <= end else (hour >= start) | (hour < end)
    return inside


def due_now(as_of, preferred_hour: Column, start: int = 22, end: int = 7) -> Column:
    hour = F.hour(ts(as_of))
    return ~in_quiet_hours(hour, start, end) & (hour >= preferred_hour)
