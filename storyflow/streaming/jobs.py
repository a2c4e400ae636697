"""Streaming twins of the batch operators.

Every stateful step sits behind a watermark, and every sink is either append-only files
or a keyed upsert, so a retried batch leaves the same table."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from storyflow.config import DEFAULT, EngineConfig
from storyflow.functions.text import normalize_url
from storyflow.operators import cluster as CL
from storyflow.operators import stats as AG
from storyflow.operators import trends as TR
from storyflow.operators.notify import alert_messages, is_interrupt
from storyflow.session import materialize, scratch_path
from storyflow.sources.tables import read_since, upsert


def run_available(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> StreamingQuery:
    """Process everything that has landed, then stop."""
    q = (stream.writeStream.foreachBatch(each_batch).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# ---- DD-11

def dedup_stream(articles: DataFrame, horizon: str = "168 hours") -> DataFrame:
    """First article per normalised url; state older than the horizon is dropped. Undated rows
    use their arrival time."""
    return (
        articles.withColumn("event_time", F.coalesce("published_at", "created_at"))
        .withColumn("normalized_url", normalize_url(F.col("url")))
        .withWatermark("event_time", horizon).dropDuplicatesWithinWatermark(["normalized_url"])
    )


def write_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    q = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# ---- CL-09

EVENT_STATE = ["event_id", "headline", "summary", "category", "source_domains", "source_count", "priority_score",
               "freshness_score", "trust_score", "is_breaking", "primary_source_domain", "primary_source_url",
               "published_at", "created_at", "last_updated_at"]


def end_of_batch(batch: DataFrame) -> str | None:
    """The midnight at or after the batch's newest article."""
    newest = batch.agg(F.max("created_at")).first()[0]
    if newest is None:
        return None
    day = newest.replace(hour=0, minute=0, second=0, microsecond=0)
    return str(day if day == newest else day + timedelta(days=1))


def cluster_step(batch: DataFrame, state_path: str, as_of=None, cfg: EngineConfig = DEFAULT, log_path: str | None = None) -> dict[str, int]:
    """One incremental clustering step: group the batch, match events of the last 72 h, create and
    update. Event ids come from the canonical url, so a repeated batch repeats its ids.

    The events lie in a keyed table by the day they were first seen. Days behind the horizon have expired: the step neither
    lists nor opens them, so what a step reads is bounded by three days of events, however long the stream has run."""
    spark = batch.sparkSession
    if as_of is None and (as_of := end_of_batch(batch)) is None:
        return {"created": 0, "updated": 0, "state_rows": 0}
    assignment = CL.cluster_articles(batch, cfg)
    rolled = CL.roll_up(batch, assignment)
    canonical = batch.select(F.col("article_id").alias("leader_id"), "title", "description", "url", "source_domain", "is_official",
                             F.col("published_at").alias("canonical_at"))
    clusters = rolled.join(canonical, "leader_id")
    clusters = materialize(clusters, "clusters")
    first_day = (datetime.fromisoformat(str(as_of)) - timedelta(hours=cfg.event_window_hours)).date().isoformat()
    state = read_since(spark, state_path, first_day)
    events, state_rows = state if state is not None else (None, 0)
    if state_rows:
        matched = materialize(clusters.join(CL.match_events(clusters, events, as_of, cfg), "leader_id"), "matched")
        open_clusters = clusters.join(matched.select("leader_id"), "leader_id", "left_anti")
    else:
        matched = None
        open_clusters = clusters
    created = CL.create_events(CL.merge_same_url(open_clusters), as_of).withColumnsRenamed({"first_seen_at": "created_at"}).withColumn(
        "last_updated_at", F.col("created_at"))
    changed = created.select(*EVENT_STATE)
    if matched is not None:
        base = events.withColumns({"event_type": F.lit(None).cast("string"), "companies": F.array().cast("array<string>"),
                                   "funding_amount": F.lit(None).cast("double")})
        new = CL.update_events(base, matched, as_of)
        keep = [c for c in EVENT_STATE if c not in new.columns]
        changed = changed.unionByName(new.join(events.select("event_id", *keep), "event_id").select(*EVENT_STATE))
    done = upsert(changed.withColumn("day", F.to_date("created_at")), state_path, ["event_id"], partition_by="day") | {"state_rows": state_rows}
    if log_path is not None:
        row = spark.createDataFrame([(str(as_of), *(done[k] for k in ("state_rows", "created", "updated")))], "as_of string, state_rows long, created long, updated long")
        row.coalesce(1).write.mode("overwrite").parquet(f"{log_path}/{re.sub('[^0-9]', '', str(as_of))}")  # a repeated batch replaces its row
    return done


def cluster_stream(articles: DataFrame, state_path: str, checkpoint: str, as_of=None, cfg: EngineConfig = DEFAULT,
                   log_path: str | None = None) -> StreamingQuery:
    """``as_of``: the time of all batches (None: each batch ends with its newest article's day). ``log_path``: a folder that gets one row per batch."""
    return run_available(articles, lambda df, _id: cluster_step(df, state_path, as_of, cfg, log_path), checkpoint)


# ---- TR-13

def trend_stream(mentions: DataFrame, window: str = "24 hours", slide: str = "6 hours", late: str = "168 hours") -> DataFrame:
    """``(ts, entity)`` -> sliding counts; rows up to ``late`` behind are still counted."""
    return (
        mentions.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w"), "entity")
        .agg(F.count("*").alias("mention_count"))
        .select(F.col("w.start").alias("window_start"), "entity", "mention_count")
    )


def keep_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Update-mode counts kept as one row per key."""
    return run_available(stream, lambda df, _id: upsert(df, path, keys) and None, checkpoint, "update")


def with_velocity(counts: DataFrame, hours: int = 24) -> DataFrame:
    """Compare each window with the one that ended when it began."""
    prior = counts.select(
        F.timestamp_micros(F.unix_micros("window_start") + hours * 3_600_000_000).alias("window_start"), "entity",
        F.col("mention_count").alias("previous_mention_count"))
    return (
        counts.join(prior, ["window_start", "entity"], "left")
        .withColumn("previous_mention_count", F.coalesce("previous_mention_count", F.lit(0)))
        .withColumn("velocity", TR.velocity(F.col("mention_count"), F.col("previous_mention_count")))
    )


def velocity_step(changed: DataFrame, path: str, hours: int = 24) -> dict[str, int]:
    """Changed counts of one batch -> rows with velocity in the table at ``path``: those of the changed windows, and of stored windows that
    look back on one. Only the days around the changed windows are read. Counts are combined before they come here, so a
    hot entity is one row per window; a state keyed by entity would see each of its mentions in one task."""
    spark, key = changed.sparkSession, ["window_start", "entity"]
    changed = materialize(changed.select(*key, "mention_count"), "changed")
    span = changed.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b")).first()
    if span["a"] is None:
        return {"created": 0, "updated": 0}
    look = timedelta(hours=hours)
    stored = read_since(spark, path, (span["a"] - look).date().isoformat(), (span["b"] + look).date().isoformat())
    affected = changed.select(*key)
    now = changed
    if stored is not None:
        table = stored[0].select(*key, "mention_count")
        now = table.join(affected, key, "left_anti").unionByName(changed)
        later = affected.withColumn("window_start", F.timestamp_micros(F.unix_micros("window_start") + hours * 3_600_000_000))
        affected = affected.unionByName(table.select(*key).join(later, key, "left_semi")).distinct()
    rows = with_velocity(now, hours).join(affected, key, "left_semi")
    return upsert(rows.withColumn("day", F.to_date("window_start")), path, key, partition_by="day")


def velocity_stream(mentions: DataFrame, path: str, checkpoint: str, window: str = "24 hours", slide: str = "6 hours", late: str = "168 hours") -> StreamingQuery:
    """Sliding counts with velocity, kept up to date batch by batch in a keyed table."""
    return run_available(trend_stream(mentions, window, slide, late), lambda df, _id: velocity_step(df, path) and None, checkpoint, "update")


# ---- AG-04 and SS-01

def request_stream(requests: DataFrame, late: str = "5 minutes", **limits) -> DataFrame:
    return AG.request_counts(requests.withWatermark("ts", late), **limits)


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Append mode: a session leaves the state once the watermark has passed its end. Sessions of
    one task merge before the shuffle (see ``session.prepare``)."""
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("events"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
    )


# ---- NT-07

def alert_stream(events: DataFrame) -> DataFrame:
    """Stateless rules over a stream of scored events."""
    hot = events.filter(is_interrupt(F.col("priority_score"), F.col("event_type")) & ~F.col("notification_sent"))
    return alert_messages(hot)


def scratch(spark, label: str) -> tuple[str, str]:
    base = scratch_path(spark, label)
    return f"{base}/table", f"{base}/checkpoint"
