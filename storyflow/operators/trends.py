"""Mention counts over rolling windows, velocity, and ranked trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyflow.functions.dates import hours_before, ts
from storyflow.functions.text import prettify, py_round, trend_slug

WINDOWS = (6, 24, 168)

# Type -> (array column, lower-case?, minimum length, first cut, minimum count).
# "topic" is a scalar column.
TYPES = {
    "company": ("companies", False, 2, 20),
    "topic": ("event_type", False, 1, 15),
    "model": ("models_mentioned", False, 3, 15),
    "keyword": ("keywords", True, 4, 20),
    "technology": ("technologies_mentioned", False, 3, 10),
}


def velocity(current: Column, prior: Column) -> Column:
    change = py_round((current - prior) / F.nullif(prior, F.lit(0)) * 100.0, 2)
    return F.when(prior == 0, F.when(current > 0, 100.0).otherwise(0.0)).otherwise(change)


def trend_score(mentions: Column, vel: Column) -> Column:
    reach = F.least(F.lit(50.0), F.log2(mentions + 1) * 10.0)
    bonus = F.least(F.lit(50.0), F.greatest(F.lit(0.0), vel) / 4.0)
    return py_round(F.least(F.lit(100.0), reach + bonus), 2)


def is_emerging(current: Column, prior: Column) -> Column:
    return (prior == 0) & (current >= 2)


def _labelled(label: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.struct(F.lit(label).alias("type"), n.alias("name")))


def mentions(events: DataFrame, types=tuple(TYPES)) -> DataFrame:
    """Long form: one row per (event, type, name)."""
    parts = []
    for t in types:
        col, lower, _, _ = TYPES[t]
        if t == "topic":
            arr = F.array(prettify(F.col(col)))
        else:
            arr = F.transform(F.col(col), F.lower) if lower else F.col(col)
        parts.append(_labelled(t, F.coalesce(arr, F.array().cast("array<string>"))))
    return (
        events.select(
            "event_id", "published_at", "priority_score", "headline", "primary_source_domain",
            F.explode(F.flatten(F.array(*parts))).alias("m"),
        )
        .select("*", "m.type", "m.name").drop("m")
        .filter(F.col("name").isNotNull() & (F.col("name") != ""))
    )


def window_counts(events: DataFrame, as_of, hours=WINDOWS, types=tuple(TYPES), details: bool = False) -> DataFrame:
    """Mentions in ``[as_of-w, as_of)`` against ``[as_of-2w, as_of-w)`` for every window and
    type in one aggregation. The windows nest, so each mention expands to at most
    ``len(hours)`` rows, combined map-side before the shuffle.

    With ``details`` the first five event ids and the top headline are added; both are
    bounded per group (min_by/max_by and a five-row rank filter), never whole lists.
    """
    hours = list(hours)
    longest = max(hours)
    cur = lambda h: F.col("published_at") >= hours_before(as_of, h)
    scoped = events.filter(
        (F.col("published_at") >= hours_before(as_of, 2 * longest)) & (F.col("published_at") < ts(as_of))
    )
    tagged = F.array_compact(F.array(*[
        F.when(F.col("published_at") >= hours_before(as_of, 2 * h),
               F.struct(F.lit(h).alias("hours"), cur(h).alias("current")))
        for h in hours
    ]))
    long = (
        mentions(scoped, types).withColumn("w", F.explode(tagged))
        .select("*", F.col("w.hours").alias("period_hours"), F.col("w.current").alias("cur")).drop("w")
    )
    keys = ["period_hours", "type", "name"]
    counts = long.groupBy(*keys).agg(
        F.count_if("cur").alias("mention_count"),
        F.count_if(~F.col("cur")).alias("previous_mention_count"),
        F.min_by("headline", F.when(F.col("cur"), F.struct(-F.col("priority_score"), "event_id"))).alias("top_headline"),
    )
    if not details:
        return counts
    # Distinct domains: two-level count, so a hot name spreads over its domains.
    domains = (
        long.filter("cur").groupBy(*keys, "primary_source_domain").agg(F.lit(1).alias("one"))
        .groupBy(*keys).agg(F.count("primary_source_domain").alias("source_count"))
    )
    return counts.join(domains, keys, "left").fillna(0, ["source_count"])


def first_ids(events: DataFrame, ranked: DataFrame, as_of, hours=WINDOWS, types=tuple(TYPES), n: int = 5) -> DataFrame:
    """Ids of the n highest-priority current events per ranked trend. ``ranked`` is
    bounded by windows x types x top-k, so it is broadcast."""
    base = mentions(events.filter(
        (F.col("published_at") >= hours_before(as_of, max(hours))) & (F.col("published_at") < ts(as_of))), types)
    keys = ["period_hours", "type", "name"]
    hit = base.join(F.broadcast(ranked.select(*keys)), ["type", "name"]).filter(
        F.unix_micros(ts(as_of)) - F.unix_micros("published_at") <= F.col("period_hours") * 3_600_000_000
    )
    w = Window.partitionBy(*keys).orderBy(F.desc("priority_score"), "event_id")
    return (
        hit.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "event_id"))),
                         lambda s: s["event_id"]).alias("related_event_ids"))
    )


def _ranked(counts: DataFrame) -> DataFrame:
    """Apply the per-type rules: length filter, top-k by count, keyword and technology cuts."""
    t = F.col("type")
    length_ok = F.lit(False)
    top = F.lit(0)
    for name, (_, _, min_len, k) in TYPES.items():
        length_ok = F.when(t == name, F.length("name") >= min_len).otherwise(length_ok)
        top = F.when(t == name, k).otherwise(top)
    w = Window.partitionBy("period_hours", "type").orderBy(F.desc("mention_count"), "name")
    largest = max(k for *_, k in TYPES.values())
    vel = velocity(F.col("mention_count"), F.col("previous_mention_count"))
    ranked = (
        counts.filter(length_ok & (F.col("mention_count") > 0))
        # A literal bound first lets Spark cut each partition before the shuffle.
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= largest)
        .filter(F.col("rank") <= top)
        .withColumn("velocity", vel)
        .withColumn("trend_score", trend_score(F.col("mention_count"), F.col("velocity")))
        .withColumn("is_emerging", is_emerging(F.col("mention_count"), F.col("previous_mention_count")))
        .withColumn("slug", trend_slug(F.col("name")))
        .withColumn("top_headline", F.when(t.isin("keyword", "technology"), None)
                    .otherwise(F.substring("top_headline", 1, 200)))
    )
    keep = (
        F.when(t == "keyword", (F.col("mention_count") >= 2) | (F.col("velocity") >= 50))
        .when(t == "technology", F.col("mention_count") >= 2).otherwise(True)
    )
    kept = ranked.filter(keep)
    w2 = Window.partitionBy("period_hours", "type").orderBy("rank")
    return (
        kept.withColumn("pos", F.row_number().over(w2))
        .filter((t != "keyword") | (F.col("pos") <= 10)).drop("pos", "rank")
    )


def trends(events: DataFrame, as_of, hours=WINDOWS, types=tuple(TYPES), with_ids: bool = True) -> DataFrame:
    """Ranked trends for all windows and types in one plan."""
    # A trend shows this much of a headline; whole ones would travel with each of their words.
    short = events.withColumn("headline", F.substring("headline", 1, 200))
    out = _ranked(window_counts(short, as_of, hours, types, details=True)).withColumn(
        "event_count", F.col("mention_count")
    )
    if with_ids:
        out = out.join(first_ids(events, out, as_of, hours, types), ["period_hours", "type", "name"], "left")
    return out.withColumnRenamed("type", "trend_type").withColumns({
        "period_start": hours_before_col(as_of, F.col("period_hours")),
        "period_end": ts(as_of),
    })


def hours_before_col(as_of, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts(as_of)) - hours.cast("long") * 3_600_000_000)


TREND_KEYS = ["trend_type", "slug", "period_hours", "period_start"]


def truncate_run(df: DataFrame, grain: str = "HOUR") -> DataFrame:
    """Run-grain period start, so that a repeated run hits the same upsert key. Names
    that share a slug fold into one row (highest count, then name)."""
    out = df.withColumn("period_start", F.date_trunc(grain, "period_start"))
    best = F.max_by(F.struct(*out.columns), F.struct("mention_count", F.col("name")))
    return out.groupBy(*TREND_KEYS).agg(best.alias("r")).select("r.*")


def top_trends(trend_table: DataFrame, as_of, hours: int = 24, trend_type: str | None = None,
               limit: int = 20) -> DataFrame:
    out = trend_table.filter((F.col("period_hours") == hours)
                             & (F.col("period_start") >= hours_before(as_of, hours + 12)))
    if trend_type:
        out = out.filter(F.col("trend_type") == trend_type)
    return out.orderBy(F.desc("trend_score"), "trend_type", "name").limit(limit)


def company_ranking(events: DataFrame, top: int = 10, per_company: int = 3) -> DataFrame:
    """Most mentioned companies with their best events."""
    rows = events.select("event_id", "priority_score", "headline", F.explode("companies").alias("company")).filter(
        F.col("company") != "")
    counts = (rows.groupBy("company").agg(F.count("*").alias("mention_count"))
              .orderBy(F.desc("mention_count"), "company").limit(top))
    w = Window.partitionBy("company").orderBy(F.desc("priority_score"), "event_id")
    best = (
        rows.join(F.broadcast(counts), "company")
        .withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= per_company)
        .groupBy("company", "mention_count")
        .agg(F.array_sort(F.collect_list(F.struct(
            "pos", F.substring("headline", 1, 100).alias("headline"), "priority_score"))).alias("top_events"))
    )
    return best
