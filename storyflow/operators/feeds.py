"""Feed queries: filters, joins, sorting, paging and projections."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyflow.functions.dates import end_of_day, hours_before, start_of_day, ts
from storyflow.functions.scores import live_feed_score
from storyflow.functions.text import normalize_url, py_round
from storyflow.sources.tables import delete_before


def _strings() -> Column:
    return F.array().cast("array<string>")


def published(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("is_verified") & ~F.col("is_duplicate") & F.col("ai_processed"))


def article_feed(articles: DataFrame, analyses: DataFrame, category: str | None = None,
                 company: str | None = None, from_date: str | None = None, to_date: str | None = None,
                 preferences: dict | None = None) -> DataFrame:
    """Visible articles with their analysis: inner join when a category is asked for, else left."""
    base = published(articles)
    if from_date:
        base = base.filter(F.col("published_at") >= start_of_day(from_date))
    if to_date:
        base = base.filter(F.col("published_at") <= end_of_day(to_date))
    if category:
        out = base.join(analyses.filter(F.col("category") == category), "article_id")
    else:
        out = base.join(analyses, "article_id", "left")
    if company:
        out = out.filter(F.array_contains("companies", company))
    if preferences and not category and not company:
        out = preference_filter(out, **preferences)
    return out


def preference_filter(feed: DataFrame, categories=(), companies=(), topics=()) -> DataFrame:
    """Any of: category listed, a company listed, a tag listed. No preference, no filter."""
    cond = None
    for hit, values in (
        (lambda v: F.col("category").isin(list(v)), categories),
        (lambda v: F.arrays_overlap("companies", F.array(*[F.lit(x) for x in v])), companies),
        (lambda v: F.arrays_overlap("tags", F.array(*[F.lit(x) for x in v])), topics),
    ):
        if values:
            c = F.coalesce(hit(values), F.lit(False))
            cond = c if cond is None else cond | c
    return feed if cond is None else feed.filter(cond)


def sort_columns(mode: str = "score") -> list[Column]:
    date = F.desc_nulls_last("published_at")
    return {
        "date": [date, F.asc("article_id")],
        "trust": [F.desc("trust_score"), date, F.asc("article_id")],
        "score": [date, F.desc("final_score"), F.asc("article_id")],
    }[mode]


def page(df: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, columns: list[tuple[str, bool]], last: dict | None, size: int = 20) -> DataFrame:
    """The page behind row ``last`` (its values of ``columns``; None: the first page). ``columns`` are (name, descending) and
    end with a unique one; nulls come last. Unlike an offset, a deep page sorts no more rows than it returns per task."""
    order = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in columns]
    if last is not None:
        behind, equal = F.lit(False), F.lit(True)
        for c, down in columns:
            v = F.lit(last[c])
            step = F.col(c).isNull() if last[c] is None else (F.col(c) < v if down else F.col(c) > v) | F.col(c).isNull()
            behind = behind | (equal & (step if last[c] is not None else F.lit(False)))
            equal = equal & F.col(c).eqNullSafe(v)
        df = df.filter(behind)
    return df.orderBy(*order).limit(size)


def page_info(df: DataFrame, size: int = 20) -> DataFrame:
    total = F.count("*")
    return df.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / size)).cast("long").alias("pages"))


def trending_today(articles: DataFrame, as_of, limit: int = 10) -> DataFrame:
    return (published(articles).filter(F.col("created_at").between(start_of_day(as_of), ts(as_of)))
            .orderBy(F.desc("final_score"), "article_id").limit(limit))


def event_list(events: DataFrame, as_of, days: int = 7, min_priority: float = 0.0, category=None,
               event_type=None, breaking_only: bool = False) -> DataFrame:
    out = events.filter((F.col("published_at") >= hours_before(as_of, days * 24))
                        & (F.col("priority_score") >= min_priority))
    if category:
        out = out.filter(F.col("category") == category)
    if event_type:
        out = out.filter(F.col("event_type") == event_type)
    return out.filter("is_breaking") if breaking_only else out


def event_order() -> list[Column]:
    return [F.desc("priority_score"), F.desc("published_at"), F.asc("event_id")]


def breaking(events: DataFrame, limit: int = 10) -> DataFrame:
    return events.filter("is_breaking").orderBy(*event_order()).limit(limit)


def event_articles(events: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """Event detail: one row per event and article. Flat, because an event may own any number of
    articles; filter ``events`` for a single page."""
    a = articles.select("article_id", "title", F.col("url").alias("article_url"), "trust_score")
    return events.join(links, "event_id").join(a, "article_id")


def article_detail(articles: DataFrame, analyses: DataFrame) -> DataFrame:
    cols = [c for c in analyses.columns if c != "article_id"]
    nested = analyses.select("article_id", F.struct(*cols).alias("analysis"))
    return articles.join(nested, "article_id", "left")


def event_list_row(events: DataFrame) -> DataFrame:
    short = lambda c, k: F.slice(F.coalesce(F.col(c), _strings()), 1, k).alias(c)
    return events.select(
        "event_id", "headline", "category", "event_type",
        py_round(F.col("priority_score"), 1).alias("priority_score"),
        py_round(F.col("freshness_score"), 1).alias("freshness_score"),
        "is_breaking", short("companies", 5), short("tags", 5), short("models_mentioned", 3),
        short("source_domains", 3), "published_at", "primary_source_url", "funding_amount")


def article_list_row(feed: DataFrame) -> DataFrame:
    return feed.select(
        "article_id", "title", "url", "published_at", "source_domain", "trust_score", "final_score", "category",
        F.coalesce("companies", _strings()).alias("companies"), F.coalesce("tags", _strings()).alias("tags"), "created_at")


def with_text(articles: DataFrame) -> DataFrame:
    """Lower-cased title and description as a column, for projections without a filter on the result."""
    return articles.withColumn("_text", F.lower(F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))))


def on_text(test) -> Column:
    """``test`` of the lower-cased title and description. The text is bound as a lambda variable:
    a filter on the result would otherwise be pushed down with a copy of the text per keyword."""
    text = F.lower(F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))))
    return F.get(F.transform(F.array(text), test), F.lit(0))


def live_feed(articles: DataFrame, as_of, days: int = 3, limit: int | None = 60,
              companies: Column | None = None, topics: Column | None = None) -> DataFrame:
    """Recent or undated rows with a positive score, newest first, then score."""
    score = on_text(lambda text: live_feed_score(
        as_of, text, F.col("source_name"), F.col("published_at"), F.col("is_official"), companies, topics))
    out = (
        articles.filter(F.col("published_at").isNull() | (F.col("published_at") >= hours_before(as_of, days * 24)))
        .withColumn("feed_score", score).filter(F.col("feed_score") > 0)
        .orderBy(F.desc_nulls_last("published_at"), F.desc("feed_score"), "article_id")
    )
    return out if limit is None else out.limit(limit)


def existing_ids(incoming: DataFrame, articles: DataFrame) -> DataFrame:
    """Known id per incoming normalised url; of repeated urls the last incoming row counts."""
    last = incoming.groupBy(normalize_url(F.col("url")).alias("normalized_url")).agg(F.max("seq").alias("seq"))
    known = articles.groupBy(normalize_url(F.col("url")).alias("normalized_url")).agg(F.min("article_id").alias("article_id"))
    return last.join(known, "normalized_url", "left")


def bookmark_list(bookmarks: DataFrame, articles: DataFrame, analyses: DataFrame) -> DataFrame:
    return (
        bookmarks.select("user_id", "article_id", F.col("created_at").alias("bookmarked_at"))
        .join(articles, "article_id").join(analyses.select("article_id", "category"), "article_id", "left")
    )


def latest_per_user(rows: DataFrame, ts_col: str, tie: str, limit: int) -> DataFrame:
    """Newest ``limit`` rows of every user; the rank bound cuts each partition before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.desc(ts_col), F.asc(tie))
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)


def active_categories(categories: DataFrame) -> DataFrame:
    return categories.filter("is_active").orderBy("display_order", "slug")


def expired(rows: DataFrame, as_of, days: int = 30) -> Column:
    return F.col("created_at") < hours_before(as_of, days * 24)


def retain(rows: DataFrame, as_of, days: int = 30) -> DataFrame:
    return rows.filter(~expired(rows, as_of, days))


def retention_counts(rows: DataFrame, as_of, days: int = 30) -> DataFrame:
    gone = expired(rows, as_of, days)
    return rows.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


def apply_retention(spark: SparkSession, path: str, as_of, days: int = 30, column: str = "created_at") -> dict[str, int]:
    """Delete the rows older than ``days`` from a keyed table that is partitioned by the day of ``column``."""
    limit = datetime.fromisoformat(str(as_of)) - timedelta(days=days)
    return delete_before(spark, path, column, ts(limit.isoformat(sep=" ")), limit.date().isoformat())


def engagement(log: DataFrame) -> DataFrame:
    """Event log ``(article_id, user_id, action, ts, seq)`` -> views and current bookmarks.

    A bookmark counts once per user: the last bookmark/unbookmark action decides."""
    views = log.groupBy("article_id").agg(F.count_if(F.col("action") == "view").alias("view_count"))
    marks = (
        log.filter(F.col("action").isin("bookmark", "unbookmark")).groupBy("article_id", "user_id")
        .agg(F.max_by("action", F.struct("ts", "seq")).alias("last"))
        .groupBy("article_id").agg(F.count_if(F.col("last") == "bookmark").alias("bookmark_count"))
    )
    return views.join(marks, "article_id", "left").withColumn(
        "bookmark_count", F.greatest(F.lit(0), F.coalesce("bookmark_count", F.lit(0))))


def mark_all_read(notifications: DataFrame, user_ids: DataFrame, as_of) -> DataFrame:
    """Changed rows only: unread notifications of the given users become read."""
    return (notifications.filter(~F.col("is_read")).join(user_ids.select("user_id").distinct(), "user_id", "left_semi")
            .withColumn("is_read", F.lit(True)).withColumn("read_at", ts(as_of)))
