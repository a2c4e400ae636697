"""Landed feed and API payloads -> article rows.

Each reader takes files (``read_*``) or an already parsed DataFrame, and yields the
columns of ``ARTICLE_SCHEMA``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.functions.dates import hours_before, parse_datetime, raw_age_hours
from storyflow.functions.text import clean_html, contains_any, lit_array, nfc

ARTICLE_SCHEMA = (
    "title string, url string, source_name string, source_domain string, description string, content_snippet string, "
    "image_url string, author string, published_at timestamp, is_official boolean, official_company string, source_type string"
)
_COLUMNS = [c.strip().split(" ")[0] for c in ARTICLE_SCHEMA.split(",")]

# Elements of RSS items and Atom entries; either spelling may be missing.
FEED_ITEM = (
    "title string, link string, summary string, description string, content string, author string, "
    "published string, pubDate string, updated string, "
    "`media:content` array<struct<_url: string>>, `media:thumbnail` array<struct<_url: string>>"
)
ATOM_ENTRY = "id string, title string, summary string, published string, author array<struct<name: string>>"
STORY_HITS = ("hits array<struct<title: string, url: string, points: int, objectID: string, created_at_i: bigint, num_comments: int>>")
LISTING = ("data struct<children: array<struct<data: struct<title: string, url: string, domain: string, score: int, "
           "is_self: boolean, selftext: string, created_utc: double, subreddit: string>>>>")
RELEASE = "repo string, tag_name string, name string, html_url string, body string, published_at string, prerelease boolean"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def as_articles(df: DataFrame, source_name: str | Column | None = None, source_domain: str | None = None,
                source_type: str = "rss", official: bool = False, company: str | None = None) -> DataFrame:
    """Fill missing article columns with source constants; texts are composed (NFC) here, once."""
    fixed = {"source_name": source_name, "source_domain": source_domain, "source_type": source_type,
             "is_official": official, "official_company": company}
    types = dict(c.strip().split(" ") for c in ARTICLE_SCHEMA.split(","))
    out = []
    for c in _COLUMNS:
        value = F.col(c) if c in df.columns else F.lit(fixed.get(c))
        value = value.cast(types[c])
        out.append((nfc(value) if c in ("title", "description", "content_snippet") else value).alias(c))
    extra = [c for c in df.columns if c not in _COLUMNS]
    return df.select(*out, *extra)


def read_feed_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Feed files, split by element so that a large file is read in parallel."""
    return (spark.read.format("xml").option("rowTag", tag).schema(FEED_ITEM).load(path)
            .withColumn("feed", F.input_file_name()))


def feed_articles(items: DataFrame, max_per_feed: int | None = None, order: list | None = None) -> DataFrame:
    """Items -> article rows. ``max_per_feed`` keeps the first items of each feed by ``order``."""
    has = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    title, link = F.trim(has("title")), F.trim(has("link"))
    text = F.coalesce(has("summary"), has("description"))
    description = clean_html(text)
    snippet = clean_html(has("content"))
    image = F.coalesce(F.try_element_at(F.col("media:content"), F.lit(1))["_url"],
                       F.try_element_at(F.col("media:thumbnail"), F.lit(1))["_url"])
    out = items.filter((title != "") & (link != ""))
    if max_per_feed is not None:
        w = Window.partitionBy("feed").orderBy(*order)
        out = out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_per_feed).drop("_n")
    keep = [c for c in ("feed", "seq") if c in items.columns]
    return out.select(
        *keep, title.alias("title"), link.alias("url"),
        blank_to_null(description).alias("description"),
        blank_to_null(snippet).alias("content_snippet"), image.alias("image_url"), has("author").alias("author"),
        parse_datetime(F.coalesce(has("published"), has("pubDate"), has("updated"))).alias("published_at"))


def read_paper_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "entry").schema(ATOM_ENTRY).load(path)


def paper_articles(entries: DataFrame, as_of, max_age_hours: int = 48) -> DataFrame:
    flat = lambda c: F.replace(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("\n"), F.lit(" "))
    names = F.filter(F.transform("author", lambda a: F.trim(a["name"])), lambda n: n.isNotNull() & (n != ""))
    author = F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, " et al.").otherwise(""))
    published = parse_datetime(F.col("published"))
    return (
        entries.filter(F.col("title").isNotNull() & F.col("id").isNotNull())
        .select(
            flat("title").alias("title"),
            F.replace(F.trim("id"), F.lit("http://"), F.lit("https://")).alias("url"),
            blank_to_null(flat("summary")).alias("description"),
            blank_to_null(author).alias("author"), published.alias("published_at"))
        .filter(F.col("published_at").isNull() | (F.col("published_at") >= hours_before(as_of, max_age_hours)))
    )


def read_json_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON responses, one document per file or per line; unreadable ones are dropped, unknown fields ignored."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    parsed = lambda c: F.from_json(c, schema)
    documents = whole.select(F.when(parsed(F.col("text")).isNotNull() & ~F.rtrim("text").contains("\n{"), F.array("text")).otherwise(F.split(F.trim("text"), "\n")).alias("d"))
    return documents.select(F.explode("d").alias("d")).select(parsed(F.col("d")).alias("r")).where("r is not null").select("r.*")


def read_story_hits(spark: SparkSession, path: str) -> DataFrame:
    return read_json_payloads(spark, path, STORY_HITS)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return read_json_payloads(spark, path, LISTING)


def read_releases(spark: SparkSession, path: str) -> DataFrame:
    return read_json_payloads(spark, path, RELEASE)


def story_articles(payloads: DataFrame, as_of, min_points: int = 5, max_days: int = 3) -> DataFrame:
    """Search-result payloads (``hits``). A story that several payloads repeat is kept once."""
    h = payloads.select(F.explode("hits").alias("h")).select("h.*")
    created = F.timestamp_seconds("created_at_i")
    url = F.when(F.coalesce("url", F.lit("")) == "",
                 F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID")).otherwise(F.col("url"))
    rows = (
        h.filter((F.trim("title") != "") & (F.col("points") >= min_points)
                 & (created >= hours_before(as_of, 24 * max_days)))
        .select(
            F.trim("title").alias("title"), url.alias("url"),
            F.format_string("Hacker News — %d points, %d comments", F.col("points"), F.coalesce("num_comments", F.lit(0))).alias("description"),
            created.alias("published_at"), "objectID")
    )
    story = F.when(F.contains("url", F.lit("id=")), F.substring_index("url", "id=", -1)).otherwise(F.col("url"))
    first = F.min_by(F.struct("title", "url", "description", "published_at"), "objectID")
    return rows.groupBy(story.alias("story_id")).agg(first.alias("r")).select("story_id", "r.*")


def listing_articles(payloads: DataFrame, min_upvotes: int = 50) -> DataFrame:
    """Link listings: no self posts, enough votes, trusted domain (equal or containing) or a
    document link. The same url is kept once."""
    p = payloads.select(F.explode("data.children").alias("c")).select("c.data.*")
    domain = F.lower(F.coalesce("domain", F.lit("")))
    listed = contains_any(domain, K.LISTING_NEWS_DOMAINS)
    document = F.lower("url").rlike(r"\.(pdf|html)$")
    fallback = F.format_string("Reddit hot post on r/%s with %d upvotes", F.col("subreddit"), F.col("score"))
    rows = (
        p.filter(~F.coalesce("is_self", F.lit(False)) & (F.trim("title") != "") & (F.coalesce("url", F.lit("")) != "")
                 & (F.col("score") >= min_upvotes) & (listed | document))
        .select(
            F.trim("title").alias("title"), "url", F.col("domain").alias("source_domain"),
            F.coalesce(blank_to_null(F.col("selftext")), fallback).alias("description"),
            F.timestamp_seconds(F.col("created_utc").cast("bigint")).alias("published_at"))
    )
    best = F.min_by(F.struct("title", "source_domain", "description", "published_at"), F.struct("published_at", "title"))
    return rows.groupBy("url").agg(best.alias("r")).select("url", "r.*")


def release_articles(releases: DataFrame, as_of, max_age_hours: int = 168) -> DataFrame:
    name = F.coalesce(blank_to_null(F.col("name")), blank_to_null(F.col("tag_name")))
    body = F.trim(F.coalesce("body", F.lit("")))
    published = parse_datetime(F.col("published_at"))
    repo = F.element_at(F.split("repo", "/"), -1)
    return (
        releases.filter((F.coalesce("html_url", F.lit("")) != "") & name.isNotNull() & ~F.coalesce("prerelease", F.lit(False)))
        .select(
            F.concat(F.lit("🚀 "), repo, F.lit(" "), name, F.lit(" released")).alias("title"),
            F.col("html_url").alias("url"),
            F.coalesce(blank_to_null(body), F.concat(F.lit("New release of "), "repo")).alias("description"),
            published.alias("published_at"))
        .filter(F.col("published_at").isNull() | (raw_age_hours(as_of, F.col("published_at")) <= max_age_hours))
    )


def registry(spark: SparkSession) -> DataFrame:
    """The 15 known sources and their aliases; small and fixed."""
    rows = [(s, t, c, o) for s, t, c, o in K.SOURCE_REGISTRY]
    by_name = {r[0]: r for r in rows}
    rows += [(alias, *by_name[name][1:]) for alias, name in K.SOURCE_ALIASES.items()]
    return spark.createDataFrame(rows, "source_name string, tier int, source_category string, company string")


def with_source_meta(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Stamp source columns. Spark broadcasts ``sources`` by its measured size."""
    return articles.join(sources, "source_name", "left")


def only_active(articles: DataFrame, sources: DataFrame) -> DataFrame:
    return articles.join(sources.filter(~F.col("is_active")).select("source_name"), "source_name", "left_anti")


def is_valid(title: Column, url: Column) -> Column:
    return (F.trim(F.coalesce(title, F.lit(""))) != "") & (F.trim(F.coalesce(url, F.lit(""))) != "")


def valid_records(articles: DataFrame) -> DataFrame:
    return articles.filter(is_valid(F.col("title"), F.col("url")))


def source_stats(articles: DataFrame, url_key: Column) -> DataFrame:
    """Fetched, valid, dropped and distinct urls per source. Urls are made distinct per source
    in a first aggregation, so a hot source spreads over its urls."""
    ok = is_valid(F.col("title"), F.col("url"))
    per_url = articles.groupBy("source_name", F.when(ok, url_key).alias("k")).agg(
        F.count("*").alias("n"), F.count_if(ok).alias("v"))
    return per_url.groupBy("source_name").agg(
        F.sum("n").alias("total"), F.sum("v").alias("valid"), F.sum(F.col("n") - F.col("v")).alias("dropped"),
        F.count("k").alias("unique_urls"))


def source_dimension(names: DataFrame) -> DataFrame:
    """``(source_name, source_domain, official_company)`` -> display name and reliability."""
    official = F.col("official_company").isNotNull()
    pretty = F.replace(F.replace(F.initcap(F.replace("source_name", F.lit("_"), F.lit(" "))), F.lit(" Ai"), F.lit(" AI")),
                       F.lit(" Rss"), F.lit(""))
    suffix = F.when(F.contains("source_name", F.lit("news")), " News").otherwise(" Blog")
    return names.select(
        "source_name", F.when(official, F.concat("official_company", suffix)).otherwise(pretty).alias("display_name"),
        F.concat(F.lit("https://"), "source_domain").alias("url"), "source_domain",
        F.when(official, 90.0).otherwise(75.0).alias("reliability_score"), official.alias("is_official"),
        F.lit(True).alias("is_active"))
