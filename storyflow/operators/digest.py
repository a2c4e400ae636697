"""Daily digest sections, company ranking inputs and weekly brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyflow.functions.dates import hours_before, ts
from storyflow.functions.text import py_round


def for_day(events: DataFrame, day: str) -> DataFrame:
    """24 hours ending 23:59:59 of the day, both ends included."""
    end = f"{day} 23:59:59"
    return events.filter(F.col("published_at").between(hours_before(end, 24), ts(end)))


def section_predicates() -> dict[str, Column]:
    et = F.coalesce(F.col("event_type"), F.lit(""))
    return {
        "top": F.lit(True),
        "funding": (et == "funding") | (F.coalesce(F.col("funding_amount"), F.lit(0.0)) > 0),
        "research": et.isin("research_paper", "benchmark") | F.col("arxiv_id").isNotNull(),
        "launch": et.isin("product_launch", "model_release", "api_release"),
        "open_source": et == "open_source_release",
        "github": F.exists("source_domains", lambda d: F.contains(d, F.lit("github.com"))),
        "tools": et.isin("developer_tool", "framework", "coding_ai"),
        "opportunity": F.length(F.coalesce(F.col("business_opportunities"), F.lit(""))) > 20,
        "risk": F.length(F.coalesce(F.col("risks"), F.lit(""))) > 20,
    }


SECTION_SIZE = {"top": 10}


def section(events: DataFrame, name: str, n: int | None = None) -> DataFrame:
    """One section as a top-k: sort key is the amount for funding, else the priority."""
    n = n or SECTION_SIZE.get(name, 5)
    first = F.desc(F.coalesce(F.col("funding_amount"), F.lit(0.0))) if name == "funding" else F.desc("priority_score")
    return (events.filter(section_predicates()[name])
            .orderBy(first, F.desc("priority_score"), "event_id").limit(n))


def snippets(events: DataFrame, column: str, n: int = 5) -> DataFrame:
    kept = events.filter(F.length(column) > 20).orderBy(F.desc("priority_score"), "event_id").limit(n)
    return kept.select("event_id", F.substring(column, 1, 300).alias("snippet"))


def digest(events: DataFrame) -> DataFrame:
    """Every section in one scan: label array, explode, rank inside each label.

    The rank filter is a literal bound, so each partition keeps only its own best rows
    before the shuffle and no label is ever gathered whole."""
    labels = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in section_predicates().items()]))
    amount = F.coalesce(F.col("funding_amount"), F.lit(0.0))
    rows = events.withColumn("section", F.explode(labels)).withColumn(
        "sort_key", F.when(F.col("section") == "funding", amount).otherwise(F.col("priority_score")))
    w = Window.partitionBy("section").orderBy(F.desc("sort_key"), F.desc("priority_score"), "event_id")
    return (
        rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= 10)
        .filter((F.col("section") == "top") | (F.col("pos") <= 5))
    )


def totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total_events"), F.count_if("is_breaking").alias("breaking_count"))


def extractive_summary(events: DataFrame) -> DataFrame:
    """First three summaries of the top five events, 600 characters at most."""
    top = section(events.select("event_id", "priority_score", "summary", *_section_inputs(events)), "top", 5)
    parts = F.transform(
        F.array_sort(F.collect_list(F.when(F.coalesce(F.col("summary"), F.lit("")) != "",
                                           F.struct(-F.col("priority_score"), "event_id", "summary")))),
        lambda s: s["summary"],
    )
    joined = F.substring(F.array_join(F.slice(parts, 1, 3), " "), 1, 600)
    return top.agg(F.when(F.size(parts) > 0, joined).otherwise("AI market activity continues.").alias("market_summary"))


def _section_inputs(events: DataFrame) -> list[str]:
    wanted = ["event_type", "funding_amount", "arxiv_id", "source_domains", "business_opportunities", "risks"]
    return [c for c in wanted if c in events.columns]


def parse_predictions(text: Column, n: int = 3) -> Column:
    """Lines longer than 20 characters without their numbering, first n."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")),
                     lambda x: F.length(x) > 20)
    return F.slice(F.transform(lines, lambda x: F.regexp_replace(x, r"^[0-9.\-) ]+", "")), 1, n)


def weekly_brief(events: DataFrame, as_of, n: int = 5) -> DataFrame:
    """Top n of the last 7 days and one content hash over id:headline for change detection."""
    top = (events.filter(F.col("published_at") >= hours_before(as_of, 168))
           .orderBy(F.desc("priority_score"), "event_id").limit(n))
    ordered = F.array_sort(F.collect_list(F.struct(-F.col("priority_score"), "event_id", "headline")))
    text = F.array_join(F.transform(ordered, lambda s: F.concat(s["event_id"].cast("string"), F.lit(":"), s["headline"])), "")
    return top.agg(
        F.transform(ordered, lambda s: s["event_id"]).alias("event_ids"), F.sha2(text, 256).alias("hash_key"))


def digest_row(events: DataFrame) -> DataFrame:
    """List projection: short arrays, one decimal."""
    caps = {"companies": 5, "tags": 5, "source_domains": 5}
    return events.select(
        "event_id", "headline", "summary", "category", "event_type",
        py_round(F.col("priority_score"), 1).alias("priority_score"),
        *[F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, k).alias(c) for c, k in caps.items()],
        F.size("source_domains").alias("source_count"), "published_at", "primary_source_url", "funding_amount",
    )
