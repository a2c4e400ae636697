"""Model responses as data: validation, coercion, folding into events, user functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.functions import scores as S
from storyflow.functions.text import normalize_title, reading_time, tokens


def _kind(v: Column, field: str) -> Column:
    """JSON kind of a field; null when the field is missing."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def validation_error(raw: Column) -> Column:
    """First schema violation of a JSON response, or null."""
    v = F.try_parse_json(raw)
    missing = F.array_compact(F.array(*[F.when(_kind(v, f).isNull(), F.lit(f)) for f, _ in K.REQUIRED_FIELDS]))
    accept = {
        "string": lambda k: k == "STRING",
        "array": lambda k: k.startswith("ARRAY"),
        "integer": lambda k: k.isin("BIGINT", "BOOLEAN"),
        "number": lambda k: k.isin("BIGINT", "BOOLEAN", "DOUBLE") | k.startswith("DECIMAL"),
    }
    error = (
        F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "output is not a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(missing, ", ")))
    )
    for field, kind in K.REQUIRED_FIELDS:
        error = error.when(~accept[kind](_kind(v, field)), f"Invalid type for {field}")
    for field, allowed in (("category", K.CATEGORIES), ("sentiment", K.SENTIMENTS), ("urgency", K.URGENCIES)):
        error = error.when(~F.try_variant_get(v, f"$.{field}", "string").isin(allowed), f"Invalid {field}")
    return error


# List field -> how many entries are kept.
LIST_CAPS = {
    "key_takeaways": 5, "keywords": 10, "tags": 10, "companies": 10, "products_mentioned": 10,
    "people_mentioned": 10, "technologies_mentioned": 10, "programming_languages": 5,
    "models_mentioned": 10, "countries_affected": 10, "industries_affected": 10,
}
OPTIONAL_TEXT = ["subcategory", "funding_currency", "research_paper_url", "arxiv_id", "market_impact",
                 "business_opportunities", "risks"]


def coerced(raw: Column, fallback_text: Column) -> dict[str, Column]:
    """Typed analysis fields of one response: list caps, ranges, enum fallbacks."""
    v = F.try_parse_json(raw)
    text = lambda f: F.nullif(F.try_variant_get(v, f"$.{f}", "string"), F.lit(""))
    empty = F.array().cast("array<string>")

    def enum(field: str, allowed, default) -> Column:
        got = F.try_variant_get(v, f"$.{field}", "string")
        return F.when(got.isin(allowed), got).otherwise(F.lit(default))

    def number(field: str, default: float) -> Column:
        got = F.try_variant_get(v, f"$.{field}", "double")
        return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), got)), F.lit(default))

    minutes = F.coalesce(F.nullif(F.try_variant_get(v, "$.reading_time_minutes", "double").cast("int"), F.lit(0)), F.lit(3))
    out = {
        "summary": F.coalesce(text("summary"), F.substring(fallback_text, 1, 300)),
        "executive_summary": F.coalesce(text("executive_summary"), F.lit("")),
        "why_it_matters": F.coalesce(text("why_it_matters"), F.lit("")),
        "category": enum("category", K.CATEGORIES, "General AI"),
        "event_type": enum("event_type", K.EVENT_TYPES, None).cast("string"),
        "sentiment": enum("sentiment", K.SENTIMENTS, "neutral"),
        "urgency": enum("urgency", K.URGENCIES, "medium"),
        "funding_amount": F.try_variant_get(v, "$.funding_amount", "double"),
        "confidence_score": number("confidence_score", 70.0),
        "importance_score": number("importance_score", 50.0),
        "reading_time_minutes": F.greatest(F.lit(1), F.least(F.lit(15), minutes)),
    }
    for f in OPTIONAL_TEXT:
        out[f] = text(f)
    for f, cap in LIST_CAPS.items():
        items = F.coalesce(F.try_variant_get(v, f"$.{f}", "array<string>"), empty)
        out[f] = F.slice(F.filter(items, lambda x: x.isNotNull() & (x != "")), 1, cap)
    return out


def degraded(title: Column, content: Column) -> dict[str, Column]:
    """Safe record used when a response does not validate."""
    summary = F.concat(F.lit(K.DEGRADED_SUMMARY), title)
    empty = F.array().cast("array<string>")
    out = {f: empty for f in LIST_CAPS} | {f: F.lit(None).cast("string") for f in OPTIONAL_TEXT}
    return out | {
        "summary": summary, "executive_summary": summary, "why_it_matters": F.lit(K.DEGRADED_WHY),
        "key_takeaways": F.array(F.substring(title, 1, 180)), "tags": F.array(F.lit("needs-review")),
        "category": F.lit("General AI"), "event_type": F.lit(None).cast("string"),
        "sentiment": F.lit("neutral"), "urgency": F.lit("medium"), "funding_amount": F.lit(None).cast("double"),
        "confidence_score": F.lit(60.0), "importance_score": F.lit(35.0),
        "reading_time_minutes": reading_time(F.when(F.coalesce(content, F.lit("")) != "", content).otherwise(title)),
    }


def analyses_from_responses(df: DataFrame) -> DataFrame:
    """``(article_id, title, content, raw)`` -> analysis rows; invalid responses degrade."""
    good, bad = coerced(F.col("raw"), F.col("content")), degraded(F.col("title"), F.col("content"))
    checked = df.withColumn("validation_error", validation_error(F.col("raw")))
    ok = F.col("validation_error").isNull()
    return checked.select("article_id", "validation_error",
                          *[F.when(ok, good[f]).otherwise(bad[f]).alias(f) for f in good])


def work_queue(articles: DataFrame, limit: int | None = None) -> DataFrame:
    out = articles.filter(F.col("is_verified") & ~F.col("ai_processed") & ~F.col("is_duplicate")).orderBy(
        F.desc("trust_score"), "article_id")
    return out if limit is None else out.limit(limit)


def run_model(articles: DataFrame, make_client: Callable[[], Callable[[pd.DataFrame], Iterable[str]]],
              content_cap: int | None = None) -> DataFrame:
    """Call a user-supplied model. ``make_client`` runs once per task and returns a function
    from a pandas batch (title, url, source, content) to one JSON string per row. The client
    gets the whole text unless ``content_cap`` states how much its model takes. The number
    of partitions is the number of concurrent clients."""
    aid = articles.schema["article_id"].dataType.simpleString()
    inputs = articles.select("article_id", "title", "url", F.col("source_domain").alias("source"),
                             (F.col("body") if content_cap is None else F.substring("body", 1, content_cap)).alias("content"))

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            yield pd.DataFrame({"article_id": pdf["article_id"], "title": pdf["title"], "content": pdf["content"],
                                "raw": list(client(pdf))})

    return inputs.mapInPandas(call, f"article_id {aid}, title string, content string, raw string")


def call_model(articles: DataFrame, make_client: Callable[[], Callable[[dict], str]], concurrency: int = 5, attempts: int = 3,
               wait_s: float = 0.5, content_cap: int | None = None) -> DataFrame:
    """Like ``run_model`` for a client that answers one request (title, url, source, content) at a time. A task has at most ``concurrency``
    requests open; a failed one is tried again after a pause that doubles, ``attempts`` times in all. Every row comes back
    once and in order; a row whose attempts all fail has a null answer, which validation turns into the degraded record."""
    aid = articles.schema["article_id"].dataType.simpleString()
    inputs = articles.select("article_id", "title", "url", F.col("source_domain").alias("source"),
                             (F.col("body") if content_cap is None else F.substring("body", 1, content_cap)).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def ask(request: dict) -> str | None:
            for attempt in range(attempts):
                try:
                    return client(request)
                except Exception:  # noqa: BLE001  whatever a client raises
                    if attempt + 1 < attempts:
                        time.sleep(wait_s * 2**attempt)
            return None

        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                answers = list(pool.map(ask, pdf[["title", "url", "source", "content"]].to_dict("records")))
                yield pd.DataFrame({"article_id": pdf["article_id"], "title": pdf["title"], "content": pdf["content"], "raw": pd.Series(answers, dtype="object")})

    return inputs.mapInPandas(run, f"article_id {aid}, title string, content string, raw string")


# Array field of an event -> cap after merging.
FOLD_CAPS = {
    "companies": 15, "products_mentioned": 10, "people_mentioned": 10, "technologies_mentioned": 15,
    "models_mentioned": 10, "keywords": 15, "tags": 15, "countries_affected": 10, "industries_affected": 10,
}
FILL_IF_EMPTY = ["market_impact", "business_opportunities", "risks", "summary", "executive_summary"]


def _labelled(c: str) -> Column:
    values = F.coalesce(F.col(c), F.array().cast("array<string>"))
    return F.transform(values, lambda x: F.struct(F.lit(c).alias("field"), x.alias("value")))


def fold_into_events(events: DataFrame, analyses: DataFrame, as_of) -> DataFrame:
    """Merge the analyses of an event's articles (``event_id``, ``seq`` = processing order).

    Array values are made distinct and ranked before anything is gathered, so an event with
    very many articles never builds a long list."""
    arrays = [c for c in FOLD_CAPS if c in analyses.columns]
    stacked = lambda df: df.select("event_id", F.explode(F.flatten(F.array(*[
        _labelled(c) for c in arrays if c in df.columns]))).alias("e")).select("event_id", "e.*")
    touched = analyses.select("event_id").distinct()
    values = stacked(analyses).unionByName(stacked(events.join(touched, "event_id", "left_semi"))).distinct()
    cap = F.lit(0)
    for c in arrays:
        cap = F.when(F.col("field") == c, FOLD_CAPS[c]).otherwise(cap)
    w = Window.partitionBy("event_id", "field").orderBy("value")
    merged = (
        values.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= max(FOLD_CAPS.values())).filter(F.col("pos") <= cap)
        .groupBy("event_id").pivot("field", arrays).agg(F.array_sort(F.collect_list("value")))
    )
    last = lambda c, cond=None: F.max_by(c, F.when(F.col(c).isNotNull() if cond is None else cond, F.col("seq")))
    fills = [c for c in FILL_IF_EMPTY if c in analyses.columns]
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("seq")))
    agg = analyses.groupBy("event_id").agg(
        last("category", F.coalesce("category", F.lit("General AI")) != "General AI").alias("n_category"),
        last("event_type").alias("n_event_type"),
        F.min_by("funding_amount", F.when(F.coalesce("funding_amount", F.lit(0.0)) != 0, F.col("seq"))).alias("n_funding"),
        F.max_by(F.struct("event_type", "companies", "funding_amount"), "seq").alias("n_last"),
        *[F.max_by(c, "seq").alias(f"n_{c}") for c in ("sentiment", "urgency", "confidence_score") if c in analyses.columns],
        *[first(c).alias(f"n_{c}") for c in fills],
    )
    rec = S.priority_record(as_of, F.col("published_at"), F.col("source_domains"), F.col("source_count"),
                            event_type=F.col("n_last.event_type"), companies=F.col("n_last.companies"),
                            funding=F.col("n_last.funding_amount"))
    keep = F.nullif(F.coalesce("funding_amount", F.lit(0.0)), F.lit(0.0))
    joined = events.drop(*arrays).join(agg, "event_id").join(merged, "event_id", "left").withColumn("p", rec)
    return joined.select(
        "event_id", F.coalesce("n_category", "category").alias("category"),
        F.coalesce("n_event_type", "event_type").alias("event_type"),
        F.coalesce(keep, "n_funding").alias("funding_amount"),
        *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in arrays],
        *[F.col(f"n_{c}").alias(c) for c in ("sentiment", "urgency", "confidence_score") if c in analyses.columns],
        *[F.coalesce(F.nullif(F.col(c), F.lit("")), f"n_{c}").alias(c) for c in fills if c in events.columns],
        "p.priority_score", "p.freshness_score", "p.trust_score", "p.impact_score", "p.is_breaking")


def is_placeholder(analysis_present: Column, model_used: Column, description: Column, snippet: Column,
                   summary: Column) -> Column:
    source = F.trim(F.coalesce(F.nullif(description, F.lit("")), F.nullif(snippet, F.lit("")), F.lit("")))
    short = F.trim(F.coalesce(summary, F.lit("")))
    same = (source != "") & (short != "") & (F.substring(source, 1, 500) == F.substring(short, 1, 500))
    return ~analysis_present | F.coalesce(model_used == "live-fetcher", F.lit(False)) | same


def with_embedding(df: DataFrame, text_col: str, embed: Callable[[pd.Series], Iterable] | None = None,
                   dims: int = 64) -> DataFrame:
    """Adds ``embedding``. With ``embed`` a user function maps a batch of texts to vectors;
    without it, tokens are hashed into ``dims`` counters and scaled to unit length in the JVM."""
    if embed is not None:
        @F.pandas_udf("array<float>")
        def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(list(embed(texts)))

        return df.withColumn("embedding", call(F.col(text_col)))
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.withColumn("_w", tokens(normalize_title(F.col(text_col))))
    counted = HashingTF(numFeatures=dims, inputCol="_w", outputCol="_tf").transform(words)
    scaled = Normalizer(inputCol="_tf", outputCol="_v").transform(counted)
    return scaled.withColumn("embedding", vector_to_array("_v", "float32")).drop("_w", "_tf", "_v")
