"""Duplicate detection: hash layers, vectors, components and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.config import DEFAULT, EngineConfig
from storyflow.functions.dates import hours_before
from storyflow.functions.text import (
    content_fingerprint, entity_fingerprint, normalize_url, title_fingerprint, url_dedup_key,
)
from storyflow.operators.vectors import cosine_join
from storyflow.session import materialize

HASH_LAYERS = ("url", "title_hash", "content_hash")


def with_fingerprints(articles: DataFrame) -> DataFrame:
    """Adds ``normalized_url``, ``title_fingerprint`` and ``content_fingerprint``."""
    return articles.withColumns({
        "normalized_url": normalize_url(F.col("url")),
        "title_fingerprint": title_fingerprint(F.col("title")),
        "content_fingerprint": content_fingerprint(F.col("title"), F.col("content_snippet")),
    })


def source_tier(source_name: Column) -> Column:
    table = {s: tier for s, tier, _, _ in K.SOURCE_REGISTRY}
    table |= {alias: table[name] for alias, name in K.SOURCE_ALIASES.items()}
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, source_name), F.lit(K.DEFAULT_TIER))


def best_per_url(articles: DataFrame, key: Column | None = None, tier: Column | None = None) -> DataFrame:
    """One row per url: lowest tier, newest, smallest id. A minimum over a struct, combined
    before the shuffle, so a url with very many copies sends one row per task."""
    key = url_dedup_key(F.col("url")) if key is None else key
    tier = source_tier(F.col("source_name")) if tier is None else tier
    order = F.struct(tier.alias("tier"), F.coalesce(-F.unix_micros("published_at"), F.lit(0)).alias("t"),
                     F.col("article_id").alias("i"))
    return (
        articles.groupBy(key.alias("url_key"))
        .agg(F.min_by(F.struct(*articles.columns), order).alias("r")).select("url_key", "r.*")
    )


def match_layer(batch: DataFrame, history: DataFrame, key: str, layer: str) -> DataFrame:
    """Equi-join on one fingerprint with the non-duplicate history; smallest id is canonical."""
    canon = (
        history.filter(~F.col("is_duplicate") & F.col(key).isNotNull() & (F.col(key) != ""))
        .groupBy(key).agg(F.min("article_id").alias("canonical_id"))
    )
    return batch.select("article_id", key).join(canon, key).select(
        "article_id", "canonical_id", F.lit(layer).alias("layer"), F.lit(1.0).alias("score"))


def _layer_keys(df: DataFrame, id_alias: str) -> DataFrame:
    """One row per (article, layer): ``(rank, key, id)``."""
    entries = F.array(
        F.struct(F.lit(0).alias("rank"), F.col("normalized_url").alias("key")),
        F.struct(F.lit(1).alias("rank"), F.col("title_fingerprint").alias("key")),
        F.struct(F.lit(2).alias("rank"), F.col("content_fingerprint").alias("key")),
    )
    return df.select(F.col("article_id").alias(id_alias), F.explode(entries).alias("e")).select(id_alias, "e.rank", "e.key")


def hash_duplicates(batch: DataFrame, history: DataFrame) -> DataFrame:
    """First hash layer that hits, all three layers in one join: ``(article_id, canonical_id, layer, score)``."""
    canon = (_layer_keys(history.filter(~F.col("is_duplicate")), "canonical_id")
             .groupBy("rank", "key").agg(F.min("canonical_id").alias("canonical_id")))
    hits = _layer_keys(batch, "article_id").join(canon, ["rank", "key"])
    names = F.array(*[F.lit(x) for x in HASH_LAYERS])
    return (
        hits.groupBy("article_id").agg(F.min(F.struct("rank", "canonical_id")).alias("m"))
        .select("article_id", F.col("m.canonical_id").alias("canonical_id"),
                F.element_at(names, F.col("m.rank") + 1).alias("layer"), F.lit(1.0).alias("score"))
    )


def semantic_duplicates(batch: DataFrame, history: DataFrame, as_of, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Best cosine against the last 48 hours of non-duplicate history. All of it competes."""
    recent = history.filter(
        ~F.col("is_duplicate") & F.col("embedding").isNotNull()
        & (F.col("created_at") >= hours_before(as_of, cfg.semantic_window_hours)))
    pairs = cosine_join(
        batch.select(F.col("article_id").alias("id"), F.col("embedding").alias("v")),
        recent.select(F.col("article_id").alias("id"), F.col("embedding").alias("v")),
        cfg.semantic_duplicate, cfg)
    return pairs.select(F.col("left_id").alias("article_id"), F.col("right_id").alias("canonical_id"),
                        F.lit("semantic_similarity").alias("layer"), "score")


def cascade(batch: DataFrame, history: DataFrame, as_of, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Hash layers first; only rows they leave open reach the vectors.
    ``(article_id, is_duplicate, canonical_id, layer, score)`` for every batch row."""
    exact = materialize(hash_duplicates(batch, history), "exact")
    survivors = batch.join(exact.select("article_id"), "article_id", "left_anti")
    near = semantic_duplicates(survivors, history, as_of, cfg)
    found = exact.unionByName(near)
    return batch.select("article_id").join(found, "article_id", "left").select(
        "article_id", F.col("canonical_id").isNotNull().alias("is_duplicate"), "canonical_id", "layer",
        F.coalesce("score", F.lit(0.0)).alias("score"))


def entity_duplicates(batch: DataFrame, history: DataFrame) -> DataFrame:
    """After enrichment: same companies, product and event type."""
    fp = lambda df: df.withColumn("entity_fingerprint", entity_fingerprint(
        F.col("companies"), F.col("product"), F.col("event_type")))
    return match_layer(fp(batch), fp(history), "entity_fingerprint", "entity_fingerprint")


def supporting_sources(articles: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``(canonical_id, url)``: urls a canonical article already has and those of its duplicates,
    each once. Kept as rows, because one story may have any number of copies."""
    added = (
        duplicates.filter(F.col("canonical_id").isNotNull())
        .join(articles.select("article_id", "url"), "article_id").select("canonical_id", "url")
    )
    known = articles.select(F.col("article_id").alias("canonical_id"), F.explode("supporting_sources").alias("url"))
    return known.unionByName(added).distinct()


def components(keys: DataFrame) -> DataFrame:
    """``(id, key)`` -> ``(id, label)``: rows that share a key, directly or through others, get
    the smallest ``id`` of their group.

    Each round takes minima per key and per id (combined before the shuffle, so a key or a
    group of any size is cheap) and then jumps to the label of the label. Ends when a
    round changes nothing."""
    keys = materialize(keys.distinct(), "keys")
    labels = materialize(keys.groupBy("key").agg(F.min("id").alias("m")).join(keys, "key")
                         .groupBy("id").agg(F.min("m").alias("label")), "labels")
    while True:
        per_key = keys.join(labels, "id").groupBy("key").agg(F.min("label").alias("m"))
        nearer = keys.join(per_key, "key").groupBy("id").agg(F.min("m").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = nearer.join(jump, "label", "left").select("id", F.least("label", F.coalesce("next", "label")).alias("label"))
        new = materialize(moved, "labels")
        changed = new.join(labels.withColumnRenamed("label", "old"), "id").filter(F.col("label") != F.col("old"))
        stop = changed.isEmpty()
        labels = new
        if stop:
            return labels


def intra_batch(batch: DataFrame) -> DataFrame:
    """Transitive duplicates inside one batch over the three fingerprints. The canonical row of
    a group is the first by (official, time, id): ``(article_id, canonical_id, is_duplicate)``."""
    keys = _layer_keys(batch, "id").select("id", F.concat_ws(":", F.col("rank").cast("string"), "key").alias("key"))
    labels = components(keys).withColumnRenamed("id", "article_id")
    order = F.struct((~F.col("is_official")).alias("o"),
                     F.coalesce(F.unix_micros("published_at"), F.lit(2**62)).alias("t"), F.col("article_id").alias("i"))
    labelled = batch.select("article_id", order.alias("ord")).join(labels, "article_id")
    canon = labelled.groupBy("label").agg(F.min("ord").alias("m")).select("label", F.col("m.i").alias("canonical_id"))
    return labelled.join(canon, "label").select(
        "article_id", "canonical_id", (F.col("article_id") != F.col("canonical_id")).alias("is_duplicate"))


def duplicate_report(results: DataFrame) -> DataFrame:
    """Rows, duplicates and rate per source and layer, with subtotals."""
    return results.rollup("source_name", "layer").agg(
        F.count("*").alias("articles"), F.count_if("is_duplicate").alias("duplicates"))
