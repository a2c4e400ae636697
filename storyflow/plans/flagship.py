"""Flagship plan: title tokens, trust, ranking, newest-first feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.functions.scores import final_score
from storyflow.functions.text import normalize_title, title_fingerprint, tokens
from storyflow.operators.feeds import page, sort_columns
from storyflow.operators.validate import with_trust
from storyflow.plans.data import AS_OF, Data


def ranked_feed(d: Data, size: int = 20) -> DataFrame:
    articles = with_trust(d.f_articles.join(d.f_analyses.select("article_id", "importance_score"), "article_id"), AS_OF)
    scored = articles.withColumn("final_score", final_score(
        AS_OF, F.col("importance_score"), F.col("trust_score"), F.col("published_at"), F.col("is_official")))
    top = page(scored.filter("is_verified"), sort_columns("score"), size=size)
    return top.select(
        "article_id", "title", title_fingerprint(F.col("title")).alias("title_fingerprint"),
        F.size(tokens(normalize_title(F.col("title")), K.STOP_WORDS)).alias("title_words"),
        "source_domain", "trust_score", "final_score", "published_at")
