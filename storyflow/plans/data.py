"""Input tables and the domain views derived from them.

Each view is SQL text that Spark and the checking engine both run, so a query and its
oracle start from the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.session import prepare

AS_OF = "2024-01-31 00:00:00"
DAY = "2024-01-30"
DAY_END = "2024-01-30 23:59:59"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

VIEWS["f_articles"] = """
SELECT doc_id AS article_id, 'doc' || CAST(doc_id AS STRING) AS article_key,
  split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS description, text AS body,
  lang, source AS source_name,
  'https://www.' || source || '.example.com/' || lang || '/' || CAST(doc_id % 700 AS STRING)
    || CASE doc_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '?utm_source=feed' WHEN 2 THEN '#top' ELSE '?page=2&ref=x' END AS url,
  CASE CAST(substr(source, 4) AS INT) % 10
    WHEN 0 THEN 'openai.com' WHEN 1 THEN 'deepmind.google' WHEN 2 THEN 'reuters.com' WHEN 3 THEN 'techcrunch.com'
    WHEN 4 THEN 'arxiv.org' WHEN 5 THEN 'github.com' WHEN 6 THEN 'wired.com' WHEN 7 THEN 'bloomberg.com'
    ELSE source || '.example.net' END AS source_domain,
  CAST(substr(source, 4) AS INT) % 10 IN (0, 1) AS is_official,
  CASE WHEN doc_id % 97 = 0 THEN NULL
    ELSE TIMESTAMP '2024-01-31 00:00:00' - ((doc_id * 7919) % 14400) * INTERVAL '1' MINUTE END AS published_at,
  TIMESTAMP '2024-01-31 00:00:00' - ((doc_id * 7919) % 14400) * INTERVAL '1' MINUTE AS created_at
FROM documents
"""

VIEWS["f_analyses"] = """
SELECT d.doc_id AS article_id,
  CASE d.doc_id % 7 WHEN 0 THEN 'LLMs' WHEN 1 THEN 'AI Agents' WHEN 2 THEN 'Research' WHEN 3 THEN 'Coding'
    WHEN 4 THEN 'Hardware' WHEN 5 THEN 'Finance' ELSE 'General AI' END AS category,
  CASE d.doc_id % 9 WHEN 0 THEN 'model_release' WHEN 1 THEN 'funding' WHEN 2 THEN 'research_paper'
    WHEN 3 THEN 'product_launch' WHEN 4 THEN 'open_source_release' WHEN 5 THEN 'developer_tool'
    WHEN 6 THEN 'government_regulation' WHEN 7 THEN 'gpu' ELSE NULL END AS event_type,
  split(CASE d.doc_id % 5 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Google,NVIDIA' WHEN 2 THEN 'Meta'
    WHEN 3 THEN 'Mistral AI,Microsoft,Cohere' ELSE 'Anthropic' END, ',') AS companies,
  split(CASE d.doc_id % 4 WHEN 0 THEN 'safety,benchmark' WHEN 1 THEN 'funding' WHEN 2 THEN 'open-source,multimodal'
    ELSE 'research-paper' END, ',') AS tags,
  split(lower(split_part(d.text, chr(10), 1)), ' ') AS keywords,
  split(CASE d.doc_id % 6 WHEN 0 THEN 'ChatKit,Studio' WHEN 1 THEN 'Workbench' ELSE 'none' END, ',') AS products_mentioned,
  split(CASE d.doc_id % 3 WHEN 0 THEN 'RAG' WHEN 1 THEN 'RLHF,MoE' ELSE 'Transformers' END, ',') AS technologies_mentioned,
  split(CASE d.doc_id % 4 WHEN 0 THEN 'GPT-5' WHEN 1 THEN 'Llama 4,Claude' WHEN 2 THEN 'Gemini' ELSE 'Mistral' END, ',') AS models_mentioned,
  CASE WHEN d.doc_id % 9 = 1 THEN CAST((d.doc_id * 37) % 1500 AS DOUBLE) END AS funding_amount,
  split_part(d.text, chr(10), 2) AS summary,
  CASE WHEN d.doc_id % 17 = 0 THEN 'live-fetcher' ELSE 'model-a' END AS model_used,
  CASE d.doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS sentiment,
  CAST(30 + 40 * coalesce(l.quality, 0) - 20 * coalesce(l.toxic, 0) + d.doc_id % 30 AS DOUBLE) AS importance_score
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

VIEWS["f_news"] = """
SELECT a.*,
  CAST(30 + (a.article_id * 17) % 66 AS DOUBLE) AS trust_score,
  30 + (a.article_id * 17) % 66 >= 40 AS is_verified,
  a.article_id % 13 = 5 AS is_duplicate,
  a.article_id % 11 <> 3 AS ai_processed,
  n.importance_score,
  CAST((a.article_id * 613) % 1000 AS DOUBLE) / 10 AS priority_score,
  CAST((a.article_id * 419) % 1000 AS DOUBLE) / 10 AS final_score
FROM f_articles a JOIN f_analyses n ON n.article_id = a.article_id
"""

# Analyses as stored beside articles: some articles have none yet.
VIEWS["f_stored"] = "SELECT article_id, category, event_type, companies, tags, keywords, products_mentioned, " \
    "technologies_mentioned, models_mentioned, funding_amount, summary, model_used, sentiment FROM f_analyses WHERE article_id % 19 <> 7"

VIEWS["f_users"] = """
SELECT user_id, min(ts) AS created_at, max(ts) AS last_seen_at, user_id % 11 <> 0 AS is_active,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'tok' || CAST(user_id AS STRING) END AS push_token
FROM events GROUP BY user_id
"""

VIEWS["f_preferences"] = """
SELECT user_id,
  split(CASE user_id % 4 WHEN 0 THEN 'LLMs' WHEN 1 THEN 'Research,Coding' WHEN 2 THEN 'Hardware' ELSE 'Finance' END, ',') AS favorite_categories,
  split(CASE user_id % 3 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Google,Meta' ELSE 'NVIDIA' END, ',') AS favorite_companies,
  split(CASE user_id % 3 WHEN 0 THEN 'agents' WHEN 1 THEN 'rag,llms' ELSE 'quantization' END, ',') AS favorite_topics,
  split(CASE user_id % 5 WHEN 0 THEN 'gpu' ELSE 'zz-none' END, ',') AS blocked_topics
FROM f_users WHERE user_id % 7 <> 6
"""

VIEWS["f_bookmarks"] = """
SELECT user_id, article_id, min(ts) AS created_at FROM (
  SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_id % (SELECT count(*) FROM documents) AS article_id
  FROM events WHERE event_type = 'purchase') x
GROUP BY user_id, article_id
"""

VIEWS["f_sources"] = """
SELECT source AS source_name, count(*) AS total_articles_fetched, CAST(substr(source, 4) AS INT) % 6 <> 5 AS is_active,
  CAST(substr(source, 4) AS INT) % 7 AS consecutive_failures, CAST(substr(source, 4) AS INT) % 4 AS tier,
  CASE WHEN CAST(substr(source, 4) AS INT) % 10 IN (0, 1) THEN 'Company ' || substr(source, 4) END AS official_company
FROM documents GROUP BY source
"""

VIEWS["f_story_events"] = """
SELECT a.article_id AS event_id, a.title AS headline, a.body AS summary,
  n.category, n.event_type, n.companies, n.tags, n.keywords, n.funding_amount, n.models_mentioned, n.technologies_mentioned,
  CASE WHEN a.article_id % 23 = 0 THEN '2401.' || CAST(a.article_id AS STRING) END AS arxiv_id,
  CAST((a.article_id * 613) % 1000 AS DOUBLE) / 10 AS priority_score,
  CAST((a.article_id * 389) % 1000 AS DOUBLE) / 10 AS freshness_score,
  (a.article_id * 613) % 1000 >= 950 AS is_breaking, a.article_id % 5 = 0 AS notification_sent,
  split(CASE WHEN a.article_id % 6 = 0 THEN a.source_domain || ',github.com' ELSE a.source_domain END, ',') AS source_domains,
  a.source_domain AS primary_source_domain, a.url AS primary_source_url,
  CASE WHEN a.article_id % 8 = 0 THEN a.body END AS business_opportunities,
  CASE WHEN a.article_id % 13 = 0 THEN reverse(a.body) END AS risks,
  a.published_at, a.created_at
FROM f_articles a JOIN f_analyses n ON n.article_id = a.article_id
"""

VIEWS["f_event_vectors"] = "SELECT e.*, v.embedding FROM f_story_events e LEFT JOIN embeddings v ON v.vec_id = e.event_id"

VIEWS["f_briefs"] = "\nUNION ALL\n".join(f"""
SELECT user_id, user_id * 10 + {k} AS brief_id, DATE '2024-01-30' - INTERVAL '{k}' DAY AS brief_ts,
  CAST(5 + (user_id + {k}) % 10 AS INT) AS total_articles, (user_id + {k}) % 4 = 0 AS notification_sent,
  split(CAST((user_id * 31 + {k}) % 190 AS STRING) || ',' || CAST((user_id * 17 + 3) % 190 AS STRING) || ','
    || CAST((user_id * 7 + 11) % 190 AS STRING), ',') AS article_keys
FROM f_users""" for k in range(3))

VIEWS["f_notifications"] = """
SELECT event_id AS notification_id, user_id, CAST(ts AS TIMESTAMP) AS created_at, event_type AS notification_type, event_id % 3 = 0 AS is_read
FROM events
"""

_NAMES = re.compile(r"(?<![.\w'])(" + "|".join(sorted(TABLES + list(VIEWS), key=len, reverse=True)) + r")(?![\w'.])")


def _dependencies(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAMES.findall(sql)))


def with_views(sql: str) -> str:
    """Oracle text with the views it names as a leading WITH list."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _dependencies(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    # Only names that the text really selects from are needed; extra views are harmless.
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    body = sql.strip()
    if not ctes:
        return body
    if re.match(r"(?i)with recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n" + re.sub(r"(?i)^with recursive\s*", "", body)
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n" + re.sub(r"(?i)^with\s*", "", body)
    return f"WITH {ctes}\n{body}"


#: What a view needs of a table, where it moves the table's rows before it selects from them: f_analyses names the first two lines of a text.
_NEEDED = {("f_analyses", "documents"): lambda documents: documents.withColumn("text", F.substring_index("text", "\n", 2))}


class Data:
    """Tables and views of one data folder, by attribute; each is built once and lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in VIEWS:
                deps = _dependencies(VIEWS[name])
                text = _NAMES.sub(lambda m: "{" + m.group(1) + "}", VIEWS[name])
                self._built[name] = self.spark.sql(text, **{d: _NEEDED.get((name, d), lambda table: table)(getattr(self, d)) for d in deps})
            elif name in TABLES:
                self._built[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._built[name]

    def stream(self, name: str) -> DataFrame:
        """The same table as a file stream. A glob path may lead to one file or to a folder of part files; a plain one has to be a folder."""
        return self.spark.readStream.schema(getattr(self, name).schema).parquet(f"{self.folder}/{name}[.]parquet")
