"""Trend, digest, feed, statistics, search and notification queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.functions import text as T
from storyflow.operators import digest as DG
from storyflow.operators import feeds as FQ
from storyflow.operators import notify as NT
from storyflow.operators import personalize as PZ
from storyflow.operators import search as SE
from storyflow.operators import stats as AG
from storyflow.operators import trends as TR
from storyflow.plans.data import AS_OF, DAY, DAY_END
from storyflow.plans.q_scalar import LIVE, _norm_url
from storyflow.plans.registry import NOW, half_even, joined, norm_title, query, sql_in, sql_list, stamp, text_ts
from storyflow.session import scratch_path
from storyflow.sources import tables as TB

# ------------------------------------------------------------------ TR

_VEL = (f"CASE WHEN prior = 0 THEN CASE WHEN cur > 0 THEN 100e0 ELSE 0e0 END ELSE {half_even('(cur - prior) * 1e0 / prior * 100e0')} END")
_TSCORE = half_even(f"least(100e0, least(50e0, log2(cur + 1) * 10e0) + least(50e0, greatest(0e0, {_VEL}) / 4e0))")
_SLUG = lambda c: (f"substr(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), "
                   f"'^-+|-+$', '', 'g'), 1, 100)")
_PRETTY = "array_to_string(list_transform(string_split(event_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"

_LONG = f"""
m AS (
  SELECT event_id, published_at, priority_score, headline, primary_source_domain, 'company' AS type, unnest(companies) AS name FROM f_story_events
  UNION ALL SELECT event_id, published_at, priority_score, headline, primary_source_domain, 'topic', {_PRETTY} FROM f_story_events WHERE event_type IS NOT NULL
  UNION ALL SELECT event_id, published_at, priority_score, headline, primary_source_domain, 'model', unnest(models_mentioned) FROM f_story_events
  UNION ALL SELECT event_id, published_at, priority_score, headline, primary_source_domain, 'keyword', lower(unnest(keywords)) FROM f_story_events
  UNION ALL SELECT event_id, published_at, priority_score, headline, primary_source_domain, 'technology', unnest(technologies_mentioned) FROM f_story_events),
w AS (SELECT unnest([6, 24, 168]) AS hours),
c AS (
  SELECT hours, type, name, count_if(published_at >= {NOW} - hours * INTERVAL 1 HOUR)::BIGINT AS cur,
    count_if(published_at < {NOW} - hours * INTERVAL 1 HOUR)::BIGINT AS prior,
    count(DISTINCT CASE WHEN published_at >= {NOW} - hours * INTERVAL 1 HOUR THEN primary_source_domain END)::BIGINT AS sources,
    array_to_string(list_transform(list(event_id ORDER BY priority_score DESC, event_id)
      FILTER (WHERE published_at >= {NOW} - hours * INTERVAL 1 HOUR)[1:5], lambda x: x::VARCHAR), ',') AS ids,
    first(headline ORDER BY priority_score DESC, event_id) FILTER (WHERE published_at >= {NOW} - hours * INTERVAL 1 HOUR) AS top
  FROM m, w WHERE name <> '' AND published_at >= {NOW} - 2 * hours * INTERVAL 1 HOUR AND published_at < {NOW}
  GROUP BY hours, type, name)"""

_MIN_LEN = "CASE type WHEN 'company' THEN 2 WHEN 'topic' THEN 1 WHEN 'model' THEN 3 WHEN 'keyword' THEN 4 ELSE 3 END"
_TOP = "CASE type WHEN 'company' THEN 20 WHEN 'topic' THEN 15 WHEN 'model' THEN 15 WHEN 'keyword' THEN 20 ELSE 10 END"
_RANKED = _LONG + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY hours, type ORDER BY cur DESC, name) AS rk, {_VEL} AS vel, {_TSCORE} AS score
  FROM c WHERE cur > 0 AND length(name) >= {_MIN_LEN}),
k AS (SELECT *, row_number() OVER (PARTITION BY hours, type ORDER BY rk) AS pos FROM r WHERE rk <= {_TOP}
  AND CASE type WHEN 'keyword' THEN cur >= 2 OR vel >= 50 WHEN 'technology' THEN cur >= 2 ELSE true END),
t AS (SELECT * FROM k WHERE type <> 'keyword' OR pos <= 10)"""

_TREND_SELECT = f"""type AS trend_type, name, hours::INT AS period_hours, cur AS mention_count, prior AS previous_mention_count, sources AS source_count,
  vel AS velocity, score AS trend_score, prior = 0 AND cur >= 2 AS is_emerging, {_SLUG('name')} AS slug, ids AS related_ids,
  CASE WHEN type IN ('keyword', 'technology') THEN NULL ELSE substr(top, 1, 200) END AS top_headline"""


@query("tr_01", f"WITH {_LONG} SELECT hours::INT AS period_hours, type, name, cur AS mention_count, prior AS previous_mention_count FROM c")
def _(d):
    return TR.window_counts(d.f_story_events, AS_OF).select("period_hours", "type", "name", "mention_count", "previous_mention_count")


def _trend(d, types=tuple(TR.TYPES), hours=TR.WINDOWS):
    t = TR.trends(d.f_story_events, AS_OF, hours, types)
    return t.select("trend_type", "name", "period_hours", "mention_count", "previous_mention_count", "source_count", "velocity",
                    "trend_score", "is_emerging", "slug", joined("related_event_ids").alias("related_ids"), "top_headline")


for _i, _type in enumerate(TR.TYPES):
    query(f"tr_{2 + _i:02d}", f"WITH {_RANKED} SELECT {_TREND_SELECT} FROM t WHERE type = '{_type}' AND hours = 24")(
        lambda d, _type=_type: _trend(d, (_type,), (24,)))


@query("tr_07", f"WITH {_LONG} SELECT hours::INT AS period_hours, type, name, {_VEL} AS velocity FROM c")
def _(d):
    c = TR.window_counts(d.f_story_events, AS_OF)
    return c.select("period_hours", "type", "name", TR.velocity(F.col("mention_count"), F.col("previous_mention_count")).alias("velocity"))


@query("tr_08", f"WITH {_LONG} SELECT hours::INT AS period_hours, type, name, {_TSCORE} AS trend_score FROM c")
def _(d):
    c = TR.window_counts(d.f_story_events, AS_OF)
    v = TR.velocity(F.col("mention_count"), F.col("previous_mention_count"))
    return c.select("period_hours", "type", "name", TR.trend_score(F.col("mention_count"), v).alias("trend_score"))


@query("tr_09", f"WITH {_LONG} SELECT hours::INT AS period_hours, type, name, prior = 0 AND cur >= 2 AS is_emerging FROM c")
def _(d):
    c = TR.window_counts(d.f_story_events, AS_OF)
    return c.select("period_hours", "type", "name", TR.is_emerging(F.col("mention_count"), F.col("previous_mention_count")).alias("is_emerging"))


@query("tr_10", f"WITH {_RANKED} SELECT {_TREND_SELECT} FROM t")
def _(d):
    return _trend(d)


@query("tr_12", f"WITH {_RANKED} SELECT type AS trend_type, name, score AS trend_score FROM t WHERE hours = 24 ORDER BY score DESC, type, name LIMIT 20")
def _(d):
    return TR.top_trends(TR.trends(d.f_story_events, AS_OF, with_ids=False), AS_OF, 24).select("trend_type", "name", "trend_score")


_DAY = "published_at BETWEEN TIMESTAMP '2024-01-29 23:59:59' AND TIMESTAMP '2024-01-30 23:59:59'"


@query("tr_14", f"""
WITH m AS (SELECT event_id, priority_score, headline, unnest(companies) AS company FROM f_story_events WHERE {_DAY}),
c AS (SELECT company, count(*)::BIGINT AS n FROM m GROUP BY 1 ORDER BY n DESC, company LIMIT 10),
r AS (SELECT m.company, n, headline, priority_score, row_number() OVER (PARTITION BY m.company ORDER BY priority_score DESC, event_id) AS pos FROM m JOIN c ON m.company = c.company)
SELECT company, n AS mention_count, pos::INT AS pos, substr(headline, 1, 100) AS headline, priority_score FROM r WHERE pos <= 3""")
def _(d):
    best = TR.company_ranking(DG.for_day(d.f_story_events, DAY))
    return best.select("company", "mention_count", F.explode("top_events").alias("e")).select("company", "mention_count", "e.*")


# ------------------------------------------------------------------ DG

_SECTIONS = {
    "top": "true", "funding": "coalesce(event_type, '') = 'funding' OR coalesce(funding_amount, 0) > 0",
    "research": "coalesce(event_type, '') IN ('research_paper', 'benchmark') OR arxiv_id IS NOT NULL",
    "launch": "event_type IN ('product_launch', 'model_release', 'api_release')", "open_source": "event_type = 'open_source_release'",
    "github": "len(list_filter(source_domains, lambda x: contains(x, 'github.com'))) > 0",
    "tools": "event_type IN ('developer_tool', 'framework', 'coding_ai')",
    "opportunity": "length(business_opportunities) > 20", "risk": "length(risks) > 20",
}


@query("dg_01", f"SELECT event_id, priority_score FROM f_story_events WHERE {_DAY}")
def _(d):
    return DG.for_day(d.f_story_events, DAY).select("event_id", "priority_score")


def _register_section(key: str, name: str):
    order = "coalesce(funding_amount, 0e0) DESC, " if name == "funding" else ""
    n = DG.SECTION_SIZE.get(name, 5)
    query(key, f"SELECT event_id, priority_score, funding_amount FROM f_story_events WHERE ({_SECTIONS[name]}) AND {_DAY} "
               f"ORDER BY {order}priority_score DESC, event_id LIMIT {n}")(
        lambda d: DG.section(DG.for_day(d.f_story_events, DAY), name).select("event_id", "priority_score", "funding_amount"))


for _i, _name in enumerate(["top", "funding", "research", "launch", "open_source", "github", "tools"]):
    _register_section(f"dg_{2 + _i:02d}", _name)


@query("dg_09", f"""
(SELECT 'opportunity' AS kind, event_id, substr(business_opportunities, 1, 300) AS snippet FROM f_story_events
 WHERE length(business_opportunities) > 20 AND {_DAY} ORDER BY priority_score DESC, event_id LIMIT 5)
UNION ALL (SELECT 'risk', event_id, substr(risks, 1, 300) FROM f_story_events WHERE length(risks) > 20 AND {_DAY} ORDER BY priority_score DESC, event_id LIMIT 5)""")
def _(d):
    e = DG.for_day(d.f_story_events, DAY)
    one = lambda k, c: DG.snippets(e, c).select(F.lit(k).alias("kind"), "event_id", "snippet")
    return one("opportunity", "business_opportunities").unionByName(one("risk", "risks"))


@query("dg_10", "WITH s AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS section, event_id, row_number() OVER (ORDER BY {'coalesce(funding_amount, 0e0) DESC, ' if n == 'funding' else ''}priority_score DESC, event_id)::INT AS pos "
    f"FROM f_story_events WHERE ({p}) AND {_DAY}" for n, p in _SECTIONS.items()) + f""")
SELECT section, event_id, pos, (SELECT count(*) FROM f_story_events WHERE {_DAY})::BIGINT AS total_events,
  (SELECT count_if(is_breaking) FROM f_story_events WHERE {_DAY})::BIGINT AS breaking_count FROM s WHERE pos <= CASE section WHEN 'top' THEN 10 ELSE 5 END""")
def _(d):
    e = DG.for_day(d.f_story_events, DAY)
    k = F.lit(1).alias("_k")
    return (DG.digest(e).select("section", "event_id", "pos", k).join(DG.totals(e).select("*", k), "_k").drop("_k"))


@query("dg_11", f"""
WITH t AS (SELECT event_id, priority_score, summary FROM f_story_events WHERE {_DAY} ORDER BY priority_score DESC, event_id LIMIT 5)
SELECT substr(array_to_string(list(summary ORDER BY priority_score DESC, event_id)[1:3], ' '), 1, 600) AS market_summary FROM t WHERE summary <> ''""")
def _(d):
    return DG.extractive_summary(DG.for_day(d.f_story_events, DAY))


@query("dg_12", """
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) > 20) AS ls FROM documents)
SELECT doc_id, array_to_string(list_transform(ls, lambda x: regexp_replace(x, '^[0-9.\\-) ]+', ''))[1:3], chr(10)) AS predictions FROM l""")
def _(d):
    return d.documents.select("doc_id", F.array_join(DG.parse_predictions(F.col("text")), "\n").alias("predictions"))


@query("dg_13", f"""
WITH t AS (SELECT event_id, headline, priority_score FROM f_story_events WHERE published_at >= {NOW} - INTERVAL 7 DAY ORDER BY priority_score DESC, event_id LIMIT 5)
SELECT array_to_string(list(event_id ORDER BY priority_score DESC, event_id), ',') AS event_ids,
  sha256(string_agg(event_id || ':' || headline, '' ORDER BY priority_score DESC, event_id)) AS hash_key FROM t""")
def _(d):
    return DG.weekly_brief(d.f_story_events, AS_OF).select(joined("event_ids").alias("event_ids"), "hash_key")


@query("dg_14", f"""
SELECT event_id, headline, category, event_type, {half_even('priority_score', 1)} AS priority_score, array_to_string(companies[1:5], ',') AS companies,
  array_to_string(tags[1:5], ',') AS tags, array_to_string(source_domains[1:5], ',') AS source_domains, len(source_domains)::INT AS source_count,
  {stamp('published_at')} AS published_at, primary_source_url, funding_amount FROM f_story_events""")
def _(d):
    return DG.digest_row(d.f_story_events).withColumns({c: joined(c) for c in ("companies", "tags", "source_domains")}).withColumn(
        "published_at", text_ts("published_at")).drop("summary")


# ------------------------------------------------------------------ SE

# Every turn of a user is a query; its vector is one of the table's, dealt by the turn's number.
_QUERIES = "SELECT conv_id * 100 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'"
_RECENT = f"published_at >= {NOW} - INTERVAL 7 DAY"


def _vector_queries(d):
    own = d.conversations.filter("role = 'user'").select(
        F.expr("conv_id * 100 + turn").alias("query_id"), F.col("text").alias("query"), F.expr(f"(conv_id * 7 + turn) % {d.embeddings.count()}").alias("vec_id"))
    return own.join(d.embeddings.select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")


@query("se_01", f"""
SELECT event_id, headline, priority_score FROM f_story_events
WHERE {_RECENT} AND (contains(lower(headline), 'the') OR contains(lower(headline), 'ing') OR contains(lower(headline), 'eau'))
ORDER BY priority_score DESC, event_id LIMIT 50""")
def _(d):
    return SE.keyword_search(d.f_story_events, "The ing of eau", AS_OF).select("event_id", "headline", "priority_score")


_COS = "round_even(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) * 1e6, 0) / 1e6"
_SEM = f"""
s AS (SELECT q.query_id, e.event_id, {half_even(_COS, 4)} AS similarity_score
  FROM (SELECT c.conv_id * 100 + c.turn AS query_id, v.embedding FROM conversations c JOIN embeddings v
    ON v.vec_id = (c.conv_id * 7 + c.turn) % (SELECT count(*) FROM embeddings) WHERE c.role = 'user') q
  JOIN f_event_vectors e ON e.embedding IS NOT NULL WHERE {_RECENT} AND {_COS} >= 0.78e0)"""
_KW = f"""
tm AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 2)) AS term FROM q),
kw AS (SELECT query_id, event_id FROM (SELECT query_id, event_id, row_number() OVER (PARTITION BY query_id ORDER BY priority_score DESC, event_id) AS rn
  FROM (SELECT DISTINCT query_id, event_id, priority_score FROM tm JOIN f_story_events ON contains(lower(headline), term) AND {_RECENT} AND {{kw}})) WHERE rn <= 50)"""


@query("se_02", f"WITH {_SEM} SELECT * FROM s")
def _(d):
    return SE.semantic_matches(_vector_queries(d), d.f_event_vectors, AS_OF)


_MERGE = f"""
b AS (SELECT query_id, event_id, similarity_score, 'semantic' AS match_type FROM s
  UNION ALL SELECT query_id, event_id, 0.7e0, 'keyword' FROM kw WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = kw.query_id AND s.event_id = kw.event_id)),
j AS (SELECT b.*, e.category, {half_even("similarity_score * 0.6e0 + " + half_even('priority_score', 1) + " / 100e0 * 0.4e0", 6)} AS combined_score
  FROM b JOIN f_story_events e ON e.event_id = b.event_id),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, event_id)::INT AS pos FROM j WHERE {{cond}})
SELECT query_id, event_id, match_type, similarity_score, combined_score, pos FROM p WHERE pos <= 20"""
_HITS = ["query_id", "event_id", "match_type", "similarity_score", "combined_score", "pos"]


@query("se_03", f"WITH q AS ({_QUERIES}), {_SEM}, {_KW.format(kw="category = 'Research'")}, {_MERGE.format(cond=chr(99) + 'ategory = ' + chr(39) + 'Research' + chr(39))}")
def _(d):
    return SE.search_many(_vector_queries(d), d.f_event_vectors, AS_OF, category="Research").select(*_HITS)


_SEARCH = (f"is_verified AND NOT is_duplicate AND (contains({norm_title('a.title')}, 'the ing') OR contains(lower(coalesce(a.description, '')), 'the ing') "
           f"OR contains(lower(coalesce(n.summary, '')), 'the ing') OR coalesce(list_contains(n.keywords, 'the ing'), false))")


@query("se_04", f"""
SELECT a.article_id, a.title, a.final_score, (SELECT count(*) FROM f_news a LEFT JOIN f_stored n ON n.article_id = a.article_id WHERE {_SEARCH})::BIGINT AS total
FROM f_news a LEFT JOIN f_stored n ON n.article_id = a.article_id WHERE {_SEARCH} ORDER BY a.final_score DESC, a.article_id LIMIT 20""")
def _(d):
    hits = SE.search_articles(d.f_news.select("article_id", "title", "description", "final_score", "is_verified", "is_duplicate"),
                              d.f_stored.select("article_id", "summary", "keywords", "category"), "the ing")
    k = F.lit(1).alias("_k")
    first = FQ.page(hits, [F.desc("final_score"), F.asc("article_id")]).select("article_id", "title", "final_score", k)
    return first.join(hits.agg(F.count("*").alias("total")).select("total", k), "_k").drop("_k")


@query("se_05", f"WITH q AS ({_QUERIES}), {_SEM}, {_KW.format(kw='true')}, {_MERGE.format(cond='true')}")
def _(d):
    return SE.search_many(_vector_queries(d), d.f_event_vectors, AS_OF).select(*_HITS)


_TERMS = """
SELECT conv_id, turn, u.pos::INT AS pos, u.term FROM (
  SELECT conv_id, turn, unnest(list_transform(range(1, len(ts) + 1), lambda i: {'pos': i, 'term': ts[i]})) AS u FROM (
    SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2) AS ts FROM conversations))"""


@query("ud_04", _TERMS)
def _(d):
    return d.conversations.select("conv_id", "turn", F.posexplode(SE.search_terms(F.col("text"))).alias("p", "term")).select(
        "conv_id", "turn", (F.col("p") + 1).alias("pos"), "term")


@query("ud_04_sql", _TERMS)
def _(d):
    """The table function, from SQL."""
    SE.register_functions(d.spark)
    return d.spark.sql("SELECT conv_id, turn, t.pos, t.term FROM {turns}, LATERAL search_terms(text) AS t", turns=d.conversations)


# ------------------------------------------------------------------ FQ

_PUB = "is_verified AND NOT is_duplicate AND ai_processed"
_A = "article_id, title, source_domain, trust_score, is_verified, is_duplicate, ai_processed, published_at, created_at, final_score, url"


def _news(d):
    return d.f_news.select(*_A.split(", "))


def _stored(d):
    return d.f_stored.select("article_id", "category", "companies", "tags")


@query("fq_01", f"""
SELECT 'all' AS feed, a.article_id, n.category FROM f_news a LEFT JOIN f_stored n ON n.article_id = a.article_id WHERE {_PUB}
UNION ALL SELECT 'category', a.article_id, n.category FROM f_news a JOIN f_stored n ON n.article_id = a.article_id WHERE {_PUB} AND n.category = 'Research'""")
def _(d):
    one = lambda k, df: df.select(F.lit(k).alias("feed"), "article_id", "category")
    return one("all", FQ.article_feed(_news(d), _stored(d))).unionByName(one("category", FQ.article_feed(_news(d), _stored(d), category="Research")))


@query("fq_02", f"""
SELECT a.article_id, n.category FROM f_news a JOIN f_stored n ON n.article_id = a.article_id WHERE {_PUB}
AND (n.category IN ('LLMs', 'Coding') OR list_has_any(n.companies, ['OpenAI', 'Cohere']) OR list_has_any(n.tags, ['safety']))""")
def _(d):
    prefs = {"categories": ["LLMs", "Coding"], "companies": ["OpenAI", "Cohere"], "topics": ["safety"]}
    return FQ.article_feed(_news(d), _stored(d), preferences=prefs).select("article_id", "category")


@query("fq_03", f"SELECT a.article_id FROM f_news a JOIN f_stored n ON n.article_id = a.article_id WHERE {_PUB} AND list_contains(n.companies, 'Google')")
def _(d):
    return FQ.article_feed(_news(d), _stored(d), company="Google").select("article_id")


@query("fq_04", f"SELECT article_id FROM f_news WHERE {_PUB} AND published_at >= TIMESTAMP '2024-01-25' AND published_at < TIMESTAMP '2024-01-28'")
def _(d):
    return FQ.article_feed(_news(d), _stored(d), from_date="2024-01-25", to_date="2024-01-27").select("article_id")


@query("fq_05", f"SELECT count(*)::BIGINT AS total, greatest(1, ceil(count(*) / 20e0))::BIGINT AS pages FROM f_news WHERE {_PUB}")
def _(d):
    return FQ.page_info(FQ.article_feed(_news(d), _stored(d)))


@query("fq_06", " UNION ALL ".join(
    f"(SELECT '{m}' AS mode, article_id, row_number() OVER (ORDER BY {o})::INT AS pos FROM f_news WHERE {_PUB} ORDER BY {o} LIMIT 20)"
    for m, o in (("date", "published_at DESC NULLS LAST, article_id"), ("trust", "trust_score DESC, published_at DESC NULLS LAST, article_id"),
                 ("score", "published_at DESC NULLS LAST, final_score DESC, article_id"))))
def _(d):
    out = None
    for mode in ("date", "trust", "score"):
        top = FQ.page(FQ.published(_news(d)), FQ.sort_columns(mode))
        one = top.select(F.lit(mode).alias("mode"), "article_id",
                         F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*FQ.sort_columns(mode))).alias("pos"))
        out = one if out is None else out.unionByName(one)
    return out


@query("fq_07", f"SELECT article_id FROM f_news WHERE {_PUB} ORDER BY published_at DESC NULLS LAST, final_score DESC, article_id LIMIT 20 OFFSET 40")
def _(d):
    return FQ.page(FQ.article_feed(_news(d), _stored(d)), FQ.sort_columns("score"), page=3).select("article_id")


_TODAY = f"created_at BETWEEN TIMESTAMP '{DAY} 00:00:00' AND TIMESTAMP '{DAY_END}'"


@query("fq_08", f"SELECT article_id, final_score FROM f_news WHERE {_PUB} AND {_TODAY} ORDER BY final_score DESC, article_id LIMIT 10")
def _(d):
    return FQ.trending_today(_news(d), DAY_END).select("article_id", "final_score")


@query("fq_09", f"""
WITH e AS (SELECT * FROM f_story_events WHERE {_RECENT} AND priority_score >= 30 AND category = 'Coding')
SELECT event_id, priority_score, (SELECT count(*) FROM e)::BIGINT AS total, (SELECT greatest(1, ceil(count(*) / 20e0)) FROM e)::BIGINT AS pages
FROM e ORDER BY priority_score DESC, published_at DESC, event_id LIMIT 20""")
def _(d):
    e = FQ.event_list(d.f_story_events, AS_OF, min_priority=30, category="Coding")
    k = F.lit(1).alias("_k")
    return (FQ.page(e, FQ.event_order()).select("event_id", "priority_score", k)
            .join(FQ.page_info(e).select("*", k), "_k").drop("_k"))


@query("fq_10", "SELECT event_id, priority_score FROM f_story_events WHERE is_breaking ORDER BY priority_score DESC, published_at DESC, event_id LIMIT 10")
def _(d):
    return FQ.breaking(d.f_story_events).select("event_id", "priority_score")


def _links(d):
    return d.f_news.select("article_id", F.expr("article_id - article_id % 3").alias("event_id"))


@query("fq_11", """
SELECT e.event_id, e.headline, e.priority_score, a.article_id, a.title, a.url AS article_url, a.trust_score
FROM f_story_events e JOIN f_news a ON e.event_id = a.article_id - a.article_id % 3""")
def _(d):
    return FQ.event_articles(d.f_story_events.select("event_id", "headline", "priority_score"), _links(d), _news(d))


@query("fq_12", f"""
SELECT a.article_id, a.title, {stamp('a.published_at')} AS published_at, n.category, n.summary, array_to_string(n.companies, ',') AS companies, n.article_id IS NOT NULL AS has_analysis
FROM f_news a LEFT JOIN f_stored n ON n.article_id = a.article_id""")
def _(d):
    x = FQ.article_detail(_news(d), d.f_stored)
    return x.select("article_id", "title", text_ts("published_at").alias("published_at"), "analysis.category", "analysis.summary",
                    joined("analysis.companies").alias("companies"), F.col("analysis").isNotNull().alias("has_analysis"))


@query("fq_13", f"""
SELECT 'event' AS kind, event_id AS id, {half_even('priority_score', 1)} AS score, array_to_string(companies[1:5], ',') AS companies,
  array_to_string(models_mentioned[1:3], ',') AS extra FROM f_story_events
UNION ALL SELECT 'article', a.article_id, a.final_score, coalesce(array_to_string(n.companies, ','), ''), coalesce(array_to_string(n.tags, ','), '')
FROM f_news a LEFT JOIN f_stored n ON n.article_id = a.article_id WHERE {_PUB}""")
def _(d):
    e = FQ.event_list_row(d.f_story_events).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("priority_score").alias("score"),
                                                   joined("companies").alias("companies"), joined("models_mentioned").alias("extra"))
    a = FQ.article_list_row(FQ.article_feed(_news(d), _stored(d))).select(
        F.lit("article").alias("kind"), F.col("article_id").alias("id"), F.col("final_score").alias("score"),
        joined("companies").alias("companies"), joined("tags").alias("extra"))
    return e.unionByName(a)




@query("fq_14", f"""
WITH s AS (SELECT *, {LIVE} AS feed_score FROM f_articles),
r AS (SELECT * FROM s WHERE (published_at IS NULL OR published_at >= {NOW} - INTERVAL 3 DAY) AND feed_score > 0)
SELECT article_id, feed_score, (SELECT least(60, count(*)) > 20 FROM r) AS has_more FROM r
ORDER BY published_at DESC NULLS LAST, feed_score DESC, article_id LIMIT 60""")
def _(d):
    rows = FQ.live_feed(d.f_articles, AS_OF, companies=F.array(F.lit("The")), topics=F.array(F.lit("RAG"))).select("article_id", "feed_score")
    # A page holds at most 60 rows, so counting it needs no second pass over the articles.
    return rows.withColumn("has_more", F.count("*").over(Window.partitionBy(F.lit(1))) > 20)


@query("fq_15", f"""
WITH i AS (SELECT {_norm_url("replace(url, 'www.', 'WWW.')")} AS normalized_url, max(article_id) AS seq FROM f_articles WHERE article_id % 2 = 0 GROUP BY 1),
k AS (SELECT {_norm_url('url')} AS normalized_url, min(article_id) AS article_id FROM f_articles WHERE article_id % 3 = 0 GROUP BY 1)
SELECT i.normalized_url, seq, k.article_id FROM i LEFT JOIN k ON k.normalized_url = i.normalized_url""")
def _(d):
    incoming = d.f_articles.filter("article_id % 2 = 0").select(F.expr("replace(url, 'www.', 'WWW.')").alias("url"), F.col("article_id").alias("seq"))
    return FQ.existing_ids(incoming, d.f_articles.filter("article_id % 3 = 0"))


@query("fq_16", f"""
SELECT b.user_id, b.article_id, a.title, n.category, {stamp('b.created_at')} AS bookmarked_at
FROM f_bookmarks b JOIN f_news a ON a.article_id = b.article_id LEFT JOIN f_stored n ON n.article_id = b.article_id""")
def _(d):
    return FQ.bookmark_list(d.f_bookmarks, d.f_news.select("article_id", "title"), d.f_stored).select(
        "user_id", "article_id", "title", "category", text_ts("bookmarked_at").alias("bookmarked_at"))


@query("fq_17", f"""
SELECT user_id, notification_id, pos::INT AS pos FROM (SELECT user_id, notification_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, notification_id) AS pos
FROM f_notifications) WHERE pos <= 50""")
def _(d):
    return FQ.latest_per_user(d.f_notifications, "created_at", "notification_id", 50).select("user_id", "notification_id", "pos")


@query("fq_18", """
SELECT 'category' AS kind, category AS name, articles FROM (SELECT category, count(*)::BIGINT AS articles FROM f_stored GROUP BY 1) WHERE articles % 2 >= 0
UNION ALL SELECT 'source', source_name, total_articles_fetched::BIGINT FROM f_sources WHERE is_active""")
def _(d):
    cats = d.f_stored.groupBy(F.col("category").alias("slug")).agg(F.count("*").alias("articles")).withColumns(
        {"is_active": F.lit(True), "display_order": F.col("slug")})
    one = lambda k, df, n, c: df.select(F.lit(k).alias("kind"), F.col(n).alias("name"), F.col(c).alias("articles"))
    return one("category", FQ.active_categories(cats), "slug", "articles").unionByName(
        one("source", d.f_sources.filter("is_active").orderBy("source_name"), "source_name", "total_articles_fetched"))


_KEPT = f"created_at >= {NOW} - INTERVAL 5 DAY"


def _retained_sql(name: str, table: str) -> str:
    return (f"SELECT '{name}' AS tbl, count_if(NOT ({_KEPT}))::BIGINT AS deleted, count_if({_KEPT})::BIGINT AS kept, "
            f"{stamp(f'min(created_at) FILTER ({_KEPT})')} AS oldest FROM {table}")


@query("fq_19", f"{_retained_sql('articles', 'f_news')} UNION ALL {_retained_sql('notifications', 'f_notifications')}")
def _(d):
    """Stored by day, cut at the horizon, and read back."""
    from functools import reduce

    def one(name, df, key):
        path = scratch_path(d.spark, "retention")
        TB.upsert(df.select(key, "created_at").withColumn("day", F.to_date("created_at")), path, [key], partition_by="day")
        gone = FQ.apply_retention(d.spark, path, AS_OF, 5)["deleted"]
        return TB.read_table(d.spark, path).agg(F.count("*").alias("kept"), F.min("created_at").alias("oldest")).select(
            F.lit(name).alias("tbl"), F.lit(gone).cast("bigint").alias("deleted"), "kept", text_ts("oldest").alias("oldest"))

    return reduce(lambda a, b: a.unionByName(b), [one("articles", d.f_news, "article_id"), one("notifications", d.f_notifications, "notification_id")])


_LOG = """SELECT event_id % 500 AS article_id, user_id, ts, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'bookmark' WHEN 'signup' THEN 'unbookmark' ELSE 'view' END AS action FROM events"""


@query("fq_20", f"""
WITH l AS ({_LOG}), m AS (SELECT article_id, user_id, arg_max(action, seq) AS last FROM l WHERE action <> 'view' GROUP BY 1, 2),
b AS (SELECT article_id, count_if(last = 'bookmark')::BIGINT AS n FROM m GROUP BY 1)
SELECT l.article_id, count_if(action = 'view')::BIGINT AS view_count, coalesce(any_value(b.n), 0)::BIGINT AS bookmark_count FROM l LEFT JOIN b ON b.article_id = l.article_id GROUP BY 1""")
def _(d):
    log = d.events.selectExpr("event_id % 500 AS article_id", "user_id", "ts", "event_id AS seq",
                              "CASE event_type WHEN 'purchase' THEN 'bookmark' WHEN 'signup' THEN 'unbookmark' ELSE 'view' END AS action")
    return FQ.engagement(log)


@query("fq_21", f"SELECT notification_id, user_id, true AS is_read, '{AS_OF}' AS read_at FROM f_notifications WHERE NOT is_read AND user_id IN (SELECT user_id FROM f_users WHERE is_active)")
def _(d):
    return FQ.mark_all_read(d.f_notifications, d.f_users.filter("is_active"), AS_OF).select(
        "notification_id", "user_id", "is_read", text_ts("read_at").alias("read_at"))


# ------------------------------------------------------------------ AG

@query("ag_01", f"""
SELECT (SELECT count(*) FROM f_news)::BIGINT AS total_articles, (SELECT count_if({_TODAY}) FROM f_news)::BIGINT AS articles_today,
  (SELECT count_if(is_verified) FROM f_news)::BIGINT AS verified_articles, (SELECT count_if(is_duplicate) FROM f_news)::BIGINT AS duplicate_articles,
  (SELECT count_if(ai_processed) FROM f_news)::BIGINT AS ai_processed, (SELECT count(*) FROM f_users)::BIGINT AS total_users,
  (SELECT count_if(is_active) FROM f_users)::BIGINT AS active_users, (SELECT count_if(notification_sent) FROM f_briefs)::BIGINT AS total_briefs_sent,
  (SELECT count_if(is_active) FROM f_sources)::BIGINT AS sources_active, (SELECT count_if(consecutive_failures >= 5) FROM f_sources)::BIGINT AS sources_failed""")
def _(d):
    return AG.platform_stats(d.f_news, d.f_users, d.f_briefs, d.f_sources, DAY_END)


@query("ag_02", """
SELECT n.category, a.source_name, count(*)::BIGINT AS articles, (grouping(n.category) * 2 + grouping(a.source_name))::INT AS level
FROM f_news a LEFT JOIN f_stored n ON n.article_id = a.article_id GROUP BY ROLLUP (n.category, a.source_name)""")
def _(d):
    return AG.articles_per_source(d.f_news, d.f_stored)


def requests(d):
    return d.events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("identity"),
                           (F.col("user_id") % 5 != 0).alias("authenticated"))


_REQ = """
SELECT window_start, identity, requests, request_limit, requests > request_limit AS over_limit FROM (
  SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id::VARCHAR AS identity, count(*)::BIGINT AS requests,
    CASE WHEN user_id % 5 <> 0 THEN 100 ELSE 20 END::INT AS request_limit FROM events GROUP BY 1, 2, 4)"""


@query("ag_04", _REQ)
def _(d):
    return AG.request_counts(requests(d)).withColumn("window_start", text_ts("window_start"))


@query("ss_01", f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, {stamp('min(ts)')} AS session_start, {stamp('max(ts) + INTERVAL 30 MINUTE')} AS session_end, count(*)::BIGINT AS events FROM s GROUP BY user_id, sid""")
def _(d):
    s = AG.sessions(d.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")))
    return s.withColumns({c: text_ts(c) for c in ("session_start", "session_end")})


# ------------------------------------------------------------------ NT

_INTERRUPT = f"priority_score >= 85 AND (priority_score >= 95 OR coalesce(event_type IN {sql_in(K.INTERRUPT_TYPES)}, false))"
_CAND = f"{_INTERRUPT} AND NOT notification_sent"


@query("nt_01", f"SELECT event_id, priority_score FROM f_story_events WHERE {_CAND} ORDER BY priority_score DESC, event_id LIMIT 20")
def _(d):
    return NT.alert_candidates(d.f_story_events).select("event_id", "priority_score")




@query("nt_02", f"SELECT event_id, {_INTERRUPT} AS interrupt FROM f_story_events")
def _(d):
    return d.f_story_events.select("event_id", NT.is_interrupt(F.col("priority_score"), F.col("event_type")).alias("interrupt"))


_EMOJI = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ALERT_EMOJI.items()) + f" ELSE '{K.DEFAULT_EMOJI}' END"
_PREFIX = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ALERT_PREFIX.items()) + f" ELSE {_EMOJI} || ' AI News' END"


@query("nt_03", f"""
SELECT event_id, CASE WHEN priority_score >= 95 THEN '🚨 Breaking AI News' WHEN event_type = 'model_release' THEN '🤖 New ' || coalesce(companies[1], 'AI') || ' Model'
  WHEN event_type = 'funding' THEN '💰 AI Funding' || CASE WHEN coalesce(funding_amount, 0) <> 0 THEN ' $' || round_even(funding_amount, 0)::BIGINT || 'M' ELSE '' END
  ELSE {_PREFIX} END AS title,
  CASE WHEN length(coalesce(summary, '')) > 20 THEN substr(headline, 1, 120) || '. ' || substr(summary, 1, 100) ELSE substr(headline, 1, 200) END AS body,
  coalesce(event_type, 'news') AS event_type, floor(priority_score)::INT AS priority FROM f_story_events""")
def _(d):
    return NT.alert_messages(d.f_story_events).select("event_id", "title", "body", "event_type", "priority")


def _alerts(d):
    return NT.alert_candidates(d.f_story_events)


@query("nt_04", f"""
WITH c AS (SELECT * FROM f_story_events WHERE {_CAND} ORDER BY priority_score DESC, event_id LIMIT 20), a AS (SELECT * FROM c),
u AS (SELECT u.user_id, list_distinct(list_transform(list_concat(p.favorite_categories, p.favorite_companies, p.favorite_topics), lambda x: lower(x))) AS terms
  FROM f_users u LEFT JOIN f_preferences p ON p.user_id = u.user_id WHERE u.is_active),
e AS (SELECT *, list_transform(list_concat([coalesce(category, ''), coalesce(event_type, '')], tags, companies, models_mentioned), lambda x: lower(x)) AS et FROM a)
SELECT e.event_id, u.user_id FROM e JOIN u ON e.priority_score >= 95 OR u.terms IS NULL OR len(u.terms) = 0 OR list_has_any(u.terms, e.et)""")
def _(d):
    return NT.affected_users(_alerts(d), d.f_users, d.f_preferences).select("event_id", "user_id")


@query("nt_05", f"""
SELECT u.user_id, u.push_token, b.brief_id, '{K.BRIEF_ALERT_TITLE}' AS title,
  'Today''s top ' || b.total_articles || ' AI stories — personalized for you.' AS body, '{DAY_END}' AS sent_at
FROM f_users u JOIN f_briefs b ON b.user_id = u.user_id WHERE u.is_active AND u.push_token IS NOT NULL AND CAST(b.brief_ts AS DATE) = DATE '{DAY}' AND NOT b.notification_sent""")
def _(d):
    briefs = d.f_briefs.withColumn("brief_date", F.col("brief_ts").cast("date"))
    return NT.daily_sends(d.f_users, briefs, DAY, DAY_END).select(
        "user_id", "push_token", "brief_id", "title", "body", text_ts("sent_at").alias("sent_at"))


@query("nt_06", """
SELECT event_id, (hour(ts) >= 22 OR hour(ts) < 7) AS quiet, NOT (hour(ts) >= 22 OR hour(ts) < 7) AND hour(ts) >= user_id % 24 AS due FROM events""")
def _(d):
    h = F.hour("ts")
    return d.events.select("event_id", NT.in_quiet_hours(h).alias("quiet"), NT.due_now(F.col("ts").cast("timestamp"), F.col("user_id") % 24).alias("due"))
