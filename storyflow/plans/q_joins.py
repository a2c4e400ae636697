"""Duplicate detection and clustering queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.config import DEFAULT
from storyflow.functions import text as T
from storyflow.operators import cluster as CL
from storyflow.operators import dedup as DD
from storyflow.operators import history as HI
from storyflow.operators import validate as VF
from storyflow.plans.data import AS_OF, DAY
from storyflow.plans.q_scalar import (
    _CONTENT_FP, _norm_url, count_sql, curve_sql, entity_fp_sql, priority_sql, trust_sql, TRUST_SET, FUND, IMPACT,
    LAUNCH, GOV, RESEARCH,
)
from storyflow.session import materialize, scratch_path
from storyflow.plans.registry import NOW, age0, half_even, jac, joined, norm_title, query, sql_in, stamp, text_ts, token_set

# The last day is the new batch, everything before it is history.
_SPLIT = f"created_at >= TIMESTAMP '{DAY} 00:00:00'"
_WIDE = replace(DEFAULT, semantic_window_hours=240)


def _fp(d):
    news = d.f_news.select("article_id", "title", F.col("body").alias("content_snippet"), "url", "source_name", "is_official",
                           "published_at", "created_at", "is_duplicate")
    return DD.with_fingerprints(news)


def _batch(df):
    return df.filter(F.col("created_at") >= F.lit(f"{DAY} 00:00:00").cast("timestamp"))


def _history(df):
    return df.filter(F.col("created_at") < F.lit(f"{DAY} 00:00:00").cast("timestamp"))


_FP = f"""
fp AS (SELECT *, {_norm_url('url')} AS nurl, sha256({norm_title('title')}) AS tfp, {_CONTENT_FP} AS cfp FROM f_news),
bt AS (SELECT * FROM fp WHERE {_SPLIT}), hs AS (SELECT * FROM fp WHERE NOT ({_SPLIT}) AND NOT is_duplicate)"""


@query("dd_01", """
WITH r AS (SELECT article_id, lower(regexp_replace(trim(url), '/+$', '')) AS url_key, row_number() OVER (
  PARTITION BY lower(regexp_replace(trim(url), '/+$', '')) ORDER BY tier, published_at DESC NULLS LAST, article_id) AS rn
  FROM (SELECT a.*, s.tier FROM f_articles a JOIN f_sources s ON s.source_name = a.source_name))
SELECT url_key, article_id FROM r WHERE rn = 1""")
def _(d):
    rows = d.f_articles.join(d.f_sources.select("source_name", "tier"), "source_name")
    return DD.best_per_url(rows.select("article_id", "url", "published_at", "tier"), tier=F.col("tier")).select("url_key", "article_id")


for _i, (_key, _col, _layer) in enumerate((("nurl", "normalized_url", "url"), ("tfp", "title_fingerprint", "title_hash"),
                                           ("cfp", "content_fingerprint", "content_hash"))):
    query(f"dd_{2 + _i:02d}", f"""
WITH {_FP}, c AS (SELECT {_key} AS k, min(article_id) AS canonical_id FROM hs GROUP BY 1)
SELECT bt.article_id, c.canonical_id, '{_layer}' AS layer, 1e0 AS score FROM bt JOIN c ON c.k = bt.{_key}""")(
        lambda d, _col=_col, _layer=_layer: DD.match_layer(_batch(_fp(d)), _history(_fp(d)), _col, _layer))


def _vec(d, df):
    return df.join(d.embeddings.select(F.col("vec_id").alias("article_id"), "embedding"), "article_id", "left")


_COS = "round_even(list_cosine_similarity(b.embedding::DOUBLE[], h.embedding::DOUBLE[]) * 1e6, 0) / 1e6"


def _semantic_sql(batch: str) -> str:
    return f"""
sv AS (SELECT b.article_id, h.article_id AS canonical_id, {_COS} AS score,
    row_number() OVER (PARTITION BY b.article_id ORDER BY {_COS} DESC, h.article_id) AS rn
  FROM (SELECT x.article_id, v.embedding FROM {batch} x JOIN embeddings v ON v.vec_id = x.article_id) b,
       (SELECT x.article_id, v.embedding FROM hs x JOIN embeddings v ON v.vec_id = x.article_id) h),
sem AS (SELECT article_id, canonical_id, 'semantic_similarity' AS layer, score FROM sv WHERE rn = 1 AND score >= 0.35e0)"""


# Stored vectors are topic vectors, so the near-copy threshold is lower here.
_NEAR = replace(_WIDE, semantic_duplicate=0.35)


@query("dd_05", f"WITH {_FP}, {_semantic_sql('bt')} SELECT * FROM sem")
def _(d):
    news = _vec(d, d.f_news.select("article_id", "created_at", "is_duplicate"))
    return DD.semantic_duplicates(_batch(news), _history(news), AS_OF, _NEAR)


_HASH = """
hk AS (SELECT 0 AS r, nurl AS k, min(article_id) AS canonical_id FROM hs GROUP BY ALL UNION ALL SELECT 1, tfp, min(article_id) FROM hs GROUP BY ALL
  UNION ALL SELECT 2, cfp, min(article_id) FROM hs GROUP BY ALL),
ht AS (SELECT bt.article_id, r, canonical_id, row_number() OVER (PARTITION BY bt.article_id ORDER BY r) AS rn
  FROM bt JOIN hk ON k = CASE r WHEN 0 THEN nurl WHEN 1 THEN tfp ELSE cfp END),
ex AS (SELECT article_id, canonical_id, CASE r WHEN 0 THEN 'url' WHEN 1 THEN 'title_hash' ELSE 'content_hash' END AS layer, 1e0 AS score FROM ht WHERE rn = 1),
sb AS (SELECT * FROM bt WHERE article_id NOT IN (SELECT article_id FROM ex))"""
_CASCADE = f"""{_FP}, {_HASH}, {_semantic_sql('sb')},
cs AS (SELECT bt.article_id, bt.source_name, f.canonical_id IS NOT NULL AS is_duplicate, f.canonical_id, f.layer, coalesce(f.score, 0e0) AS score
  FROM bt LEFT JOIN (SELECT * FROM ex UNION ALL SELECT * FROM sem) f ON f.article_id = bt.article_id)"""


def _cascade(d):
    rows = _vec(d, _fp(d))
    return DD.cascade(_batch(rows), _history(rows), AS_OF, _NEAR)


@query("dd_06", f"WITH {_CASCADE} SELECT article_id, is_duplicate, canonical_id, layer, score FROM cs")
def _(d):
    return _cascade(d)


@query("dd_07", f"""
WITH x AS (SELECT n.article_id, a.created_at, a.is_duplicate, {entity_fp_sql("n.products_mentioned[1] || (n.article_id % 40)").replace('companies', 'n.companies').replace('event_type', 'n.event_type')} AS fp
  FROM f_analyses n JOIN f_news a ON a.article_id = n.article_id),
c AS (SELECT fp, min(article_id) AS canonical_id FROM x WHERE NOT ({_SPLIT}) AND NOT is_duplicate GROUP BY fp)
SELECT x.article_id, c.canonical_id, 'entity_fingerprint' AS layer, 1e0 AS score FROM x JOIN c ON c.fp = x.fp WHERE {_SPLIT}""")
def _(d):
    rows = d.f_analyses.select("article_id", "companies", "event_type",
                               F.expr("products_mentioned[0] || CAST(article_id % 40 AS STRING)").alias("product")).join(
        d.f_news.select("article_id", "created_at", "is_duplicate"), "article_id")
    return DD.entity_duplicates(_batch(rows), _history(rows))


# The history goes into the index in two parts; one batch is then looked up in all three hash layers.
@query("dd_02_index", f"WITH {_FP}, {_HASH} SELECT * FROM ex")
def _(d):
    path, fp = scratch_path(d.spark, "fingerprints"), materialize(_fp(d), "fingerprinted")
    history = _history(fp).where(~F.col("is_duplicate"))
    for part in (0, 1):
        HI.add(HI.hash_entries(history.where(F.col("article_id") % 2 == part)), path, bucket_rows=20_000)
    return HI.duplicates(HI.hash_entries(_batch(fp), "article_id"), path)


@query("dd_08", f"""
WITH {_FP}, {_HASH}, u AS (SELECT DISTINCT ex.canonical_id, b.url FROM ex JOIN f_news b ON b.article_id = ex.article_id)
SELECT canonical_id, url FROM u UNION SELECT article_id, 'https://seen.example/' || article_id FROM f_news WHERE article_id % 5 = 0""")
def _(d):
    fp = _fp(d)
    dup = DD.hash_duplicates(_batch(fp), _history(fp))
    seen = F.when(F.col("article_id") % 5 == 0, F.array(F.concat(F.lit("https://seen.example/"), F.col("article_id").cast("string"))))
    return DD.supporting_sources(fp.select("article_id", "url", seen.alias("supporting_sources")), dup)


@query("dd_09", f"""
WITH RECURSIVE fp AS (SELECT *, {_norm_url('url')} AS nurl, sha256({norm_title('title')}) AS tfp, {_CONTENT_FP} AS cfp FROM f_news),
k AS (SELECT article_id AS id, '0:' || nurl AS key FROM fp UNION SELECT article_id, '1:' || tfp FROM fp UNION SELECT article_id, '2:' || cfp FROM fp),
m AS (SELECT key, min(id) AS m FROM k GROUP BY key), e AS (SELECT DISTINCT k.id AS a, m.m AS b FROM k JOIN m ON m.key = k.key UNION SELECT DISTINCT m.m, k.id FROM k JOIN m ON m.key = k.key),
r(id, n) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.n),
l AS (SELECT id, min(n) AS label FROM r GROUP BY id),
c AS (SELECT l.label, first(f.article_id ORDER BY NOT f.is_official, f.published_at NULLS LAST, f.article_id) AS canonical_id FROM l JOIN fp f ON f.article_id = l.id GROUP BY l.label)
SELECT l.id AS article_id, c.canonical_id, l.id <> c.canonical_id AS is_duplicate FROM l JOIN c ON c.label = l.label""")
def _(d):
    return DD.intra_batch(_fp(d))


@query("dd_10", f"""
WITH {_CASCADE} SELECT source_name, layer, count(*)::BIGINT AS articles, count_if(is_duplicate)::BIGINT AS duplicates FROM cs GROUP BY ROLLUP (source_name, layer)""")
def _(d):
    return DD.duplicate_report(_cascade(d).join(d.f_news.select("article_id", "source_name"), "article_id"))


# ------------------------------------------------------------------ CL

def greedy_sql(order: str, stop) -> str:
    """Leader clustering by walking the ranks one by one."""
    return f"""
n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {order}) AS rk, article_id, {token_set('title', stop)} AS tok FROM f_articles),
ut AS MATERIALIZED (SELECT rk, len(tok) AS sz, unnest(tok) AS t FROM n),
pr AS MATERIALIZED (SELECT a.rk AS a, b.rk AS b, count(*) * 1e0 / (any_value(a.sz) + any_value(b.sz) - count(*)) AS j
  FROM ut a JOIN ut b ON a.t = b.t AND a.rk < b.rk GROUP BY a.rk, b.rk HAVING count(*) * 1e0 / (any_value(a.sz) + any_value(b.sz) - count(*)) >= 0.35e0),
nb AS MATERIALIZED (SELECT n.rk, coalesce(list(pr.a ORDER BY pr.a) FILTER (WHERE pr.a IS NOT NULL), []) AS earlier FROM n LEFT JOIN pr ON pr.b = n.rk GROUP BY n.rk),
g(rk, leaders, hit) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT
  UNION ALL
  SELECT nb.rk, CASE WHEN len(list_intersect(nb.earlier, g.leaders)) = 0 THEN list_append(g.leaders, nb.rk) ELSE g.leaders END,
    list_min(list_intersect(nb.earlier, g.leaders)) FROM g JOIN nb ON nb.rk = g.rk + 1),
asg AS (SELECT n.article_id, l.article_id AS leader_id, len(n.tok) AS sz, coalesce(pr.j, 1e0) AS similarity
  FROM g JOIN n ON n.rk = g.rk JOIN n l ON l.rk = coalesce(g.hit, g.rk) LEFT JOIN pr ON pr.a = g.hit AND pr.b = g.rk)"""


_STORY_ORDER = "NOT is_official, published_at DESC NULLS LAST, article_id"


@query("cl_01", f"WITH RECURSIVE {greedy_sql(_STORY_ORDER, K.STOP_WORDS)} "
                f"SELECT article_id, leader_id, {half_even('similarity', 6)} AS jaccard FROM asg WHERE article_id <> leader_id")
def _(d):
    c = CL.cluster_articles(d.f_articles)
    return c.filter("article_id <> leader_id").select("article_id", "leader_id", T.py_round(F.col("similarity"), 6).alias("jaccard"))


@query("cl_02", f"WITH RECURSIVE {greedy_sql(_STORY_ORDER, K.STOP_WORDS)} SELECT article_id, leader_id FROM asg")
def _(d):
    return CL.cluster_articles(d.f_articles).select("article_id", "leader_id")


@query("vf_06", f"WITH RECURSIVE {greedy_sql('article_id', ())} SELECT article_id, leader_id AS story_id FROM asg WHERE sz > 0")
def _(d):
    return CL.group_stories(d.f_articles)


# The roll-up and event steps take any assignment; here articles with equal titles belong together.
_ASG = f"""
asg AS (SELECT article_id, min(article_id) OVER (PARTITION BY {norm_title('title')}) AS leader_id FROM f_articles)"""


def _assignment(articles):
    key = T.title_fingerprint(F.col("title"))
    first = articles.groupBy(key.alias("k")).agg(F.min("article_id").alias("leader_id"))
    return articles.select("article_id", key.alias("k")).join(first, "k").select("article_id", "leader_id")


_ROLL = """
SELECT leader_id, list_sort(list(DISTINCT source_domain)) AS source_domains, count(DISTINCT source_domain)::INT AS source_count,
  min(published_at) AS earliest_published, count(*)::BIGINT AS size FROM asg JOIN {src} a ON a.article_id = asg.article_id GROUP BY leader_id"""


@query("cl_03", f"""WITH {_ASG}, ro AS ({_ROLL.format(src='f_articles')})
SELECT leader_id, array_to_string(source_domains, ',') AS source_domains, source_count, {stamp('earliest_published')} AS earliest_published, size FROM ro""")
def _(d):
    r = CL.roll_up(d.f_articles, _assignment(d.f_articles))
    return r.withColumns({"source_domains": joined("source_domains"), "earliest_published": text_ts("earliest_published")})


_NEW_ASG = f"""
ba AS (SELECT * FROM f_articles WHERE {_SPLIT}),
asg AS (SELECT article_id, min(article_id) OVER (PARTITION BY {norm_title('title')}) AS leader_id FROM ba),
cl AS (SELECT r.*, a.title, a.description, a.url, a.source_domain, a.is_official FROM ({_ROLL.format(src='ba')}) r JOIN ba a ON a.article_id = r.leader_id),
ev AS (SELECT * FROM f_story_events WHERE NOT ({_SPLIT}) AND created_at >= {NOW} - INTERVAL 72 HOUR),
eu AS (SELECT primary_source_url AS url, arg_max(event_id, (epoch_us(created_at), event_id)) AS event_id FROM ev GROUP BY 1),
mu AS (SELECT leader_id, event_id, 'url' AS match, 1e0 AS jaccard FROM cl JOIN eu ON eu.url = cl.url),
ct AS (SELECT leader_id, {token_set('title', K.STOP_WORDS)} AS tok FROM cl WHERE leader_id NOT IN (SELECT leader_id FROM mu)),
et AS (SELECT event_id, created_at, {token_set('headline', K.STOP_WORDS)} AS tok FROM ev),
mj AS (SELECT leader_id, event_id, j, row_number() OVER (PARTITION BY leader_id ORDER BY j DESC, created_at DESC, event_id DESC) AS rn
  FROM (SELECT leader_id, event_id, created_at, {jac('ct.tok', 'et.tok')} AS j FROM ct, et WHERE len(ct.tok) > 0 AND len(et.tok) > 0) WHERE j >= 0.35e0),
ma AS (SELECT * FROM mu UNION ALL SELECT leader_id, event_id, 'title', j FROM mj WHERE rn = 1)"""


def _clusters(d):
    batch = _batch(d.f_articles)
    rolled = CL.roll_up(batch, _assignment(batch))
    canonical = batch.select(F.col("article_id").alias("leader_id"), "title", "description", "url", "source_domain", "is_official")
    return materialize(rolled.join(canonical, "leader_id"), "clusters")


def _events(d):
    return _history(d.f_story_events)


_EVENT_COS = "round_even(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) * 1e6, 0) / 1e6"
# Stored vectors are topic vectors, so the threshold is lower here.
_EVENT_NEAR = replace(DEFAULT, event_vector=0.35)


@query("cl_04", f"""
WITH {_NEW_ASG},
mv AS (SELECT leader_id, event_id, cos, row_number() OVER (PARTITION BY leader_id ORDER BY cos DESC, event_id) AS rn
  FROM (SELECT c.leader_id, ev.event_id, {_EVENT_COS} AS cos FROM cl c JOIN embeddings x ON x.vec_id = c.leader_id, ev JOIN embeddings y ON y.vec_id = ev.event_id
    WHERE c.leader_id NOT IN (SELECT leader_id FROM ma)) WHERE cos >= 0.35e0)
SELECT leader_id, event_id, match, {half_even('jaccard', 6)} AS jaccard FROM (SELECT * FROM ma UNION ALL SELECT leader_id, event_id, 'vector', cos FROM mv WHERE rn = 1)""")
def _(d):
    """Clusters to events by url, title, then vector."""
    vectors = lambda df, key: df.join(d.embeddings.select(F.col("vec_id").alias(key), "embedding"), key, "left")
    return CL.match_events(vectors(_clusters(d), "leader_id"), vectors(_events(d), "event_id"), AS_OF, _EVENT_NEAR).withColumn("jaccard", T.py_round(F.col("jaccard"), 6))


_P_NEW = priority_sql(fresh=f"CASE WHEN earliest_published IS NULL THEN 30e0 ELSE {curve_sql('greatest(5e0, 20e0 - (' + age0('earliest_published') + ' - 48e0) * 0.125e0)', age0('earliest_published'))} END",
                      count=count_sql("source_count"), impact="30e0", research="0e0", launch="0e0", fund="0e0", gov="0e0")
_CREATED = f"""
cr AS (SELECT sha256(url || '|2024-01-31') AS event_id, *, {_P_NEW} AS priority_score FROM cl WHERE leader_id NOT IN (SELECT leader_id FROM ma))"""


@query("cl_05", f"""
WITH {_NEW_ASG}, {_CREATED}
SELECT asg.article_id, asg.leader_id, x.event_id, x.priority_score FROM asg JOIN (
  SELECT ma.leader_id, ma.event_id::VARCHAR AS event_id, ev.priority_score FROM ma JOIN ev ON ev.event_id = ma.event_id
  UNION ALL SELECT leader_id, event_id, priority_score FROM cr) x ON x.leader_id = asg.leader_id""")
def _(d):
    clusters, events = _clusters(d), _events(d)
    m = materialize(CL.match_events(clusters, events, AS_OF), "matches")
    matched = m.join(events.select("event_id", "priority_score"), "event_id")
    created = CL.create_events(clusters.join(m.select("leader_id"), "leader_id", "left_anti"), AS_OF)
    return CL.link_articles(_assignment(_batch(d.f_articles)), matched, created)


@query("cl_06", f"""
WITH {_NEW_ASG}, {_CREATED}
SELECT event_id, leader_id, title AS headline, CASE WHEN description <> '' THEN description END AS summary, 'General AI' AS category,
  priority_score, {TRUST_SET} AS trust_score, source_count, array_to_string(source_domains, ',') AS source_domains, url AS primary_source_url FROM cr""")
def _(d):
    clusters, events = _clusters(d), _events(d)
    m = materialize(CL.match_events(clusters, events, AS_OF), "matches")
    created = CL.create_events(clusters.join(m.select("leader_id"), "leader_id", "left_anti"), AS_OF)
    return created.select("event_id", "leader_id", "headline", "summary", "category", "priority_score", "trust_score", "source_count",
                          joined("source_domains").alias("source_domains"), "primary_source_url")


_STRONG = "(contains(primary_source_domain, 'openai') OR contains(primary_source_domain, 'anthropic') OR contains(primary_source_domain, 'deepmind'))"


@query("cl_07", f"""
WITH {_NEW_ASG}, mc AS (SELECT cl.*, ma.event_id FROM cl JOIN ma ON ma.leader_id = cl.leader_id),
dm AS (SELECT event_id, list(DISTINCT dd) AS nd FROM (SELECT event_id, unnest(source_domains) AS dd FROM mc) GROUP BY 1),
oc AS (SELECT event_id, arg_min(title, leader_id) AS ot, arg_min(source_domain, leader_id) AS od, arg_min(url, leader_id) AS ou FROM mc WHERE is_official GROUP BY 1),
up AS (SELECT ev.event_id, headline, primary_source_domain, primary_source_url, event_type, companies, funding_amount, published_at, ot, od, ou,
  list_sort(list_distinct(list_concat(ev.source_domains, dm.nd))) AS source_domains FROM ev JOIN dm ON dm.event_id = ev.event_id LEFT JOIN oc ON oc.event_id = ev.event_id)
SELECT event_id, CASE WHEN ot IS NOT NULL AND NOT {_STRONG} THEN ot ELSE headline END AS headline,
  CASE WHEN ot IS NOT NULL AND NOT {_STRONG} THEN od ELSE primary_source_domain END AS primary_source_domain,
  array_to_string(source_domains, ',') AS source_domains, len(source_domains)::INT AS source_count, {priority_sql()} AS priority_score FROM up""")
def _(d):
    clusters, events = _clusters(d), _events(d)
    matched = clusters.join(CL.match_events(clusters, events, AS_OF), "leader_id")
    return CL.update_events(events, matched, AS_OF).select(
        "event_id", "headline", "primary_source_domain", joined("source_domains").alias("source_domains"), "source_count", "priority_score")


@query("cl_08", f"""
WITH {_NEW_ASG} SELECT count_if(ma.leader_id IS NULL)::BIGINT AS events_created, count_if(ma.leader_id IS NOT NULL)::BIGINT AS events_updated
FROM cl LEFT JOIN ma ON ma.leader_id = cl.leader_id""")
def _(d):
    clusters = _clusters(d)
    return CL.batch_counts(clusters, CL.match_events(clusters, _events(d), AS_OF))


# ------------------------------------------------------------------ whole verification

_T_SCORE, _T_NOTES = trust_sql("c")
from storyflow.plans.q_scalar import _REASON  # noqa: E402


@query("vf_09", f"""
WITH RECURSIVE {greedy_sql('article_id', ()).replace('FROM f_articles)', f"FROM f_articles WHERE {_REASON} = 'accepted')", 1)},
st AS (SELECT a.*, s.leader_id AS story_id, s.sz FROM f_articles a JOIN asg s ON s.article_id = a.article_id),
co AS (SELECT story_id, count(DISTINCT source_domain) AS c FROM st WHERE sz > 0 AND source_domain IN {sql_in(K.TRUST_TIER1 + K.OFFICIAL_DOMAINS + K.TRUST_TECH)} GROUP BY 1),
x AS (SELECT st.*, greatest(1, coalesce(CASE WHEN sz > 0 THEN co.c END, 1)) AS c FROM st LEFT JOIN co ON co.story_id = st.story_id)
SELECT article_id, c::BIGINT AS corroboration, {half_even(_T_SCORE, 1)} AS trust_score, {_T_SCORE} >= 40 AS is_verified, {_T_NOTES} AS notes FROM x""")
def _(d):
    return VF.verify_batch(d.f_articles, AS_OF).select("article_id", F.col("corroboration").cast("bigint").alias("corroboration"),
                                                       "trust_score", "is_verified", "notes")
