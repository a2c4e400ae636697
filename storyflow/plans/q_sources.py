"""Payload, page, sink and streaming queries.

Payloads are what a landed feed or API response looks like; Spark builds one per document,
so the parsers run over every row of the given tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.functions import text as T
from storyflow.operators import stats as AG
from storyflow.operators import trends as TR
from storyflow.operators import validate as VF
from storyflow.operators import dedup as DD
from storyflow.plans.data import AS_OF
from storyflow.plans.q_joins import _P_NEW, _ROLL, _STORY_ORDER, _STRONG, greedy_sql
from storyflow.plans.q_scalar import _CONTENT_FP, _REASON, _norm_url, priority_sql, trust_sql
from storyflow.plans.q_sets import _RANKED, _SLUG, requests
from storyflow.plans.registry import NOW, half_even, jac, joined, norm_title, query, sql_in, sql_list, stamp, text_ts, token_set
from storyflow.session import materialize
from storyflow.sources import pages as PG
from storyflow.sources import payloads as SR
from storyflow.sources import tables as SK
from storyflow.streaming import jobs as ST

# ------------------------------------------------------------------ SRC


def _xml(c: str):
    e = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


_CLEAN = lambda x: f"trim(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '\\s+', ' ', 'g'))"
_NULL = lambda x: f"nullif({x}, '')"


@query("src_01", f"""
SELECT article_id AS seq, source_name AS feed, trim(title) AS title, trim(url) AS url, {_NULL(_CLEAN('description'))} AS description,
  {_NULL(_CLEAN('body'))} AS content_snippet, CASE WHEN article_id % 3 = 0 THEN 'https://img.example.com/' || article_id END AS image_url,
  {stamp('created_at')} AS published_at FROM f_articles WHERE trim(title) <> ''""")
def _(d):
    a = d.f_articles
    item = F.concat(
        F.lit("<item><title> "), _xml("title"), F.lit(" </title><link>"), _xml("url"), F.lit("</link><summary>"), _xml("description"),
        F.lit("</summary><content>"), _xml("body"), F.lit("</content><published>"), F.date_format("created_at", "EEE, dd MMM yyyy HH:mm:ss Z"), F.lit("</published>"),
        F.when(F.col("article_id") % 3 == 0, F.concat(F.lit('<media:content url="https://img.example.com/'), F.col("article_id").cast("string"), F.lit('"/>'))).otherwise(""),
        F.lit("</item>"))
    items = a.select(F.col("article_id").alias("seq"), F.col("source_name").alias("feed"),
                     F.from_xml(item, SR.FEED_ITEM, {"attributePrefix": "_"}).alias("i")).select("seq", "feed", "i.*")
    return SR.feed_articles(items).select("seq", "feed", "title", "url", "description", "content_snippet", "image_url", text_ts("published_at").alias("published_at"))


@query("src_02", f"""
SELECT 'https://papers.example.org/' || article_id AS url, trim(title) AS title, {_NULL("replace(trim(body), chr(10), ' ')")} AS description,
  CASE article_id % 3 WHEN 0 THEN 'Ann Ay' WHEN 1 THEN 'Ann Ay, Bo Bee' ELSE 'Ann Ay, Bo Bee, Cy Cee et al.' END AS author, {stamp('created_at')} AS published_at
FROM f_articles WHERE created_at >= {NOW} - INTERVAL 48 HOUR""")
def _(d):
    authors = F.when(F.col("article_id") % 3 == 0, 1).when(F.col("article_id") % 3 == 1, 2).otherwise(4)
    names = F.array_join(F.slice(F.array(*[F.lit(f"<author><name> {n} </name></author>") for n in ("Ann Ay", "Bo Bee", "Cy Cee", "Di Dee")]), F.lit(1), authors), "")
    entry = F.concat(F.lit("<entry><id> http://papers.example.org/"), F.col("article_id").cast("string"), F.lit(" </id><title> "), _xml("title"), F.lit("\n</title><summary>"),
                     _xml("body"), F.lit("</summary><published>"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published>"), names, F.lit("</entry>"))
    parsed = d.f_articles.select(F.from_xml(entry, SR.ATOM_ENTRY).alias("e")).select("e.*")
    return SR.paper_articles(parsed, AS_OF).withColumn("published_at", text_ts("published_at"))


@query("src_03", f"""
SELECT CASE WHEN event_id % 4 = 0 THEN 'https://news.ycombinator.com/item?id=' || event_id ELSE 'https://s.example.com/' || event_id END AS url, event_type || ' story ' || event_id AS title,
  'Hacker News — ' || (event_id % 40) || ' points, ' || (user_id % 9) || ' comments' AS description, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS published_at
FROM events WHERE event_id % 40 >= 5 AND ts >= {NOW} - INTERVAL 4 DAY AND date_trunc('second', ts) >= {NOW} - INTERVAL 3 DAY""")
def _(d):
    hit = F.struct(
        F.concat("event_type", F.lit(" story "), F.col("event_id").cast("string")).alias("title"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("https://s.example.com/"), F.col("event_id").cast("string"))).alias("url"),
        (F.col("event_id") % 40).cast("int").alias("points"), F.col("event_id").cast("string").alias("objectID"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at_i"), (F.col("user_id") % 9).cast("int").alias("num_comments"))
    # Two queries return the same story.
    text = F.to_json(F.struct(F.array(hit, hit).alias("hits")))
    payloads = d.events.select(F.from_json(text, SR.STORY_HITS).alias("p")).select("p.*")
    return SR.story_articles(payloads, AS_OF).select("url", "title", "description", text_ts("published_at").alias("published_at"))


_HOST = "CASE event_id % 5 WHEN 0 THEN 'arxiv.org' WHEN 1 THEN 'blog.openai.com' WHEN 2 THEN 'memes.example' WHEN 3 THEN 'nature.com' ELSE 'files.example' END"
_LURL = f"'https://' || {_HOST} || '/' || event_id || CASE WHEN event_id % 10 = 4 THEN '.pdf' ELSE '' END"


@query("src_04", f"""
SELECT {_LURL} AS url, 'Post ' || event_id AS title, {_HOST} AS source_domain,
  CASE WHEN event_id % 2 = 0 THEN 'self ' || event_type ELSE 'Reddit hot post on r/' || event_type || ' with ' || (event_id % 200) || ' upvotes' END AS description
FROM events WHERE event_id % 7 <> 0 AND event_id % 200 >= 50 AND (event_id % 5 IN (0, 1, 3) OR event_id % 10 = 4)""")
def _(d):
    c = F.struct(F.struct(
        F.concat(F.lit(" Post "), F.col("event_id").cast("string")).alias("title"), F.expr(_LURL.replace("event_id ||", "CAST(event_id AS STRING) ||")).alias("url"), F.expr(_HOST).alias("domain"),
        (F.col("event_id") % 200).cast("int").alias("score"), (F.col("event_id") % 7 == 0).alias("is_self"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("self "), "event_type")).otherwise("").alias("selftext"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("created_utc"), F.col("event_type").alias("subreddit")).alias("data"))
    text = F.to_json(F.struct(F.struct(F.array(c).alias("children")).alias("data")))
    payloads = d.events.select(F.from_json(text, SR.LISTING).alias("p")).select("p.*")
    return SR.listing_articles(payloads).select("url", "title", "source_domain", "description")


@query("src_05", f"""
SELECT '🚀 tool' || article_id || ' v1.' || article_id || ' released' AS title, 'https://git.example.com/' || article_id AS url,
  CASE WHEN trim(description) <> '' THEN trim(description) ELSE 'New release of org/tool' || article_id END AS description, {stamp('created_at')} AS published_at
FROM f_articles WHERE article_id % 8 <> 5 AND created_at >= {NOW} - INTERVAL 168 HOUR""")
def _(d):
    i = F.col("article_id").cast("string")
    text = F.to_json(F.struct(
        F.concat(F.lit("org/tool"), i).alias("repo"), F.concat(F.lit("v1."), i).alias("tag_name"), F.lit("").alias("name"),
        F.concat(F.lit("https://git.example.com/"), i).alias("html_url"), F.col("description").alias("body"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), (F.col("article_id") % 8 == 5).alias("prerelease")))
    rel = d.f_articles.select(F.from_json(text, SR.RELEASE).alias("r")).select("r.*")
    return SR.release_articles(rel, AS_OF).withColumn("published_at", text_ts("published_at"))


# Navigation links of every page: each anchor text as the heading of a card.
@query("src_06", """
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="(/[^"]*)">([^<]*)</a>', 2)) AS txt FROM pages)
SELECT page_id, trim(txt || ' and more') AS title, 'https://site.example' || href AS url, trim('about ' || txt) AS description, '2024-01-05 10:00:00' AS published_at
FROM a WHERE length(trim(txt || ' and more')) >= 10""")
def _(d):
    wrapped = F.regexp_replace("html", r"(<a href=\"/[^\"]*\">)([^<]*)</a>", "$1<h3>$2 and more</h3><time datetime=\"2024-01-05T10:00:00Z\"></time><p>about $2</p></a>")
    cards = PG.anchors(d.pages.withColumn("html", wrapped))
    return PG.link_cards(cards, "/", "https://site.example").withColumn("published_at", text_ts("published_at"))


_PSLUG = ("regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(regexp_extract(html, '<title>([^<]*)', 1)), '[^\\x00-\\x7F]', '', 'g')), "
          "'[^\\w\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g')")


@query("src_07", f"""
WITH r AS (SELECT page_id, 'org' || page_id || '/' || {_PSLUG} AS repo, trim(regexp_extract(html, '<div class="ad">([^<]*)', 1)) AS about, page_id % 90 AS stars, page_id % 3 = 0 AS nlp FROM pages),
n AS (SELECT *, replace(repo, '/', ' / ') AS name FROM r)
SELECT 'https://github.com/' || repo AS url, '🔥 GitHub Trending: ' || name || ' (' || stars || ' stars today)' AS title, nullif(about, '') AS description FROM n
WHERE nlp OR len(list_filter({sql_list(K.REPO_KEYWORDS)}, lambda k: contains(lower(name || ' ' || about), k))) > 0""")
def _(d):
    """Every page becomes one trending row: its links as repository and topic."""
    row = F.concat(
        F.lit('<article class="Box-row"><h2><a href="/org'), F.col("page_id").cast("string"), F.lit("/"), T.slugify(F.regexp_extract("html", "<title>([^<]*)", 1)),
        F.lit('">x</a></h2><p>'), F.regexp_extract("html", '<div class="ad">([^<]*)', 1), F.lit('</p><a href="/topics/'),
        F.when(F.col("page_id") % 3 == 0, "nlp").otherwise("cooking"), F.lit('">t</a><span>'), (F.col("page_id") % 90).cast("string"), F.lit(" stars today</span></article>"))
    return PG.topic_repos(PG.repositories(d.pages.select("page_id", row.alias("html"))))


@query("src_08")
def _(d):
    return PG.article_text(d.pages).select("page_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"))


@query("ud_01")
def _(d):
    """User-function surface: composition of Unicode text and paragraph text of HTML."""
    p = d.pages.select("page_id", PG.html_text(F.col("html")).alias("text"))
    return T.ensure_nfc(p, "text").select("page_id", F.length("text").alias("chars"))




@query("src_09", """
SELECT a.article_id, a.source_name, s.tier, s.official_company, s.official_company IS NOT NULL AS official FROM f_articles a LEFT JOIN f_sources s ON s.source_name = a.source_name""")
def _(d):
    s = d.f_sources.select("source_name", "tier", "official_company")
    return SR.with_source_meta(d.f_articles.select("article_id", "source_name"), s).withColumn("official", F.col("official_company").isNotNull())


@query("src_10", "SELECT article_id FROM f_articles WHERE source_name NOT IN (SELECT source_name FROM f_sources WHERE NOT is_active)")
def _(d):
    return SR.only_active(d.f_articles, d.f_sources).select("article_id")


_BLANK = "CASE WHEN article_id % 9 = 0 THEN '  ' ELSE title END"


@query("src_11", f"SELECT article_id FROM f_articles WHERE trim({_BLANK}) <> '' AND trim(url) <> ''")
def _(d):
    return SR.valid_records(d.f_articles.withColumn("title", F.expr(_BLANK))).select("article_id")


@query("src_12", f"""
WITH x AS (SELECT source_name, trim({_BLANK}) <> '' AS ok, lower(regexp_replace(trim(url), '/+$', '')) AS k FROM f_articles)
SELECT source_name, count(*)::BIGINT AS total, count_if(ok)::BIGINT AS valid, count_if(NOT ok)::BIGINT AS dropped, count(DISTINCT CASE WHEN ok THEN k END)::BIGINT AS unique_urls
FROM x GROUP BY source_name""")
def _(d):
    return SR.source_stats(d.f_articles.withColumn("title", F.expr(_BLANK)), T.url_dedup_key(F.col("url")))


@query("src_13", """
SELECT source_name || '_ai_rss' AS source_name, CASE WHEN official_company IS NOT NULL THEN official_company || ' Blog' ELSE upper(source_name[1]) || source_name[2:] || ' AI' END AS display_name,
  CASE WHEN official_company IS NOT NULL THEN 90e0 ELSE 75e0 END AS reliability_score, official_company IS NOT NULL AS is_official, 'https://' || source_name || '.example.com' AS url FROM f_sources""")
def _(d):
    names = d.f_sources.select(F.concat("source_name", F.lit("_ai_rss")).alias("source_name"), F.concat("source_name", F.lit(".example.com")).alias("source_domain"), "official_company")
    return SR.source_dimension(names).select("source_name", "display_name", "reliability_score", "is_official", "url")


# ------------------------------------------------------------------ SNK and run statistics

@query("snk_01", "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*)::BIGINT AS articles, count(DISTINCT article_id)::BIGINT AS ids FROM f_articles GROUP BY 1")
def _(d):
    path, _ = ST.scratch(d.spark, "articles")
    SK.write_table(d.f_articles.select("article_id", "title", "created_at", F.to_date("created_at").alias("day")), path, ["day"])
    t = SK.read_table(d.spark, path)
    return t.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("articles"), F.count_distinct("article_id").alias("ids"))


@query("snk_02", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS version, (SELECT count_if(doc_id % 3 = 0 AND doc_id % 2 = 0) FROM documents)::BIGINT AS updated,
  (SELECT count_if(doc_id % 3 = 0 AND doc_id % 2 = 1) FROM documents)::BIGINT AS created FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""")
def _(d):
    path, _ = ST.scratch(d.spark, "upsert")
    SK.upsert(d.documents.filter("doc_id % 2 = 0").select("doc_id", F.lit("first").alias("version")), path, ["doc_id"])
    n = SK.upsert(d.documents.filter("doc_id % 3 = 0").select("doc_id", F.lit("second").alias("version")), path, ["doc_id"])
    return SK.read_table(d.spark, path).withColumns({k: F.lit(v).cast("bigint") for k, v in n.items()})


@query("tr_11", f"""
WITH {_RANKED}, s AS (SELECT type AS trend_type, {_SLUG('name')} AS slug, hours::INT AS period_hours, cur AS mention_count, score AS trend_score,
  row_number() OVER (PARTITION BY type, {_SLUG('name')}, hours ORDER BY cur DESC, name DESC) AS rn FROM t)
SELECT trend_type, slug, period_hours, mention_count, trend_score, 0::BIGINT AS created, (SELECT count(*) FROM s WHERE rn = 1)::BIGINT AS updated FROM s WHERE rn = 1""")
def _(d):
    path, _ = ST.scratch(d.spark, "trends")
    rows = TR.truncate_run(TR.trends(d.f_story_events, AS_OF, with_ids=False))
    rows = materialize(rows, "run")
    SK.upsert(rows, path, TR.TREND_KEYS)
    n = SK.upsert(rows, path, TR.TREND_KEYS)  # a repeated run updates, never adds
    return SK.read_table(d.spark, path).select("trend_type", "slug", "period_hours", "mention_count", "trend_score").withColumns(
        {k: F.lit(v).cast("bigint") for k, v in n.items()})


@query("ag_03", f"""
WITH RECURSIVE ck AS (SELECT *, {_REASON} AS reason FROM f_articles),
vr AS (SELECT *, {trust_sql("1")[0]} >= 40 AS ok FROM ck WHERE reason = 'accepted'),
fp AS (SELECT *, {_norm_url('url')} AS nurl, sha256({norm_title('title')}) AS tfp, {_CONTENT_FP} AS cfp FROM vr WHERE ok),
k AS (SELECT article_id AS id, '0:' || nurl AS key FROM fp UNION SELECT article_id, '1:' || tfp FROM fp UNION SELECT article_id, '2:' || cfp FROM fp),
m AS (SELECT key, min(id) AS m FROM k GROUP BY key), e AS (SELECT DISTINCT k.id AS a, m.m AS b FROM k JOIN m ON m.key = k.key UNION SELECT DISTINCT m.m, k.id FROM k JOIN m ON m.key = k.key),
r(id, n) AS (SELECT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.n),
l AS (SELECT id, min(n) AS label FROM r GROUP BY id)
SELECT 'fetched' AS stage, count(*)::BIGINT AS rows FROM ck UNION ALL SELECT 'accepted', count_if(reason = 'accepted')::BIGINT FROM ck
UNION ALL SELECT 'verified', count_if(ok)::BIGINT FROM vr UNION ALL SELECT 'duplicates', (count(*) - count(DISTINCT label))::BIGINT FROM l
UNION ALL SELECT 'saved', count(DISTINCT label)::BIGINT FROM l""")
def _(d):
    verify = lambda rows: VF.with_trust(rows, AS_OF)
    dedup = lambda rows: DD.intra_batch(DD.with_fingerprints(rows.withColumn("content_snippet", F.col("body"))))
    return AG.ingest_run(VF.validated(d.f_articles, AS_OF), verify, dedup)[1]


# ------------------------------------------------------------------ streams

def _article_stream(d):
    """Articles as they land: the same view over a file stream of documents."""
    from storyflow.plans.data import VIEWS

    return d.spark.sql(VIEWS["f_articles"].replace("FROM documents", "FROM {documents}"), documents=d.stream("documents"))


@query("dd_11", f"SELECT DISTINCT {_norm_url('url')} AS normalized_url FROM f_articles")
def _(d):
    path, cp = ST.scratch(d.spark, "dedup")
    ST.write_files(ST.dedup_stream(_article_stream(d)).select("normalized_url", "article_id"), path, cp)
    return d.spark.read.parquet(path).select("normalized_url")


#: Batches of the clustering stream by arrival; events of the first are older than 72 h when the second ends.
_CUTS = ["2024-01-01 00:00:00", "2024-01-25 00:00:00", "2024-01-29 00:00:00", "2024-01-31 00:00:01"]
_ENDS = ["2024-01-25 00:00:00", "2024-01-29 00:00:00", "2024-01-31 00:00:00"]


def _renamed(sql: str, names: str, k: int) -> str:
    return re.sub(rf"(?<![\w'.])({names})(?![\w'])", rf"\g<1>{k}", sql)


def _cluster_step_sql(k: int) -> str:
    """Events e{k} after batch k, from e{k-1}."""
    end, day = f"TIMESTAMP '{_ENDS[k - 1]}'", _ENDS[k - 1][:10]
    at = lambda sql: sql.replace(NOW, end)
    greedy = _renamed(greedy_sql(_STORY_ORDER, K.STOP_WORDS).replace("FROM f_articles", "FROM ba"), "n|ut|pr|nb|g|asg|ba", k)
    return f"""
ba{k} AS (SELECT * FROM f_articles WHERE created_at >= TIMESTAMP '{_CUTS[k - 1]}' AND created_at < TIMESTAMP '{_CUTS[k]}'),
{greedy},
cl{k} AS MATERIALIZED (SELECT r.*, a.title, a.url, a.source_domain, a.is_official, a.published_at AS canonical_at FROM ({_renamed(_ROLL.format(src='ba'), 'asg|ba', k)}) r
  JOIN ba{k} a ON a.article_id = r.leader_id),
ev{k} AS MATERIALIZED (SELECT * FROM e{k - 1} WHERE created_at >= {end} - INTERVAL 72 HOUR AND created_at <= {end}),
eu{k} AS (SELECT primary_source_url AS url, arg_max(event_id, (epoch_us(created_at), event_id)) AS event_id FROM ev{k} GROUP BY 1),
mu{k} AS (SELECT leader_id, event_id FROM cl{k} c JOIN eu{k} u ON u.url = c.url),
ct{k} AS (SELECT leader_id, {token_set('title', K.STOP_WORDS)} AS tok FROM cl{k} WHERE leader_id NOT IN (SELECT leader_id FROM mu{k})),
et{k} AS (SELECT event_id, created_at, {token_set('headline', K.STOP_WORDS)} AS tok FROM ev{k}),
mj{k} AS (SELECT leader_id, event_id, row_number() OVER (PARTITION BY leader_id ORDER BY j DESC, created_at DESC, event_id DESC) AS rn
  FROM (SELECT leader_id, event_id, created_at, {jac('c.tok', 'e.tok')} AS j FROM ct{k} c, et{k} e WHERE len(c.tok) > 0 AND len(e.tok) > 0) WHERE j >= 0.35e0),
ma{k} AS MATERIALIZED (SELECT * FROM mu{k} UNION ALL SELECT leader_id, event_id FROM mj{k} WHERE rn = 1),
oc{k} AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY NOT is_official, canonical_at DESC NULLS LAST, leader_id) AS rn FROM cl{k} WHERE leader_id NOT IN (SELECT leader_id FROM ma{k})),
od{k} AS (SELECT url, list_sort(list(DISTINCT dd)) AS source_domains FROM (SELECT url, unnest(source_domains) AS dd FROM oc{k}) GROUP BY url),
cr{k} AS MATERIALIZED (SELECT sha256(url || '|{day}') AS event_id, title AS headline, source_domains, {at(_P_NEW)} AS priority_score, source_domain AS primary_source_domain, url AS primary_source_url,
    earliest_published AS published_at, {end} AS created_at
  FROM (SELECT c.title, c.url, c.source_domain, c.earliest_published, o.source_domains, len(o.source_domains) AS source_count FROM oc{k} c JOIN od{k} o ON o.url = c.url WHERE c.rn = 1)),
mc{k} AS (SELECT c.*, m.event_id FROM cl{k} c JOIN ma{k} m ON m.leader_id = c.leader_id),
md{k} AS (SELECT event_id, list(DISTINCT dd) AS nd FROM (SELECT event_id, unnest(source_domains) AS dd FROM mc{k}) GROUP BY 1),
mo{k} AS (SELECT event_id, arg_min(title, leader_id) AS ot, arg_min(source_domain, leader_id) AS od, arg_min(url, leader_id) AS ou FROM mc{k} WHERE is_official GROUP BY 1),
up{k} AS MATERIALIZED (SELECT event_id, CASE WHEN ot IS NOT NULL AND NOT {_STRONG} THEN ot ELSE headline END AS headline, source_domains, {at(priority_sql())} AS priority_score,
    CASE WHEN ot IS NOT NULL AND NOT {_STRONG} THEN od ELSE primary_source_domain END AS primary_source_domain,
    CASE WHEN ot IS NOT NULL AND NOT {_STRONG} THEN ou ELSE primary_source_url END AS primary_source_url, published_at, created_at
  FROM (SELECT v.event_id, headline, primary_source_domain, primary_source_url, published_at, created_at, ot, od, ou, NULL::VARCHAR AS event_type, []::VARCHAR[] AS companies, NULL::DOUBLE AS funding_amount,
      list_sort(list_distinct(list_concat(v.source_domains, md{k}.nd))) AS source_domains FROM ev{k} v JOIN md{k} ON md{k}.event_id = v.event_id LEFT JOIN mo{k} ON mo{k}.event_id = v.event_id)),
e{k} AS MATERIALIZED (SELECT * FROM e{k - 1} WHERE event_id NOT IN (SELECT event_id FROM up{k}) UNION ALL SELECT * FROM up{k} UNION ALL SELECT * FROM cr{k})"""


_EVENTS = ("WITH RECURSIVE e0 AS (SELECT ''::VARCHAR AS event_id, ''::VARCHAR AS headline, []::VARCHAR[] AS source_domains, 0e0 AS priority_score, '' AS primary_source_domain, '' AS primary_source_url, "
           "TIMESTAMP '2000-01-01' AS published_at, TIMESTAMP '2000-01-01' AS created_at WHERE false)," + ",".join(_cluster_step_sql(k) for k in (1, 2, 3)))


def _event_stream(d):
    """Articles land in three files, which the stream takes one at a time."""
    path, checkpoint = ST.scratch(d.spark, "events")
    landing = path.removesuffix("/table") + "/landing"
    articles = d.f_articles.select("article_id", "title", "description", "url", "source_domain", "is_official", "published_at", "created_at")
    moment = lambda t: F.lit(t).cast("timestamp")
    for lo, hi in zip(_CUTS, _CUTS[1:]):
        articles.filter((F.col("created_at") >= moment(lo)) & (F.col("created_at") < moment(hi))).coalesce(1).write.mode("append").parquet(f"{landing}/until={hi[:10]}")
    stream = d.spark.readStream.schema(articles.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(landing)
    ST.cluster_stream(stream, path, checkpoint, log_path=f"{path}-log")
    return path


@query("cl_09", f"""{_EVENTS} SELECT event_id, headline, len(source_domains)::INT AS source_count, priority_score, array_to_string(source_domains, ',') AS source_domains,
  {stamp('created_at')} AS created_at FROM e3""")
def _(d):
    return SK.read_table(d.spark, _event_stream(d)).select("event_id", "headline", "source_count", "priority_score", joined("source_domains").alias("source_domains"),
                                                           text_ts("created_at").alias("created_at"))


@query("cl_09_state", _EVENTS + " " + " UNION ALL ".join(f"""
SELECT '{_ENDS[k - 1]}' AS as_of, (SELECT count(*) FROM e{k - 1} WHERE created_at >= TIMESTAMP '{_ENDS[k - 1]}' - INTERVAL 72 HOUR)::BIGINT AS state_rows,
  (SELECT count(*) FROM cr{k})::BIGINT AS created, (SELECT count(*) FROM up{k})::BIGINT AS updated""" for k in (1, 2, 3)))
def _(d):
    """What each batch read of the state, created and updated."""
    return d.spark.read.option("recursiveFileLookup", "true").parquet(_event_stream(d) + "-log")


@query("tr_13", f"""
WITH w AS (SELECT e.event_type AS entity, time_bucket(INTERVAL 6 HOUR, e.ts, TIMESTAMP '2000-01-01') - k * INTERVAL 6 HOUR AS s FROM events e, (SELECT unnest([0, 1, 2, 3]) AS k)),
c AS (SELECT s, entity, count(*)::BIGINT AS n FROM w GROUP BY 1, 2)
SELECT {stamp('c.s')} AS window_start, c.entity, c.n AS mention_count, coalesce(p.n, 0)::BIGINT AS previous_mention_count,
  CASE WHEN coalesce(p.n, 0) = 0 THEN 100e0 ELSE {half_even('(c.n - p.n) * 1e0 / p.n * 100e0')} END AS velocity
FROM c LEFT JOIN c p ON p.entity = c.entity AND p.s = c.s - INTERVAL 24 HOUR""")
def _(d):
    """Mentions land in five files, out of order by up to four days."""
    path, cp = ST.scratch(d.spark, "windows")
    landing = path.removesuffix("/table") + "/landing"
    rows = d.events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("entity"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.col("event_id") % 5 * 86_400_000_000).alias("seen"))
    ends = rows.agg(F.min("seen").alias("a"), F.max("seen").alias("b")).first()
    for i in range(5):
        part = F.least(F.lit(4), F.floor((F.col("seen") - ends["a"]) * 5 / (ends["b"] - ends["a"] + 1)))
        rows.filter(part == i).select("ts", "entity").coalesce(1).write.mode("append").parquet(f"{landing}/{i}")
    s = d.spark.readStream.schema("ts timestamp, entity string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(landing)
    ST.velocity_stream(s, path, cp)
    return SK.read_table(d.spark, path).drop("day").withColumn("window_start", text_ts("window_start"))


@query("ag_04_stream", """
SELECT window_start, identity, requests, request_limit, requests > request_limit AS over_limit FROM (
  SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id::VARCHAR AS identity, count(*)::BIGINT AS requests,
    CASE WHEN user_id % 5 <> 0 THEN 100 ELSE 20 END::INT AS request_limit FROM events GROUP BY 1, 2, 4)""")
def _(d):
    path, cp = ST.scratch(d.spark, "requests")
    s = d.stream("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("identity"), (F.col("user_id") % 5 != 0).alias("authenticated"))
    ST.keep_latest(ST.request_stream(s), path, cp, ["window_start", "identity"])
    return SK.read_table(d.spark, path).withColumn("window_start", text_ts("window_start"))


@query("nt_07", f"""
SELECT event_id, event_type, floor(priority_score)::INT AS priority FROM f_story_events
WHERE NOT notification_sent AND priority_score >= 85 AND (priority_score >= 95 OR coalesce(event_type IN {sql_in(K.INTERRUPT_TYPES)}, false))""")
def _(d):
    path, cp = ST.scratch(d.spark, "alerts")
    a = _article_stream(d)
    from storyflow.plans.data import VIEWS

    text = VIEWS["f_story_events"].replace("FROM f_articles a JOIN f_analyses n", "FROM {arts} a JOIN {known} n")
    scored = d.spark.sql(text, arts=a, known=d.f_analyses)
    ST.keep_latest(ST.alert_stream(scored), path, cp, ["event_id"])
    return SK.read_table(d.spark, path).withColumn("event_type", F.nullif("event_type", F.lit("news"))).select("event_id", "event_type", "priority")


@query("ss_01_stream", f"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
x AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*)::BIGINT AS events FROM s GROUP BY user_id, sid)
SELECT user_id, {stamp('a')} AS session_start, {stamp('b')} AS session_end, events FROM x WHERE b <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(d):
    """Sessions that the watermark has closed."""
    path, cp = ST.scratch(d.spark, "sessions")
    s = d.stream("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    ST.write_files(ST.session_stream(s), path, cp)
    return d.spark.read.parquet(path).withColumns({c: text_ts(c) for c in ("session_start", "session_end")})
