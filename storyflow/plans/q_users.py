"""Personalisation and enrichment queries."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.functions import text as T
from storyflow.operators import briefs as BR
from storyflow.operators import enrich as EN
from storyflow.operators import personalize as PZ
from storyflow.operators.feeds import with_text
from storyflow.plans.data import AS_OF, DAY, DAY_END
from storyflow.plans.q_scalar import (
    FRESH_PRIORITY, FUND, GOV, IMPACT, LAUNCH, RESEARCH, TRUST_SET, _DIGIT_SUM, _TEXT, count_sql, priority_sql,
)
from storyflow.functions import scores as S
from storyflow.plans.registry import NOW, age0, half_even, joined, norm_title, query, sql_in, sql_list, stamp, text_ts
from storyflow.session import materialize

# ------------------------------------------------------------------ PZ

_END = f"TIMESTAMP '{DAY_END}'"


def _tag_sql(n: str, a: str) -> str:
    parts = (f"list_concat([{n}.category, {n}.event_type, {a}.source_domain], coalesce({n}.tags, []), coalesce({n}.keywords, []), coalesce({n}.companies, []), "
             f"coalesce({n}.products_mentioned, []), coalesce({n}.technologies_mentioned, []), coalesce({n}.models_mentioned, []))")
    return f"list_distinct(list_filter(list_transform({parts}, lambda x: lower(trim(coalesce(x, '')))), lambda x: x <> ''))"


_TAGGED = f"""
tg AS (SELECT a.article_id, a.title, a.description, a.source_domain, a.trust_score, a.is_verified, a.is_duplicate, a.ai_processed, a.importance_score, a.priority_score,
  a.final_score, a.published_at, a.created_at, n.category, n.event_type, n.companies, n.tags, n.keywords, n.products_mentioned, n.technologies_mentioned, n.models_mentioned,
  n.summary, {_tag_sql('n', 'a')} AS tag_set FROM f_news a LEFT JOIN f_stored n ON n.article_id = a.article_id),
tp AS (SELECT *, CASE WHEN coalesce(category, '') <> '' THEN lower(trim(category)) ELSE coalesce(list_min(tag_set), 'general ai') END AS primary_tag FROM tg)"""
_ARTICLE = ["article_id", "title", "description", "source_domain", "trust_score", "is_verified", "is_duplicate", "ai_processed", "importance_score",
            "priority_score", "final_score", "published_at", "created_at"]


def _tagged(d):
    return PZ.with_tags(d.f_news.select(*_ARTICLE).join(d.f_stored.drop("model_used", "sentiment", "funding_amount"), "article_id", "left"))


@query("pz_01", f"WITH {_TAGGED} SELECT article_id, array_to_string(list_sort(tag_set), '|') AS tags FROM tp")
def _(d):
    return _tagged(d).select("article_id", F.array_join(F.array_sort("tag_set"), "|").alias("tags"))


@query("pz_02", f"WITH {_TAGGED} SELECT article_id, primary_tag FROM tp")
def _(d):
    return _tagged(d).select("article_id", "primary_tag")


_EXPAND = "CASE {t} " + " ".join(f"WHEN '{k}' THEN {sql_list(v)}" for k, v in K.TOPIC_EXPANSIONS.items()) + " ELSE []::VARCHAR[] END"
_EXPLICIT = f"""
er AS (SELECT user_id, lower(trim(unnest(favorite_categories))) AS term, 3.5e0 AS w FROM f_preferences
  UNION ALL SELECT user_id, lower(trim(unnest(favorite_companies))), 2.5e0 FROM f_preferences
  UNION ALL SELECT user_id, lower(trim(unnest(favorite_topics))), 3e0 FROM f_preferences
  UNION ALL SELECT user_id, unnest({_EXPAND.format(t='t')}), 1.65e0 FROM (SELECT user_id, lower(trim(unnest(favorite_topics))) AS t FROM f_preferences)),
ea AS (SELECT user_id, term, sum(w) AS weight FROM er WHERE term <> '' GROUP BY 1, 2)"""
_BEHAVE = f"""
br AS (SELECT b.user_id, unnest(t.tag_set) AS term, 5e0 * pow(0.5e0, greatest(0e0, (epoch_us({NOW}) - epoch_us(b.created_at)) / 86400e6) / 14e0) AS w
  FROM f_bookmarks b JOIN tp t ON t.article_id = b.article_id WHERE (epoch_us({NOW}) - epoch_us(b.created_at)) / 86400e6 <= 180),
ba AS (SELECT user_id, term, sum(w) AS weight FROM br GROUP BY 1, 2)"""
_VECTOR = f"""{_TAGGED}, {_EXPLICIT}, {_BEHAVE},
av AS (SELECT user_id, term, sum(weight) AS weight FROM (SELECT * FROM ea UNION ALL SELECT * FROM ba) GROUP BY 1, 2)"""


@query("pz_03", f"WITH {_EXPLICIT} SELECT user_id, term, {half_even('weight', 6)} AS weight FROM ea")
def _(d):
    return PZ.explicit_affinity(d.f_preferences).withColumn("weight", T.py_round(F.col("weight"), 6))


@query("pz_04", f"WITH {_TAGGED}, {_BEHAVE} SELECT user_id, term, {half_even('weight', 4)} AS weight FROM ba")
def _(d):
    return PZ.bookmark_affinity(d.f_bookmarks, _tagged(d), AS_OF).withColumn("weight", T.py_round(F.col("weight"), 4))


def _vectors(d):
    return PZ.affinity_vectors(PZ.explicit_affinity(d.f_preferences), PZ.bookmark_affinity(d.f_bookmarks, _tagged(d), AS_OF))


@query("pz_05", f"WITH {_VECTOR} SELECT user_id, term, {half_even('weight', 4)} AS weight FROM av")
def _(d):
    return _vectors(d).withColumn("weight", T.py_round(F.col("weight"), 4))


_POOL = f"""
pl AS (SELECT * FROM tp WHERE is_verified AND ai_processed AND NOT is_duplicate AND trust_score >= 40
  AND created_at BETWEEN TIMESTAMP '{DAY} 00:00:00' AND {_END} )"""
_AFF = f"""
af AS (SELECT v.user_id, p.article_id, {half_even('1e0 - exp(-sum(v.weight) / 4e0)', 4)} AS affinity
  FROM (SELECT article_id, unnest(tag_set) AS term FROM pl) p JOIN av v ON v.term = p.term GROUP BY 1, 2)"""
_BLOCK = """
bk AS (SELECT DISTINCT u.user_id, p.article_id FROM (SELECT user_id, lower(trim(unnest(blocked_topics))) AS term FROM f_preferences) u
  JOIN pl p ON list_contains(p.tag_set, u.term) OR contains(lower(trim(p.title)), u.term))"""
_SCORED = f"""{_VECTOR}, {_POOL}, {_AFF}, {_BLOCK},
ql AS (SELECT *, greatest(priority_score, final_score) AS bt, greatest(priority_score, final_score) * 0.52e0 + trust_score * 0.2e0 + importance_score * 0.18e0
  + CASE WHEN published_at IS NULL THEN 0.5e0 ELSE exp(-{age0(now=_END)} / 24e0) END * 100e0 * 0.1e0 AS q FROM pl),
us AS (SELECT user_id FROM f_users WHERE is_active),
sc AS (SELECT us.user_id, ql.article_id, ql.primary_tag, coalesce(af.affinity, 0e0) AS affinity, q, bt,
    q * (0.7e0 + 0.3e0 * coalesce(af.affinity, 0e0)) + 12e0 * coalesce(af.affinity, 0e0) AS raw
  FROM us CROSS JOIN ql LEFT JOIN af ON af.user_id = us.user_id AND af.article_id = ql.article_id
  WHERE NOT EXISTS (SELECT 1 FROM bk WHERE bk.user_id = us.user_id AND bk.article_id = ql.article_id)),
sd AS (SELECT user_id, article_id, primary_tag, affinity, {half_even('least(100e0, CASE WHEN bt >= 85 THEN greatest(raw, bt * 0.72e0) ELSE raw END)')} AS personalized_score,
  {half_even('least(100e0, q)')} AS quality_score, {half_even('bt')} AS base_trend_score,
  CASE WHEN affinity = 0 THEN 'quality threshold' WHEN bt >= 85 THEN 'global trend override' ELSE 'profile affinity' END AS reason FROM sc)"""


def _pool(d):
    """Today's pool with tags, stored once."""
    pool = PZ.brief_pool(d.f_news.select(*_ARTICLE), d.f_stored.drop("model_used", "sentiment", "funding_amount"), DAY_END)
    return materialize(PZ.with_tags(pool), "pool")


def _active(d):
    return d.f_users.filter("is_active")


@query("pz_06", f"WITH {_VECTOR}, {_POOL}, {_AFF} SELECT * FROM af")
def _(d):
    return PZ.pool_affinity(_vectors(d), _pool(d))


@query("pz_07", f"WITH {_TAGGED}, {_POOL}, {_BLOCK} SELECT * FROM bk")
def _(d):
    return PZ.blocked_pairs(d.f_preferences, _pool(d))


_SCORES = ["article_id", "personalized_score", "quality_score", "affinity", "base_trend_score", "reason"]


@query("pz_08", f"""
WITH {_SCORED} SELECT user_id, {', '.join(_SCORES)} FROM sd WHERE affinity > 0
UNION ALL SELECT NULL, article_id, {half_even('least(100e0, CASE WHEN bt >= 85 THEN greatest(q * 0.7e0, bt * 0.72e0) ELSE q * 0.7e0 END)')}, {half_even('least(100e0, q)')}, 0e0,
  {half_even('bt')}, 'quality threshold' FROM ql""")
def _(d):
    """Pairs with an affinity, and the score that an article has for everybody else once."""
    pool = _pool(d)
    pairs = PZ.score_pairs(_active(d), pool, _vectors(d), d.f_preferences, DAY_END)
    rest = PZ.default_scores(pool, DAY_END).withColumn("user_id", F.lit(None).cast(pairs.schema["user_id"].dataType))
    return pairs.select("user_id", *_SCORES).unionByName(rest.select("user_id", *_SCORES))


@query("pz_09", f"WITH {_TAGGED}, {_POOL} SELECT article_id, priority_score, final_score FROM pl")
def _(d):
    return _pool(d).select("article_id", "priority_score", "final_score")


@query("pz_10", f"""
WITH {_SCORED}, e AS (SELECT user_id, count(*)::BIGINT AS eligible FROM sd WHERE personalized_score >= 42 OR base_trend_score >= 85 GROUP BY 1),
t AS (SELECT *, CASE WHEN eligible > 18 THEN least(eligible, 20) ELSE eligible END AS target FROM e)
SELECT user_id, eligible, target::BIGINT AS target, greatest(1, ceil(target * 0.35e0))::INT AS tag_quota FROM t""")
def _(d):
    return PZ.brief_targets(_active(d), _pool(d), _vectors(d), d.f_preferences, DAY_END).withColumn("target", F.col("target").cast("bigint"))


_SEED = _DIGIT_SUM.format(s=f"user_id || ':{DAY}'")


@query("pz_11", f"""
WITH {_SCORED}, o AS (SELECT sd.*, row_number() OVER (PARTITION BY user_id ORDER BY quality_score DESC, base_trend_score DESC, personalized_score DESC, article_id) AS pos
  FROM sd WHERE (personalized_score >= 42 OR base_trend_score >= 85) AND quality_score >= 42
  AND NOT EXISTS (SELECT 1 FROM av WHERE av.user_id = sd.user_id AND av.term = sd.primary_tag))
SELECT user_id, article_id, quality_score, pos::INT AS pos FROM o WHERE pos <= CASE WHEN ({_SEED}) % 3 = 0 THEN 1 ELSE 2 END""")
def _(d):
    return BR.serendipity(_active(d), _pool(d), _vectors(d), d.f_preferences, DAY_END, DAY)


def _briefs(d):
    return BR.select_briefs(_active(d), _pool(d), _vectors(d), d.f_preferences, DAY_END, DAY)


def _choice_sql(items: str, readers: str = "us") -> str:
    """The selection rule, one pick a step. ``items``: user_id, i, s (score), ql (quality), tr (trend), tg, ts (tag set), nv (tag unknown)."""
    return f"""
it AS MATERIALIZED ({items}),
n0 AS (SELECT user_id, count(*) AS n FROM it GROUP BY 1),
tq AS (SELECT user_id, CASE WHEN n > 18 THEN least(n, 20) ELSE n END AS target FROM n0),
hd AS MATERIALIZED (SELECT * FROM (SELECT it.user_id, i, s, ql, tr, tg, row_number() OVER (PARTITION BY user_id ORDER BY ql DESC, tr DESC, s DESC, i) AS rn FROM it WHERE nv AND ql >= 42)
  WHERE rn <= CASE WHEN ({_SEED}) % 3 = 0 THEN 1 ELSE 2 END),
lim AS MATERIALIZED (SELECT tq.user_id, target, greatest(1, ceil(target * 0.35e0)) AS quota, target - (SELECT count(*) FROM hd WHERE hd.user_id = tq.user_id) AS main FROM tq),
fr AS MATERIALIZED (SELECT it.user_id, i, s, tg, ts, quota, main FROM it JOIN lim ON lim.user_id = it.user_id WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.user_id = it.user_id AND hd.i = it.i)),
st(user_id, step, ci, cg, cs, go) AS (
  SELECT user_id, 0, []::BIGINT[], []::VARCHAR[], []::VARCHAR[][], main > 0 FROM lim
  UNION ALL
  SELECT user_id, any_value(step) + 1, CASE WHEN max(gain) IS NULL THEN any_value(ci) ELSE list_append(any_value(ci), arg_min(i, (-gain, -s, i)) FILTER (WHERE gain IS NOT NULL)) END,
    CASE WHEN max(gain) IS NULL THEN any_value(cg) ELSE list_append(any_value(cg), arg_min(tg, (-gain, -s, i)) FILTER (WHERE gain IS NOT NULL)) END,
    CASE WHEN max(gain) IS NULL THEN any_value(cs) ELSE list_append(any_value(cs), arg_min(ts, (-gain, -s, i)) FILTER (WHERE gain IS NOT NULL)) END,
    max(gain) IS NOT NULL AND any_value(step) + 1 < any_value(main)
  FROM (SELECT st.*, fr.i, fr.s, fr.tg, fr.ts, fr.main,
      CASE WHEN list_contains(ci, fr.i) OR len(list_filter(cg, lambda g: g = fr.tg)) >= quota THEN NULL ELSE
        s * 0.86e0 - coalesce(list_max(list_transform(cs, lambda c: len(list_intersect(c, fr.ts)) * 1e0 / greatest(1, len(c) + len(fr.ts) - len(list_intersect(c, fr.ts))))), 0e0) * 22e0
        + CASE WHEN list_contains(cg, fr.tg) THEN 0e0 ELSE 4e0 END END AS gain
    FROM st JOIN fr ON fr.user_id = st.user_id WHERE go) GROUP BY user_id),
ch AS (SELECT user_id, ci, cg FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step DESC) AS rn FROM st) WHERE rn = 1),
h2 AS (SELECT hd.*, target, quota, len(ci) AS got, len(list_filter(cg, lambda g: g = hd.tg)) + (SELECT count(*) FROM hd o WHERE o.user_id = hd.user_id AND o.tg = hd.tg AND o.rn < hd.rn) AS same
  FROM hd JOIN ch ON ch.user_id = hd.user_id JOIN lim ON lim.user_id = hd.user_id),
pk AS (SELECT user_id, i, FALSE AS sp, pos AS seq FROM (SELECT user_id, unnest(ci) AS i, generate_subscripts(ci, 1) AS pos FROM ch)
  UNION ALL SELECT user_id, i, TRUE, 100 + rn FROM h2 WHERE same < quota AND got + (SELECT count(*) FROM h2 o WHERE o.user_id = h2.user_id AND o.rn < h2.rn AND o.same < o.quota) < target),
bf AS (SELECT pk.user_id, pk.i AS article_id, row_number() OVER (PARTITION BY pk.user_id ORDER BY sp, s DESC, tr DESC, seq)::INT AS pos, sp AS is_serendipity, s AS personalized_score, tg AS primary_tag, it.a AS affinity
  FROM pk JOIN it ON it.user_id = pk.user_id AND it.i = pk.i)"""


def _items_sql(source: str = "sd", extra: str = "TRUE") -> str:
    return (f"SELECT x.user_id, x.article_id AS i, personalized_score AS s, quality_score AS ql, base_trend_score AS tr, x.primary_tag AS tg, pl.tag_set AS ts, affinity AS a, "
            f"NOT EXISTS (SELECT 1 FROM av WHERE av.user_id = x.user_id AND av.term = x.primary_tag) AS nv FROM {source} x JOIN pl ON pl.article_id = x.article_id "
            f"WHERE (personalized_score >= 42 OR base_trend_score >= 85) AND {extra}")


_PICKED = "user_id, article_id, pos, is_serendipity, personalized_score, primary_tag"
_BRIEFS = f"WITH RECURSIVE {_SCORED}, {_choice_sql(_items_sql())}"


@query("pz_12", f"{_BRIEFS} SELECT {_PICKED} FROM bf")
def _(d):
    return _briefs(d).select(*_PICKED.split(", "))


@query("ud_03", f"WITH RECURSIVE {_SCORED}, {_choice_sql(_items_sql(extra='affinity > 0'))} SELECT {_PICKED} FROM bf")
def _(d):
    """The same choice over an own candidate list per user: the articles that share a term."""
    return BR.select_matched(_active(d), _pool(d), _vectors(d), d.f_preferences, DAY_END, DAY).select(*_PICKED.split(", "))


_META = ("list_distinct(list_filter(list_transform(list_concat([title, description, source_domain, summary, category, event_type], coalesce(tags, []), coalesce(keywords, []), "
         "coalesce(companies, []), coalesce(products_mentioned, []), coalesce(technologies_mentioned, []), coalesce(models_mentioned, [])), lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> ''))")
_MINUS = lambda s: "'" + s.replace("'", "''") + "'"
_TOPIC_CASE = lambda i: " ".join(f"WHEN {n} THEN {_MINUS(item[i])}" for n, item in enumerate(K.MENTOR_BACKLOG))
_FB4 = f"(strpos('0123456789abcdef', right(sha256('fallback:' || user_id || ':{DAY}'), 1)) - 1)"
_ACTION = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {_MINUS(v)}" for k, v in K.MENTOR_ACTIONS.items()) + f" ELSE {_MINUS(K.MENTOR_ACTION)} END"


@query("pz_13", f"""
WITH {_TAGGED}, {_POOL}, p AS (SELECT *, greatest(final_score, priority_score) AS base, {_META} AS meta FROM pl),
u AS (SELECT u.user_id, coalesce(f.favorite_categories, []) AS fc, coalesce(f.favorite_companies, []) AS fo, coalesce(f.blocked_topics, []) AS bl
  FROM f_users u LEFT JOIN f_preferences f ON f.user_id = u.user_id WHERE u.is_active),
r AS (SELECT u.user_id, p.*, base + CASE WHEN list_contains(fc, category) THEN 8 ELSE 0 END + CASE WHEN list_has_any(fo, coalesce(companies, [])) THEN 6 ELSE 0 END AS sc
  FROM u JOIN p ON NOT list_has_any(list_transform(bl, lambda x: lower(x)), meta)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sc DESC, article_id) AS rn FROM r WHERE sc >= 55) WHERE rn = 1),
f AS (SELECT u.user_id, b.article_id, coalesce(nullif(category, ''), 'AI practice') AS topic,
    coalesce(nullif(products_mentioned[1], ''), nullif(technologies_mentioned[1], ''), nullif(models_mentioned[1], ''), nullif(keywords[1], ''), 'a small prototype') AS tool,
    CASE WHEN coalesce(summary, '') <> '' THEN substr(summary, 1, 180) WHEN coalesce(tags[1], '') <> '' THEN 'the article is tagged ' || tags[1] ELSE substr(title, 1, 120) END AS reason,
    {_ACTION} AS action, meta FROM u LEFT JOIN b ON b.user_id = u.user_id),
g AS (SELECT *, article_id IS NOT NULL AND len(list_filter(meta, lambda m: contains(lower(reason), m) OR contains(m, substr(lower(reason), 1, 60)))) > 0 AS ok FROM f)
SELECT user_id, CASE WHEN ok THEN article_id END AS article_id, CASE WHEN ok THEN topic ELSE CASE ({_FB4}) % 4 {_TOPIC_CASE(0)} END END AS topic,
  CASE WHEN ok THEN tool ELSE CASE ({_FB4}) % 4 {_TOPIC_CASE(1)} END END AS tool, CASE WHEN ok THEN reason ELSE {_MINUS(K.MENTOR_FALLBACK_REASON)} END AS reason,
  NOT ok AS fallback FROM g""")
def _(d):
    return PZ.mentor_picks(_active(d), d.f_preferences, _pool(d), DAY).select("user_id", "article_id", "topic", "tool", "reason", "fallback")


@query("pz_14", f"""{_BRIEFS} SELECT user_id, string_agg(article_id, ',' ORDER BY pos) AS article_ids, count(*)::INT AS total_articles,
  {half_even('avg(affinity) * 100e0')} AS personalization_score FROM bf GROUP BY user_id""")
def _(d):
    return BR.brief_rows(_briefs(d), DAY).select("user_id", joined("article_ids").alias("article_ids"), "total_articles", "personalization_score")


@query("pz_15", f"""{_BRIEFS} SELECT count(DISTINCT bf.user_id)::BIGINT AS generated, (count(DISTINCT us.user_id) - count(DISTINCT bf.user_id))::BIGINT AS skipped
FROM us LEFT JOIN bf ON bf.user_id = us.user_id""")
def _(d):
    return BR.brief_run_counts(d.f_users, BR.brief_rows(_briefs(d), DAY))


_NOON = f"TIMESTAMP '{DAY} 12:00:00'"


def _step(sql: str, suffix: str) -> str:
    """The selection's names with a suffix, so that two selections stand in one text."""
    return re.sub(r"(?<![\w.'])(it|n0|tq|hd|lim|fr|st|ch|h2|pk|bf)(?![\w'(])", lambda m: m.group(1) + suffix, sql).replace("\nst(", f"\nst{suffix}(")


_MORNING = _step(_choice_sql(_items_sql(extra=f"pl.created_at < {_NOON}")), "_am")
_HOT = f"(pl.created_at >= {_NOON} AND greatest(pl.priority_score, pl.final_score) >= 85)"


@query("pz_16", f"""
WITH RECURSIVE {_SCORED}, {_MORNING},
gr AS (SELECT DISTINCT x.user_id FROM sd x JOIN pl ON pl.article_id = x.article_id WHERE {_HOT} AND x.user_id IN (SELECT user_id FROM bf_am)),
{_choice_sql(_items_sql(extra=f"x.user_id IN (SELECT user_id FROM gr) AND ({_HOT} OR EXISTS (SELECT 1 FROM bf_am b WHERE b.user_id = x.user_id AND b.article_id = x.article_id))"))}
SELECT user_id, article_id, pos, is_serendipity FROM bf""")
def _(d):
    """Morning briefs, then the day's later articles arrive as alerts."""
    v = materialize(_vectors(d), "vectors")
    pool = _pool(d)
    noon = F.col("created_at") < F.lit(f"{DAY} 12:00:00").cast("timestamp")
    briefs = BR.brief_rows(BR.select_briefs(_active(d), materialize(pool.filter(noon), "morning"), v, d.f_preferences, DAY_END, DAY), DAY)
    return BR.merge_breaking(materialize(briefs, "briefs"), pool.filter(~noon), pool, v, d.f_preferences, DAY_END, DAY).select("user_id", "article_id", "pos", "is_serendipity")


@query("pz_17", """
SELECT article_id, final_score FROM f_news WHERE is_verified AND NOT is_duplicate ORDER BY final_score DESC, priority_score DESC, created_at DESC, article_id LIMIT 8""")
def _(d):
    return PZ.fallback_brief(d.f_news.select("article_id", "final_score", "priority_score", "created_at", "is_verified", "is_duplicate")).select("article_id", "final_score")


def _stored_briefs(d):
    return d.f_briefs.withColumns({"article_ids": F.transform("article_keys", lambda x: x.cast("bigint")), "brief_date": F.col("brief_ts").cast("date")})


@query("pz_18", """
SELECT b.brief_id, b.user_id, (g.pos - 1)::INT AS pos, a.article_id, a.title FROM f_briefs b, (SELECT unnest([1, 2, 3]) AS pos) g JOIN f_news a ON a.article_id = b.article_keys[g.pos]::BIGINT""")
def _(d):
    ids = _stored_briefs(d).select("brief_id", "user_id", F.posexplode("article_ids").alias("pos", "article_id"))
    return ids.join(d.f_news.select("article_id", "title"), "article_id")


@query("pz_19", """
SELECT user_id, brief_id, strftime(brief_ts, '%Y-%m-%d') AS brief_date, total_articles, row_number() OVER (PARTITION BY user_id ORDER BY brief_ts DESC, brief_id)::INT AS pos FROM f_briefs""")
def _(d):
    from storyflow.operators.feeds import latest_per_user

    return latest_per_user(_stored_briefs(d), "brief_date", "brief_id", 30).select(
        "user_id", "brief_id", F.date_format("brief_date", "yyyy-MM-dd").alias("brief_date"), "total_articles", "pos")


# Picks here are each reader's bookmarks, so that the measure has a plain SQL twin.
@query("pz_20", f"""
WITH {_TAGGED}, x AS (SELECT b.user_id, t.primary_tag, count(*)::BIGINT AS n, count_if(b.article_id % 5 = 0)::BIGINT AS s FROM f_bookmarks b JOIN tp t ON t.article_id = b.article_id GROUP BY 1, 2),
y AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM x)
SELECT user_id, sum(n)::BIGINT AS selected_count, count(*)::BIGINT AS category_coverage, sum(s)::BIGINT AS serendipity_count,
  {half_even('-sum(n * 1e0 / total * log2(n * 1e0 / total))', 3)} + 0e0 AS tag_entropy FROM y GROUP BY user_id""")
def _(d):
    picks = d.f_bookmarks.select("user_id", "article_id", (F.col("article_id") % 5 == 0).alias("is_serendipity")).join(
        _tagged(d).select("article_id", "primary_tag"), "article_id")
    return PZ.diversity(picks)


@query("pz_21", """
SELECT user_id, array_to_string(list_filter([CASE WHEN user_id % 4 = 0 THEN 'agents' ELSE '' END, 'python', CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'agents' END,
  'rag', 'topic' || (user_id % 6)], lambda x: x IS NOT NULL AND x <> ''), ',') AS topics FROM f_users""")
def _(d):
    four = F.col("user_id") % 4 == 0
    return d.f_users.select("user_id", joined(PZ.seed_topics(
        F.when(four, "agents").otherwise(""), F.array(F.lit("python"), F.when(~four, F.lit("agents"))),
        F.array(F.lit("rag"), F.concat(F.lit("topic"), (F.col("user_id") % 6).cast("string")), F.lit("python")))).alias("topics"))


@query("pz_22", f"""
WITH bm AS (SELECT user_id, string_agg(title, '|' ORDER BY pos) AS bookmarked FROM (SELECT b.user_id, a.title, row_number() OVER (PARTITION BY b.user_id ORDER BY b.created_at DESC, b.article_id) AS pos
  FROM f_bookmarks b JOIN f_news a ON a.article_id = b.article_id) WHERE pos <= 10 GROUP BY 1),
bt AS (SELECT b.user_id, string_agg(a.title, '|' ORDER BY g.pos) AS brief_titles FROM f_briefs b, (SELECT unnest([1, 2, 3]) AS pos) g JOIN f_news a ON a.article_id = b.article_keys[g.pos]::BIGINT
  WHERE CAST(b.brief_ts AS DATE) = DATE '{DAY}' GROUP BY 1),
nw AS (SELECT string_agg(title || '/' || category, '|' ORDER BY final_score DESC, created_at DESC, article_id) AS news FROM (
  SELECT a.article_id, a.title, coalesce(n.category, 'General') AS category, a.final_score, a.created_at FROM f_news a LEFT JOIN f_stored n ON n.article_id = a.article_id
  WHERE a.is_verified AND NOT a.is_duplicate ORDER BY a.final_score DESC, a.created_at DESC, a.article_id LIMIT 15))
SELECT u.user_id, coalesce(array_to_string(p.favorite_topics, ','), '') AS topics, coalesce(bookmarked, '') AS bookmarked, coalesce(brief_titles, '') AS brief_titles, news
FROM f_users u LEFT JOIN f_preferences p ON p.user_id = u.user_id LEFT JOIN bm ON bm.user_id = u.user_id LEFT JOIN bt ON bt.user_id = u.user_id CROSS JOIN nw""")
def _(d):
    x = PZ.suggestion_inputs(d.f_users, d.f_preferences, d.f_bookmarks, _stored_briefs(d).filter(F.col("brief_date") == F.lit(DAY).cast("date")), d.f_news, d.f_stored)
    text = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return x.select("user_id", F.coalesce(F.array_join("favorite_topics", ","), F.lit("")).alias("topics"), text("bookmarked").alias("bookmarked"),
                    text("brief_titles").alias("brief_titles"),
                    F.array_join(F.transform("recent_news", lambda s: F.concat(s["title"], F.lit("/"), s["category"])), "|").alias("news"))


# ------------------------------------------------------------------ EN

@query("en_01", "SELECT article_id, CASE " + " ".join(
    f"WHEN len(list_filter({sql_list(w)}, lambda k: contains({_TEXT}, k))) > 0 THEN '{n}'" for n, w in K.CATEGORY_RULES) + f" ELSE '{K.DEFAULT_CATEGORY}' END AS category FROM f_articles")
def _(d):
    return with_text(d.f_articles).select("article_id", S.rule_category(F.col("_text")).alias("category"))


# Model responses landed as JSON text; every defect the validator knows occurs.
_RAW = """CASE WHEN doc_id % 20 = 19 THEN 'not json' WHEN doc_id % 20 = 18 THEN '[1, 2]' ELSE
  '{"summary": ' || CASE WHEN doc_id % 20 = 17 THEN '12' ELSE '"Summary ' || CAST(doc_id AS STRING) || ' in ' || lang || '"' END
  || CASE WHEN doc_id % 20 = 16 THEN '' ELSE ', "key_takeaways": ["a", "", "b", "c", "d", "e", "f"]' END
  || CASE WHEN doc_id % 20 = 16 THEN '' ELSE ', "why_it_matters": "because"' END
  || ', "category": "' || CASE doc_id % 20 WHEN 15 THEN 'Cooking' WHEN 1 THEN 'Research' ELSE 'Robotics' END
  || '", "keywords": ' || CASE WHEN doc_id % 20 = 14 THEN '"k"' ELSE '["k1", "k2", "' || source || '"]' END
  || ', "tags": ["t1"], "companies": ["OpenAI", "Meta"], "sentiment": "' || CASE WHEN doc_id % 20 = 13 THEN 'angry' ELSE 'positive' END
  || '", "urgency": "' || CASE WHEN doc_id % 20 = 12 THEN 'now' ELSE 'high' END
  || '", "confidence_score": ' || CAST(doc_id % 130 AS STRING) || ', "importance_score": ' || CASE WHEN doc_id % 20 = 11 THEN '"high"' ELSE CAST(n_chars % 150 AS STRING) || '.5' END
  || ', "event_type": "' || CASE WHEN doc_id % 3 = 0 THEN 'funding' ELSE 'party' END || '", "funding_amount": ' || CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 900 AS STRING) ELSE 'null' END
  || ', "reading_time_minutes": ' || CASE WHEN doc_id % 20 = 10 THEN '"5"' ELSE CAST(doc_id % 25 AS STRING) END || '}' END"""
_ERR = ("CASE doc_id % 20 WHEN 19 THEN 'output is not a JSON object' WHEN 18 THEN 'output is not a JSON object' WHEN 17 THEN 'Invalid type for summary' "
        "WHEN 16 THEN 'Missing required fields: key_takeaways, why_it_matters' WHEN 15 THEN 'Invalid category' WHEN 14 THEN 'Invalid type for keywords' "
        "WHEN 13 THEN 'Invalid sentiment' WHEN 12 THEN 'Invalid urgency' WHEN 11 THEN 'Invalid type for importance_score' "
        "WHEN 10 THEN 'Invalid type for reading_time_minutes' END")


def _responses(d):
    return d.documents.select(F.col("doc_id").alias("article_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                              F.col("text").alias("content"), F.expr(_RAW).alias("raw"))


@query("en_02", f"SELECT doc_id AS article_id, {_ERR} AS error FROM documents")
def _(d):
    return _responses(d).select("article_id", EN.validation_error(F.col("raw")).alias("error"))


@query("en_03", f"""
SELECT doc_id AS article_id, 'Summary ' || doc_id || ' in ' || lang AS summary, 'a,b,c,d,e' AS key_takeaways, CASE doc_id % 20 WHEN 1 THEN 'Research' ELSE 'Robotics' END AS category,
  CASE WHEN doc_id % 3 = 0 THEN 'funding' END AS event_type, 'k1,k2,' || source AS keywords, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 900)::DOUBLE END AS funding_amount,
  least(100, doc_id % 130)::DOUBLE AS confidence_score, least(100e0, n_chars % 150 + 0.5e0) AS importance_score,
  least(15, CASE WHEN doc_id % 25 = 0 THEN 3 ELSE doc_id % 25 END)::INT AS reading_time_minutes
FROM documents WHERE {_ERR} IS NULL""")
def _(d):
    c = EN.coerced(F.col("raw"), F.col("content"))
    ok = _responses(d).filter(EN.validation_error(F.col("raw")).isNull())
    return ok.select("article_id", *[(joined(c[k]) if k in EN.LIST_CAPS else c[k]).alias(k) for k in (
        "summary", "key_takeaways", "category", "event_type", "keywords", "funding_amount", "confidence_score", "importance_score", "reading_time_minutes")])


@query("en_04", f"""
SELECT doc_id AS article_id, {_ERR} AS validation_error, CASE WHEN {_ERR} IS NULL THEN 'Summary ' || doc_id || ' in ' || lang ELSE '{K.DEGRADED_SUMMARY}' || split_part(text, chr(10), 1) END AS summary,
  CASE WHEN {_ERR} IS NULL THEN 'a,b,c,d,e' ELSE substr(split_part(text, chr(10), 1), 1, 180) END AS key_takeaways, CASE WHEN {_ERR} IS NULL THEN 't1' ELSE 'needs-review' END AS tags,
  CASE WHEN {_ERR} IS NULL THEN least(15, CASE WHEN doc_id % 25 = 0 THEN 3 ELSE doc_id % 25 END)
    ELSE greatest(1, round_even(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / 238e0, 0)) END::INT AS reading_time_minutes FROM documents""")
def _(d):
    return EN.analyses_from_responses(_responses(d)).select("article_id", "validation_error", "summary", joined("key_takeaways").alias("key_takeaways"),
                                                            joined("tags").alias("tags"), "reading_time_minutes")


@query("en_05", "SELECT article_id, trust_score FROM f_news WHERE is_verified AND NOT ai_processed AND NOT is_duplicate ORDER BY trust_score DESC, article_id")
def _(d):
    return EN.work_queue(d.f_news.select("article_id", "trust_score", "is_verified", "ai_processed", "is_duplicate")).select("article_id", "trust_score")


def keyword_client():
    """A stand-in for a user's model: valid JSON from the request text alone."""
    def answer(pdf):
        for title, content in zip(pdf["title"], pdf["content"]):
            words = [w for w in title.lower().split() if len(w) > 3][:12]
            yield json.dumps({
                "summary": content or title, "key_takeaways": words[:3], "why_it_matters": title[:80], "category": "General AI",
                "keywords": words, "tags": ["auto"], "companies": [], "sentiment": "neutral", "urgency": "low",
                "confidence_score": 50, "importance_score": min(100, len(words) * 8), "reading_time_minutes": 2})
    return answer


def request_client():
    """The same model behind one request at a time; the first try of some requests fails."""
    answer, tried = keyword_client(), set()

    def ask(request):
        if len(request["title"] or "") % 97 == 13 and request["url"] not in tried:
            tried.add(request["url"])
            raise ConnectionError("busy")
        return next(iter(answer({k: [v] for k, v in request.items()})))

    return ask


_WORDS = "list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda w: length(w) > 3)"


@query("en_06", f"""
SELECT article_id, NULL::VARCHAR AS validation_error, 'General AI' AS category, array_to_string({_WORDS}[1:10], ',') AS keywords,
  least(100, len({_WORDS}[1:12]) * 8)::DOUBLE AS importance_score FROM f_articles""")
def _(d):
    out = EN.analyses_from_responses(EN.call_model(d.f_articles, request_client))
    return out.select("article_id", "validation_error", "category", joined("keywords").alias("keywords"), "importance_score")


@query("ud_02", "SELECT conv_id * 1000 + turn AS article_id, text AS summary FROM conversations")
def _(d):
    turns = d.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("article_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
                                   F.lit("").alias("url"), F.col("role").alias("source_domain"), F.col("text").alias("body"))
    return EN.run_model(turns, keyword_client).select("article_id", F.get_json_object("raw", "$.summary").alias("summary"))


# Articles of one event: runs of three ids.
_FOLD = ["companies", "tags", "keywords", "models_mentioned", "technologies_mentioned"]
_merge = lambda c, k: f"list_sort(list_distinct(list_concat(e.{c}, flatten(list(n.{c})))))[1:{k}]"


@query("en_07", f"""
WITH n AS (SELECT article_id - article_id % 3 AS event_id, article_id AS seq, * FROM f_analyses),
g AS (SELECT event_id, arg_max(category, seq) FILTER (WHERE category <> 'General AI') AS ncat, arg_max(event_type, seq) FILTER (WHERE event_type IS NOT NULL) AS net,
    arg_min(funding_amount, seq) FILTER (WHERE funding_amount <> 0) AS nfund, max(seq) AS ls, arg_max(sentiment, seq) AS sentiment,
    {", ".join(f"flatten(list({c})) AS l_{c}" for c in _FOLD)} FROM n GROUP BY event_id),
m AS (SELECT e.event_id, coalesce(ncat, e.category) AS category, coalesce(net, e.event_type) AS event_type, coalesce(nullif(e.funding_amount, 0), nfund) AS funding_amount, g.sentiment, ls,
    {", ".join(f"list_sort(list_distinct(list_concat(e.{c}, l_{c})))[1:{EN.FOLD_CAPS[c]}] AS {c}" for c in _FOLD)}, e.published_at, e.source_domains
  FROM f_story_events e JOIN g ON g.event_id = e.event_id),
p AS (SELECT m.event_id, {priority_sql()} AS priority_score FROM (SELECT m.event_id, m.published_at, m.source_domains, l.event_type, l.companies, l.funding_amount
  FROM m JOIN f_analyses l ON l.article_id = m.ls) m)
SELECT m.event_id, category, event_type, funding_amount, sentiment, {", ".join(f"array_to_string(m.{c}, '|') AS {c}" for c in _FOLD)}, p.priority_score FROM m JOIN p ON p.event_id = m.event_id""")
def _(d):
    n = d.f_analyses.select(F.expr("article_id - article_id % 3").alias("event_id"), F.col("article_id").alias("seq"), "category", "event_type", "funding_amount", "sentiment", *_FOLD)
    e = d.f_story_events.select("event_id", "category", "event_type", "funding_amount", "published_at", "source_domains", F.size("source_domains").alias("source_count"), *_FOLD)
    out = EN.fold_into_events(e, n, AS_OF)
    return out.select("event_id", "category", "event_type", "funding_amount", "sentiment", *[joined(c, "|").alias(c) for c in _FOLD], "priority_score")


@query("en_08", """
SELECT a.article_id, n.article_id IS NULL OR n.model_used = 'live-fetcher' OR (trim(a.description) <> '' AND trim(n.summary) <> ''
  AND substr(trim(a.description), 1, 500) = substr(trim(n.summary), 1, 500)) AS placeholder
FROM f_news a LEFT JOIN (SELECT article_id, model_used, CASE WHEN article_id % 2 = 0 THEN summary ELSE category END AS summary FROM f_stored) n ON n.article_id = a.article_id""")
def _(d):
    n = d.f_stored.select("article_id", "model_used", F.expr("CASE WHEN article_id % 2 = 0 THEN summary ELSE category END").alias("summary"), F.lit(True).alias("present"))
    x = d.f_news.select("article_id", "description").join(n, "article_id", "left")
    return x.select("article_id", EN.is_placeholder(F.coalesce("present", F.lit(False)), F.col("model_used"), F.col("description"), F.lit(""), F.col("summary")).alias("placeholder"))


@query("en_09", f"SELECT article_id, 64 AS dims, CASE WHEN {norm_title('title')} = '' THEN 0e0 ELSE 1e0 END AS squared_norm FROM f_articles")
def _(d):
    v = EN.with_embedding(d.f_articles.select("article_id", "title"), "title")
    return v.select("article_id", F.size("embedding").alias("dims"), T.py_round(F.aggregate(
        "embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")), 4).alias("squared_norm"))
