"""Text, validation and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.functions import dates as D
from storyflow.functions import scores as S
from storyflow.functions import text as T
from storyflow.functions import vectors as V
from storyflow.operators import validate as VF
from storyflow.operators.feeds import with_text
from storyflow.plans.data import AS_OF, DAY_END
from storyflow.plans.registry import (
    NOW, age, age0, half_even, jac, joined, norm_title, query, sql_in, sql_list, stamp, text_ts, token_set,
)

# ------------------------------------------------------------------ TX

_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _norm_url(u: str) -> str:
    part = lambda i: f"regexp_extract(trim({u}), '{_URL}', {i})"
    path = f"regexp_replace(regexp_replace({part(3)}, ';[^/]*$', ''), '/+$', '')"
    pairs = (f"list_filter(string_split({part(4)}, '&'), lambda p: strpos(p, '=') > 0 AND split_part(p, '=', 2) <> ''"
             f" AND lower(split_part(p, '=', 1)) NOT IN {sql_in(K.TRACKING_PARAMS)})")
    return (f"lower({part(1)}) || '://' || lower({part(2)}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END"
            f" || CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END")


@query("tx_01", f"SELECT page_id, {_norm_url('url')} AS normalized_url FROM pages")
def _(d):
    return d.pages.select("page_id", T.normalize_url(F.col("url")).alias("normalized_url"))


@query("tx_02", "SELECT page_id, lower(regexp_replace(trim(url), '/+$', '')) AS url_key FROM pages")
def _(d):
    return d.pages.select("page_id", T.url_dedup_key(F.col("url")).alias("url_key"))


@query("tx_03", f"SELECT page_id, regexp_replace(lower(regexp_extract(url, '{_URL}', 2)), '^www\\.', '') AS domain FROM pages")
def _(d):
    return d.pages.select("page_id", T.extract_domain(F.col("url")).alias("domain"))


@query("tx_04", f"SELECT doc_id, {norm_title('nfc_normalize(text)')} AS normalized FROM documents")
def _(d):
    return T.ensure_nfc(d.documents, "text").select("doc_id", T.normalize_title(F.col("text")).alias("normalized"))


@query("tx_05", f"SELECT article_id, sha256({norm_title('title')}) AS fp FROM f_articles")
def _(d):
    return d.f_articles.select("article_id", T.title_fingerprint(F.col("title")).alias("fp"))


_CONTENT_FP = f"sha256({norm_title('title')} || '||' || trim(lower(body)))"


@query("tx_06", f"SELECT article_id, {_CONTENT_FP} AS fp FROM f_articles")
def _(d):
    return d.f_articles.select("article_id", T.content_fingerprint(F.col("title"), F.col("body")).alias("fp"))


def entity_fp_sql(product: str) -> str:
    names = "array_to_string(list_sort(list_transform(companies, lambda c: lower(trim(c)))), '|')"
    parts = f"list_filter([{names}, lower(trim({product})), lower(trim(coalesce(event_type, '')))], lambda p: p <> '')"
    return f"CASE WHEN len({parts}) = 0 THEN '' ELSE sha256(array_to_string({parts}, '::')) END"


@query("tx_07", f"SELECT article_id, {entity_fp_sql('products_mentioned[1]')} AS fp FROM f_analyses")
def _(d):
    return d.f_analyses.select("article_id", T.entity_fingerprint(
        F.col("companies"), F.col("products_mentioned")[0], F.col("event_type")).alias("fp"))


@query("tx_08", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), "
                "'&[a-zA-Z]+;', ' ', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM pages")
def _(d):
    return d.pages.select("page_id", T.clean_html(F.col("html")).alias("cleaned"))


@query("tx_09", """
WITH h AS (SELECT doc_id, text, substr(text, 1, 500) AS head,
  CASE WHEN strpos(substr(text, 1, 500), ' ') > 0 THEN 500 - strpos(reverse(substr(text, 1, 500)), ' ') ELSE -1 END AS last FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 500 THEN text
  ELSE regexp_replace(CASE WHEN last > 400 THEN substr(head, 1, last) ELSE head END, '[.,;:]+$', '') || '…' END AS short FROM h""")
def _(d):
    return d.documents.select("doc_id", T.truncate_text(F.col("text"), 500).alias("short"))


@query("tx_10", """
SELECT doc_id, greatest(1, round_even(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / 238e0, 0))::INT AS minutes
FROM documents""")
def _(d):
    return d.documents.select("doc_id", T.reading_time(F.col("text")).alias("minutes"))


@query("tx_11", """
SELECT article_id,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(title), '[^\\x00-\\x7F]', '', 'g')), '[^\\w\\s-]', '', 'g'),
    '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  substr(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'),
    '^-+|-+$', '', 'g'), 1, 100) AS trend_slug
FROM f_articles""")
def _(d):
    return d.f_articles.select("article_id", T.slugify(F.col("title")).alias("slug"), T.trend_slug(F.col("title")).alias("trend_slug"))


@query("tx_12", f"SELECT article_id, array_to_string(list_sort({token_set('title', K.STOP_WORDS)}), ' ') AS tokens FROM f_articles")
def _(d):
    return d.f_articles.select("article_id", F.array_join(F.array_sort(
        T.tokens(T.normalize_title(F.col("title")), K.STOP_WORDS)), " ").alias("tokens"))


@query("tx_13", f"""
WITH t AS (SELECT article_id, {token_set('title')} AS a, {token_set('description')} AS b FROM f_articles)
SELECT article_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0e0 ELSE {half_even(jac('a', 'b'), 6)} END AS jaccard FROM t""")
def _(d):
    tok = lambda c: T.tokens(T.normalize_title(F.col(c)))
    return d.f_articles.select("article_id", tok("title").alias("a"), tok("description").alias("b")).select(
        "article_id", T.py_round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query("tx_14", f"""
SELECT a.vec_id, {half_even('list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 4)} AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(d):
    a = d.embeddings.select("vec_id", F.col("embedding").alias("x"))
    b = d.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", T.py_round(V.cosine(F.col("x"), F.col("y")), 4).alias("cosine"))


@query("tx_15", f"""
SELECT vec_id, len(embedding)::INT AS dims, {half_even('list_sum(embedding::DOUBLE[])', 3)} AS total
FROM embeddings WHERE vec_id % 10 <> 3""")
def _(d):
    # Vectors as stored text; every tenth one is damaged and must be skipped.
    text = F.when(F.col("vec_id") % 10 == 3, F.lit("[1.0, oops")).otherwise(F.to_json("embedding"))
    v = d.embeddings.select("vec_id", V.parse_vector(text).alias("v")).filter(F.col("v").isNotNull())
    return v.select("vec_id", F.size("v").alias("dims"), T.py_round(F.aggregate(
        "v", F.lit(0.0), lambda acc, x: acc + x.cast("double")), 3).alias("total"))


@query("tx_16", f"SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL ELSE {stamp('ts')} END AS parsed FROM events")
def _(d):
    t = F.col("ts").cast("timestamp")
    text = (
        F.when(F.col("event_id") % 7 == 6, F.lit("not a date"))
        .when(F.col("event_id") % 3 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 3 == 1, F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss Z"))
        .when(F.col("event_id") % 5 == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss'+00:00'"))
        .when(F.col("event_id") % 5 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'.0000000+0000'"))
        .when(F.col("event_id") % 5 == 2, F.date_format(t, "EEE, d MMM yy HH:mm:ss 'EST'"))
        .otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss")))
    return d.events.select("event_id", text_ts(D.parse_datetime(text)).alias("parsed"))


@query("tx_17", f"""
SELECT event_id, {half_even(age('ts'), 4)} AS hours_since, {stamp("date_trunc('day', ts)")} AS day_start,
  {stamp("date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND")} AS day_end,
  ts >= {NOW} - INTERVAL 72 HOUR AS within_72h, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS iso FROM events""")
def _(d):
    t = F.col("ts").cast("timestamp")
    return d.events.select(
        "event_id", T.py_round(D.raw_age_hours(AS_OF, t), 4).alias("hours_since"), text_ts(D.start_of_day(t)).alias("day_start"),
        text_ts(D.end_of_day(t)).alias("day_end"), (t >= D.hours_before(AS_OF, 72)).alias("within_72h"), D.format_iso(t).alias("iso"))


@query("tx_18", f"SELECT event_id, {half_even(f'exp(-{age0(chr(116) + chr(115))} / 24e0)', 6)} AS freshness FROM events")
def _(d):
    return d.events.select("event_id", T.py_round(D.exponential_freshness(AS_OF, F.col("ts").cast("timestamp")), 6).alias("freshness"))


@query("tx_19", "SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS term FROM conversations")
def _(d):
    return d.conversations.select("conv_id", "turn", T.normalize_term(F.col("text")).alias("term"))


_DIGIT_SUM = "list_sum(list_transform(string_split(sha256({s}), ''), lambda c: strpos('0123456789abcdef', c) - 1))"


@query("tx_20", "SELECT event_id, ({a} % 3)::INT AS bucket3, ({b} % 5)::INT AS bucket5 FROM events".format(
    a=_DIGIT_SUM.format(s="event_id || ':2024-01-30'"), b=_DIGIT_SUM.format(s="event_id || ':2024-01-30'")))
def _(d):
    seed = F.concat(F.col("event_id").cast("string"), F.lit(":2024-01-30"))
    return d.events.select("event_id", T.hash_bucket(seed, 3).alias("bucket3"), T.hash_bucket(seed, 5).alias("bucket5"))


@query("tx_21", """
SELECT article_id, array_to_string(list_transform(string_split(event_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label
FROM f_analyses WHERE event_type IS NOT NULL""")
def _(d):
    return d.f_analyses.filter("event_type IS NOT NULL").select("article_id", T.prettify(F.col("event_type")).alias("label"))


# ------------------------------------------------------------------ VF

_TEXT = "lower(title || ' ' || coalesce(description, ''))"
_REL = (f"(is_official OR lower(source_domain) IN {sql_in(K.OFFICIAL_DOMAINS)} OR "
        f"len(list_filter({sql_list(K.RELEVANCE_KEYWORDS)}, lambda k: contains({_TEXT}, k))) > 0)")
_CONTENT = "length(trim(title)) >= 15"
# One decimal, half up like the formatted message.
_FRESH = (f"CASE WHEN published_at IS NULL THEN 'no_date_assumed_recent' WHEN {age()} > 168 "
          f"THEN 'too_old_' || round_even({age()}, 0)::BIGINT || 'h' ELSE 'accepted' END")
_REASON = (f"CASE WHEN NOT {_REL} THEN 'not_ai_relevant' WHEN NOT ({_CONTENT}) THEN 'insufficient_content' "
           f"WHEN {_FRESH} LIKE 'too_old%' THEN {_FRESH} ELSE 'accepted' END")


@query("vf_01", f"SELECT article_id, {_REL} AS relevant FROM f_articles")
def _(d):
    return with_text(d.f_articles).select("article_id", VF.is_relevant(
        F.col("_text"), F.col("source_domain"), F.col("is_official")).alias("relevant"))


@query("vf_02", f"SELECT article_id, {_CONTENT} AS sufficient FROM f_articles")
def _(d):
    return d.f_articles.select("article_id", VF.has_content(F.col("title")).alias("sufficient"))


@query("vf_03", f"SELECT article_id, {_FRESH} AS reason, {_FRESH} NOT LIKE 'too_old%' AS accepted FROM f_articles")
def _(d):
    r = VF.acceptance_reason(AS_OF, F.col("published_at"))
    return d.f_articles.select("article_id", r.alias("reason"), VF.is_accepted(r).alias("accepted"))


@query("vf_04", f"SELECT article_id, {_REASON} AS reason FROM f_articles")
def _(d):
    return VF.validated(d.f_articles, AS_OF).select("article_id", "reason")


@query("vf_05", f"SELECT regexp_replace({_REASON}, '_[0-9]+h$', '') AS reason, count(*)::BIGINT AS articles FROM f_articles GROUP BY 1")
def _(d):
    return VF.rejection_breakdown(VF.validated(d.f_articles, AS_OF))


_TRUSTED = sql_in(K.TRUST_TIER1 + K.OFFICIAL_DOMAINS + K.TRUST_TECH)


# Stories of this query: articles with the same title.
@query("vf_07", f"""
SELECT article_id, greatest(1, count(DISTINCT CASE WHEN source_domain IN {_TRUSTED} THEN source_domain END)
  OVER (PARTITION BY {norm_title('title')}))::INT AS corroboration FROM f_articles""")
def _(d):
    stories = d.f_articles.select("article_id", T.title_fingerprint(F.col("title")).alias("story_id"), "source_domain")
    return VF.with_corroboration(d.f_articles, stories).select("article_id", F.col("corroboration").cast("int").alias("corroboration"))


def trust_sql(corr: str, now: str = NOW) -> tuple[str, str]:
    base = (f"CASE WHEN is_official OR source_domain IN {sql_in(K.OFFICIAL_DOMAINS)} THEN 95e0 WHEN source_domain IN {sql_in(K.TRUST_TIER1)} "
            f"THEN 80e0 WHEN source_domain IN {sql_in(K.TRUST_TECH)} THEN 65e0 ELSE 35e0 END")
    score = (f"least(100e0, greatest(0e0, {base} + CASE WHEN {corr} >= 3 THEN 15 WHEN {corr} = 2 THEN 8 ELSE 0 END + "
             f"CASE WHEN {age(now=now)} <= 6 THEN 10 WHEN {age(now=now)} > 48 THEN -20 ELSE 0 END))")
    notes = (f"concat_ws('; ', CASE {base} WHEN 95 THEN 'official company source' WHEN 80 THEN 'tier-1 media' WHEN 65 THEN 'trusted tech media' "
             f"ELSE 'unknown/low-trust source' END, CASE WHEN {corr} >= 3 THEN 'corroborated by ' || {corr} || ' sources (+15)' "
             f"WHEN {corr} = 2 THEN 'corroborated by 2 sources (+8)' END, CASE WHEN {age(now=now)} <= 6 THEN 'very fresh (<6h, +10)' "
             f"WHEN {age(now=now)} > 48 THEN 'old (' || round_even({age(now=now)}, 0)::BIGINT || 'h, -20)' END)")
    return score, notes


_SCORE, _NOTES = trust_sql("c")


@query("vf_08", f"""
WITH x AS (SELECT *, 1 + article_id % 4 AS c FROM f_articles)
SELECT article_id, {half_even(_SCORE, 1)} AS trust_score, {_SCORE} >= 40 AS is_verified, {_NOTES} AS notes FROM x""")
def _(d):
    return VF.with_trust(d.f_articles, AS_OF, F.lit(1) + F.col("article_id") % 4).select(
        "article_id", "trust_score", "is_verified", "notes")


@query("vf_10", """
WITH a AS (SELECT 'src' || user_id % 20 AS source, ts, event_id, event_type <> 'error' AS ok FROM events),
l AS (SELECT source, max(CASE WHEN ok THEN event_id END) AS last_ok, max(CASE WHEN ok THEN ts END) AS last_ts FROM a GROUP BY source)
SELECT a.source, count_if(NOT ok AND event_id > coalesce(last_ok, -1))::BIGINT AS consecutive_failures,
  strftime(any_value(last_ts), '%Y-%m-%d %H:%M:%S') AS last_success, count(*)::BIGINT AS attempts,
  count_if(NOT ok AND event_id > coalesce(last_ok, -1)) < 5 AS is_active
FROM a JOIN l ON a.source = l.source GROUP BY a.source""")
def _(d):
    log = d.events.select(F.concat(F.lit("src"), F.col("user_id") % 20).alias("source"), "ts",
                          F.col("event_id").alias("attempt_id"), (F.col("event_type") != "error").alias("ok"))
    return VF.source_health(log).select("source", "consecutive_failures", text_ts("last_successful_fetch_at").alias("last_success"),
                                        "attempts", "is_active")


# ------------------------------------------------------------------ PR

def curve_sql(tail: str, a: str = None) -> str:
    a = a or age0()
    return (f"CASE WHEN {a} < 2 THEN 100e0 WHEN {a} < 6 THEN 100e0 - ({a} - 2e0) * 3.75e0 WHEN {a} < 12 THEN 85e0 - ({a} - 6e0) * 4.17e0 "
            f"WHEN {a} < 24 THEN 60e0 - ({a} - 12e0) * 1.67e0 WHEN {a} < 48 THEN 40e0 - ({a} - 24e0) * 0.83e0 WHEN {a} < 168 THEN {tail} ELSE 2e0 END")


FRESH_PRIORITY = f"CASE WHEN published_at IS NULL THEN 30e0 ELSE {curve_sql(f'greatest(5e0, 20e0 - ({age0()} - 48e0) * 0.125e0)')} END"
FRESH_EVENT = (f"CASE WHEN published_at IS NULL THEN 30e0 ELSE "
               + half_even(f"greatest(2e0, least(100e0, {curve_sql(f'20e0 - ({age0()} - 48e0) * 0.107e0')}))") + " END")
_DOM = "list_distinct(list_transform(source_domains, lambda x: lower(x)))"
_has = lambda vals: f"len(list_intersect({_DOM}, {sql_list(vals)})) > 0"
TRUST_SET = (f"CASE WHEN len(source_domains) = 0 THEN 20e0 ELSE least(100e0, CASE WHEN {_has(K.OFFICIAL_DOMAINS)} THEN 90e0 WHEN {_has(K.PRIORITY_TIER1)} "
             f"THEN 70e0 WHEN {_has(K.PRIORITY_TIER2)} THEN 55e0 ELSE 30e0 END + least(10e0, len({_DOM}) * 2e0)) END")
count_sql = lambda n: f"CASE WHEN {n} <= 0 THEN 10e0 ELSE least(100e0, (log2({n}::DOUBLE) + 1e0) * 20e0) END"
_FUND = ("CASE WHEN funding_amount IS NULL OR funding_amount <= 0 THEN 0e0 WHEN funding_amount >= 1000 THEN 100e0 WHEN funding_amount >= 500 THEN 90e0 "
         "WHEN funding_amount >= 100 THEN 70e0 WHEN funding_amount >= 50 THEN 50e0 WHEN funding_amount >= 10 THEN 30e0 ELSE 15e0 END")
FUND = f"CASE WHEN event_type = 'funding' AND funding_amount <> 0 THEN greatest({_FUND}, 40e0) ELSE {_FUND} END"
_BONUS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in K.EVENT_BONUS.items()) + " ELSE 0e0 END"
IMPACT = (f"least(100e0, 30e0 + {_BONUS} + least(20e0, coalesce(list_sum(list_transform(companies, lambda c: CASE WHEN c IN "
          f"{sql_in(K.HIGH_IMPACT_COMPANIES)} THEN 10e0 ELSE 3e0 END)), 0e0)))")
RESEARCH = "CASE event_type WHEN 'research_paper' THEN 70e0 WHEN 'benchmark' THEN 60e0 ELSE 0e0 END"
LAUNCH = "CASE WHEN event_type IN ('model_release', 'product_launch', 'open_source_release', 'api_release') THEN 80e0 ELSE 0e0 END"
GOV = "CASE WHEN event_type = 'government_regulation' THEN 80e0 ELSE 0e0 END"


def priority_sql(fresh=FRESH_PRIORITY, trust=TRUST_SET, count=None, impact=IMPACT, research=RESEARCH, launch=LAUNCH, fund=FUND, gov=GOV, social="0e0"):
    count = count or count_sql("len(source_domains)")
    raw = (f"({fresh}) * 0.2e0 + ({trust}) * 0.2e0 + ({count}) * 0.1e0 + ({impact}) * 0.15e0 + ({research}) * 0.1e0 + ({launch}) * 0.1e0 "
           f"+ ({fund}) * 0.05e0 + ({gov}) * 0.05e0 + ({social}) * 0.05e0")
    return half_even(f"least(100e0, greatest(0e0, {raw}))")


def tier_sql(p: str, a: str | None) -> str:
    top = f"{p} >= 95" + (f" AND {a} <= 4" if a else "")
    return (f"CASE WHEN {top} THEN 'breaking' WHEN {p} >= 80 THEN 'very_important' WHEN {p} >= 60 THEN 'important' "
            f"WHEN {p} >= 40 THEN 'medium' ELSE 'low' END")


@query("pr_01", f"SELECT event_id, {half_even(FRESH_PRIORITY, 4)} AS freshness FROM f_story_events")
def _(d):
    return d.f_story_events.select("event_id", T.py_round(S.priority_freshness(AS_OF, F.col("published_at")), 4).alias("freshness"))


@query("pr_02", f"SELECT event_id, {FRESH_EVENT} AS freshness FROM f_story_events")
def _(d):
    return d.f_story_events.select("event_id", S.event_freshness(AS_OF, F.col("published_at")).alias("freshness"))


@query("pr_03", f"SELECT event_id, {TRUST_SET} AS trust FROM f_story_events")
def _(d):
    return d.f_story_events.select("event_id", S.source_set_trust(F.col("source_domains")).alias("trust"))


@query("pr_04", f"SELECT event_id, {half_even(count_sql('(event_id % 12)'), 4)} AS score FROM f_story_events")
def _(d):
    return d.f_story_events.select("event_id", T.py_round(S.source_count_score(F.col("event_id") % 12), 4).alias("score"))


@query("pr_05", f"SELECT event_id, {FUND} AS score FROM f_story_events")
def _(d):
    return d.f_story_events.select("event_id", S.funding_score(F.col("funding_amount"), F.col("event_type")).alias("score"))


@query("pr_06", f"SELECT event_id, {IMPACT} AS impact FROM f_story_events")
def _(d):
    return d.f_story_events.select("event_id", S.industry_impact(F.col("event_type"), F.col("companies")).alias("impact"))


@query("pr_07", f"SELECT event_id, {RESEARCH} AS research, {LAUNCH} AS launch, {GOV} AS regulation, least(100e0, event_id % 150) AS social FROM f_story_events")
def _(d):
    et = F.col("event_type")
    return d.f_story_events.select("event_id", S.research_score(et).alias("research"), S.launch_score(et).alias("launch"),
                                   S.regulation_score(et).alias("regulation"),
                                   S.social_score((F.col("event_id") % 150).cast("double")).alias("social"))


def _factors():
    return S.priority_factors(AS_OF, F.col("published_at"), F.col("source_domains"), F.size("source_domains"),
                              event_type=F.col("event_type"), companies=F.col("companies"), funding=F.col("funding_amount"))


@query("pr_08", f"SELECT event_id, {priority_sql()} AS priority FROM f_story_events")
def _(d):
    return d.f_story_events.select("event_id", S.weighted_priority(_factors()).alias("priority"))


@query("pr_09", f"""
WITH p AS (SELECT *, {priority_sql()} AS pr, coalesce({age()}, 0e0) AS a FROM f_story_events)
SELECT event_id, pr AS priority_score, {half_even(FRESH_PRIORITY, 4)} AS freshness_score, {TRUST_SET} AS trust_score, {IMPACT} AS impact_score,
  {tier_sql('pr', 'a')} AS tier, pr >= 95 AND a <= 4 AS is_breaking, {half_even(FUND, 4)} AS funding_factor FROM p""")
def _(d):
    rec = S.priority_record(AS_OF, F.col("published_at"), F.col("source_domains"), F.size("source_domains"),
                            event_type=F.col("event_type"), companies=F.col("companies"), funding=F.col("funding_amount"))
    return d.f_story_events.select("event_id", rec.alias("p")).select(
        "event_id", "p.priority_score", T.py_round(F.col("p.freshness_score"), 4).alias("freshness_score"), "p.trust_score",
        "p.impact_score", "p.tier", "p.is_breaking", T.py_round(F.col("p.factors")["funding"], 4).alias("funding_factor"))


@query("pr_10", f"""
SELECT event_id, {tier_sql('priority_score', age0())} AS tier, CASE WHEN priority_score >= 95 THEN '🚨 Breaking' WHEN priority_score >= 80 THEN '🔥 Very Important'
  WHEN priority_score >= 60 THEN '📌 Important' WHEN priority_score >= 40 THEN '📰 Medium' ELSE '📄 Low' END AS label,
  priority_score >= 95 AND {age0()} <= 4 AS breaking FROM f_story_events""")
def _(d):
    p, a = F.col("priority_score"), D.age_hours(AS_OF, F.col("published_at"))
    return d.f_story_events.select("event_id", S.priority_tier(p, a).alias("tier"), S.tier_label(p).alias("label"),
                                   ((p >= 95) & (a <= 4)).alias("breaking"))


_BREAK = f"({age0()} <= 4 AND priority_score >= 80)"


@query("pr_11", f"""
SELECT event_id, {FRESH_EVENT} AS freshness_score, {half_even(age0())} AS age_hours, {_BREAK} AS is_breaking, {age0()} > 168 AS is_stale,
  {age0()} > 168 AND priority_score < 60 AS should_reject,
  CASE WHEN {_BREAK} THEN 'breaking' WHEN {age0()} <= 6 THEN 'high' WHEN {age0()} <= 24 THEN 'medium' ELSE 'low' END AS urgency FROM f_story_events""")
def _(d):
    cols = S.freshness_analysis(AS_OF, F.col("published_at"), F.col("priority_score"))
    return d.f_story_events.select("event_id", *[c.alias(n) for n, c in cols.items()])


@query("pr_12", f"""
SELECT event_id, {FRESH_EVENT} AS freshness_score, {_BREAK} AS is_breaking FROM f_story_events
WHERE published_at >= {NOW} - INTERVAL 168 HOUR AND abs({FRESH_EVENT} - freshness_score) > 0.5e0""")
def _(d):
    from storyflow.operators.refresh import refresh_freshness

    return refresh_freshness(d.f_story_events, AS_OF).select("event_id", "freshness_score", "is_breaking")


@query("pr_13", f"SELECT event_id, false AS is_breaking FROM f_story_events WHERE is_breaking AND published_at < {NOW} - INTERVAL 4 HOUR")
def _(d):
    from storyflow.operators.refresh import clear_breaking

    return clear_breaking(d.f_story_events, AS_OF).select("event_id", "is_breaking")


def final_sql(now: str = NOW) -> str:
    fresh = f"CASE WHEN published_at IS NULL THEN 0.5e0 ELSE exp(-{age0(now=now)} / 24e0) END"
    return half_even(f"least(100e0, (importance_score / 100e0 * 0.35e0 + trust_score / 100e0 * 0.3e0 + ({fresh}) * 0.2e0 + "
                     f"CASE WHEN is_official THEN 1e0 ELSE 0.4e0 END * 0.15e0) * 100e0)")


@query("pr_14", f"SELECT article_id, {final_sql()} AS final_score FROM f_news")
def _(d):
    return d.f_news.select("article_id", S.final_score(AS_OF, F.col("importance_score"), F.col("trust_score"),
                                                       F.col("published_at"), F.col("is_official")).alias("final_score"))


_END = f"TIMESTAMP '{DAY_END}'"


@query("pr_15", f"""
SELECT article_id, {final_sql(_END)} AS final_score FROM f_news
WHERE ai_processed AND is_verified AND NOT is_duplicate AND created_at BETWEEN date_trunc('day', {_END}) AND {_END}""")
def _(d):
    from storyflow.operators.refresh import rerank_today

    return rerank_today(d.f_news, DAY_END).select("article_id", "final_score")


@query("pr_16", "SELECT article_id, final_score FROM f_news WHERE final_score >= 30")
def _(d):
    from storyflow.operators.refresh import eligible_sorted

    return eligible_sorted(d.f_news).select("article_id", "final_score")


def _hits(words, w):
    return f"len(list_filter({sql_list(words)}, lambda k: contains({_TEXT}, k))) * {w}e0"


LIVE = (f"CASE WHEN source_name IN {sql_in(K.FEED_EXCLUDED_SOURCES)} THEN -999e0 WHEN len(list_filter({sql_list(K.FEED_BLOCKLIST)}, lambda k: contains({_TEXT}, k))) > 0 "
        f"THEN -500e0 ELSE CASE WHEN published_at IS NULL THEN 8e0 WHEN {age()} <= 24 THEN 40e0 WHEN {age()} <= 48 THEN 25e0 WHEN {age()} <= 72 THEN 12e0 ELSE 0e0 END "
        f"+ CASE WHEN is_official THEN 60e0 ELSE 0e0 END + CASE WHEN source_name IN {sql_in(K.FEED_TRUSTED_MEDIA)} THEN 10e0 ELSE 0e0 END + "
        f"{_hits(K.FEED_MARKET, 40)} + {_hits(K.FEED_MODEL, 30)} + {_hits(K.FEED_RESEARCH, 20)} "
        f"+ CASE WHEN contains({_TEXT}, 'the') THEN 50e0 ELSE 0e0 END + CASE WHEN contains({_TEXT}, 'rag') THEN 40e0 ELSE 0e0 END END")


@query("pr_17", f"SELECT article_id, {LIVE} AS score FROM f_articles")
def _(d):
    s = S.live_feed_score(AS_OF, F.col("_text"), F.col("source_name"), F.col("published_at"), F.col("is_official"),
                          companies=F.array(F.lit("The")), topics=F.array(F.lit("RAG")))
    return with_text(d.f_articles).select("article_id", s.alias("score"))
