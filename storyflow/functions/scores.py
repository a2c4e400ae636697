"""Scoring columns: freshness, trust, priority, ranking and feed scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.functions.dates import age_hours, exponential_freshness, raw_age_hours
from storyflow.functions.text import contains_any, count_matches, lit_array, py_round


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _piecewise(age: Column, tail: Column) -> Column:
    # Fixed values: (upper age bound, start score, start age, slope).
    steps = [(6, 100.0, 2, 3.75), (12, 85.0, 6, 4.17), (24, 60.0, 12, 1.67), (48, 40.0, 24, 0.83)]
    curve = F.when(age < 2, 100.0)
    for bound, start, origin, slope in steps:
        curve = curve.when(age < bound, F.lit(start) - (age - F.lit(float(origin))) * F.lit(slope))
    return curve.when(age < 168, tail).otherwise(2.0)


def priority_freshness(as_of, published: Column) -> Column:
    age = age_hours(as_of, published)
    tail = F.greatest(F.lit(5.0), F.lit(20.0) - (age - 48.0) * F.lit(0.125))
    return F.when(published.isNull(), 30.0).otherwise(_piecewise(age, tail))


def event_freshness(as_of, published: Column) -> Column:
    age = age_hours(as_of, published)
    score = _piecewise(age, F.lit(20.0) - (age - 48.0) * F.lit(0.107))
    bounded = F.greatest(F.lit(2.0), F.least(F.lit(100.0), score))
    return F.when(published.isNull(), 30.0).otherwise(py_round(bounded, 2))


def source_set_trust(domains: Column) -> Column:
    d = F.array_distinct(F.transform(domains, F.lower))
    base = (
        F.when(F.arrays_overlap(d, lit_array(K.OFFICIAL_DOMAINS)), 90.0)
        .when(F.arrays_overlap(d, lit_array(K.PRIORITY_TIER1)), 70.0)
        .when(F.arrays_overlap(d, lit_array(K.PRIORITY_TIER2)), 55.0)
        .otherwise(30.0)
    )
    score = F.least(F.lit(100.0), base + F.least(F.lit(10.0), F.size(d) * 2.0))
    return F.when(domains.isNull() | (F.size(domains) == 0), 20.0).otherwise(score)


def source_count_score(n: Column) -> Column:
    return F.when(n <= 0, 10.0).otherwise(F.least(F.lit(100.0), (F.log2(n.cast("double")) + 1.0) * 20.0))


def funding_score(amount: Column, event_type: Column | None = None) -> Column:
    s = (
        F.when(amount.isNull() | (amount <= 0), 0.0)
        .when(amount >= 1000, 100.0).when(amount >= 500, 90.0).when(amount >= 100, 70.0)
        .when(amount >= 50, 50.0).when(amount >= 10, 30.0).otherwise(15.0)
    )
    if event_type is None:
        return s
    return F.when((event_type == "funding") & (amount != 0), F.greatest(s, F.lit(40.0))).otherwise(s)


def industry_impact(event_type: Column, companies: Column) -> Column:
    bonus = F.coalesce(F.try_element_at(_map(K.EVENT_BONUS), F.coalesce(event_type, F.lit(""))), F.lit(0.0))
    big = lit_array(K.HIGH_IMPACT_COMPANIES)
    weight = F.aggregate(
        F.coalesce(companies, F.array().cast("array<string>")), F.lit(0.0),
        lambda acc, c: acc + F.when(F.array_contains(big, c), 10.0).otherwise(3.0),
    )
    return F.least(F.lit(100.0), F.lit(30.0) + bonus + F.least(F.lit(20.0), weight))


def research_score(event_type: Column, is_research: Column | None = None) -> Column:
    is_research = F.lit(False) if is_research is None else is_research
    return (
        F.when(event_type == "research_paper", 70.0)
        .when(event_type == "benchmark", 60.0)
        .when(is_research, 70.0).otherwise(0.0)
    )


def launch_score(event_type: Column) -> Column:
    kinds = ["model_release", "product_launch", "open_source_release", "api_release"]
    return F.when(event_type.isin(kinds), 80.0).otherwise(0.0)


def regulation_score(event_type: Column, is_government: Column | None = None) -> Column:
    is_government = F.lit(False) if is_government is None else is_government
    return F.when(is_government | (event_type == "government_regulation"), 80.0).otherwise(0.0)


def social_score(value: Column) -> Column:
    return F.least(F.lit(100.0), value)


def weighted_priority(factors: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in K.PRIORITY_WEIGHTS.items():
        total = total + factors[name] * F.lit(weight)
    return py_round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)), 2)


def priority_factors(as_of, published, domains, source_count, event_type=None, companies=None,
                     funding=None, is_research=None, is_government=None, social=None) -> dict[str, Column]:
    et = F.lit(None).cast("string") if event_type is None else event_type
    co = F.array().cast("array<string>") if companies is None else companies
    fu = F.lit(None).cast("double") if funding is None else funding
    return {
        "freshness": priority_freshness(as_of, published),
        "source_trust": source_set_trust(domains),
        "source_count": source_count_score(source_count),
        "industry_impact": industry_impact(et, co),
        "research_sig": research_score(et, is_research),
        "product_launch": launch_score(et),
        "funding": funding_score(fu, et),
        "gov_regulation": regulation_score(et, is_government),
        "social_signal": social_score(F.lit(0.0) if social is None else social),
    }


def priority_tier(score: Column, age: Column | None = None) -> Column:
    """Tier name; with an age, a breaking score older than 4 h drops one tier."""
    top = F.when(score >= 95, "breaking") if age is None else (
        F.when((score >= 95) & (age <= 4), "breaking"))
    return (
        top.when(score >= 80, "very_important").when(score >= 60, "important")
        .when(score >= 40, "medium").otherwise("low")
    )


def tier_label(score: Column) -> Column:
    return (
        F.when(score >= 95, "🚨 Breaking").when(score >= 80, "🔥 Very Important")
        .when(score >= 60, "📌 Important").when(score >= 40, "📰 Medium").otherwise("📄 Low")
    )


def priority_record(as_of, published, domains, source_count, **kw) -> Column:
    """The whole scoring result as one struct."""
    f = priority_factors(as_of, published, domains, source_count, **kw)
    score = weighted_priority(f)
    age = F.coalesce(raw_age_hours(as_of, published), F.lit(0.0))
    return F.struct(
        score.alias("priority_score"),
        f["freshness"].alias("freshness_score"),
        f["source_trust"].alias("trust_score"),
        f["industry_impact"].alias("impact_score"),
        priority_tier(score, age).alias("tier"),
        ((score >= 95) & (age <= 4)).alias("is_breaking"),
        F.create_map(*[x for k, v in f.items() for x in (F.lit(k), v)]).alias("factors"),
    )


def freshness_analysis(as_of, published: Column, priority: Column) -> dict[str, Column]:
    age = age_hours(as_of, published)
    breaking = (age <= 4) & (priority >= 80)
    stale = age > 168
    return {
        "freshness_score": event_freshness(as_of, published),
        "age_hours": py_round(age, 2),
        "is_breaking": breaking,
        "is_stale": stale,
        "should_reject": stale & (priority < 60),
        "urgency": F.when(breaking, "breaking").when(age <= 6, "high").when(age <= 24, "medium").otherwise("low"),
    }


def final_score(as_of, importance: Column, trust: Column, published: Column, official: Column) -> Column:
    fresh = F.when(published.isNull(), 0.5).otherwise(exponential_freshness(as_of, published))
    raw = (
        importance / 100.0 * F.lit(0.35) + trust / 100.0 * F.lit(0.30) + fresh * F.lit(0.20)
        + F.when(official, 1.0).otherwise(0.4) * F.lit(0.15)
    )
    return py_round(F.least(F.lit(100.0), raw * 100.0), 2)


def domain_base(domain: Column, official: Column) -> Column:
    d = F.lower(domain)
    return (
        F.when(official | d.isin(K.OFFICIAL_DOMAINS), 95.0).when(d.isin(K.TRUST_TIER1), 80.0)
        .when(d.isin(K.TRUST_TECH), 65.0).otherwise(35.0)
    )


def is_trusted_domain(domain: Column) -> Column:
    return F.lower(domain).isin(K.TRUST_TIER1 + K.OFFICIAL_DOMAINS + K.TRUST_TECH)


def trust_result(as_of, domain: Column, official: Column, published: Column, corroboration: Column) -> Column:
    base = domain_base(domain, official)
    age = raw_age_hours(as_of, published)
    corr = F.when(corroboration >= 3, 15.0).when(corroboration == 2, 8.0).otherwise(0.0)
    fresh = F.when(age <= 6, 10.0).when(age > 48, -20.0).otherwise(0.0)
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), base + corr + fresh))
    notes = F.concat_ws(
        "; ",
        F.when(base == 95, "official company source").when(base == 80, "tier-1 media")
        .when(base == 65, "trusted tech media").otherwise("unknown/low-trust source"),
        F.when(corroboration >= 3,
               F.concat(F.lit("corroborated by "), corroboration.cast("string"), F.lit(" sources (+15)")))
        .when(corroboration == 2, "corroborated by 2 sources (+8)"),
        F.when(age <= 6, "very fresh (<6h, +10)")
        .when(age > 48, F.concat(F.lit("old ("), F.rint(age).cast("long").cast("string"), F.lit("h, -20)"))),
    )
    return F.struct(
        py_round(score, 1).alias("trust_score"), (score >= 40).alias("is_verified"), notes.alias("notes")
    )


def live_feed_score(as_of, text: Column, source_name: Column, published: Column, official: Column,
                    companies: Column | None = None, topics: Column | None = None) -> Column:
    """``text`` is the lower-cased title and description."""
    age = raw_age_hours(as_of, published)
    score = (
        F.when(published.isNull(), 8.0).when(age <= 24, 40.0).when(age <= 48, 25.0)
        .when(age <= 72, 12.0).otherwise(0.0)
        + F.when(official, 60.0).otherwise(0.0)
        + F.when(source_name.isin(K.FEED_TRUSTED_MEDIA), 10.0).otherwise(0.0)
        + count_matches(text, K.FEED_MARKET) * 40.0
        + count_matches(text, K.FEED_MODEL) * 30.0
        + count_matches(text, K.FEED_RESEARCH) * 20.0
    )
    for terms, weight in ((companies, 50.0), (topics, 40.0)):
        if terms is not None:
            hits = F.filter(F.coalesce(terms, F.array().cast("array<string>")),
                            lambda t: F.contains(text, F.lower(t)))
            score = score + F.size(hits) * weight
    return (
        F.when(source_name.isin(K.FEED_EXCLUDED_SOURCES), -999.0)
        .when(contains_any(text, K.FEED_BLOCKLIST), -500.0).otherwise(score)
    )


def rule_category(text: Column) -> Column:
    out = None
    for name, words in K.CATEGORY_RULES:
        hit = contains_any(text, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(K.DEFAULT_CATEGORY)
