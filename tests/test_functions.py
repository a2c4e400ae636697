"""Column functions on hand-made values."""

import hashlib
import unicodedata
from urllib.parse import parse_qs, urlencode, urlparse

import pytest
from pyspark.sql import functions as F

from storyflow.functions import dates as D
from storyflow.functions import scores as S
from storyflow.functions import text as T
from storyflow.functions import vectors as V

NOW = "2024-01-31 00:00:00"


def column(spark, values, fn, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.select(fn(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


@pytest.mark.parametrize("url, want", [
    ("https://x.com/a?utm_source=t&id=1", "https://x.com/a?id=1"),
    ("https://x.com/a/", "https://x.com/a"),
    ("HTTPS://X.Com/CaSe", "https://x.com/CaSe"),
    ("https://x.com/a#frag", "https://x.com/a"),
    ("https://x.com", "https://x.com/"),
    ("https://x.com/a;v=1?b=&c=2", "https://x.com/a?c=2"),
    ("https://x.com/?b=2&a=1&b=3", "https://x.com/?b=2&b=3&a=1"),
    ("https://x.com/?q=a%20b+c&UTM_Campaign=z", "https://x.com/?q=a+b+c"),
    ("https://x.com/?q=%C3%A9*~", "https://x.com/?q=%C3%A9%2A~"),
    ("  https://x.com/p?ref=q ", "https://x.com/p"),
])
def test_normalize_url(spark, url, want):
    assert column(spark, [url], T.normalize_url) == [want]


def test_normalize_url_agrees_with_url_rules(spark):
    urls = [f"http://h{i % 3}.org:80/{'A/' * (i % 4)}p{i}{'/' * (i % 3)}?{'k=%d&' % i if i % 2 else ''}z={i}%2Fx#{i}" for i in range(40)]

    def rule(u):
        p = urlparse(u)
        q = urlencode(parse_qs(p.query), doseq=True)
        return f"{p.scheme}://{p.netloc.lower()}{p.path.rstrip('/') or '/'}" + (f"?{q}" if q else "")

    assert column(spark, urls, T.normalize_url) == [rule(u) for u in urls]


def test_titles(spark):
    got = column(spark, ["OpenAI Launches GPT-6", "Hello, World!", "a   b", "", None, "été_1"], T.normalize_title)
    assert got == ["openai launches gpt 6", "hello world", "a b", "", "", "été_1"]


def test_nfc_only_touches_marked_rows(spark):
    values = ["café", "plain", None, "Å"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.v for r in T.ensure_nfc(df, "v").collect()]
    assert got == [v if v is None else unicodedata.normalize("NFC", v) for v in values]


def test_fingerprints(spark):
    df = spark.createDataFrame([(["B", " a "], "P", "E"), (["a", "b"], "p", "e"), ([], "", None)], "c array<string>, p string, e string")
    a, b, c = [r[0] for r in df.select(T.entity_fingerprint(F.col("c"), F.col("p"), F.col("e"))).collect()]
    assert a == b == hashlib.sha256(b"a|b::p::e").hexdigest() and c == ""
    assert column(spark, ["Hi!"], lambda v: T.content_fingerprint(v, F.lit(" Body "))) == [hashlib.sha256(b"hi||body").hexdigest()]


def test_truncate_and_reading_time(spark):
    long = "word " * 120
    got = column(spark, [long, "short", "x" * 600], lambda v: T.truncate_text(v, 500))
    assert got[0] == long[:499] + "…" and got[1] == "short" and got[2] == "x" * 500 + "…"
    assert column(spark, ["w " * 238, "w " * 357, "", "w " * 595], T.reading_time) == [1, 2, 1, 2]


def test_slugs(spark):
    assert column(spark, ["Crème Brûlée, 100%!", "--A  b--"], T.slugify) == ["creme-brulee-100", "a-b"]
    assert column(spark, ["GPT_5 & Co"], T.trend_slug) == ["gpt-5-co"]


def test_hash_bucket(spark):
    seeds = [f"{i}:2024" for i in range(20)]
    for k in (3, 5, 7):
        want = [int(hashlib.sha256(s.encode()).hexdigest(), 16) % k for s in seeds]
        assert column(spark, seeds, lambda v: T.hash_bucket(v, k)) == want


def test_round_matches_half_even(spark):
    values = [0.125, 0.375, 1.005, -0.125, 12.344, 66.666, 0.0]
    assert column(spark, values, lambda v: T.py_round(v, 2), "double") == [round(v, 2) for v in values]


@pytest.mark.parametrize("a, b, want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 2.0], [-1.0, -2.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(V.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_parse_vector(spark):
    assert column(spark, ["[1, 2.5]", "[1,", "[1, \"x\"]", None], V.parse_vector) == [[1.0, 2.5], None, None, None]


def test_parse_datetime(spark):
    got = column(spark, ["2024-01-05T10:00:00Z", "2024-01-05T12:00:00+02:00", "Fri, 05 Jan 2024 10:00:00 GMT", "2024-01-05T10:00:00.250000Z",
                         "2024-01-05 10:00:00", "soon", None], lambda v: F.date_format(D.parse_datetime(v), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-01-05 10:00:00"] * 5 + [None, None]


AGES = [0, 1.99, 2, 4, 6, 12, 24, 48, 100, 167.9, 168, 300, -5]


def ages(spark, fn):
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(AGES)], "i int, a double").select(
        "i", F.timestamp_micros(F.unix_micros(F.lit(NOW).cast("timestamp")) - (F.col("a") * 3.6e9).cast("long")).alias("t"))
    return [r[0] for r in df.select(fn(F.col("t")).alias("o"), "i").orderBy("i").collect()]


def test_freshness_curves(spark):
    p = ages(spark, lambda t: S.priority_freshness(NOW, t))
    assert p[:3] == [100, 100, 100] and p[3] == 92.5 and p[4] == 85 and p[9] == pytest.approx(5.0125) and p[10:] == [2, 2, 100]
    assert p[:12] == sorted(p[:12], reverse=True)
    e = ages(spark, lambda t: S.event_freshness(NOW, t))
    assert e[9] == 7.17 and e[10] == 2.0
    assert column(spark, [None], lambda v: S.priority_freshness(NOW, v.cast("timestamp"))) == [30.0]


@pytest.mark.parametrize("amount, want", [(None, 0), (0.0, 0), (9.9, 15), (10.0, 30), (50.0, 50), (100.0, 70), (500.0, 90), (1000.0, 100)])
def test_funding(spark, amount, want):
    assert column(spark, [amount], S.funding_score, "double") == [want]


def test_final_score_bounds(spark):
    def one(imp, trust, hours, official):
        t = F.timestamp_micros(F.unix_micros(F.lit(NOW).cast("timestamp")) - F.lit(int(hours * 3.6e9)))
        return spark.range(1).select(S.final_score(NOW, F.lit(float(imp)), F.lit(float(trust)), t, F.lit(official))).first()[0]

    assert one(90, 90, 0, True) > 70 and one(20, 20, 60, False) < 30
    assert all(0 <= one(i, t, 1, False) <= 100 for i in (0, 50, 100) for t in (0, 50, 100))


def test_trust_cases(spark):
    def one(domain, official, hours, corr=1):
        t = F.timestamp_micros(F.unix_micros(F.lit(NOW).cast("timestamp")) - F.lit(int(hours * 3.6e9)))
        return spark.range(1).select(S.trust_result(NOW, F.lit(domain), F.lit(official), t, F.lit(corr)).alias("t")).first().t

    assert one("openai.com", True, 1).trust_score == 100
    assert one("reuters.com", False, 10).trust_score == 80
    unknown = one("some-random-blog.xyz", False, 24)
    assert unknown.trust_score == 35 and not unknown.is_verified
    assert one("some-random-blog.xyz", False, 3).is_verified
    assert one("techcrunch.com", False, 72).trust_score == 45
    assert one("techcrunch.com", False, 12, 3).trust_score == 80
    assert one("techcrunch.com", False, 12, 10).notes.endswith("corroborated by 10 sources (+15)")


def test_future_dates(spark):
    from storyflow.operators.validate import acceptance_reason

    df = spark.createDataFrame([("2024-01-31 00:10:00",), ("2024-01-31 02:00:00",), ("2024-01-01 00:00:00",), (None,)], "t string")
    strict = [r[0] for r in df.select(acceptance_reason(NOW, F.col("t").cast("timestamp"))).collect()]
    assert strict == ["accepted", "future_dated_-2.0h_ahead", "too_old_720h", "no_date_assumed_recent"]
    loose = [r[0] for r in df.select(acceptance_reason(NOW, F.col("t").cast("timestamp"), strict_future=False)).collect()]
    assert loose[1] == "accepted"


def test_relevance_whole_word(spark):
    from storyflow.operators.validate import is_relevant

    def one(title, **kw):
        return spark.range(1).select(is_relevant(F.lower(F.lit(title)), F.lit("x.org"), F.lit(False), **kw)).first()[0]

    assert one("Cold storage prices") and not one("Cold storage prices", whole_word=True) and one("Using RAG now", whole_word=True)


def test_lenient_dates(spark):
    from storyflow.functions.dates import parse_datetime

    cases = {
        "2024-01-05 10:00:00+00:00": "2024-01-05 10:00:00", "2024-01-05T10:00Z": "2024-01-05 10:00:00", "2024-01-05T10:00:00+0000": "2024-01-05 10:00:00",
        "2024-01-05T10:00:00.1234567Z": "2024-01-05 10:00:00.123456", "Fri, 05 Jan 2024 10:00 GMT": "2024-01-05 10:00:00", "5 Jan 24 10:00:00 EST": "2024-01-05 10:00:00",
        "Fri, 5 Jan 2024 10:00:00 +0200": "2024-01-05 08:00:00", "2024-01-05": "2024-01-05 00:00:00", "20240105T100000Z": "2024-01-05 10:00:00", "not a date": None, "2024-13-05": None, "": None,
    }
    got = spark.createDataFrame([(c,) for c in cases], "s string").select("s", parse_datetime(F.col("s")).cast("string").alias("t")).collect()
    assert {r.s: r.t for r in got} == cases


def test_composition_of_all_letters(spark):
    from storyflow.functions.text import nfc

    texts = ["é", "ά豈", "plain", "é", "한", None]
    import unicodedata

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1).select(nfc(F.col("s"))).collect()]
    assert got == [t and unicodedata.normalize("NFC", t) for t in texts]


def test_content_fingerprint_covers_the_whole_body(spark):
    from storyflow.functions.text import content_fingerprint

    rows = [("t", "x" * 300 + "a"), ("t", "x" * 300 + "b")]
    df = spark.createDataFrame(rows, "t string, b string")
    assert df.select(content_fingerprint(F.col("t"), F.col("b"))).distinct().count() == 2
    assert df.select(content_fingerprint(F.col("t"), F.col("b"), window=200)).distinct().count() == 1


def test_search_takes_text_literally(spark):
    from storyflow.operators.search import keyword_search

    rows = [(1, "a\\bcd here", 5.0), (2, "c_d\\ there", 4.0), (3, "cxd there", 3.0), (4, "100% sure", 2.0)]
    events = spark.createDataFrame(rows, "event_id long, headline string, priority_score double").withColumn("published_at", F.lit("2024-01-30").cast("timestamp"))
    find = lambda q: [r.event_id for r in keyword_search(events, q, "2024-01-31 00:00:00").collect()]
    assert find("a\\b") == [1] and find("c_d") == [2] and find("00%") == [4]
    assert find("zz1 zz2 zz3 zz4 zz5 sure") == [4]


def test_fixed_lists_are_complete():
    from storyflow import constants as K

    assert len(K.MENTOR_BACKLOG) == 4 and len(K.MENTOR_TEMPLATES) == 5


def test_filter_on_validation_does_not_rebuild_the_text(spark):
    from storyflow.operators.validate import validated

    df = spark.createDataFrame([("AI model", "d", "x.com", False, None)], "title string, description string, source_domain string, is_official boolean, published_at timestamp")
    plan = validated(df, "2024-01-31 00:00:00").filter("reason = 'accepted'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws") <= 2
