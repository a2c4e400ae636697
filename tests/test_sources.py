"""Payload readers, page parsers, sinks and enrichment."""

import json

import pytest
from pyspark.sql import functions as F

from storyflow import constants as K
from storyflow.operators import enrich as EN
from storyflow.sources import pages as PG
from storyflow.sources import payloads as SR
from storyflow.sources import tables as SK

NOW = "2024-01-31 00:00:00"


def test_feed_files(spark, tmp_path):
    item = lambda i, extra="": f"<item><title> Title {i} </title><link>https://a.com/{i}</link>{extra}</item>"
    (tmp_path / "one.xml").write_text(
        '<rss xmlns:media="http://search.yahoo.com/mrss/"><channel>'
        + item(1, "<description>&lt;b&gt;Hello&lt;/b&gt; &amp;amp; bye</description><pubDate>Mon, 29 Jan 2024 10:00:00 GMT</pubDate>"
                  '<media:thumbnail url="https://i/t.png"/>')
        + item(2, "<description>d2</description>") + "<item><title> </title><link>https://a.com/3</link></item><item><title>No link</title></item></channel></rss>")
    (tmp_path / "two.xml").write_text("<rss><channel>" + "".join(item(i) for i in range(10, 16)) + "</channel></rss>")
    items = SR.read_feed_items(spark, str(tmp_path))
    out = SR.feed_articles(items)
    rows = {r.url: r for r in out.collect()}
    assert len(rows) == 8
    first = rows["https://a.com/1"]
    assert (first.title, first.description, first.image_url) == ("Title 1", "Hello bye", "https://i/t.png")
    assert str(first.published_at) == "2024-01-29 10:00:00"
    assert SR.feed_articles(items, max_per_feed=3, order=[F.col("link")]).count() == 5
    full = SR.as_articles(out.drop("feed"), "feed_x", "a.com", official=True, company="A")
    assert full.columns == SR._COLUMNS and full.filter("is_official and source_name = 'feed_x'").count() == 8


def test_paper_files(spark, tmp_path):
    names = "".join(f"<author><name>N{i}</name></author>" for i in range(5))
    entry = lambda i, when: f"<entry><id>http://p.org/{i}</id><title>A\nB</title><summary>s\nt</summary><published>{when}</published>{names}</entry>"
    (tmp_path / "p.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom">' + entry(1, "2024-01-30T00:00:00Z") + entry(2, "2024-01-20T00:00:00Z") + "</feed>")
    rows = SR.paper_articles(SR.read_paper_entries(spark, str(tmp_path)), NOW).collect()
    assert [(r.url, r.title, r.description, r.author) for r in rows] == [("https://p.org/1", "A B", "s t", "N0, N1, N2 et al.")]


def test_registry_alias_and_tiers(spark):
    from storyflow.operators.dedup import source_tier

    df = spark.createDataFrame([("arxiv",), ("openai_blog",), ("hacker_news",), ("unknown",)], "s string")
    assert [r[0] for r in df.select(source_tier(F.col("s"))).collect()] == [1, 0, 2, 9]
    assert SR.registry(spark).count() == 16


def test_paragraphs():
    long = "This paragraph is long enough to be kept."
    html = (f"<html><body><nav><p>{long} nav</p></nav><p>short</p><p>{long} <b>bold</b> &amp; more</p><script>var x = '</p>{long}';</script>"
            f"<article><p>open {long}<br><p>{long} inner</p></article><footer><p>{long}</p></footer><p>{long} last</body></html>")
    assert PG.paragraph_text(html).split("\n\n") == [f"{long} bold & more", f"open {long}{long} inner", f"{long} inner", f"{long} last"]
    assert PG.paragraph_text(None) == "" and len(PG.paragraph_text(f"<p>{'x' * 20000}</p>")) == 20000


def test_cards_and_repos(spark):
    page = ('<a href="/news/one"><h3>A long enough title</h3><time datetime="2024-01-05T10:00:00Z">x</time><p>About <i>it</i></p></a><a href="/news/two"><h2>Short</h2></a>'
            '<a href="https://s.com/news/three"><h4>Another long title</h4></a><a href="/about"><h2>About this company</h2></a>')
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    rows = {r.url: r for r in PG.link_cards(PG.anchors(pages), "/news/", "https://s.com").collect()}
    assert set(rows) == {"https://s.com/news/one", "https://s.com/news/three"}
    assert rows["https://s.com/news/one"].description == "Aboutit" and str(rows["https://s.com/news/one"].published_at) == "2024-01-05 10:00:00"
    row = lambda path, desc, topic: (f'<article class="Box-row"><h2><a href="/{path}">r</a></h2><p> {desc} </p><a href="/topics/{topic}">t</a>'
                                     f'<span>12</span><span> 34 stars today </span></article>')
    trend = spark.createDataFrame([(1, row("o/llm-kit", "tool", "x") + row("o/web", "cooking", "nlp") + row("o/web2", "cooking", "food"))], "page_id long, html string")
    got = {r.url: r.title for r in PG.topic_repos(PG.repositories(trend)).collect()}
    assert got == {"https://github.com/o/llm-kit": "🔥 GitHub Trending: o / llm-kit (34 stars today)", "https://github.com/o/web": "🔥 GitHub Trending: o / web (34 stars today)"}


def test_upsert_counts_and_repeat(spark, tmp_path):
    path = f"{tmp_path}/t"
    mk = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "k long, v string")
    assert SK.upsert(mk(range(10), "a"), path, ["k"], 4) == {"created": 10, "updated": 0}
    for _ in range(2):
        n = SK.upsert(mk(range(5, 15), "b"), path, ["k"], 4)
    assert n == {"created": 0, "updated": 10}
    assert {r.k: r.v for r in SK.read_table(spark, path).collect()} == {i: "a" if i < 5 else "b" for i in range(15)}
    assert SK.upsert(mk([], "c"), path, ["k"]) == {"created": 0, "updated": 0}


GOOD = {"summary": "s", "key_takeaways": ["a"], "why_it_matters": "w", "category": "LLMs", "keywords": ["k"], "tags": ["t"], "companies": ["c"], "sentiment": "neutral",
        "urgency": "low", "confidence_score": 50, "importance_score": 60.5, "reading_time_minutes": 3}


@pytest.mark.parametrize("field", [f for f, _ in K.REQUIRED_FIELDS])
def test_each_required_field(spark, field):
    missing = {k: v for k, v in GOOD.items() if k != field}
    rows = [json.dumps(missing), json.dumps(GOOD | {field: None}), json.dumps(GOOD)]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "raw string").select(EN.validation_error(F.col("raw"))).collect()]
    assert got == [f"Missing required fields: {field}", f"Invalid type for {field}", None]


def test_malformed_json(spark):
    got = [r[0] for r in spark.createDataFrame([("{bad",), ("[]",), (None,), ("3",)], "raw string").select(EN.validation_error(F.col("raw"))).collect()]
    assert got == ["output is not a JSON object"] * 4


def test_user_embedding_function(spark):
    df = spark.createDataFrame([("a",), ("bb",)], "t string")
    got = EN.with_embedding(df, "t", lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert [list(r.embedding) for r in got] == [[1.0, 1.0], [2.0, 1.0]]


def test_json_payload_files(spark, tmp_path):
    import json

    from storyflow.sources import payloads as PL

    story = lambda i: {"hits": [{"title": f"t{i}", "url": f"https://e.org/{i}", "points": 9, "objectID": str(i), "created_at_i": 1706572800, "num_comments": 2, "other": 1}]}
    (tmp_path / "one.json").write_text(json.dumps(story(1), indent=1))
    (tmp_path / "lines.json").write_text(json.dumps(story(2)) + "\n" + json.dumps(story(3)) + "\nnot json\n")
    rows = PL.story_articles(PL.read_story_hits(spark, str(tmp_path)), "2024-01-31 00:00:00").collect()
    assert sorted(r.title for r in rows) == ["t1", "t2", "t3"]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps({"repo": "o/t", "name": "v1", "html_url": "https://x", "body": "b" * 900, "published_at": "2024-01-30T00:00:00Z"}))
    assert [len(r.description) for r in PL.release_articles(PL.read_releases(spark, str(tmp_path / "r")), "2024-01-31 00:00:00").collect()] == [900]


def test_keyset_pages_equal_offsets(spark):
    from pyspark.sql import functions as F

    from storyflow.operators import feeds as FQ

    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5) for i in range(50)], "id long, s int")
    columns = [("s", True), ("id", False)]
    order, last, seen = [F.desc_nulls_last("s"), F.asc("id")], None, []
    while rows := FQ.page_after(df, columns, last, 8).collect():
        seen += [r.id for r in rows]
        last = rows[-1].asDict()
    assert seen == [r.id for r in df.orderBy(*order).collect()]
