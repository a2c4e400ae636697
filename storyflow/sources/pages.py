"""HTML pages -> text, link cards and repositories.

Spark has no HTML parser, so these run as ``mapInPandas`` over Arrow batches; each page is
handled on its own and whole."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from storyflow import constants as K
from storyflow.functions.dates import parse_datetime
from storyflow.functions.text import contains_any

_SKIPPED = {"script", "style", "nav", "footer", "header", "noscript", "aside", "form"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Paragraphs(HTMLParser):
    """Text of every ``p`` outside skipped elements. An open ``p`` ends with its own end tag or
    with the end of an enclosing element; until then it also owns the text of nested ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str] | None]] = []
        self.done: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        parts = None
        if tag == "p" and not self._skipping():
            parts = []
            self.done.append(parts)
        self.stack.append((tag, parts))

    def _skipping(self) -> bool:
        return any(tag in _SKIPPED for tag, _ in self.stack)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not self._skipping():
            for _, parts in self.stack:
                if parts is not None:
                    parts.append(data)


def paragraph_text(html: str | None) -> str:
    parser = _Paragraphs()
    parser.feed(html or "")
    parser.close()
    texts = ("".join(p).strip() for p in parser.done)
    return "\n\n".join(t for t in texts if len(t) > 30)


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(paragraph_text)


def article_text(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", html_text(F.col("html")))


class _Cards(HTMLParser):
    """Anchors with the heading, time and first paragraph inside them."""

    def __init__(self, headings=("h2", "h3", "h4")):
        super().__init__(convert_charrefs=True)
        self.headings = set(headings)
        self.cards: list[dict] = []
        self.card: dict | None = None
        self.field: str | None = None
        self.field_tag: str | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and a.get("href") is not None:
            self.card = {"href": a["href"], "text": []}
            self.cards.append(self.card)
        elif self.card is not None and self.field is None:
            name = "title" if tag in self.headings else {"time": "time", "p": "desc"}.get(tag)
            if name and name not in self.card:
                self.card[name] = []
                self.field, self.field_tag = name, tag
                if tag == "time" and a.get("datetime"):
                    self.card["datetime"] = a["datetime"]

    def handle_endtag(self, tag):
        if tag == "a":
            self.card = self.field = self.field_tag = None
        elif tag == self.field_tag:
            self.field = self.field_tag = None

    def handle_data(self, data):
        if self.card is not None:
            self.card["text"].append(data.strip())
            if self.field:
                self.card[self.field].append(data.strip())


def _page_cards(html: str | None) -> list[dict]:
    parser = _Cards()
    parser.feed(html or "")
    parser.close()
    join = lambda c, k: "".join(c[k]) if k in c else None
    return [{"href": c["href"], "anchor_text": join(c, "text"), "title": join(c, "title"),
             "time_text": c.get("datetime") or join(c, "time"), "description": join(c, "desc")} for c in parser.cards]


def anchors(pages: DataFrame) -> DataFrame:
    """Every anchor of every page: ``(page_id, pos, href, anchor_text, title, time_text, description)``."""
    pid = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [{"page_id": p, "pos": i, **c} for p, h in zip(pdf["page_id"], pdf["html"])
                    for i, c in enumerate(_page_cards(h))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "href", "anchor_text", "title", "time_text", "description"])

    return pages.select("page_id", "html").mapInPandas(
        run, f"page_id {pid}, pos int, href string, anchor_text string, title string, time_text string, description string")


def link_cards(cards: DataFrame, prefix: str, base: str, min_title: int = 10) -> DataFrame:
    """Cards below a path: heading long enough, relative links made absolute."""
    absolute = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base), "href"))
    under = F.col("href").startswith(prefix) | F.col("href").startswith(base + prefix)
    return cards.filter(under & (F.length("title") >= min_title)).select(
        "page_id", "title", absolute.alias("url"), F.nullif("description", F.lit("")).alias("description"),
        parse_datetime(F.col("time_text")).alias("published_at"))


class _Repos(HTMLParser):
    """Rows of a trending list: ``article.Box-row`` with heading link, paragraph, spans and topics."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.row: dict | None = None
        self.stack: list[str] = []
        self.span: list[str] | None = None
        self.in_p = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "article" and "Box-row" in (a.get("class") or "").split():
            self.row = {"href": None, "desc": None, "stars": None, "topics": []}
            self.rows.append(self.row)
            self.stack = []
        if self.row is None:
            return
        href = a.get("href") or ""
        if tag == "a" and "h2" in self.stack and self.row["href"] is None:
            self.row["href"] = href
        elif tag == "a" and "/topics/" in href:
            self.row["topics"].append(href.split("/")[-1])
        elif tag == "p" and self.row["desc"] is None:
            self.row["desc"], self.in_p = [], True
        elif tag == "span":
            self.span = []
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if self.row is None:
            return
        if tag == "span" and self.span is not None:
            text = "".join(self.span)
            if self.row["stars"] is None and "stars today" in text.lower():
                self.row["stars"] = text
            self.span = None
        elif tag == "p":
            self.in_p = False
        elif tag == "article":
            self.row = None
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if self.row is not None:
            if self.in_p:
                self.row["desc"].append(data.strip())
            if self.span is not None:
                self.span.append(data.strip())


def repositories(pages: DataFrame) -> DataFrame:
    """``(page_id, repo, description, stars, topics)`` of trending list pages."""
    pid = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for page, html in zip(pdf["page_id"], pdf["html"]):
                parser = _Repos()
                parser.feed(html or "")
                for r in parser.rows:
                    path = (r["href"] or "").strip().strip("/")
                    if "/" in path:
                        rows.append({"page_id": page, "repo": path, "description": "".join(r["desc"] or []),
                                     "stars": r["stars"] or "", "topics": r["topics"]})
            yield pd.DataFrame(rows, columns=["page_id", "repo", "description", "stars", "topics"])

    return pages.select("page_id", "html").mapInPandas(
        run, f"page_id {pid}, repo string, description string, stars string, topics array<string>")


def topic_repos(repos: DataFrame, keywords=tuple(K.REPO_KEYWORDS)) -> DataFrame:
    """Repositories whose name, text or topics contain a keyword; the first row per url counts."""
    name = F.replace("repo", F.lit("/"), F.lit(" / "))
    text = F.lower(F.concat_ws(" ", name, "description"))
    hit = contains_any(text, keywords) | F.exists("topics", lambda t: contains_any(F.lower(t), keywords))
    title = F.concat(F.lit("🔥 GitHub Trending: "), name,
                     F.when(F.col("stars") != "", F.concat(F.lit(" ("), "stars", F.lit(")"))).otherwise(""))
    rows = repos.filter(hit).select("page_id", F.concat(F.lit("https://github.com/"), "repo").alias("url"),
                                    title.alias("title"), F.nullif("description", F.lit("")).alias("description"))
    return rows.groupBy("url").agg(F.min_by(F.struct("title", "description"), "page_id").alias("r")).select("url", "r.*")
