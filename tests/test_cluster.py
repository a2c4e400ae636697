"""Clustering, similarity joins and components against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from storyflow.operators import cluster as CL
from storyflow.operators import dedup as DD
from storyflow.operators.similarity import cross_pairs, order_tokens, self_pairs

NOW = "2024-01-31 00:00:00"


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def greedy(rows, t):
    """rows: [(id, order, set)] -> {id: leader}"""
    rows = sorted(rows, key=lambda r: r[1])
    leader = {}
    for i, _, s in rows:
        if i in leader:
            continue
        leader[i] = i
        for j, _, u in rows:
            if j not in leader and jaccard(s, u) >= t:
                leader[j] = i
    return leader


def random_sets(seed, n, vocab, size):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    weights = [1 / (i + 1) for i in range(vocab)]  # some words are very common
    return [(i, rnd.random(), set(rnd.choices(words, weights, k=rnd.randint(0, size)))) for i in range(n)]


@pytest.mark.parametrize("seed, vocab, size, budget", [(1, 30, 6, 10**9), (2, 12, 5, 200), (3, 200, 12, 5000), (4, 6, 4, 1)])
def test_leader_clusters(spark, seed, vocab, size, budget):
    rows = random_sets(seed, 150, vocab, size)
    df = spark.createDataFrame([(i, o, sorted(s)) for i, o, s in rows], "id long, o double, tok array<string>")
    got = {r.id: r.leader_id for r in CL.leader_clusters(df, "id", "tok", "o", 0.35, budget).collect()}
    assert got == greedy(rows, 0.35)


def test_hot_group_of_near_copies(spark):
    """A third of all titles differ in one word only; a small budget still gives the exact result."""
    rows = [(i, float(i), {"daily", "weather", "report", f"city{i}"} if i % 3 == 0 else {f"a{i}", f"b{i}", f"c{i % 7}"}) for i in range(600)]
    df = spark.createDataFrame([(i, o, sorted(s)) for i, o, s in rows], "id long, o double, tok array<string>").repartition(7)
    got = {r.id: r.leader_id for r in CL.leader_clusters(df, "id", "tok", "o", 0.35, 2000).collect()}
    assert got == greedy(rows, 0.35) and sum(v == 0 for v in got.values()) == 200


def test_chain_is_not_a_component(spark):
    rows = [(1, 1.0, {"a", "b"}), (2, 2.0, {"b", "c"}), (3, 3.0, {"c", "d"}), (4, 4.0, {"a", "b", "c"})]
    df = spark.createDataFrame([(i, o, sorted(s)) for i, o, s in rows], "id long, o double, tok array<string>")
    got = {r.id: r.leader_id for r in CL.leader_clusters(df, "id", "tok", "o", 0.6).collect()}
    assert got == greedy(rows, 0.6)


def test_blank_and_stop_word_titles_stay_alone(spark):
    df = spark.createDataFrame([(1, "", True, None), (2, "The and of", False, None), (3, "the AND of!", False, None), (4, "Model released", False, None),
                                (5, "model, RELEASED", True, None)], "article_id long, title string, is_official boolean, published_at timestamp")
    got = {r.article_id: r.leader_id for r in CL.cluster_articles(df).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 5, 5: 5}


def test_story_groups(spark):
    titles = ["OpenAI launches GPT-6 model today", "OpenAI launches new GPT-6 model", "DeepMind solves protein folding again"]
    df = spark.createDataFrame(list(enumerate(titles)), "article_id long, title string")
    got = {r.article_id: r.story_id for r in CL.group_stories(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


@pytest.mark.parametrize("t", [0.35, 0.5, 0.8])
def test_pairs(spark, t):
    a = [(i, s) for i, _, s in random_sets(7, 80, 25, 8) if s]
    distinct = {}
    for i, s in a:
        distinct.setdefault(frozenset(s), i)
    a = [(i, set(s)) for s, i in distinct.items()]
    df = order_tokens(spark.createDataFrame([(i, sorted(s)) for i, s in a], "rank long, tok array<string>"))
    want = {(i, j) for i, s in a for j, u in a if i < j and jaccard(s, u) >= t}
    assert {(r.a, r.b) for r in self_pairs(df, t).collect()} == want
    assert {(r.a, r.b) for r in cross_pairs(df, df, t, F.col("x.rank") < F.col("y.rank")).collect()} == want


def test_components_of_a_long_chain(spark):
    rows = [(i, f"k{i}") for i in range(40)] + [(i + 1, f"k{i}") for i in range(39)] + [(100, "z"), (101, "z")]
    got = {r.id: r.label for r in DD.components(spark.createDataFrame(rows, "id long, key string")).collect()}
    assert got == {i: 0 for i in range(40)} | {100: 100, 101: 100}


def test_cascade_layers(spark):
    cols = ("article_id long, title string, content_snippet string, url string, is_duplicate boolean, created_at timestamp, embedding array<double>")
    import datetime as dt

    now = dt.datetime(2024, 1, 30, 12)
    hist = [(1, "Alpha story of the day", "x", "https://a.com/1", False, now, [1.0, 0.0]), (2, "Beta", "body", "https://a.com/2", True, now, [0.0, 1.0]),
            (3, "Gamma", "y", "https://a.com/3", False, now, [0.6, 0.8])]
    new = [(10, "Other", "q", "https://A.com/1/?utm_source=x", False, now, None), (11, "ALPHA story, of the day", "z", "https://b.com/1", False, now, None),
           (12, "Beta", "body", "https://b.com/2", False, now, None), (13, "Delta", "w", "https://b.com/3", False, now, [0.61, 0.79]), (14, "Eps", "w", "https://b.com/4", False, now, [-1.0, 0.0])]
    mk = lambda rows: DD.with_fingerprints(spark.createDataFrame(rows, cols))
    got = {r.article_id: (r.is_duplicate, r.canonical_id, r.layer) for r in DD.cascade(mk(new), mk(hist), NOW).collect()}
    assert got == {10: (True, 1, "url"), 11: (True, 1, "title_hash"), 12: (False, None, None), 13: (True, 3, "semantic_similarity"), 14: (False, None, None)}


def test_partitioning_does_not_matter(spark):
    rows = random_sets(9, 120, 20, 6)
    df = spark.createDataFrame([(i, o, sorted(s)) for i, o, s in rows], "id long, o double, tok array<string>")
    a = {(r.id, r.leader_id) for r in CL.leader_clusters(df.repartition(1), "id", "tok", "o", 0.35).collect()}
    b = {(r.id, r.leader_id) for r in CL.leader_clusters(df.repartition(13), "id", "tok", "o", 0.35, 500).collect()}
    assert a == b
