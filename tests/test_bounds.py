"""Work and memory that must not grow with the product of two tables."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from storyflow.config import DEFAULT
from storyflow.operators import personalize as PZ
from storyflow.operators.vectors import VectorIndex, cosine_join, distinct_units, units
from storyflow.session import materialize, prepare


def test_vectors_without_structure_are_compared_as_a_grid(spark):
    """Where each vector would visit nearly all cells, no vector is sent to cells; the pairs are those of all cells."""
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 24)))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    table = materialize(distinct_units(units(df)), "vectors")
    index = VectorIndex(table, 900, 24)
    assert index.plain(table, 900, 0.35)
    index.routed = None  # a grid sends nothing to cells
    u = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1)[:, None]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.round(u @ u.T, 6) >= 0.35))}
    assert {(r.left_id, r.right_id) for r in index.search(table, 0.35, False).collect()} == want
    small = replace(DEFAULT, vector_broadcast_mb=0, vector_block=64)
    assert {(r.left_id, r.right_id) for r in cosine_join(df, df, 0.35, small, best_only=False).collect()} == want


def test_python_gets_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    prepare(spark)
    assert max(r.n for r in spark.range(5000, numPartitions=1).mapInArrow(sizes, "n long").collect()) <= 512


def test_blocked_counts_are_those_of_the_pairs(spark):
    pool = spark.createDataFrame([(i, f"Title {i % 7} gpu" if i % 3 == 0 else f"Title {i % 7}", [f"t{i % 5}"]) for i in range(60)], "article_id long, title string, tag_set array<string>")
    prefs = spark.createDataFrame([(u, topics) for u, topics in enumerate([["gpu"], ["gpu", "T1"], ["t1", "gpu"], ["none"], None, [], ["title 3", None], ["gpu"], ["t1"]])] + [(0, ["t2"])],
                                  "user_id long, blocked_topics array<string>")
    want = {(r.user_id, r["count"]) for r in PZ.blocked_pairs(prefs, pool).groupBy("user_id").count().collect()}
    counts = PZ.blocked_counts(prefs, pool)
    assert {(r.user_id, r.lost) for r in counts.collect()} == want and len(want) >= 6
    # The articles meet sets of topics, not users: nothing that holds a user is joined with an article.
    assert counts.filter(F.col("lost") > 60).count() == 0


def test_overlaps_of_an_own_list_are_those_of_the_sets():
    import random

    import pandas as pd

    from storyflow.operators.briefs import _overlaps

    r = random.Random(2)
    sets = [[f"t{r.randrange(9)}" for _ in range(r.randrange(6))] for _ in range(40)] + [[], [None, "t1"], [None]]
    near, others = _overlaps(pd.Series(sets)), np.arange(len(sets))[::-1]
    for i, s in enumerate(sets):
        assert list(near(i, others)) == [len(set(s) & set(sets[j])) / max(1, len(set(s) | set(sets[j]))) for j in others]
    assert list(_overlaps(pd.Series([[], []]))(0, np.arange(2))) == [0.0, 0.0]


def test_trends_carry_short_headlines(spark, monkeypatch):
    import datetime as dt

    from storyflow.operators import trends as TR

    at, seen, whole = dt.datetime(2024, 1, 30, 12), [], TR.window_counts
    rows = [(i, at, float(i), "x" * 5000 + str(i), "a.org", ["Acme"], "funding", ["m-one"], ["word", "other"], ["rag"]) for i in range(4)] + [(9, at, 99.0, None, "a.org", ["Acme"], None, None, None, None)]
    df = spark.createDataFrame(rows, "event_id long, published_at timestamp, priority_score double, headline string, primary_source_domain string, companies array<string>, event_type string, "
                                     "models_mentioned array<string>, keywords array<string>, technologies_mentioned array<string>")
    monkeypatch.setattr(TR, "window_counts", lambda events, *a, **k: seen.append(events) or whole(events, *a, **k))
    got = {(r.trend_type, r.period_hours): r.top_headline for r in TR.trends(df, "2024-01-31 00:00:00", with_ids=False).collect()}
    assert got["company", 24] is None and got["topic", 24] == "x" * 200 and got["keyword", 24] is None
    assert seen[0].agg(F.max(F.length("headline"))).first()[0] == 200


def test_blocked_pairs_neither_broadcast_titles_nor_repeat(spark):
    """Titles are cut into letters without being sent anywhere whole, and users of one set of topics are dealt over parts."""
    titles = {i: ("x" * (250 + i) if i % 10 == 9 else "") + f"Title {i % 7}" + " gpu" * (i % 3 == 0) for i in range(60)} | {-1: "gpus"}
    pool = materialize(spark.createDataFrame([(i if i >= 0 else None, t, [f"t{i % 5}"]) for i, t in [*titles.items(), (3, "other")]], "article_id int, title string, tag_set array<string>"), "pool")
    prefs = spark.createDataFrame([(u, ["gpu", None] if u == 7 else ["gpu", "xT"] if (u or 0) % 2 else ["none"]) for u in [*range(40), None]] + [(0, ["t2"]), (None, ["title 4"])], "user_id int, blocked_topics array<string>")
    rows, topics = [(r.article_id, r.title.lower(), r.tag_set) for r in pool.collect()], {}
    for r in prefs.collect():
        topics.setdefault(r.user_id, set()).update((b or "").lower() for b in r.blocked_topics)
    want = {(u, a) for u, own in topics.items() for a, t, tags in rows if any(b in t or b in tags for b in own)}
    for share in (1, 50, 1 << 20):
        got = [tuple(r) for r in PZ.blocked_pairs(prefs, pool, share).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 400
    hits = PZ.blocked_hits(materialize(prefs.selectExpr("explode(blocked_topics) term").distinct(), "terms"), pool)
    assert "Generate" in (plan := hits._jdf.queryExecution().sparkPlan().toString()) and "BroadcastHashJoin" not in plan and "BroadcastNestedLoop" not in plan


def test_pairs_are_made_in_place(spark):
    """Affinities and scores equal those of plain loops, for any blocks, and only readers' terms are shuffled."""
    import math

    pool = materialize(spark.createDataFrame([(i if i < 59 else None, f"Title {i % 7}" if i % 9 else None, sorted({f"t{i % 5}", f"u{i % 11}"})[: i % 3], 10.0 + i, 3.0 * (i % 33), 50.0, None, None, f"p{i % 3}") for i in [*range(60), 4, 4, 59]],
                                             "article_id int, title string, tag_set array<string>, priority_score double, final_score double, trust_score double, importance_score double, published_at timestamp, primary_tag string"), "pool")
    own = {(u, t): w for u in [1, 2, 3, 4, None] for t, w in {"t1": 0.5 + (u or 0), f"u{u}": 1e-7, "p1": 2.0, "zz": 9.0}.items()}
    vectors = spark.createDataFrame([(u, t, w) for (u, t), w in own.items()], "user_id int, term string, weight double")
    rows, sums = pool.collect(), {}
    for u in [1, 2, 3, 4, None]:
        for r in rows:
            for t in r.tag_set:
                if (u, t) in own:
                    sums[u, r.article_id] = sums.get((u, r.article_id), 0.0) + own[u, t]
    want = {(u, a): round(1 - math.exp(-s / 4), 4) for (u, a), s in sums.items()}
    users = spark.createDataFrame([(1,), (2,), (None,), (3,)], "user_id int")
    prefs = spark.createDataFrame([(1, ["title 3", "t4"]), (2, ["U1"]), (2, None), (3, [None])], "user_id int, blocked_topics array<string>")
    for cfg in (DEFAULT, replace(DEFAULT, pair_block_mb=0)):
        if not cfg.pair_block_mb:
            from storyflow.operators import pairs
            whole = pairs.blocks
            pairs.blocks = lambda table, size, mb: [table.where(F.pmod(F.xxhash64("article_id"), F.lit(5)) == k).toArrow() for k in range(5)]
        try:
            got = PZ.pool_affinity(vectors, pool, cfg)
            scored = PZ.score_pairs(users, pool, vectors, prefs, "2024-01-30 23:59:59", cfg)
        finally:
            if not cfg.pair_block_mb:
                pairs.blocks = whole
        found = [((r.user_id, r.article_id), r.affinity) for r in got.collect()]
        assert len(found) == len(dict(found)) and dict(found) == want and 0.0 in want.values() and (4, None) in want
        bars = [(1, ["title 3", "t4"]), (2, ["u1"]), (2, []), (3, [""])]
        expected = sorted((u, r.article_id) for u, bar in bars for r in rows if want.get((u, r.article_id), 0) > 0 and r.article_id is not None and not any(b in r.tag_set or b in (r.title or "").lower() for b in bar))
        pairs_ = scored.collect()
        assert sorted((r.user_id, r.article_id) for r in pairs_) == expected and len(expected) > 20
        assert all(r.affinity == want[r.user_id, r.article_id] and r.base_trend_score in {max(x.priority_score, x.final_score) for x in rows if x.article_id == r.article_id} for r in pairs_)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan  # pairs come out of Python and are not summed up again


def test_a_choice_looks_at_few_overlaps():
    """Of many candidates only those whose score may win are compared; the choice equals that over all of them."""
    from storyflow.operators import briefs as BR

    rng, n, asked = np.random.default_rng(4), 6000, []
    score, quality, trend = np.round(rng.uniform(42, 95, n), 2), np.round(rng.uniform(20, 90, n), 2), np.round(rng.uniform(0, 100, n), 2)
    tags, sets = [f"t{i}" for i in rng.integers(0, 9, n)], [set(rng.integers(0, 40, 6).tolist()) for _ in range(n)]
    overlap = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])

    def near(i, others):
        asked.append(len(others))
        return np.array([overlap(i, j) for j in others])

    picks, (ok, novel, floor, full) = BR.choose(list(range(n)), score, quality, trend, tags, near, {"t1"}, 2)
    held = sorted((i for i in range(n) if tags[i] != "t1" and quality[i] >= 42), key=lambda i: (-quality[i], -trend[i], -score[i], i))[:2]
    chosen = []
    while len(chosen) < 18:
        free = [i for i in range(n) if i not in chosen and i not in held and sum(tags[c] == tags[i] for c in chosen) < 7]
        gain = lambda i: score[i] * 0.86 - max((overlap(c, i) for c in chosen), default=0.0) * 22.0 + (4.0 if all(tags[c] != tags[i] for c in chosen) else 0.0)
        chosen.append(min(free, key=lambda i: (-gain(i), -score[i], i)))
    assert {i for i, s in picks if not s} == set(chosen) and novel == held and ok == n and full
    assert sum(asked) < 18 * n / 2


def test_index_in_tasks_holds_numbers_for_terms(spark):
    """What readers and the pool send to tasks are numbers of terms, and a pool's index has no list of terms by name."""
    from storyflow.operators import briefs as BR

    pool = spark.createDataFrame([(i, f"Title {i}", [f"t{i % 5}", f"u{i}"], f"t{i % 5}", 80.0 - i, 10.0, 50.0, 50.0, None) for i in range(40)], "article_id long, title string, tag_set array<string>, primary_tag string, "
                                 "priority_score double, final_score double, trust_score double, importance_score double, published_at timestamp")
    index, terms, code = BR.pool_index(pool, "2024-01-30 23:59:59")
    assert index.names is None and index.flat.dtype == np.int32 and terms.count() == 45 and len(index.terms) == 45
    users, vectors = spark.createDataFrame([(1,), (2,)], "user_id long"), spark.createDataFrame([(1, "t1", 2.0), (1, "other", 1.0)], "user_id long, term string, weight double")
    rows = {r.user_id: r for r in BR.reader_rows(users, vectors, spark.createDataFrame([(1, ["T2"])], "user_id long, blocked_topics array<string>"), "2024-01-30", terms, code).collect()}
    assert [index.places(np.array([t.code]))[0] for t in rows[1].terms] == [int(np.flatnonzero(index.terms == rows[1].terms[0].code)[0])] and rows[1].topics[0].topic == "t2" and rows[2].terms is None


def test_weights_of_readers_move_once(spark):
    """A reader's weights are summed and meet the pool's terms where they lie: nothing is dealt by terms, and by readers only bookmarks with their tags in arrays."""
    import datetime as dt
    import re

    at = dt.datetime(2024, 1, 30)
    users = spark.createDataFrame([(u if u < 9 else None, at) for u in range(10)], "user_id long, ts timestamp").groupBy("user_id").agg(F.min("ts").alias("ts"))
    prefs = users.filter("user_id % 4 <> 1").select("user_id", *[F.array(F.lit("LLMs"), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias(c) for c in ("favorite_categories", "favorite_companies", "favorite_topics")],
                                                    F.array(F.lit("zz")).alias("blocked_topics"))
    rows = [(i, f"t{i % 5}", [f"t{i % 5}", "llms", f"u{i % 7}"]) for i in [*range(20), 3]]
    pool = materialize(spark.createDataFrame([(*r, f"Title {r[0]}", 50.0, 10.0, 50.0, 50.0, None) for r in rows], "article_id long, primary_tag string, tag_set array<string>, title string, priority_score double, "
                                             "final_score double, trust_score double, importance_score double, published_at timestamp"), "pool")
    marks = [(u if u < 9 else None, (u * 7 + k) % 20) for u in range(10) for k in range(3)]
    bookmarks = spark.createDataFrame([(u, a, at) for u, a in marks], "user_id long, article_id long, created_at timestamp")
    vectors = PZ.affinity_vectors(PZ.explicit_affinity(prefs), PZ.bookmark_affinity(bookmarks, pool, "2024-01-31 00:00:00"))
    want, day = {}, 5.0 * 0.5 ** (1 / 14)
    for u in [u for u in range(9) if u % 4 != 1]:
        for t, w in (("llms", 9.0), (f"u{u}", 9.0), *((e, 1.65) for e in PZ.K.TOPIC_EXPANSIONS.get("llms", []))):
            want[u, t] = want.get((u, t), 0.0) + w
    for u, a in marks:
        for t in (t for i, _, tags in rows if i == a for t in tags):
            want[u, t] = want.get((u, t), 0.0) + day
    assert {(r.user_id, r.term): round(r.weight, 6) for r in vectors.collect()} == {k: round(w, 6) for k, w in want.items()}
    for made in (PZ.pool_affinity(vectors, pool), PZ.score_pairs(users.filter("user_id is not null"), pool, vectors, prefs, "2024-01-30 23:59:59")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange (hashpartitioning\(.*)", plan)
        assert not [e for e in dealt if "term" in e] and len([e for e in dealt if "REPARTITION_BY_NUM" in e]) == 1


def test_analyses_move_the_lines_they_need(spark, tmp_path):
    """Texts meet labels with two lines; the rows are those of the whole texts."""
    from storyflow.plans.data import VIEWS, Data

    texts = ["a B\nsecond\nthird", "one", "", "x\n\ny", None, "p\nq\n", "\nonly second\nmore"]
    spark.createDataFrame([(i, t, "en", f"src{i}", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (2, 0, 1)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    data = Data(spark, str(tmp_path))
    whole = spark.sql(VIEWS["f_analyses"].replace("documents", "{documents}").replace("labels", "{labels}"), documents=data.documents, labels=data.labels)
    assert sorted(map(str, data.f_analyses.collect())) == sorted(map(str, whole.collect()))
    assert "substring_index" in data.f_analyses._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]


def test_own_candidates_are_chosen_where_they_are_scored(spark):
    """The picks equal those over stored pairs, also for ids that repeat or are null; no pair leaves the task that scores it."""
    import random

    from storyflow.operators import briefs as BR

    rnd, day = random.Random(7), "2024-01-30"
    words = [f"w{i}" for i in range(30)]
    rows = [(i, f"Title {i % 7}" if i % 9 else None, sorted(set(rnd.choices(words, k=rnd.randint(0, 6)))), round(rnd.uniform(0, 100), 1), round(rnd.uniform(0, 100), 1), round(rnd.uniform(40, 95), 1), 50.0, None, f"p{i % 6}") for i in range(150)]
    rows += [rows[3], rows[3], (5, "Title 5", ["w1", "w2"], 99.0, 10.0, 90.0, 90.0, None, "w3"), (None, "Title x", ["w1"], 99.0, 99.0, 95.0, 90.0, None, "p1")]
    pool = materialize(spark.createDataFrame(rows, "article_id int, title string, tag_set array<string>, priority_score double, final_score double, trust_score double, importance_score double, published_at timestamp, primary_tag string"), "pool")
    users = spark.createDataFrame([(u,) for u in range(12)], "user_id int")
    own = {(u, w): round(rnd.choice([0.3, 2.0, 5.0]), 2) for u in range(1, 14) for w in rnd.sample(words, u % 5 + 1)} | {(2, "p1"): 1.0, (None, "w1"): 1.0, (4, "zz"): 2.0}
    vectors = spark.createDataFrame([(u, t, w) for (u, t), w in own.items()], "user_id int, term string, weight double")
    prefs = spark.createDataFrame([(u, [["title 3"], ["w4", "none"], [None], None][u % 4]) for u in range(0, 12, 2)], "user_id int, blocked_topics array<string>").filter("blocked_topics is null or blocked_topics[0] is not null")
    pairs = PZ.eligible(PZ.score_pairs(users, pool, vectors, prefs, f"{day} 23:59:59", tags=True))
    known = vectors.join(pool.select(F.col("primary_tag").alias("term")).distinct(), "term", "left_semi").groupBy("user_id").agg(F.collect_set("term").alias("known"))
    stored = BR.select_from_candidates(pairs.join(known, "user_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>"))), day)
    made = BR.select_matched(users, pool, vectors, prefs, f"{day} 23:59:59", day)
    plain = lambda df: sorted((r.user_id, r.pos, r.article_id, r.is_serendipity, r.personalized_score, r.affinity, r.primary_tag) for r in df.collect())
    assert plain(made) == plain(stored) and len({r[0] for r in plain(made)}) == 11
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_a_brief_reads_what_may_win():
    """Of a large pool a brief reads the articles whose best possible score could win a step, and no more for the bonus of tags that it has."""
    from storyflow.operators import briefs as BR

    rng, n = np.random.default_rng(9), 20000
    rows = [{"article_id": i, "quality_raw": float(q), "base_trend": float(t), "primary_tag": f"p{k}", "tag_set": sorted({f"x{j}" for j in s} | {"all"}), "title": "t", "shared": True}
            for i, (q, t, k, s) in enumerate(zip(rng.uniform(30, 95, n).round(1), rng.uniform(20, 84, n).round(1), rng.integers(0, 7, n), rng.integers(0, 3000, (n, 8))))]
    rows[4321]["primary_tag"], rows[4321]["quality_raw"] = "lone", 60.0
    index = BR.PoolIndex(rows, DEFAULT)
    for terms in ({"all": 40.0, **{f"p{k}": 1.0 for k in range(6)}}, {"all": 40.0, **{f"p{k}": 1.0 for k in range(7)}}, {"x1": 9.0}, {}):
        picks, read = index.brief({t: w for t, w in terms.items()}, [], np.zeros(0, np.int64), 2)
        at, weights, _ = index._named(terms, [])
        every = np.arange(n)
        _, score, trend = index.scored(every, at, weights)
        want, _ = BR.choose(every, score, index.quality, trend, index.tag_at, index.near(every), set(at.tolist()), 2)
        assert [(i, s) for i, s, *_ in picks] == want
        assert read < 5000 or "all" not in terms
