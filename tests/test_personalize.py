"""Brief selection and profile rules."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from storyflow.config import DEFAULT
from storyflow.operators import briefs as BR
from storyflow.operators import notify as NT
from storyflow.operators import personalize as PZ
from storyflow.plans.catalog import queries

FOLDER = "/root/testdata/sf0.01"


def plain_pick(items, known, slots):
    """The selection rule in its plainest form: items are dicts, already in id order."""
    ok = sorted((i for i in items if i["score"] >= 42 or i["trend"] >= 85), key=lambda i: (-i["score"], i["id"]))
    if not ok:
        return []
    target = min(len(ok), 20) if len(ok) > 18 else len(ok)
    quota = max(1, math.ceil(target * 0.35))
    surprise = sorted((i for i in ok if i["tag"] not in known and i["quality"] >= 42), key=lambda i: (-i["quality"], -i["trend"], -i["score"], i["id"]))[:slots]
    held = {i["id"] for i in surprise}
    chosen, count = [], {}
    while len(chosen) < target - len(surprise):
        best, best_gain = None, -1e9
        for i in ok:
            if i["id"] in held or i in chosen or count.get(i["tag"], 0) >= quota:
                continue
            same = max((len(i["tags"] & c["tags"]) / len(i["tags"] | c["tags"]) for c in chosen), default=0.0)
            gain = i["score"] * 0.86 - same * 22 + (4 if not count.get(i["tag"]) else 0)
            if gain > best_gain:
                best, best_gain = i, gain
        if best is None:
            break
        chosen.append(best)
        count[best["tag"]] = count.get(best["tag"], 0) + 1
    out = [(i, False) for i in chosen]
    for i in surprise:
        if len(out) < target and count.get(i["tag"], 0) < quota:
            out.append((i, True))
            count[i["tag"]] = count.get(i["tag"], 0) + 1
    return [(i["id"], s) for i, s in sorted(out, key=lambda p: (p[1], -p[0]["score"], -p[0]["trend"]))]


def test_pick_brief_against_plain_rule():
    for seed in range(40):
        rnd = random.Random(seed)
        n = rnd.randint(0, 60)
        items = [{"id": i, "score": round(rnd.uniform(20, 90), 2), "quality": round(rnd.uniform(20, 90), 2), "trend": round(rnd.uniform(0, 100), 2),
                  "tag": f"t{rnd.randint(0, 5)}", "tags": {f"x{rnd.randint(0, 8)}" for _ in range(rnd.randint(1, 5))}} for i in range(n)]
        known, slots = {"t0", "t1"}, rnd.choice([1, 2])
        col = lambda k: np.array([i[k] for i in items], dtype=float)
        got = BR.pick_brief([i["id"] for i in items], col("score"), col("quality"), col("trend"), [i["tag"] for i in items],
                            BR.overlap_matrix([i["tags"] for i in items]), known, slots)
        assert [(items[p]["id"], s) for p, s in got] == plain_pick(items, known, slots)


def large_pool(rnd, n, cfg=DEFAULT):
    words = [f"x{i}" for i in range(60)]
    rows = []
    for i in range(n):
        tags = sorted(set(rnd.choices(words, [1 / (k + 1) for k in range(60)], k=rnd.randint(0, 6))))
        rows.append({"article_id": i * 3, "quality_raw": round(rnd.uniform(15, 95), 1), "base_trend": round(rnd.uniform(20, 100), 1), "primary_tag": tags[0] if tags else "general ai",
                     "tag_set": tags, "title": rnd.choice(["on x1", "about gpus", "news"]) + f" {i}", "shared": True})
    return rows


def plain_brief(rows, terms, topics, slots, own=None):
    items = []
    for r in rows:
        if any(b in r["tag_set"] or b in r["title"] for b in topics) or not (r["shared"] or r["article_id"] in (own or ())):
            continue
        a = round((1 - math.exp(-sum(terms.get(t, 0.0) for t in r["tag_set"]) / 4)) * 1e4) / 1e4
        raw = r["quality_raw"] * (0.7 + 0.3 * a) + 12 * a
        if r["base_trend"] >= 85:
            raw = max(raw, r["base_trend"] * 0.72)
        two = lambda x: float(np.rint(x * 100) / 100)
        items.append({"id": r["article_id"], "score": two(min(100.0, raw)), "quality": two(min(100.0, r["quality_raw"])), "trend": two(r["base_trend"]), "tag": r["primary_tag"], "tags": set(r["tag_set"])})
    for i in items:
        i["tags"] = i["tags"] or {("none", i["id"])}  # an empty set overlaps with nothing
    return plain_pick(items, set(terms), slots)


def test_briefs_over_a_pool_of_2000_equal_the_plain_rule():
    rnd = random.Random(11)
    rows = large_pool(rnd, 2000)
    index, read = BR.PoolIndex(rows, DEFAULT), []
    for user in range(25):
        terms = {f"x{rnd.randint(0, 59)}": rnd.choice([0.4, 1.5, 2.5, 3.5]) for _ in range(rnd.randint(0, 6))}
        topics = rnd.choice([[], [], ["x0"], ["gpu", "x3"], ["on x"], ["none"]])
        slots = rnd.choice([1, 2])
        for depth in (2, 64):
            picks, needed = index.brief(terms, topics, np.zeros(0, np.int64), slots, depth)
            assert [(index.ids[i], s) for i, s, _, _ in picks] == plain_brief(rows, terms, topics, slots), (user, depth)
        read.append(needed)
        quality = sorted((-q, -t, -s, i) for i, s, q, t in surprise_rows(rows, terms, topics))[:slots]
        assert [index.ids[i] for i, _ in index.surprises(terms, topics, slots, 2)] == [r[3] for r in quality]
    assert sorted(read)[len(read) // 2] < 2000  # most readers read a part of the lists


def surprise_rows(rows, terms, topics):
    """(id, score, quality, trend) of eligible, good, unblocked articles with a primary tag outside the terms."""
    for r in rows:
        if r["primary_tag"] in terms or any(b in r["tag_set"] or b in r["title"] for b in topics):
            continue
        a = round((1 - math.exp(-sum(terms.get(t, 0.0) for t in r["tag_set"]) / 4)) * 1e4) / 1e4
        raw = r["quality_raw"] * (0.7 + 0.3 * a) + 12 * a
        score = np.rint(min(100.0, max(raw, r["base_trend"] * 0.72) if r["base_trend"] >= 85 else raw) * 100) / 100
        if (score >= 42 or r["base_trend"] >= 85) and r["quality_raw"] >= 42:
            yield r["article_id"], score, r["quality_raw"], r["base_trend"]


def test_briefs_from_shared_and_own_articles():
    rnd = random.Random(5)
    rows = large_pool(rnd, 400)
    for r in rows:
        r["shared"] = rnd.random() < 0.2
    index = BR.PoolIndex(rows, DEFAULT)
    for _ in range(20):
        terms = {f"x{rnd.randint(0, 20)}": 2.0 for _ in range(3)}
        own = np.array(sorted(rnd.sample(range(400), 15)))
        picks, _ = index.brief(terms, ["x2"], own, 2, 4)
        assert [(index.ids[i], s) for i, s, _, _ in picks] == plain_brief(rows, terms, ["x2"], 2, {index.ids[i] for i in own})


def test_empty_pool_and_empty_readers(spark):
    pool = spark.createDataFrame([], "article_id long, title string, tag_set array<string>, primary_tag string, priority_score double, final_score double, trust_score double, "
                                 "importance_score double, published_at timestamp")
    users = spark.createDataFrame([(1,)], "user_id long")
    vectors = spark.createDataFrame([(1, "a", 1.0)], "user_id long, term string, weight double")
    prefs = spark.createDataFrame([(1, None)], "user_id long, blocked_topics array<string>")
    now = "2024-01-30 23:59:59"
    assert BR.select_briefs(users, pool, vectors, prefs, now, "2024-01-30").collect() == []
    assert BR.serendipity(users, pool, vectors, prefs, now, "2024-01-30").collect() == []
    assert PZ.brief_targets(users, pool, vectors, prefs, now).collect() == []


def test_blocked_hits(spark):
    rnd = random.Random(2)
    titles = ["".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 9))) for _ in range(60)] + [None]
    pool = spark.createDataFrame([(i, t, [rnd.choice("abc"), "abc"[: rnd.randint(0, 3)]]) for i, t in enumerate(titles)], "article_id long, title string, tag_set array<string>")
    terms = ["", "a", "ab", "abc", "abca", " b", "c a", "bcab"]
    want = {(t, r.article_id) for t in terms for r in pool.collect() if t in r.tag_set or t in (r.title or "").strip(" ").lower()}
    assert {(r.term, r.article_id) for r in PZ.blocked_hits(spark.createDataFrame([(t,) for t in terms], "term string"), pool).collect()} == want


def test_brief_limits(spark):
    rows = queries()["pz_12"](spark, FOLDER).collect()
    per_user, per_tag = {}, {}
    for r in rows:
        per_user[r.user_id] = per_user.get(r.user_id, 0) + 1
        per_tag[(r.user_id, r.primary_tag)] = per_tag.get((r.user_id, r.primary_tag), 0) + 1
    assert max(per_user.values()) <= DEFAULT.brief_hard_max
    assert max(per_tag.values()) <= math.ceil(DEFAULT.brief_hard_max * DEFAULT.brief_tag_share)


def test_blocked_topics(spark):
    pool = spark.createDataFrame([(1, "All about GPUs", ["hardware"]), (2, "Cooking", ["gpu", "food"]), (3, "Cooking", ["food"])], "article_id long, title string, tag_set array<string>")
    prefs = spark.createDataFrame([(1, [" GPU "]), (2, ["none"]), (3, None)], "user_id long, blocked_topics array<string>")
    assert {(r.user_id, r.article_id) for r in PZ.blocked_pairs(prefs, pool).collect()} == {(1, 1), (1, 2)}


def test_explicit_affinity(spark):
    prefs = spark.createDataFrame([(1, ["LLMs"], ["OpenAI"], ["RAG", "llms", ""]), (2, None, None, None)],
                                  "user_id long, favorite_categories array<string>, favorite_companies array<string>, favorite_topics array<string>")
    profiles = spark.createDataFrame([(1, ["OpenAI", "data"])], "user_id long, profile_terms array<string>")
    got = {r.term: round(r.weight, 6) for r in PZ.explicit_affinity(prefs, profiles).collect()}
    assert got["llms"] == 6.5 and got["openai"] == 4.0 and got["rag"] == 3.0 and got["retrieval"] == 1.65 and got["data"] == 1.5 and "" not in got


def test_affected_users(spark):
    ev = spark.createDataFrame([(1, 99.0, "LLMs", "gpu", ["x"], ["OpenAI"], ["m"]), (2, 90.0, "Research", "gpu", ["x"], ["Meta"], ["m"])],
                               "event_id long, priority_score double, category string, event_type string, tags array<string>, companies array<string>, models_mentioned array<string>")
    users = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "user_id long, is_active boolean")
    prefs = spark.createDataFrame([(1, ["Coding"], [], ["meta"]), (2, ["Coding"], [], []), (4, ["Research"], [], [])],
                                  "user_id long, favorite_categories array<string>, favorite_topics array<string>, favorite_companies array<string>")
    got = {(r.event_id, r.user_id) for r in NT.affected_users(ev, users, prefs).collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 3)}


def test_quiet_hours(spark):
    df = spark.range(24)
    quiet = [r[0] for r in df.orderBy("id").select(NT.in_quiet_hours(F.col("id"))).collect()]
    assert [h for h, q in enumerate(quiet) if q] == [0, 1, 2, 3, 4, 5, 6, 22, 23]


def test_suggestion_json(spark):
    from storyflow.plans.data import DAY, Data

    d = Data(spark, "/root/testdata/sf0.001")
    briefs = d.f_briefs.withColumns({"article_ids": F.transform("article_keys", lambda x: x.cast("bigint")), "brief_date": F.col("brief_ts").cast("date")})
    rows = PZ.suggestion_context(PZ.suggestion_inputs(d.f_users, d.f_preferences, d.f_bookmarks, briefs.filter(F.col("brief_date") == DAY), d.f_news, d.f_stored))
    parsed = rows.select(F.size(F.from_json("context", "recent_news array<struct<title: string>>")["recent_news"]).alias("n")).distinct().collect()
    assert [r.n for r in parsed] == [15]


def test_mentor_articles_equal_the_plain_rule(spark):
    """A pool's articles are arrays with the keys that somebody blocks; the choice is that of a loop over all of them."""
    rnd, firms, cats, words = random.Random(3), ["Acme", "Orb", "Zed", None], ["LLMs", "Coding", None, ""], [f"k{i}" for i in range(12)]
    rows = [(i, float(rnd.choice([20, 41, 55, 60, 61.5, 70, 70, 88])), rnd.choice(cats), rnd.choices(firms, k=rnd.randint(0, 3)), rnd.sample(words, rnd.randint(0, 4))) for i in range(900)]
    entries = spark.createDataFrame(rows, "article_id long, base double, category string, companies array<string>, metadata array<string>").withColumn("keys", F.transform("metadata", lambda x: F.xxhash64(x)))
    users = spark.createDataFrame([(u,) for u in range(30)], "user_id long")
    prefs = [(u, rnd.choices(cats, k=rnd.randint(0, 2)) or None, rnd.choices(firms, k=rnd.randint(0, 2)), [None, [], ["K1"], [None, "k2", "k3"], [w.upper() for w in words]][u % 5]) for u in range(25)]
    preferences = spark.createDataFrame(prefs, "user_id long, favorite_categories array<string>, favorite_companies array<string>, blocked_topics array<string>")
    want, own = {}, {u: (set(c or ()), set(f or ()), {(b or "").lower() for b in t or () if b}) for u, c, f, t in prefs}
    for u in range(30):
        liked, favourites, blocked = own.get(u, (set(), set(), set()))
        scored = [(-(base + (8.0 if c is not None and c in liked else 0.0) + (6.0 if (favourites - {None}) & set(f) else 0.0)), i) for i, base, c, f, keys in rows if not blocked & set(keys)]
        if (best := min(((s, i) for s, i in scored if -s >= DEFAULT.mentor_min), default=None)) is not None:
            want[u] = best[1]
    assert {r.user_id: r.article_id for r in PZ._best_mentor_articles(users, preferences, entries, DEFAULT).collect()} == want and len(want) >= 24
    asked = PZ._asked_keys(entries.select("article_id", "keys"), preferences.filter("user_id = 2"))
    assert {k for r in asked.collect() for k in r["keys"]} == {r.k for r in spark.range(1).select(F.xxhash64(F.lit("k1")).alias("k")).collect()}
    held = PZ._MentorPool(entries.select("article_id", "base", "category", "companies", "keys").orderBy(F.desc("base"), "article_id").toArrow())
    assert not any(isinstance(v, (list, set)) for v in vars(held).values())  # nothing in Python objects grows with the pool
