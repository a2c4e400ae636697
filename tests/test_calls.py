"""Model calls one by one, event matching by vector, and run counts."""

import datetime as dt

from pyspark.sql import functions as F

from storyflow.operators import cluster as CL
from storyflow.operators import enrich as EN
from storyflow.operators import stats as AG
from storyflow.operators.search import register_functions


def slow_and_failing():
    import threading
    import time

    state = {"open": 0, "most": 0, "tries": {}}
    lock = threading.Lock()

    def ask(request):
        n = int(request["title"])
        with lock:
            state["open"] += 1
            state["most"] = max(state["most"], state["open"])
            state["tries"][n] = state["tries"].get(n, 0) + 1
        time.sleep(0.02 * (n % 4))
        with lock:
            state["open"] -= 1
        if n % 10 == 3 and state["tries"][n] < 3 or n % 10 == 7:
            raise TimeoutError(str(n))
        return f"{n}:{state['tries'][n]}:{state['most']}"

    return ask


def test_calls_are_bounded_retried_and_in_order(spark):
    rows = [(i, str(i), "u", "s", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "article_id long, title string, url string, source_domain string, body string").coalesce(1)
    got = EN.call_model(df, slow_and_failing, concurrency=5, attempts=3, wait_s=0.01).collect()
    assert [r.article_id for r in got] == list(range(40))  # once each, in order
    for r in got:
        n = r.article_id
        assert (r.raw is None) == (n % 10 == 7)
        if r.raw is not None:
            _, tries, most = map(int, r.raw.split(":"))
            assert tries == (3 if n % 10 == 3 else 1) and most <= 5
    assert EN.analyses_from_responses(spark.createDataFrame(got)).count() == 40


def test_events_match_by_url_then_title_then_vector(spark):
    now = dt.datetime(2024, 1, 30)
    events = spark.createDataFrame([(1, "Chip shortage ends", "https://a/1", now, [1.0, 0.0]), (2, "Robots learn cooking", "https://a/2", now, [0.0, 1.0]),
                                    (3, "Old story", "https://a/3", now - dt.timedelta(days=9), [0.6, 0.8])],
                                   "event_id long, headline string, primary_source_url string, created_at timestamp, embedding array<double>")
    clusters = spark.createDataFrame([(10, "Nothing alike", "https://a/1", [0.0, 1.0]), (11, "Robots learn cooking fast", "https://b/1", [1.0, 0.0]),
                                      (12, "Semiconductors abundant", "https://b/2", [0.99, 0.1]), (13, "Unrelated words", "https://b/3", [0.7, 0.7]), (14, "No vector", "https://b/4", None)],
                                     "leader_id long, title string, url string, embedding array<double>")
    got = {r.leader_id: (r.event_id, r.match) for r in CL.match_events(clusters, events, "2024-01-31 00:00:00").collect()}
    assert got == {10: (1, "url"), 11: (2, "title"), 12: (1, "vector")}
    plain = CL.match_events(clusters.drop("embedding"), events, "2024-01-31 00:00:00").collect()
    assert {r.leader_id for r in plain} == {10, 11}


def test_run_counts_come_with_the_run(spark):
    checked = spark.range(20).select(F.col("id").alias("article_id"), F.when(F.col("id") % 4 == 0, "too_old").otherwise("accepted").alias("reason"))
    rows, counts = AG.ingest_run(checked, lambda d: d.withColumn("is_verified", F.col("article_id") % 3 != 0),
                                 lambda d: d.withColumn("is_duplicate", F.col("article_id") > 15))
    want = [i for i in range(20) if i % 4 and i % 3]
    assert {r.stage: r.rows for r in counts.collect()} == {"fetched": 20, "accepted": 15, "verified": len(want), "duplicates": sum(i > 15 for i in want), "saved": sum(i <= 15 for i in want)}
    assert rows.count() == len(want)


def test_search_terms_from_sql(spark):
    register_functions(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM search_terms(' The  GPU of\tAI news ')").collect()] == [(1, "the"), (2, "gpu"), (3, "news")]
    assert spark.sql("SELECT * FROM search_terms(CAST(NULL AS STRING))").collect() == []
