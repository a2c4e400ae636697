"""Streams against their batch twins, fed in several files."""

import datetime as dt

from pyspark.sql import functions as F

from storyflow.operators import cluster as CL
from storyflow.operators import stats as AG
from storyflow.sources.tables import read_table
from storyflow.streaming import jobs as ST

T0 = dt.datetime(2024, 1, 10)
ARTICLES = "article_id long, title string, description string, url string, source_domain string, is_official boolean, published_at timestamp, created_at timestamp"


def landed(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def article(i, title, url, hours=0, domain="x.org", official=False):
    t = T0 + dt.timedelta(hours=hours)
    return (i, title, "d", url, domain, official, t, t)


def test_dedup_across_batches(spark, tmp_path):
    batches = [[article(1, "a", "https://x.org/1"), article(2, "b", "https://x.org/2/")], [article(3, "c", "https://x.org/1?utm_source=z", 1), article(4, "d", "https://x.org/3", 1)],
               [article(5, "e", "https://X.org/2", 2)]]
    s = landed(spark, f"{tmp_path}/in", batches, ARTICLES)
    ST.write_files(ST.dedup_stream(s), f"{tmp_path}/out", f"{tmp_path}/cp")
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(rows) == 3 and {r.normalized_url for r in rows} == {"https://x.org/1", "https://x.org/2", "https://x.org/3"}


def test_sliding_counts_with_late_rows(spark, tmp_path):
    row = lambda h, e: (T0 + dt.timedelta(hours=h), e)
    batches = [[row(h, "a") for h in range(0, 48, 3)], [row(60, "b"), row(5, "a")], [row(100, "a"), row(-200, "a")]]
    s = landed(spark, f"{tmp_path}/in", batches, "ts timestamp, entity string")
    ST.keep_latest(ST.trend_stream(s), f"{tmp_path}/t", f"{tmp_path}/cp", ["window_start", "entity"])
    got = {(r.window_start, r.entity): r.mention_count for r in read_table(spark, f"{tmp_path}/t").collect()}
    kept = spark.createDataFrame([r for b in batches for r in b if r != row(-200, "a")], "ts timestamp, entity string")
    want = {(r.w.start, r.entity): r.n for r in kept.groupBy(F.window("ts", "24 hours", "6 hours").alias("w"), "entity").agg(F.count("*").alias("n")).collect()}
    assert got == want  # the row 55 h late counts, the one behind the watermark does not


def test_requests_twin(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=i), f"u{i % 3}", i % 3 > 0) for i in range(300)]
    s = landed(spark, f"{tmp_path}/in", [rows[:150], rows[150:]], "ts timestamp, identity string, authenticated boolean")
    ST.keep_latest(ST.request_stream(s), f"{tmp_path}/t", f"{tmp_path}/cp", ["window_start", "identity"])
    batch = AG.request_counts(spark.createDataFrame(rows, "ts timestamp, identity string, authenticated boolean"))
    cols = ["window_start", "identity", "requests", "request_limit", "over_limit"]
    assert set(map(tuple, read_table(spark, f"{tmp_path}/t").select(*cols).collect())) == set(map(tuple, batch.select(*cols).collect()))


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    row = lambda m: (1, T0 + dt.timedelta(minutes=m))
    s = landed(spark, f"{tmp_path}/in", [[row(0), row(10)], [row(35), row(300)]], "user_id long, ts timestamp")
    ST.write_files(ST.session_stream(s), f"{tmp_path}/t", f"{tmp_path}/cp")
    rows = spark.read.parquet(f"{tmp_path}/t").collect()
    assert [(r.user_id, r.events, r.session_start) for r in rows] == [(1, 3, T0)]


def test_batch_sessions_equal_session_windows(spark):
    import random

    rnd = random.Random(3)
    rows = [(u, T0 + dt.timedelta(minutes=rnd.randint(0, 3000))) for u in (1, 1, 2, 3) for _ in range(120)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp")
    want = df.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    key = lambda r: (r[0], r[1], r[2], r[3])
    assert sorted(map(key, AG.sessions(df).collect())) == sorted(map(key, want.select("user_id", "w.start", "w.end", "n").collect()))


def test_incremental_clusters(spark, tmp_path):
    batches = [[article(1, "OpenAI launches GPT-6 model", "https://a.org/1", domain="a.org"), article(2, "OpenAI launches GPT-6 model today", "https://b.org/2", domain="b.org"),
                article(3, "Chip shortage ends", "https://c.org/3", domain="c.org")],
               [article(4, "OpenAI launches big GPT-6 model", "https://d.org/4", 3, "d.org"), article(5, "Robots learn cooking", "https://e.org/5", 3, "e.org"),
                article(6, "Anything at all", "https://c.org/3", 3, "z.org")]]
    s = landed(spark, f"{tmp_path}/in", batches, ARTICLES)
    as_of = str(T0 + dt.timedelta(hours=6))
    ST.cluster_stream(s, f"{tmp_path}/state", f"{tmp_path}/cp", as_of)
    got = {r.headline: (r.source_count, sorted(r.source_domains)) for r in read_table(spark, f"{tmp_path}/state").collect()}
    # Articles 1 and 2 are equally new, so the first one leads; 4 joins by title, 6 by url.
    assert got == {"OpenAI launches GPT-6 model": (3, ["a.org", "b.org", "d.org"]), "Chip shortage ends": (2, ["c.org", "z.org"]), "Robots learn cooking": (1, ["e.org"])}
    before = {r.event_id for r in read_table(spark, f"{tmp_path}/state").collect()}
    again = spark.createDataFrame(batches[1], ARTICLES)
    ST.cluster_step(again, f"{tmp_path}/state", as_of)
    assert {r.event_id for r in read_table(spark, f"{tmp_path}/state").collect()} == before


def test_alert_stream_is_idempotent(spark, tmp_path):
    schema = ("event_id long, headline string, summary string, category string, event_type string, companies array<string>, funding_amount double, "
              "priority_score double, notification_sent boolean, primary_source_url string")
    ev = lambda i, p, t: (i, f"h{i}", None, "LLMs", t, ["Acme"], None, p, False, None)
    batches = [[ev(1, 96.0, None), ev(2, 90.0, "gpu"), ev(3, 90.0, "funding")], [ev(1, 97.0, None), ev(4, 80.0, "gpu")]]
    s = landed(spark, f"{tmp_path}/in", batches, schema)
    ST.keep_latest(ST.alert_stream(s), f"{tmp_path}/t", f"{tmp_path}/cp", ["event_id"])
    assert {r.event_id: r.priority for r in read_table(spark, f"{tmp_path}/t").collect()} == {1: 97, 2: 90}


def test_expired_events_leave_the_state(spark, tmp_path):
    """One new story every two days: a step reads the events of three days, and an old headline starts a new event."""
    words = ["alpha", "bravo", "delta", "gamma", "kappa", "sigma", "omega"]
    batches = [[article(10 * i + j, f"{words[i]}{j} {words[i]}a{j} {words[i]}b{j}", f"https://x{i}.org/{j}", 48 * i, f"d{i}{j}.org") for j in range(3)] for i in range(6)]
    batches.append([article(90, "alpha0 alphaa0 alphab0", "https://y.org/1", 290, "y.org"), article(91, "sigma1 sigmaa1 sigmab1", "https://y.org/2", 290, "z.org")])
    s = landed(spark, f"{tmp_path}/in", batches, ARTICLES)
    ST.cluster_stream(s, f"{tmp_path}/state", f"{tmp_path}/cp", log_path=f"{tmp_path}/log")
    log = sorted(spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/log").collect())
    assert [r.state_rows for r in log[:2]] == [0, 3] and max(r.state_rows for r in log) <= 6 and len(log) == 7
    heads = [r.headline for r in read_table(spark, f"{tmp_path}/state").collect()]
    assert heads.count("alpha0 alphaa0 alphab0") == 2 and heads.count("sigma1 sigmaa1 sigmab1") == 1


def test_velocity_over_out_of_order_batches(spark, tmp_path):
    import random

    rnd = random.Random(4)
    rows = sorted((T0 + dt.timedelta(minutes=rnd.randint(0, 6000)), rnd.choice("aaab")) for _ in range(400))
    batches = [[] for _ in range(5)]
    for i, r in enumerate(rows):
        batches[min(4, max(0, i // 80 + rnd.choice([-1, 0, 0, 1])))].append(r)
    s = landed(spark, f"{tmp_path}/in", batches, "ts timestamp, entity string")
    ST.velocity_stream(s, f"{tmp_path}/t", f"{tmp_path}/cp")
    counts = spark.createDataFrame(rows, "ts timestamp, entity string").groupBy(F.window("ts", "24 hours", "6 hours").alias("w"), "entity").agg(F.count("*").alias("mention_count"))
    cols = ["window_start", "entity", "mention_count", "previous_mention_count", "velocity"]
    want = ST.with_velocity(counts.select(F.col("w.start").alias("window_start"), "entity", "mention_count")).select(*cols).collect()
    assert sorted(map(tuple, read_table(spark, f"{tmp_path}/t").select(*cols).collect())) == sorted(map(tuple, want))
