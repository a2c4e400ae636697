"""Keyed tables: snapshots, splitting buckets, retention."""

import random

import pytest
from pyspark.sql import functions as F

from storyflow.operators import feeds as FQ
from storyflow.sources.tables import Snapshot, delete_before, exists, read_table, upsert, vacuum


def rows(df):
    return {r.k: r.v for r in df.collect()}


def frame(spark, data):
    return spark.createDataFrame(data, "k long, v string")


def test_upserts_equal_a_dictionary_while_buckets_split(spark, tmp_path):
    path, rnd, want, sizes = f"{tmp_path}/t", random.Random(1), {}, []
    assert not exists(spark, path)
    for step in range(6):
        new = {rnd.randint(0, 400): f"{step}-{rnd.random()}" for _ in range(60)}
        n = upsert(frame(spark, list(new.items())), path, ["k"], bucket_rows=25)
        assert n == {"created": len(set(new) - set(want)), "updated": len(set(new) & set(want))}
        want |= new
        assert rows(read_table(spark, path)) == want
        s = Snapshot.load(spark, path)
        sizes.append(s.buckets["all"])
        assert s.rows() == len(want) and s.buckets["all"] == max(sizes[0], -(-len(want) // 25))
        # Every row lies in the bucket that its key names.
        for (part, bucket), _ in s.segments.items():
            low = 1 << (s.buckets[part].bit_length() - 1)
            for r in s.read([(part, bucket)]).select(F.xxhash64("k").alias("h")).collect():
                b = r.h % (2 * low)
                assert bucket == (b if b < s.buckets[part] else r.h % low)
    assert sizes == sorted(sizes) and sizes[-1] >= 8 and exists(spark, path)


def test_a_reader_sees_one_state_and_a_failed_write_none(spark, tmp_path):
    path = f"{tmp_path}/t"
    upsert(frame(spark, [(i, "old") for i in range(50)]), path, ["k"], bucket_rows=10)
    before = read_table(spark, path)
    upsert(frame(spark, [(i, "new") for i in range(0, 50, 2)]), path, ["k"])
    assert set(rows(before).values()) == {"old"}  # the state at which it was opened
    assert sorted(rows(read_table(spark, path)).values()).count("new") == 25
    assert set(rows(read_table(spark, path, version=1)).values()) == {"old"}

    @F.udf("string")
    def broken(v):
        raise ValueError("lost")

    with pytest.raises(Exception):
        upsert(frame(spark, [(1, "x")]).withColumn("v", broken("v")), path, ["k"])
    assert Snapshot.load(spark, path).version == 2


def test_what_is_rewritten_follows_the_changed_keys(spark, tmp_path):
    path = f"{tmp_path}/t"
    upsert(frame(spark, [(i, "a") for i in range(2000)]), path, ["k"], bucket_rows=50)
    old = {p: r["segment"] for p, r in Snapshot.load(spark, path).segments.items()}
    upsert(frame(spark, [(7, "b")]), path, ["k"], bucket_rows=50)
    new = {p: r["segment"] for p, r in Snapshot.load(spark, path).segments.items()}
    assert len(old) == 40 and sum(old[p] != new[p] for p in old) == 1


def test_repeats_within_a_batch_and_null_keys(spark, tmp_path):
    path = f"{tmp_path}/t"
    upsert(frame(spark, [(1, "a"), (1, "c"), (1, "b"), (None, "n")]), path, ["k"])
    assert rows(read_table(spark, path)) == {1: "c", None: "n"}
    upsert(frame(spark, []), path, ["k"])
    assert Snapshot.load(spark, path).version == 1


def test_vacuum_keeps_what_kept_states_need(spark, tmp_path):
    path = f"{tmp_path}/t"
    for i in range(4):
        upsert(frame(spark, [(j, str(i)) for j in range(i, 40)]), path, ["k"], bucket_rows=20)
    want = rows(read_table(spark, path))
    assert vacuum(spark, path, keep=1) > 0
    assert rows(read_table(spark, path)) == want and vacuum(spark, path, keep=1) == 0


def test_retention_drops_days_and_rewrites_one(spark, tmp_path):
    path = f"{tmp_path}/t"
    data = [(i, f"2024-01-{1 + i % 20:02d} {i % 24:02d}:30:00") for i in range(400)] + [(1000, None)]
    df = spark.createDataFrame(data, "id long, t string").select("id", F.col("t").cast("timestamp").alias("created_at")).withColumn("day", F.to_date("created_at"))
    upsert(df, path, ["id"], partition_by="day")
    before = {p: r["segment"] for p, r in Snapshot.load(spark, path).segments.items()}
    gone = FQ.apply_retention(spark, path, "2024-01-20 12:00:00", 10)
    left = {i for i, t in data if t is None or t >= "2024-01-10 12:00:00"}
    assert {r.id for r in read_table(spark, path).collect()} == left
    assert gone == {"deleted": len(data) - len(left), "segments_dropped": 9, "segments_rewritten": 1, "segments_untouched": 11}
    after = {p: r["segment"] for p, r in Snapshot.load(spark, path).segments.items()}
    assert all(before[p] == after[p] for p in after if p[0] != "2024-01-10") and "none" in {p for p, _ in after}
    assert delete_before(spark, path, "created_at", F.lit("2024-01-01").cast("timestamp"), "2024-01-01")["deleted"] == 0
    # Updates of kept days still work, and everything can go.
    upsert(df.filter("id = 15"), path, ["id"])
    assert FQ.apply_retention(spark, path, "2025-01-01 00:00:00", 1)["deleted"] == len(left) - 1
    assert [r.id for r in read_table(spark, path).collect()] == [1000]
