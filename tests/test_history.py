"""The persisted fingerprint index against plain lookups, and what it opens."""

from pyspark.sql import functions as F

from storyflow.operators import history as HI
from storyflow.sources.tables import Snapshot

ENTRY = "layer int, key string, canonical_id long"


def numbered(spark, first, last, ids=0):
    return spark.range(first, last).select((F.col("id") % 3).cast("int").alias("layer"), F.concat(F.lit("key-"), F.col("id")).alias("key"), (F.col("id") + ids).alias("canonical_id"))


def asked(spark, numbers):
    return spark.createDataFrame([(n % 3, f"key-{n}") for n in numbers], "layer int, key string")


def test_index_equals_plain_lookup_over_several_updates(spark, tmp_path):
    path = f"{tmp_path}/index"
    assert HI.lookup(asked(spark, [1]), path)[0].count() == 0
    assert HI.add(numbered(spark, 0, 3000, 10), path, 500) == {"created": 3000, "updated": 0}
    version = Snapshot.load(spark, path).version
    # The same entries, or larger ids, change nothing and publish nothing.
    assert HI.add(numbered(spark, 0, 3000, 11), path, 500) == {"created": 0, "updated": 0} and Snapshot.load(spark, path).version == version
    assert HI.add(numbered(spark, 2990, 3010, -1), path, 500) == {"created": 10, "updated": 10}
    found, _ = HI.lookup(asked(spark, [*range(0, 6000, 7), 2995, 2995]), path)
    want = {(n % 3, f"key-{n}", n - 1 if n >= 2990 else n + 10) for n in [*range(0, 3010, 7), 2995]}
    assert {tuple(r) for r in found.select("layer", "key", "canonical_id").collect()} == want
    # The same key under another layer is another fingerprint.
    assert HI.lookup(spark.createDataFrame([(1, "key-3"), (0, "key-3")], "layer int, key string"), path)[0].count() == 1


def test_what_is_opened_follows_the_hits_not_the_history(spark, tmp_path):
    path, opened = f"{tmp_path}/index", []
    batch = [5, 6, 7, *range(10**6, 10**6 + 300)]
    for first, last in ((0, 4000), (4000, 40_000)):
        HI.add(numbered(spark, first, last), path, 400)
        found, o = HI.lookup(asked(spark, batch), path)
        assert found.count() == 3
        opened.append(o)
    small, large = opened
    assert large["rows"] == 10 * small["rows"] and large["segments"] >= 9 * small["segments"]
    # Three hits, and a few of 300 unknown keys that pass a filter by chance.
    assert large["segments_read"] <= 3 + 300 * 0.06 and large["rows_read"] < large["rows"] / 4


def test_segments_without_filters_are_still_searched(spark, tmp_path):
    path = f"{tmp_path}/index"
    HI.upsert(numbered(spark, 0, 100), path, ["layer", "key"], bucket_rows=30)
    assert HI.lookup(asked(spark, [3, 50, 500]), path)[0].count() == 2
    HI.add(numbered(spark, 100, 120), path, 30)
    found, opened = HI.lookup(asked(spark, [3, 110]), path)
    assert found.count() == 2 and opened["segments_read"] <= 2


def test_entries_and_first_layer(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u1", "t1", "c1"), (2, "u2", "t2", None), (3, "", "t3", "c3"), (7, "u1", "t7", "c7")],
                                 "article_id long, normalized_url string, title_fingerprint string, content_fingerprint string")
    assert HI.hash_entries(rows).count() == 10
    HI.add(HI.hash_entries(rows), f"{tmp_path}/index")
    batch = spark.createDataFrame([(20, "u1", "t2", "x"), (21, "n", "t2", "c1"), (22, "", None, "c3"), (23, "n", "n", "n"), (20, "u1", "t2", "x")], rows.schema)
    got = {tuple(r) for r in HI.duplicates(HI.hash_entries(batch, "article_id"), f"{tmp_path}/index").collect()}
    assert got == {(20, 1, "url", 1.0), (21, 2, "title_hash", 1.0), (22, 3, "content_hash", 1.0)}
    rich = spark.createDataFrame([(1, ["B", "a"], "p", "e"), (2, ["A", "b"], "P", "e")], "article_id long, companies array<string>, product string, event_type string")
    assert HI.entity_entries(rich).count() == 2
