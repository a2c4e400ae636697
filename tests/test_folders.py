"""Tables that are a folder of part files, as batches and as streams."""

import shutil

from __spark_entry__ import queries
from pyspark.sql import functions as F

SOURCE = "/root/testdata/sf0.001"


def in_parts(spark, folder):
    """The smallest data folder's documents as 300 own rows in three part files, beside its labels in one file."""
    rows = [(i, f"Title {i % 70}\nDescription {i}", ("en", "de")[i % 2], f"src{i % 20}", 20) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    shutil.copyfile(f"{SOURCE}/labels.parquet", f"{folder}/labels.parquet")
    return str(folder)


def test_streams_read_every_part_file(spark, tmp_path):
    from storyflow.plans.data import Data

    folder = in_parts(spark, tmp_path)
    d = Data(spark, folder)
    urls = {r.normalized_url for r in queries()["dd_11"](spark, folder).collect()}
    from storyflow.functions.text import normalize_url

    assert urls == {r.u for r in d.f_articles.select(normalize_url(F.col("url")).alias("u")).collect()} and len(urls) > 100
    alerts = {r.event_id for r in queries()["nt_07"](spark, folder).collect()}
    from storyflow.operators.notify import is_interrupt

    want = d.f_story_events.filter(~F.col("notification_sent") & is_interrupt(F.col("priority_score"), F.col("event_type")))
    assert alerts == {r.event_id for r in want.collect()} and alerts
