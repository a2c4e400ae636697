"""Pairs of token sets: the signature drops candidates, never pairs."""

import random

from pyspark.sql import functions as F

from storyflow.operators import similarity as SI


def test_signature_tells_sets_with_one_frequent_token_apart(spark):
    r = random.Random(5)
    sets = [["the"] + [f"w{i}-{k}" for k in range(9)] for i in range(60)]
    sets += [s[:8] + [f"x{i}"] for i, s in enumerate(sets[:20])]
    # Long sets: more tokens than the signature has bits.
    long = [f"l{k}" for k in range(900)]
    sets += [long, long[:700] + [f"m{k}" for k in range(200)], [f"n{k}" for k in range(900)]]
    r.shuffle(sets)
    df = SI.order_tokens(spark.createDataFrame(list(enumerate(sets)), "rank long, tok array<string>")).cache()
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and jac(a, b) >= 0.35}
    assert {(p.a, p.b) for p in SI.self_pairs(df, 0.35).collect()} == want and len(want) == 21
    # "the" is in every prefix here, so all pairs meet; what is written is near the pairs that hold.
    rows = df.select("rank", F.size("sorted").alias("n"), *SI._SIGNATURE, F.posexplode("sorted").alias("pos", "token"))
    met = SI._meet(rows.filter("token = 'the' AND n < 20").withColumn("pos", F.lit(0)), rows.filter("token = 'the' AND n < 20").withColumn("pos", F.lit(0)), 0.35,
                   F.col("x.rank") < F.col("y.rank"))
    assert met.count() < 60
