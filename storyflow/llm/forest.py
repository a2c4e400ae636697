"""Near duplicates of embeddings by a forest of random-projection trees.

Every tree splits the vectors of a label again and again at a random place along a random direction (one direction a
level and tree), until a node has at most ``leaf`` vectors; vectors close to a split go to both sides. Nodes are
counted and split by Spark, level by level, for all trees at once. Vectors of a leaf are compared with each other by
exact cosine; a leaf passes on a spanning forest of its links, and these links are united over all trees. A leaf that no
direction could part is compared whole too: linked to one vector if all lie close to its centre, else part against part.

All links lie inside the components found so. Each component is then compared whole: components of up to ``block``
vectors in one piece, larger ones block against block, except where all vectors lie within half the threshold's
angle of their centre, so that all of them link. So the count of links is exact within components, and neither a
pair of a dense group nor a group itself is ever written out.

Defined results: a vector that is null, zero, or holds a null or a non-finite number, and one without a label, links with
nothing and keeps its own id; labels of any type that casts to a string are compared as they are; finite components of any
size are scaled by a power of two first; vectors of different lengths do not link; equal vectors are one node with a count; rows
with a null id are vectors of their own that come last; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyflow.llm.common import Kept, Scratch, components

LAST = 2**63 - 1


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.93
    trees: int = 8
    leaf: int = 256
    #: Share of a node's spread on each side of a split that goes to both children.
    spill: float = 0.1
    #: Split places vary by this share of the spread around the mean.
    jitter: float = 0.25
    block: int = 1024
    seed: int = 7


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)))


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each row's component in a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked))
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _projections(s: Settings, levels: int):
    def run(batches):
        for batch in batches:
            frame = batch.to_pandas()
            out: list = [None] * len(frame)
            for dim, rows in frame.groupby("dim").indices.items():
                x = _matrix(frame["v"].iloc[rows])
                x /= np.sqrt((x * x).sum(1))[:, None]
                way = np.random.Generator(np.random.PCG64([s.seed, int(dim)])).standard_normal((int(dim), s.trees * levels))
                for i, p in zip(rows, (x @ way).astype(np.float32)):
                    out[i] = p.reshape(s.trees, levels).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("label"), batch.column("dim"), pa.array(out, pa.list_(pa.list_(pa.float32())))], names=["k", "label", "dim", "p"])
    return run


def leaves(scratch: Scratch, vectors: DataFrame, s: Settings) -> Kept:
    """(label, dim, tree, node, n, k): the leaves of all trees; n is the size of those that no direction could part, else null."""
    largest = vectors.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = max(1, math.ceil(math.log2(max(1, largest / s.leaf))) + 4)
    placed = vectors.select("k", "label", "dim", "v").mapInArrow(_projections(s, levels), "k long, label string, dim int, p array<array<float>>")
    now = scratch.keep(placed.select("k", "label", "dim", F.posexplode("p").alias("tree", "p")).withColumn("node", F.lit(1).cast("long")), "level")
    keys = ["label", "dim", "tree", "node"]
    for level in range(levels):
        at = F.get("p", F.lit(level)).cast("double")
        stats = scratch.keep(now.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(at).alias("mean"), F.stddev_pop(at).alias("spread")).where(F.col("n") > s.leaf), "splits")
        if stats.df.isEmpty():
            stats.drop()
            break
        chance = F.pmod(F.xxhash64("tree", "node", "label"), F.lit(1 << 20)) / float(1 << 20) * 2 - 1
        cut, both = F.col("mean") + F.col("spread") * s.jitter * chance, F.col("spread") * s.spill
        sides = F.filter(F.array(F.when(at < cut + both, F.col("node") * 2), F.when(at >= cut - both, F.col("node") * 2 + 1)), lambda x: x.isNotNull())
        split = now.df.join(stats.df.select(*keys, "mean", "spread"), keys, "left")
        following = split.select("k", "label", "dim", "tree", "p", F.explode(F.when(F.col("mean").isNull(), F.array("node")).otherwise(sides)).alias("node"))
        after = scratch.keep(following, "level")
        now.drop()
        stats.drop()
        now = after
    size = scratch.keep(now.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * s.leaf), "oversize").df
    out = scratch.keep(now.df.drop("p").join(size, keys, "left").select(*keys, "n", "k"), "leaves")
    now.drop()
    return out


def _leaf_links(s: Settings):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        k = np.sort(frame["k"].to_numpy())
        x = _matrix(frame["v"].iloc[np.argsort(frame["k"].to_numpy())])
        root = roots(cosines(x, x) >= s.cosine)
        other = np.flatnonzero(root != np.arange(len(k)))
        return pd.DataFrame({"a": k[root[other]], "b": k[other]})
    return run


def _unit(v: str) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / norm)


def _scaled(v: Column) -> Column:
    """``v`` times a power of two, so that its largest component is about 1 and squares neither overflow nor vanish."""
    top = F.array_max(F.transform(v, F.abs))
    by = F.pow(F.lit(2.0), F.least(F.greatest(-F.floor(F.log2(top)), F.lit(-1000)), F.lit(1000)))
    return F.when(top > 0, F.transform(v, lambda x: x * by)).otherwise(v)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def _tight(unit: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    """(keys, tight): whether all unit vectors u of a group lie within half the threshold's angle of their centre, so that any two link."""
    centre = unit.select(*keys, F.posexplode("u").alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x")).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("c"))
    near = unit.join(centre, keys).select(*keys, (_dot("u", "c") / F.sqrt(_dot("c", "c"))).alias("cos")).groupBy(*keys).agg(F.min("cos").alias("least"))
    half = math.cos(math.acos(s.cosine) / 2) + 1e-9
    return near.select(*keys, F.coalesce(F.col("least") >= half, F.lit(False)).alias("tight"))


def leaf_edges(scratch: Scratch, placed: DataFrame, vectors: DataFrame, s: Settings) -> DataFrame:
    """(a, b): links that connect what links inside each leaf of ``placed``; ``vectors`` has k and v."""
    keys, links = ["label", "dim", "tree", "node"], "a long, b long"
    edges = placed.where("n is null").join(vectors, "k").groupBy(*keys).applyInPandas(_leaf_links(s), links)
    if placed.where("n is not null").isEmpty():
        return edges
    large = scratch.keep(placed.where("n is not null").join(vectors, "k").select(*keys, "n", "k", "v"), "unparted").df
    judged = scratch.keep(_tight(large.select(*keys, _unit("v").alias("u")), keys, s), "unparted-tight").df
    tight = large.join(judged.where("tight"), keys)
    star = tight.select(*keys, "k").join(tight.groupBy(*keys).agg(F.min("k").alias("a")), keys).where("k <> a").select("a", F.col("k").alias("b"))
    count = F.ceil(F.col("n") / s.leaf)
    loose = large.join(judged.where("not tight"), keys).withColumn("own", F.pmod(F.xxhash64("k"), count)).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    paired = loose.select(*keys, "k", "v", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))
    return edges.unionByName(star).unionByName(paired.groupBy(*keys, "i", "j").applyInPandas(_leaf_links(s), links))


def _count_small(s: Settings):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in frame.groupby("component"):
            x, many = _matrix(own["v"]), own["many"].to_numpy()
            near = cosines(x, x) >= s.cosine
            np.fill_diagonal(near, False)
            out.append(pd.DataFrame({"k": own["k"], "n": near @ many}))
        return pd.concat(out)
    return run


def _count_blocks(s: Settings):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Links between the blocks i and j of a component."""
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        a, b = frame[frame["own"] == i], frame[frame["own"] == j]
        near = cosines(_matrix(a["v"]), _matrix(b["v"])) >= s.cosine
        if i == j:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"k": a["k"], "n": near @ b["many"].to_numpy()})
        return pd.concat([pd.DataFrame({"k": a["k"], "n": near @ b["many"].to_numpy()}), pd.DataFrame({"k": b["k"], "n": near.T @ a["many"].to_numpy()})])
    return run


def link_counts(scratch: Scratch, members: DataFrame, s: Settings) -> DataFrame:
    """(k, n): linked vectors of every member (k, component, many, v), copies of the others included."""
    sized = scratch.keep(members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("many").alias("total")), "sizes").df
    totals = sized.agg(F.sum("size").alias("rows"), F.max("size").alias("most")).first()
    buckets = 1 + 8 * (totals.rows or 0) // s.block
    small = members.join(sized.where(F.col("size") <= s.block), "component")
    counted = small.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).groupBy("bucket").applyInPandas(_count_small(s), "k long, n long")
    if (totals.most or 0) <= s.block:
        return counted
    large = scratch.keep(members.join(sized.where(F.col("size") > s.block), "component"), "large").df
    judged = scratch.keep(_tight(large.select("component", _unit("v").alias("u")), ["component"], s), "tight").df
    tight = large.join(judged.where("tight"), "component").select("k", (F.col("total") - F.col("many")).alias("n"))
    count = F.ceil(F.col("size") / s.block)
    loose = large.join(judged.where("not tight"), "component").withColumn("own", F.pmod(F.xxhash64("k"), count)).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    paired = loose.select("k", "component", "many", "v", "own", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))
    blocks = paired.groupBy("component", "i", "j").applyInPandas(_count_blocks(s), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return counted.unionByName(tight).unionByName(blocks)


def near_vectors(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per row of ``embeddings`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    s, scratch = settings, Scratch(embeddings.sparkSession, "forest")
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), _scaled(v).alias("v"), F.coalesce(usable, F.lit(False)).alias("usable")).select(
        "*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    same = ["label", "h1", "h2"]
    nodes = scratch.keep(
        rows.where("usable").groupBy(*same).agg(F.min(F.coalesce("vec_id", F.lit(LAST))).alias("id"), F.count(F.lit(1)).alias("many"), F.first("v").alias("v"))
        .withColumns({"k": F.monotonically_increasing_id(), "dim": F.size("v")}), "nodes").df
    placed = leaves(scratch, nodes, s)
    found = components(scratch, leaf_edges(scratch, placed.df, nodes.select("k", "v"), s))
    placed.drop()
    members = scratch.keep(nodes.join(found.df.withColumnRenamed("id", "node_id"), F.col("k") == F.col("node_id")).select("k", "component", "many", "v", "id"), "members").df
    counts = link_counts(scratch, members.select("k", "component", "many", "v"), s)
    least = members.groupBy("component").agg(F.min("id").alias("least"))
    linked = members.select("k", "component").join(least, "component").join(counts, "k").select("k", "least", "n")
    result = nodes.select(*same, "k", "id", "many").join(linked, "k", "left").select(
        *same, F.coalesce("least", "id").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n"))
    joined = rows.select("vec_id", "usable", *same).join(result.withColumn("usable", F.lit(True)), ["usable", *same], "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).when(F.col("component") != LAST, F.col("component"))
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
