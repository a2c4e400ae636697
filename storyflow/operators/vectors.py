"""Cosine joins of vector tables.

``cosine_join`` compares every left vector with the right vectors that can reach the threshold. Equal vectors (a 128-bit hash
of the unit vector) are compared once and expanded afterwards, so a group of copies costs one comparison.

* A right side of proven small size is sent to the tasks whole.
* Otherwise an inverted file (``VectorIndex``) is built, with 4 sqrt(N) cells around sampled pivots, so that comparing
  with pivots grows as N**1.5. A left vector visits a cell only if the triangle inequality of angles and the bisector
  between two pivots allow a neighbour there, so no pair is lost. How much that saves depends on the data: with up to
  about sqrt(N) groups a vector visits few cells; vectors spread evenly over many dimensions, or in very many small groups, leave an exact
  index little to skip. Visits are counted before vectors are sent anywhere; where sending them to their cells costs more than it saves,
  blocks of both sides are compared as a plain grid.
* ``vector_mode="bands"`` bounds the work for any data: vectors meet where a band of hyperplane signs agrees, in as many tables as the
  wanted share of pairs needs, and pairs are verified exactly. Compared pairs grow as N**(1 + rho) with
  rho = ln(1 - angle/pi) / ln(1/2), which is 0.20 at cosine 0.92 and 0.35 at 0.78.

Defined results: null vectors, vectors with null or non-finite components and zero vectors match nothing; scores are rounded to six digits;
the best right row is the one with the highest score, then the smallest id; all vectors have one length.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyflow.config import DEFAULT, EngineConfig
from storyflow.session import materialize

_SLACK = 2e-6
#: Comparisons that take as long as sending one vector to one cell or block.
_MOVE = 256
#: Most rows with a vector that a task gives back at once.
_ROWS = 4096
_KEY = ["h1", "h2"]


def units(df: DataFrame) -> DataFrame:
    """``(id, v)`` -> ``(id, h1, h2, u)``: unit vectors and a 128-bit hash of each. Scaling by the largest component first keeps norms finite."""
    top = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    scaled = df.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())).select("id", "v", top.alias("top")).filter(
        (F.col("top") > 0) & (F.col("top") < F.lit(float("inf")))).select("id", F.transform("v", lambda x: x.cast("double") / F.col("top")).alias("w"))
    norm = F.sqrt(F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x * x))
    unit = scaled.select("id", "w", norm.alias("norm")).select("id", F.transform("w", lambda x: x / F.col("norm")).alias("u"))
    return unit.select("id", F.xxhash64("u").alias("h1"), F.xxhash64(F.lit(1), "u").alias("h2"), "u")


def distinct_units(rows: DataFrame) -> DataFrame:
    """One row per vector, with its smallest id."""
    return rows.groupBy(*_KEY).agg(F.min("id").alias("id"), F.first("u").alias("u"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _hits(lid, a: np.ndarray, rid, b: np.ndarray, threshold: float, best_only: bool):
    """Frames of (left_id, right_id, score) for the pairs of two blocks; ``rid`` ascends."""
    step = max(1, 4_000_000 // len(b))
    for i in range(0, len(a), step):
        s = np.round(a[i:i + step] @ b.T, 6)
        if best_only:
            j = s.argmax(axis=1)
            rows = np.flatnonzero(s[np.arange(len(s)), j] >= threshold)
            cols = j[rows]
        else:
            rows, cols = np.nonzero(s >= threshold)
        yield pd.DataFrame({"left_id": lid[i + rows], "right_id": rid[cols], "score": s[rows, cols]})


class VectorIndex:
    """An inverted file over distinct unit vectors ``(h1, h2, id, u)``, stored by the caller.

    The pivots are sampled rows (by hash), bounded by ``cfg.vector_pivot_mb``; what the driver sees per cell is one row: its size and
    the range of angles between members and pivot.
    """

    def __init__(self, table: DataFrame, n: int, dim: int, cfg: EngineConfig = DEFAULT, cells: int | None = None):
        self.cfg, self.table, self.n = cfg, table, n
        self.id_type = table.schema["id"].dataType.simpleString()
        wanted = min(max(1, (cfg.vector_pivot_mb << 20) // (8 * dim)), cells or math.ceil(4 * math.sqrt(n)))
        self.pivots = _stack(table.select("u", *_KEY).orderBy(F.xxhash64(*_KEY), *_KEY).limit(wanted).toPandas()["u"])

    @cached_property
    def cells(self) -> DataFrame:
        """Every vector with its cell and the angle to its pivot, the nearest of all."""
        pivots = self.pivots

        def assign(batches):
            for pdf in batches:
                for i in range(0, len(pdf), 1024):
                    part = pdf.iloc[i:i + 1024]
                    dots = _stack(part["u"]) @ pivots.T
                    cell = dots.argmax(axis=1)
                    yield pd.DataFrame({"id": part["id"], "u": part["u"], "cell": cell.astype("int32"), "angle": np.arccos(np.clip(dots[np.arange(len(part)), cell], -1, 1))})

        return materialize(self.table.select("id", "u").mapInPandas(assign, f"id {self.id_type}, u array<double>, cell int, angle double"), "cells")

    @cached_property
    def stats(self) -> pd.DataFrame:
        """One row per cell, in order: vectors and range of angles."""
        found = self.cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
        return found.toPandas().set_index("cell").reindex(range(len(self.pivots))).fillna({"n": 0, "lo": np.inf, "hi": -np.inf})

    def visits(self, threshold: float):
        """Function of unit vectors: (row, cell) pairs that can hold a neighbour with cosine >= threshold."""
        pivots, lo, hi = self.pivots, self.stats["lo"].to_numpy(), self.stats["hi"].to_numpy()
        r = math.acos(max(-1.0, threshold - _SLACK)) + _SLACK

        def visit(u):
            dots = np.clip(u @ pivots.T, -1, 1)
            angle = np.arccos(dots)
            ok = (angle >= lo - r) & (angle <= hi + r)
            if r < math.pi / 2:
                # Members of a cell lie on its side of the bisector between its pivot and the vector's own nearest one.
                near = dots.argmax(axis=1)
                gap = np.sqrt(np.maximum(0.0, 2 - 2 * pivots[near] @ pivots.T))
                ok &= dots[np.arange(len(u)), near][:, None] - dots <= math.sin(r) * gap + _SLACK
            return np.nonzero(ok)

        return visit

    def routed(self, left: DataFrame, threshold: float) -> DataFrame:
        """``(id, u, cell)``: every left vector with each cell it has to visit."""
        visit = self.visits(threshold)

        def route(batches):
            for pdf in batches:
                for i in range(0, len(pdf), 1024):
                    part = pdf.iloc[i:i + 1024]
                    row, cell = visit(_stack(part["u"]))
                    ids, vectors = part["id"].to_numpy(), part["u"].to_numpy()
                    for k in range(0, len(row), _ROWS):
                        at = row[k:k + _ROWS]
                        yield pd.DataFrame({"id": ids[at], "u": vectors[at], "cell": cell[k:k + _ROWS].astype("int32")})

        return materialize(left.select("id", "u").mapInPandas(route, f"id {left.schema['id'].dataType.simpleString()}, u array<double>, cell int"), "routed")

    def visitors(self, left: DataFrame, threshold: float) -> pd.DataFrame:
        """Vectors of ``left`` that visit a cell, one row per visited cell; counted without the vectors."""
        visit, cells = self.visits(threshold), len(self.pivots)

        def count(batches):
            total = np.zeros(cells, np.int64)
            for pdf in batches:
                for i in range(0, len(pdf), 1024):
                    total += np.bincount(visit(_stack(pdf["u"].iloc[i:i + 1024]))[1], minlength=cells)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"cell": at.astype("int32"), "count": total[at]})

        return left.select("u").mapInPandas(count, "cell int, count long").groupBy("cell").agg(F.sum("count").alias("count")).toPandas()

    def compared(self, left: DataFrame, threshold: float) -> int:
        """Pairs that a search for ``left`` compares by its cells."""
        visits = self.visitors(left, threshold)
        return int((visits["count"].to_numpy() * self.stats["n"].to_numpy()[visits["cell"].to_numpy()]).sum())

    def plain(self, left: DataFrame, n: int, threshold: float) -> bool:
        """Whether a grid of blocks takes less than the cells, for ``n`` vectors of ``left``."""
        visits, block = self.visitors(left, threshold), self.cfg.vector_block
        by_cells = int((visits["count"].to_numpy() * self.stats["n"].to_numpy()[visits["cell"].to_numpy()]).sum()) + _MOVE * int(visits["count"].sum())
        return n * self.n + _MOVE * (n * math.ceil(self.n / block) + self.n * math.ceil(n / block)) <= by_cells

    def search(self, left: DataFrame, threshold: float, best_only: bool) -> DataFrame:
        """``(left_id, right_id, score)`` for distinct left vectors. Cells and their visitors are cut into blocks of bounded size; every
        slice of visitors meets every block of its cell. A grid is one cell that all visit."""
        block, n = self.cfg.vector_block, left.count()
        if self.plain(left, n, threshold):
            one = F.lit(0).alias("cell")
            routed, cells = materialize(left.select("id", "u", one), "grid"), self.table.select("id", "u", one)
        else:
            routed, cells = self.routed(left, threshold), self.cells
        visits = routed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("slices"))
        sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        plan = materialize(visits.join(sizes, "cell"), "plan")  # one row per cell, of which vector_pivot_mb bounds the number
        part = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
        span = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        lb = routed.join(F.broadcast(plan), "cell").select("id", "u", "cell", part("slices").alias("slice"), span("blocks").alias("block"))
        rb = cells.select("id", "u", "cell").join(F.broadcast(plan), "cell").select("id", "u", "cell", part("blocks").alias("block"), span("slices").alias("slice"))

        def compare(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
            if not len(lp) or not len(rp):
                return pd.DataFrame({"left_id": [], "right_id": [], "score": []})
            rp = rp.sort_values("id", kind="stable")
            return pd.concat(_hits(lp["id"].to_numpy(), _stack(lp["u"]), rp["id"].to_numpy(), _stack(rp["u"]), threshold, best_only), ignore_index=True)

        keys = ["cell", "block", "slice"]
        lid = left.schema["id"].dataType.simpleString()
        return lb.groupBy(*keys).cogroup(rb.groupBy(*keys)).applyInPandas(compare, f"left_id {lid}, right_id {self.id_type}, score double")


def _small_search(left: DataFrame, right: pd.DataFrame, types: str, threshold: float, best_only: bool) -> DataFrame:
    """All pairs with a right side that the caller has found small."""
    right = right.sort_values("id", kind="stable")
    rid, b = right["id"].to_numpy(), _stack(right["u"])

    def compare(batches):
        for pdf in batches:
            if len(pdf):
                yield from _hits(pdf["id"].to_numpy(), _stack(pdf["u"]), rid, b, threshold, best_only)

    return left.select("id", "u").mapInPandas(compare, types)


def band_plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(signs in a band, tables) with which a pair at the threshold meets with probability ``recall``."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = min(48, max(6, math.ceil(math.log2(max(n, 2))) + 2))
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-(agree**bits))))


def banded_pairs(left: DataFrame, right: DataFrame, n: int, dim: int, threshold: float, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``(left_id, right_id)`` of distinct vectors that share a band of hyperplane signs in some table."""
    bits, tables = band_plan(n, threshold, cfg.vector_recall)
    planes = np.random.Generator(np.random.PCG64(64)).standard_normal((tables * bits, dim)).astype(np.float32)
    powers = 1 << np.arange(bits, dtype=np.int64)

    def sign(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i:i + 1024]
                keys = ((_stack(part["u"]).astype(np.float32) @ planes.T >= 0).reshape(len(part), tables, bits) * powers).sum(axis=2)
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), tables), "t": np.tile(np.arange(tables, dtype="int32"), len(part)), "band": keys.ravel()})

    side = lambda df, name: df.select("id", "u").mapInPandas(sign, f"id {df.schema['id'].dataType.simpleString()}, t int, band long").withColumnRenamed("id", name)
    return side(left, "left_id").join(side(right, "right_id"), ["t", "band"]).select("left_id", "right_id").distinct()


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    dot = F.aggregate(F.zip_with("ul", "ur", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    full = pairs.join(left.select(F.col("id").alias("left_id"), F.col("u").alias("ul")), "left_id").join(right.select(F.col("id").alias("right_id"), F.col("u").alias("ur")), "right_id")
    return full.select("left_id", "right_id", F.round(dot, 6).alias("score")).filter(F.col("score") >= threshold)


def cosine_join(left: DataFrame, right: DataFrame, threshold: float, cfg: EngineConfig = DEFAULT,
                best_only: bool = True, cells: int | None = None) -> DataFrame:
    """``left(id, v)`` x ``right(id, v)`` with cosine >= threshold.

    Returns ``(left_id, right_id, score)``: every pair, or with ``best_only`` the best right row per left row.
    ``cfg.vector_mode`` "exact" loses no pair; "bands" finds a pair at the threshold with probability ``cfg.vector_recall``, nearer ones more surely.
    """
    # Both sides feed several steps; stored once, the plans above them run once.
    lrows, rrows = materialize(units(left), "left"), materialize(units(right), "right")
    lid, rid = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    types = f"left_id {lid}, right_id {rid}, score double"
    lu = materialize(distinct_units(lrows), "left_vectors")
    ru = materialize(distinct_units(rrows), "right_vectors")
    size = ru.agg(F.count("*").alias("n"), F.max(F.size("u")).alias("dim")).first()
    if not size["n"]:
        return left.sparkSession.createDataFrame([], types)
    if cfg.vector_mode == "bands":
        found = _verified(banded_pairs(lu, ru, size["n"], size["dim"], threshold, cfg), lu, ru, threshold)
    elif size["n"] * size["dim"] * 8 <= cfg.vector_broadcast_mb << 20:
        found = _small_search(lu, ru.select("id", "u").toPandas(), types, threshold, best_only)
    else:
        found = VectorIndex(ru, size["n"], size["dim"], cfg, cells).search(lu, threshold, best_only)
    if best_only:
        # Smallest id among equal best scores, whatever block it came from.
        found = found.groupBy("left_id").agg(
            F.min_by(F.struct("right_id", "score"), F.struct(-F.col("score"), F.col("right_id"))).alias("m")
        ).select("left_id", "m.*")
    else:
        found = _expand(found, ru, rrows, "right_id")
    return _expand(found, lu, lrows, "left_id")


def _expand(found: DataFrame, reps: DataFrame, rows: DataFrame, col: str) -> DataFrame:
    """Replace a representative id by every id that carries the same vector."""
    members = reps.select(F.col("id").alias(col), *_KEY).join(rows.select(*_KEY, F.col("id").alias("_m")), _KEY).select(col, "_m")
    return found.join(members, col).drop(col).withColumnRenamed("_m", col).select("left_id", "right_id", "score")
