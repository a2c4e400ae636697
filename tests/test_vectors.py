"""Vector joins against brute force: small right sides, the two-level index, and bands of signs."""

from dataclasses import replace

import numpy as np
import pytest

from storyflow.config import DEFAULT
from storyflow.operators.vectors import VectorIndex, band_plan, banded_pairs, cosine_join, distinct_units, units
from storyflow.session import materialize

PATHS = {"small": DEFAULT, "index": replace(DEFAULT, vector_broadcast_mb=0), "blocks": replace(DEFAULT, vector_broadcast_mb=0, vector_block=16)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>")


def grouped(rng, n, groups, dim, noise):
    centres = rng.normal(size=(groups, dim))
    return centres[np.arange(n) % groups] + noise * rng.normal(size=(n, dim))


def pairs_of(left, right, t):
    out = {}
    for i, v in left:
        for j, u in right:
            if v and u and None not in v and None not in u and np.isfinite(v).all() and np.isfinite(u).all() and any(v) and any(u):
                a, b = np.array(v) / np.abs(v).max(), np.array(u) / np.abs(u).max()
                s = round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6)
                if s >= t:
                    out.setdefault(i, []).append((-s, j))
    return out


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("best", [True, False])
@pytest.mark.parametrize("t", [0.9, 0.3, -0.5])
def test_cosine_join(spark, path, best, t):
    rng = np.random.default_rng(5)
    left = [(i, v.tolist()) for i, v in enumerate(grouped(rng, 60, 6, 8, 0.3))]
    rng = np.random.default_rng(5)
    right = [(1000 + i, v.tolist()) for i, v in enumerate(grouped(rng, 90, 6, 8, 0.3))]
    right += [(2000 + i, right[0][1]) for i in range(40)] + [(3000, [0.0] * 8), (3001, None), (3002, [1.0, None] * 4), (3003, [float("nan")] * 8), (3004, [float("inf")] + [0.0] * 7)]
    right += [(3005, [x * 1e200 for x in right[1][1]]), (3006, [x * 1e-200 for x in right[1][1]])]
    left += [(500, right[0][1]), (501, None), (502, []), (503, [-x for x in right[0][1]])]
    got = cosine_join(frame(spark, left), frame(spark, right), t, PATHS[path], best_only=best).collect()
    want = pairs_of(left, right, t)
    if best:
        assert {r.left_id: r.right_id for r in got} == {i: min(c)[1] for i, c in want.items()}
    else:
        assert {(r.left_id, r.right_id) for r in got} == {(i, j) for i, c in want.items() for _, j in c}
    assert len(got) == len({(r.left_id, r.right_id) for r in got})


@pytest.mark.parametrize("path", PATHS)
def test_empty_sides(spark, path):
    some, none = frame(spark, [(1, [1.0, 2.0])]), frame(spark, [(2, None)])
    assert cosine_join(some, none, 0.5, PATHS[path]).collect() == [] and cosine_join(none, some, 0.5, PATHS[path]).collect() == []


def test_every_number_of_cells_finds_the_same(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(grouped(rng, 300, 20, 12, 0.4))]
    df, want = frame(spark, rows), {(i, j) for i, c in pairs_of(rows, rows, 0.8).items() for _, j in c}
    for cells in (1, 4, 40, 300):
        assert {(r.left_id, r.right_id) for r in cosine_join(df, df, 0.8, PATHS["index"], best_only=False, cells=cells).collect()} == want


def vectors(spark, n, groups):
    rows = [(i, v.tolist()) for i, v in enumerate(grouped(np.random.default_rng(n), n, groups, 32, 0.25))]
    return materialize(distinct_units(units(frame(spark, rows))), "vectors")


@pytest.mark.parametrize("threshold", [0.78, 0.92])
def test_pairs_of_the_index_grow_slowly(spark, threshold):
    """About sqrt(N) groups, three sizes: compared pairs stay within a fixed multiple of N**1.5."""
    compared = []
    for n in (1000, 4000, 16000):
        table = vectors(spark, n, int(n**0.5) // 2)
        compared.append(VectorIndex(table, n, 32).compared(table, threshold))
    assert all(c <= 3 * n**1.5 for c, n in zip(compared, (1000, 4000, 16000))), compared  # one group against itself is 2 N**1.5 already


@pytest.mark.parametrize("threshold", [0.78, 0.92])
def test_pairs_of_the_bands_grow_slowly(spark, threshold):
    """Many small groups, which no set of sqrt(N) pivots parts: pairs of the bands stay within a fixed multiple of N**1.5."""
    met = []
    for n in (1000, 4000, 16000):
        table = vectors(spark, n, n // 10)
        met.append(banded_pairs(table, table, n, 32, threshold).count())
    assert all(m <= 2 * n**1.5 for m, n in zip(met, (1000, 4000, 16000))), met


def test_bands_find_nearly_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(grouped(rng, 600, 200, 32, 0.3))]
    df, want = frame(spark, rows), {(i, j) for i, c in pairs_of(rows, rows, 0.85).items() for _, j in c}
    got = {(r.left_id, r.right_id) for r in cosine_join(df, df, 0.85, replace(DEFAULT, vector_mode="bands"), best_only=False).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 1000


def test_band_plan_is_subquadratic():
    for t in (0.78, 0.92):
        work = [n * n * band_plan(n, t, 0.99)[1] / 2.0 ** band_plan(n, t, 0.99)[0] for n in (1 << 14, 1 << 20, 1 << 26)]
        assert all(b <= a * 64**1.5 for a, b in zip(work, work[1:]))
