"""Language identification, resampling and periodic runs against plain restatements, with nulls, empty texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from storyflow.llm import language, periodic, resampling
from storyflow.llm.catalog import op11_language, op12_resampling, op13_periodic_runs
from tests.llm.test_operators import prose, table, texts

SMALL = "/root/testdata/sf0.001"


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def collected(df):
    return by_id([tuple(r) for r in df.collect()])


# ---- languages


def plain_vector(text, s):
    """The sum over all runs of three of the products of rolled letter vectors, run by run."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    kept = " " + re.sub(" +", " ", kept).strip() + " "
    v = {c: language.letter_vectors(np.array([ord(c)]), s)[0].astype(int) for c in set(kept)}
    return sum((np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(kept, kept[1:], kept[2:])), np.zeros(s.dimensions, int))


@pytest.mark.parametrize("piece, block", [(1 << 20, 2048), (7, 3)])
def test_text_vectors_equal_the_plain_sum(monkeypatch, piece, block):
    monkeypatch.setattr(language, "PIECE", piece)
    monkeypatch.setattr(language, "BLOCK", block)
    s = language.Settings(dimensions=200)
    rows = ["Été, là-bas!", "", "a", "x y", "  ...", "das ist Gut. das", "Привет мир", "日本 語", "ab" * 50]
    raw = [r.lower().encode() for r in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    found = language.bundled(*language.counted(data, offsets), len(rows) + 1, s)[: len(rows)]
    for row, v in zip(rows, found):
        assert (plain_vector(row, s) if any(map(str.isalpha, row)) else np.zeros(s.dimensions)).tolist() == v.tolist(), row


def test_letter_vectors_are_near_orthogonal_and_fixed():
    s = language.Settings()
    v = language.letter_vectors(np.arange(97, 123), s).astype(int)
    products = v @ v.T - s.dimensions * np.eye(26, dtype=int)
    assert np.abs(products).max() < 6 * math.sqrt(s.dimensions)
    assert (language.letter_vectors(np.array([99]), s)[0] == v[2]).all()


def language_rows(seed=3):
    rnd = random.Random(seed)
    words = {"xx": ["bar", "lon", "mek", "tas", "rin"], "yy": ["öd", "ßch", "ung", "keit", "ver"], "zz": ["çion", "ño", "que", "ado", "lla"]}
    rows = [(i, " ".join("".join(rnd.choices(words[name], k=rnd.choice([1, 2]))) for _ in range(rnd.choice([1, 3, 40]))), name) for i, name in enumerate(rnd.choices(list(words), k=240))]
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 . 3", "zz"), (1003, "barlon BARTAS mek", None), (None, "keitung ver öd", "yy"), (5, rows[5][1], rows[5][2]), (1004, " ".join(["quelado"] * 60_000), None)]
    return rows


def test_languages_on_small_rows(spark):
    rows = language_rows()
    df = table(spark, rows, "doc_id long, text string, lang string").drop("score").withColumnRenamed("row", "lang_pred")
    got = [tuple(r) for r in language.languages(df.repartition(3)).collect()]
    assert len(got) == len(rows)
    found = {r[0]: r for r in got}
    for d, held, pred, score in got:
        assert held == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= score <= 1
    assert all(found[d][2:] == ("und", 0.0) for d in (1000, 1001, 1002))
    assert found[1003][2] == "xx" and found[None][2] == "yy" and found[1004][2] == "zz"
    right = [found[d][2] == name for d, text, name in rows if d is not None and d < 240]
    assert sum(right) >= 0.98 * len(right)
    # The same rows in other partitions give the same result.
    assert by_id(got) == collected(language.languages(df.repartition(7)))


def test_held_out_rows_teach_nothing(spark):
    rows = language_rows()
    other = [(d, t, "qq" if d is not None and zlib.crc32(str(d).encode()) % 3 == 1 else name) for d, t, name in rows]
    schema = "doc_id long, text string, lang string"
    assert collected(language.languages(spark.createDataFrame(rows, schema))) == collected(language.languages(spark.createDataFrame(other, schema)))


def test_languages_without_any_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert collected(language.languages(spark.createDataFrame([], schema))) == []
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    assert collected(language.languages(spark.createDataFrame([(1, "some words", None), (2, None, "en")], schema))) == [(1, held(1), "und", 0.0), (2, held(2), "und", 0.0)]
    one = collected(language.languages(spark.createDataFrame([(3, "some words", "en"), (4, "other words", None)], schema)))
    assert [(r[0], r[2]) for r in one] == [(3, "en" if not held(3) else "und"), (4, "en" if not held(3) else "und")]


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op11_language(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert len(held) > 250 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


# ---- resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_resampling(docs, target, min_words=20, percent=25, seed=7, buckets=10_000):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = WORD.findall(low)
        return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [a + " " + b for a, b in zip(w, w[1:])]]

    each = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for (d, _), (n, f) in zip(docs, each):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return [(r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("pivots, percent, min_words", [(32, 25, 20), (2, 60, 1), (3, 100, 2)])
def test_resampling_equals_the_plain_rule(spark, pivots, percent, min_words):
    docs = texts() + [(None, "a b " * 30), (3000, "a b " * 30), (3000, "a b " * 30), (3000, "a b " * 30), (3001, "long" * 5000 + " " + "Ünï" * 40 + " x" * 30), (3002, "A-b\x7fc 9Z")]
    target = [prose(random.Random(9), 60), None, "", "a b a b"]
    df = table(spark, docs).withColumnRenamed("d", "rank").repartition(5)
    s = resampling.Settings(pivots=pivots, percent=percent, min_words=min_words)
    got = [tuple(r) for r in resampling.resampled(df, spark.createDataFrame([(x,) for x in target], "text string"), s).collect()]
    assert order(got) == order(plain_resampling(docs, target, min_words, percent))


def test_resampling_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    assert resampling.resampled(none, target).collect() == []
    assert order([tuple(r) for r in resampling.resampled(some, target).collect()]) == order(plain_resampling([(1, "a b"), (2, None)], []))


def test_resampling_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert order([tuple(r) for r in op12_resampling(spark, SMALL).collect()]) == order(plain_resampling(docs, target))


# ---- periodic runs


def plain_runs(w, least=24, times=3):
    n, found = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i + q - a >= max(least, times * q):
                found.setdefault((a, i + q), q)
    return sorted((a, e - a, q) for (a, e), q in found.items())


def plain_row(d, text, rewrite=True):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(d).encode()), len(w)
    if rewrite and d is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return (d, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


@pytest.mark.parametrize("least", [4, 24])
def test_runs_equal_brute_force(least, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 50)
    rnd, s = random.Random(least), periodic.Settings(min_words=least)
    for _ in range(400):
        parts, size = [], rnd.choice([1, 2, 3])
        for _ in range(rnd.choice([1, 3])):
            n, letters = rnd.choice([5, 24, 30, 60, 200]), rnd.choice([1, 2, 3, 5])
            w = [rnd.randrange(letters) for _ in range(n)]
            for _ in range(rnd.randrange(3)):
                p, b, m = rnd.randrange(1, 12), rnd.randrange(n), rnd.randrange(n)
                for i in range(b + p, min(n, b + m)):
                    w[i] = w[i - p]
            parts.append(w)
        part = np.repeat(np.arange(len(parts)), [len(w) for w in parts])
        # Parts have numbers of their own, as documents do.
        start, end, period = periodic.runs_of(np.concatenate([np.array(w) + 10 * i for i, w in enumerate(parts)]), part, s)
        at = np.cumsum([0] + [len(w) for w in parts])
        expected = sorted((int(at[i]) + a, m, q) for i, w in enumerate(parts) for a, m, q in plain_runs(w, least))
        assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist())) == expected, parts


def test_fibonacci_and_thue_morse_words():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(512)]
    for w in (b, thue, [0] * 400, [0, 1] * 150 + [2] + [0, 1] * 150, list(range(90)) * 4 + list(range(40))):
        s = periodic.Settings(min_words=6)
        start, end, period = periodic.runs_of(np.array(w), np.zeros(len(w), np.int64), s)
        assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist())) == plain_runs(w, 6)


def run_rows(seed=4):
    rnd = random.Random(seed)
    rows = [(i, prose(rnd, rnd.choice([0, 1, 5, 30, 90, 300]))) for i in range(120)]
    for i in range(40):
        p = rnd.choice([1, 2, 5, 9, 30])
        unit = prose(rnd, p)
        rows.append((500 + i, prose(rnd, rnd.choice([0, 7])) + " \n" + " ".join([unit] * rnd.choice([2, 3, 9, 30])) + "\t" + prose(rnd, rnd.choice([0, 3, 40])) + " " + " ".join([unit] * rnd.choice([0, 4]))))
    words = prose(rnd, 2000)
    return rows + [(900, None), (901, ""), (902, " \n\x0b "), (None, "na " * 50), (904, "na " * 30_000), (905, f"{words} {words} {words} x"), (500, rows[120][1]), (906, "ÉTÉ \x00b " * 20)]


def test_periodic_runs_equal_the_plain_rule(spark):
    rows = run_rows()
    df = table(spark, rows).withColumnRenamed("id", "length").repartition(3)
    expected = by_id([plain_row(*r) for r in rows if r[0] not in (904, 905)])
    got = collected(periodic.periodic_runs(df))
    assert [r for r in got if r[0] not in (904, 905)] == expected
    assert [r[1:6] for r in collected(periodic.periodic_runs(df, rewrite=None)) if r[0] in (904, 905)] == [(1, 0, 30_000, 1, 30_000_000), (1, 0, 6_000, 2_000, 3000)]


def test_periodic_runs_of_an_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_periodic_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if len(r.text) < 12_000]
    small = {d for d, _ in docs}
    assert [r for r in collected(op13_periodic_runs(spark, SMALL)) if r[0] in small] == by_id([plain_row(*r) for r in docs])
