"""Training-data operators against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from storyflow.llm import bpe, common, decontamination, forest, licenses, line_dedup, ngram_jaccard, recompression, sharding, toxicity, warc

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "x")]
#: Columns whose names the operators use inside.
CLASH = "k long, d long, t long, n int, component string, score double, row string, id long"


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def table(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    for c in CLASH.split(", "):
        name, kind = c.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def texts(seed=1):
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.choice([3, 60, 90, 150])) for _ in range(40)]
    passage = prose(rnd, 70)
    rows = list(enumerate(base))
    for i in range(12):  # near copies with one word changed, and a chain of them
        w = base[1].split() + base[2].split()
        w[5 + i] = "edited"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, base[3]) for i in range(6)]  # copies
    rows += [(300 + i, prose(rnd, 20 + i) + " " + passage + "\n" + prose(rnd, 10)) for i in range(8)]  # a shared passage
    rows += [(400, None), (401, ""), (402, " \n "), (403, "one"), (404, "one two"), (405, "one"), (406, "the " * 400), (407, "x " + "the " * 120), (408, prose(rnd, 20_000)), (409, "ÉTÉ été\x0bA b c d")]
    rows.append((410, rows[-2][1] + " more"))
    rnd.shuffle(rows)
    return rows


def collected(df):
    return [tuple(r) for r in df.collect()]


# ---- 1


def test_warc(spark, tmp_path):
    pages = [(3, "u3", "<p>a</p>"), (1, "u1", "<p>a</p>"), (2, None, None), (4, "u\r\n4", ""), (None, "n", "<p>a</p>"), (9, "é", "€uro"), (7, "same", "z"), (7, "same", "z")]
    got = collected(warc.archive_round_trip(table(spark, pages, "page_id long, url string, html string")))
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(3, 8, sha("<p>a</p>"), "revisit", 1), (1, 8, sha("<p>a</p>"), "response", None), (2, 0, sha(""), "response", None), (4, 0, sha(""), "revisit", 2),
            (None, 8, sha("<p>a</p>"), "revisit", 1), (9, 6, sha("€uro"), "response", None), (7, 1, sha("z"), "response", None), (7, 1, sha("z"), "response", None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert collected(warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string"))) == []
    for kind in ("gzip", "none"):
        path = f"file://{tmp_path}/{kind}"
        warc.write_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), path, least_bytes=1, compression=kind)
        rows = spark.read.format("warc").option("payload", "false").load(path).where("record_type = 'response' and target_uri = 'u1'")
        assert [(r.record_id, r.payload, r.payload_length) for r in rows.collect()] == [("<urn:page:1>", None, 8)]
        assert spark.read.format("warc").load(path).where("record_type = 'revisit'").count() == 2  # empty payloads are below the limit


# ---- 2


AGPL, GPL_3, MIT = (max((t for label, t in licenses.TEMPLATES if label == name), key=len) for name in ("agpl-3", "gpl-3", "mit"))


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def license_shares(text):
    """Template -> largest share of it in any block, over all blocks."""
    w, out = license_words(text), {}
    for i, (_, t) in enumerate(licenses.TEMPLATES):
        t = t.split()
        own = set(t)
        if len(own) < 12:
            share = float(any(w[k : k + len(t)] == t for k in range(len(w))))
        else:
            span = math.ceil(len(t) * 1.25 - 1e-9)
            most = max((len(own & set(w[k : k + span])) for k in range(len(w))), default=0)
            share = most / len(own) if most >= math.ceil(len(own) * 0.8 - 1e-9) else 0.0
        if share:
            out[i] = share
    return out


def license_rows():
    rnd = random.Random(2)
    worn = lambda t, p: " ".join(rnd.choice(["so", "and"]) if rnd.random() < p else w for w in t.split())
    rows = [(1, "X released Under  the MIT-license. " + prose(rnd, 80) + " cc BY-nc"), (2, None), (3, ""), (4, "thunder the mit license underthe mit license"), (5, "apache license, version 2; é under the mit licensee"),
            (6, prose(rnd, 200) + " Licensed under the Apache License Version 2.0 " + prose(rnd, 300)), (7, "GNU Affero General Public License version 3"), (8, prose(rnd, 9000)), (9, "apache license version 2 apache license version 2"), (6, "again"),
            (10, "the license " * 300), (11, "all reserved seats keep their copyright and rights"), (12, MIT + " " + GPL_3), (13, AGPL), (14, GPL_3), (15, MIT.split(" the above ")[0]), (16, "Software " * 700 + MIT), (None, "copyright, All rights reserved.")]
    long = [t for _, t in licenses.TEMPLATES if len(set(t.split())) >= 12]
    return rows + [(20 + k, prose(rnd, rnd.randrange(300)) + " " + worn(rnd.choice(long), rnd.random() * 0.25) + " " + prose(rnd, rnd.randrange(60)) + " " + worn(rnd.choice(long), rnd.random() * 0.25)) for k in range(40)]


def test_licenses(spark):
    rows = license_rows()
    got = collected(licenses.licenses(table(spark, rows)))
    assert len(got) == len(rows)
    by = {(r[0], r[1]): r[1:] for r in got}
    for i, text in rows:
        w = license_words(text)
        spots = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        base, at, shares = {label for _, label in spots}, [k for k, _ in spots], license_shares(text)
        row = by[i, len(w)]
        assert row[:5] == (len(w), len(spots), min(at, default=None), max(at, default=None), ",".join(sorted(base))), i
        assert row[6] == (1.0 if spots else max(shares.values(), default=0.0)), i
        labels = set(row[5].split(",")) - {""}
        # The best match of a text always shows; others only if they match.
        assert base <= labels <= base | {licenses.TEMPLATES[t][0] for t in shares}, i
        if shares:
            assert licenses.TEMPLATES[max(shares, key=lambda t: (shares[t], len(set(licenses.TEMPLATES[t][1].split())), t))][0] in labels, i
    label = {i: row[5] for (i, _), row in by.items()}
    assert label[1] == "cc-by-nc,mit" and label[7] == "agpl-3" and label[11] == label[10] == "" and label[None] == "all-rights-reserved"
    assert label[12] == "gpl-3,mit" and label[13] == "agpl-3" and label[14] == "gpl-3" and label[15] == label[16] == "mit"
    assert by[6, 1][5] == "" and by[6, 508][5] == "apache-2"
    assert collected(licenses.licenses(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_license_blocks_equal_brute_force_over_all_blocks(spark):
    rows = [r for r in license_rows() if r[0] != 6]
    best = licenses.block_matches(table(spark, rows)).selectExpr("doc_id", "template", "overlap / size AS share").groupBy("doc_id", "template").agg({"share": "max"})
    assert {(r[0], r[1]): r[2] for r in best.collect()} == {(i, t): share for i, text in rows for t, share in license_shares(text).items()}


# ---- 3


def test_decontamination(spark):
    rnd = random.Random(3)
    items = [(i, prose(rnd, 30) + ". " + prose(rnd, 8) + ".") for i in range(20)] + [(20, None), (21, "too short"), (5, prose(rnd, 40))]
    reworded = items[2][1].split()
    for k in (3, 8, 14, 20, 26):
        reworded[k] = "changed"
    rows = [(i, prose(rnd, 300)) for i in range(60)] + [(100, prose(rnd, 120) + " " + items[0][1].upper() + " " + prose(rnd, 90)), (101, items[1][1]), (102, prose(rnd, 50) + " " + " ".join(reworded) + prose(rnd, 50)),
                                                        (103, None), (104, ""), (105, items[4][1] + " " + items[6][1]), (100, "same id"), (None, items[7][1]), (106, " ".join(items[8][1].split()[:12]) + " " + prose(rnd, 100))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collected(decontamination.contaminated(table(spark, rows), bench))
    assert {r[:2] for r in got} == {(100, 0), (101, 1), (102, 2), (105, 4), (105, 6), (None, 7)}
    parts = decontamination.contaminated(table(spark, rows), bench, decontamination.Settings(items_per_pass=6))
    assert {tuple(r)[:2] for r in parts.collect()} == {r[:2] for r in got}
    clean = decontamination.decontaminate(table(spark, rows), bench)
    assert clean.columns == table(spark, rows).columns and sorted(r.doc_id for r in clean.collect()) == [*range(60), 103, 104, 106]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert collected(decontamination.contaminated(empty, bench)) == []
    assert collected(decontamination.contaminated(table(spark, rows), spark.createDataFrame([], "item_id long, text string"))) == []


@pytest.mark.parametrize("many", [1000, 2000])
def test_decontamination_finds_every_copy_of_a_large_benchmark(spark, many):
    rnd = random.Random(many)
    items = [(i, prose(rnd, rnd.randrange(9, 40))) for i in range(many)]
    rows = [(i, prose(rnd, rnd.randrange(40)) + " " + t + " " + prose(rnd, rnd.randrange(40))) for i, t in items]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in got.where("doc_id = item_id and common >= 0.999").collect()} == set(range(many))


def test_decontamination_equals_brute_force_over_all_windows(spark):
    """Short items among outside words, and rewordings down to the rule's limits; items of few words."""
    rnd = random.Random(31)
    common = WORDS[:12]
    items = [(i, " ".join(rnd.choice(common if rnd.random() < 0.4 else WORDS) for _ in range(n)) + ". " + prose(rnd, max(2, n // 4)) + ".") for i, n in enumerate([7, 8, 9, 12, 20, 30] * 5)]
    rows = []
    for i, t in items:
        for keep in (1.0, 0.85, 0.62, 0.5):
            body, tail = t.split(". ")
            w = body.split()
            for k in rnd.sample(range(len(w)), int(len(w) * (1 - keep))):
                w[k] = f"q{rnd.randrange(9999)}"
            out = lambda n: " ".join(f"z{rnd.randrange(9999)}" for _ in range(n))
            rows.append((len(rows), out(rnd.randrange(30)) + " " + " ".join(w) + ". " + tail + " " + out(rnd.randrange(30))))
    s, want = decontamination.Settings(), set()
    plain = lambda t: decontamination.word_hashes(t)
    for i, t in items:
        item, answer = decontamination.Sequence(plain(t)), decontamination.Sequence(plain(decontamination.last_sentence(t)))
        size = 8 * (-(-item.size // 8) + 1)
        for d, text in rows:
            h = plain(text).tolist()
            for p in range(0, len(h), 8):
                window = h[max(0, p - 8) : p + size + 8]
                got = item.common(window) / item.size
                if got >= s.copied or got >= s.reworded and answer.common(window) / answer.size >= s.answered:
                    want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 60 and got == want
    few = spark.createDataFrame([(1, "Who wrote it?"), (2, "wrote it who"), (3, None), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "so, who WROTE it then"), (11, "who wrote"), (12, "it"), (None, "wrote it. Who"), (13, None)], "doc_id long, text string")
    assert {tuple(r)[:2] for r in decontamination.contaminated(docs, few).collect()} == {(10, 1), (None, 2)}


@pytest.mark.parametrize("entries", [7, 1 << 18])
def test_decontamination_products_and_windows_equal_the_dense_ones(monkeypatch, entries):
    """Only words that an item holds cost anything: sums of blocks and counts of windows are those over all words and items."""
    monkeypatch.setattr(decontamination, "ENTRIES", entries)
    rng = np.random.default_rng(5)
    dense = rng.random((40, 9)) * (rng.random((40, 9)) < 0.1)
    products = decontamination.Products(dense + 1e-14)
    assert len(products.value) == np.count_nonzero(dense)
    at = rng.integers(-1, 40, 300)
    block = np.sort(rng.integers(0, 50, 300))
    want = np.zeros((50, 9))
    np.add.at(want, block[at >= 0], dense[at[at >= 0]])
    assert np.allclose(products.of_blocks(at, block, 50), want)
    held = np.pad(rng.integers(0, 3, (9, 40)) * (rng.random((9, 40)) < 0.3), ((0, 0), (0, 1)))
    a = rng.integers(0, 250, 400)
    z, item, needed = a + rng.integers(1, 50, 400), rng.integers(0, 9, 400), rng.integers(1, 9, 9)
    whole = [sum(min(np.count_nonzero(at[x:y] == w), held[i, w]) for w in range(40)) for x, y, i in zip(a, z, item)]
    got = decontamination.windows_with_enough(at, a, z, item, held, needed)
    assert 0 < len(got) < 400 and got.tolist() == [k for k in range(400) if whole[k] >= needed[item[k]]]


def test_common_subsequence():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontamination.Sequence(np.array(a, np.uint64)).common(b) == best[-1][-1]


# ---- 4


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_ngram_jaccard(spark, n, percent):
    rows = texts()
    got = {r[0]: r[1:] for r in collected(ngram_jaccard.near_copies(table(spark, rows), ngram_jaccard.Settings(words=n, percent=percent, widespread=50)))}
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_ngram_jaccard_edges(spark):
    assert collected(ngram_jaccard.near_copies(spark.createDataFrame([], "doc_id long, text string"))) == []
    one = prose(random.Random(5), 40)
    rows = [(7, one), (7, one), (7, "other words than these here now"), (9, "other words than these here now"), (None, one), (3, None)]
    got = sorted(map(str, collected(ngram_jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")))))
    assert got == sorted(map(str, [(7, 36, 7), (7, 36, 7), (7, 2, 7), (9, 2, 7), (None, 36, 7), (3, 0, 3)]))


# ---- 5


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(6)
    values = [None, "", " ", "It's we'll <|endoftext|>x<|startoftext|> Don'T ΣΑΣ İx", "é \x1c a\x1db ​　 １２ ½", "a" * 9000, "".join(rnd.choice("thieanrs") for _ in range(30_000)), "'s's''ll", "\U0001f600é中"]
    values += ["".join(rnd.choice("abcdeinrst' .,1é中ΣİĲ́\t\x1e\x85\U0001f600") for _ in range(rnd.randrange(200))) for _ in range(150)]
    got = {r[0]: r[1:] for r in collected(bpe.encode(table(spark, list(enumerate(values))), path, ids=True))}
    for i, v in enumerate(values):
        ids = library.encode(v or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), ids), v
    assert collected(bpe.encode(spark.createDataFrame([], "doc_id long, text string"), path)) == []


def test_bpe_transducer_is_bounded_and_stable():
    model = bpe.Model(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(7)
    for letters in ("thieanrs", "ab", "a"):
        word = "".join(rnd.choice(letters) for _ in range(6000))
        machine, out, most = bpe.Transducer(model, chunk=64), [], 0
        for c in range(0, len(word), 7):
            out += machine.push(word[c : c + 7])
            most = max(most, len(machine.kept))
        out += machine.close()
        symbols = [*word[:-1], word[-1] + bpe.END]
        assert out == bpe.merge(symbols, model.ranks) and most <= 2 * model.lookahead + 64 + 7
    ids = [model.ids[t] for w in ("naïve", "café", "\U0001f600") for t in bpe.word_tokens(model, w)]
    assert bpe.plain_text(model, ids) == "naïve café \U0001f600"


def test_bpe_merges_each_word_once(monkeypatch):
    """A word is merged once, whether it stands alone or beside signs, while it is in use; short merges and words equal the plain ones."""
    model, calls, plain = bpe.Model(public_tokenizers.path("word_bpe_49k.json")), [], bpe.word_tokens
    monkeypatch.setattr(bpe, "word_tokens", lambda m, w: calls.append(w) or plain(m, w))
    encoder = bpe.Encoder(model, limit=40)
    for k in range(200):
        encoder.encode(f"lantern lantern, lantern! (lantern) été, été.. rare{chr(97 + k % 26)}{chr(97 + k // 26)}")
        assert len(encoder) + len(encoder.older) <= 40
    assert calls.count("lantern") == calls.count("été") == 1 and calls.count("rareaa") == 1
    rnd = random.Random(71)
    for _ in range(3000):
        run = "".join(rnd.choice("abcstremlvd''\".,!~|_-12éèºµß½²ĸ\x7f\x80ɏɐ中") for _ in range(rnd.randrange(1, 9)))
        assert bpe.split_words(run) == bpe.WORDS.findall(run), run
        word = "".join(rnd.choice("thieanrs") for _ in range(rnd.randrange(1, 60)))
        symbols = [*word[:-1], word[-1] + bpe.END]
        assert bpe.merge_short(list(symbols), model.ranks, model.merged) == bpe.merge(symbols, model.ranks), word


# ---- 6


def plain_ftrl(texts, s):
    """Follow-the-regularised-leader on dictionaries, one coordinate after another."""
    z, n, top = {}, {}, 1 << s.bits

    def weight(b):
        l1, l2, value = (0.0, 0.0, z.get(b, 0.0)) if b == top else (s.l1, s.l2, z.get(b, 0.0))
        return 0.0 if abs(value) <= l1 else -(value - math.copysign(l1, value)) / ((s.beta + math.sqrt(n.get(b, 0.0))) / s.alpha + l2)

    for _ in range(s.epochs):
        for text, label in texts:
            data = (text or "").encode()
            _, found = toxicity.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]), s.bits)
            found = [*sorted(set(found.tolist())), top]
            w = {b: weight(b) for b in found}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - label
            for b in found:
                rate = (math.sqrt(n.get(b, 0.0) + g * g) - math.sqrt(n.get(b, 0.0))) / s.alpha
                z[b], n[b] = z.get(b, 0.0) + g - rate * w[b], n.get(b, 0.0) + g * g
    return {b: w for b in z if (w := weight(b))}


def test_toxicity_fit_equals_plain_ftrl(spark):
    rnd = random.Random(18)
    rows = [(i, prose(rnd, rnd.randrange(40)) + " vile" * (i % 3 == 0)) for i in range(150)] + [(200, None), (201, "")]
    # An id that many rows share counts once, with its smallest text.
    rows += [(300, f"copy {k} of a vile text") for k in range(50, 0, -1)]
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(200, 0), (201, 1), (300, 1), (300, 0)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(table(spark, rows), marks)
    texts = sample.orderBy("place").collect()
    assert [r.text for r in texts if "copy" in (r.text or "")] == ["copy 1 of a vile text"] * (zlib.crc32(b"300") % 3 != 1)
    s = toxicity.Settings()
    buckets, weights = toxicity.fit(sample, s)
    want = plain_ftrl([(r.text, r.label) for r in texts], s)
    assert dict(zip(buckets.tolist(), weights.tolist())) == pytest.approx(want, rel=1e-9, abs=1e-12) and len(want) > 1


def test_toxicity(spark):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        w = prose(rnd, 60).split()
        if bad:
            w[rnd.randrange(60)] = rnd.choice(["vile", "rotten"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    labels += [(5000, 1), (5001, None), (None, 1)]
    rows += [(5000, None), (5001, ""), (None, "vile"), (5002, prose(rnd, 20_000))]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(table(spark, rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900))
    held = [(by[i].predicted, y) for i, y in labels[:900] if by[i].held_out]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    kept = toxicity.reject(table(spark, rows), marks)
    assert kept.columns == table(spark, rows).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    none = toxicity.toxicity(table(spark, rows[:3]), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [r.score for r in none] == [0.5] * 3
    assert collected(toxicity.toxicity(spark.createDataFrame([], "doc_id long, text string"), marks)) == []


# ---- 7


def test_sharding(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, None if i % 50 == 0 else prose(rnd, rnd.randrange(30)), rnd.choice(["en", "fr", None]), "src0" if i % 3 else f"src{i % 20}", rnd.randrange(900)) for i in range(500)]
    rows += rows[:5]
    docs = table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sharding.shards(docs).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(24)]
    assert sum(sizes) == 505 and max(sizes) - min(sizes) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want and {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [(r.curve, r.doc_id) for r in ordered] == sorted((r.curve, r.doc_id) for r in got)
    assert collected(sharding.shards(docs.limit(0))) == []
    sharding.write_shards(docs, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 505


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (2, 1), (4, 2)])
def test_hilbert_curve_is_connected(spark, dims, bits):
    n = 1 << bits
    cells = F.array(*[(F.floor(F.col("id") / n**k) % n).cast("int") for k in range(dims)])
    rows = sorted((r[1], tuple(r[0])) for r in spark.range(n**dims).select(cells, sharding.hilbert(cells, dims, bits)).collect())
    assert [p for p, _ in rows] == list(range(n**dims))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for (_, a), (_, b) in zip(rows, rows[1:]))


# ---- 8


def test_line_dedup(spark):
    rnd = random.Random(10)
    line, other, long_line = prose(rnd, 60), prose(rnd, 60), prose(rnd, 5000)
    edited = line.replace(" ", "  ", 3).upper()
    near = " ".join([*line.split()[:30], "zzz", *line.split()[31:]])
    rows = [(1, f"{line}\nshort line\n{other}"), (2, f"{edited}!\nshort line"), (3, None), (4, ""), (5, near), (6, prose(rnd, 60)), (7, "short line"), (8, long_line + " tail"), (9, long_line + " head"), (10, f"{other}\n{other}"), (None, other), (11, "\n\n")]
    got = set(collected(line_dedup.repeated_lines(table(spark, rows), line_dedup.Settings(distance=8, similarity=0.9))))
    assert got == {(2, 0, 1, 0), (5, 0, 1, 0), (9, 0, 8, 0), (10, 0, 1, 2), (10, 1, 1, 2), (None, 0, 1, 2)}
    kept = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(table(spark, rows), line_dedup.Settings(distance=8, similarity=0.9)).collect()}
    assert kept == {1: rows[0][1], 2: "short line", 3: None, 4: "", 6: rows[5][1], 7: "short line", 8: rows[7][1], 11: "\n\n"}
    assert collected(line_dedup.repeated_lines(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_line_dedup_finds_every_pair_within_the_distance(spark):
    """Components of lines by brute force over all pairs, for every choice of blocks."""
    rnd = random.Random(11)
    lines = [prose(rnd, 40) for _ in range(30)]
    for base in lines[:10]:
        for _ in range(8):
            w = base.split()
            w[rnd.randrange(40)] = rnd.choice(WORDS)
            lines.append(" ".join(w))
    s = line_dedup.Settings(distance=3, similarity=0.8)
    docs = spark.createDataFrame(list(enumerate(lines)), "d long, text string")
    sig = {r.d: r.sig & (1 << 64) - 1 for r in line_dedup.signed_lines(docs).collect()}
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    for a in range(len(lines)):
        for b in range(a):
            if lines[a] == lines[b] or (sig[a] ^ sig[b]).bit_count() <= 3 and distance(lines[a].split(), lines[b].split()) <= 8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r.kept_doc_id for r in line_dedup.repeated_lines(docs.withColumnRenamed("d", "doc_id"), s).collect()}
    assert got == {i: find(i) for i in range(len(lines)) if find(i) != i}
    for blocks, agree in ((4, 1), (5, 2), (6, 3)):
        keyed = {r.d: set(r.keys) for r in spark.createDataFrame([(d, v - (1 << 64) if v >> 63 else v) for d, v in sig.items()], "d long, sig long").select("d", line_dedup.block_keys(F.col("sig"), blocks, agree).alias("keys")).collect()}
        assert all(keyed[a] & keyed[b] for a in sig for b in sig if (sig[a] ^ sig[b]).bit_count() <= 3)


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_production_settings_against_brute_force_over_edit_similarity(spark):
    """Pairs of lines with up to a fifth of their words replaced, dropped or put in, half of them with few edits: all pairs of up to
    12 words are found, and at least 0.9 of those of every longer class."""
    rnd = random.Random(21)
    vocabulary = [a + b for a in WORDS for b in ("", "er", "ung", "ito")]
    word = lambda: rnd.choice(vocabulary) if rnd.random() < 0.7 else rnd.choice(["the", "of", "and", "in", "to", "is"])
    lines = []
    for n in [8, 9, 10, 11, 12] * 30 + [13, 15, 17, 20] * 50 + [22, 26, 33, 40] * 40 + [45, 60, 80, 100] * 30 + [120, 200] * 20:
        base = [word() for _ in range(n)]
        w = list(base)
        for _ in range(rnd.randrange(1, (n // 5 if rnd.random() < 0.5 else max(1, n // 12)) + 1)):
            at = rnd.randrange(len(w))
            kind = rnd.randrange(3)
            w[at : at + (kind != 1)] = [word()] if kind != 2 else []
        lines.append((base, w))
    flat = [x for pair in lines for x in pair]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(flat)], "doc_id long, text string").repartition(7)
    kept = {r.doc_id: r.kept_doc_id for r in line_dedup.repeated_lines(docs).collect()}
    found = {}
    for i, (x, y) in enumerate(lines):
        m = max(len(x), len(y))
        if min(len(x), len(y)) >= 8:
            similar = 5 * word_edits(x, y) <= m
            one = kept.get(2 * i + 1) == 2 * i
            assert similar or not one
            if similar:
                found.setdefault(next(c for c in (12, 20, 40, 100, 300) if m <= c), []).append(one)
    share = {c: sum(v) / len(v) for c, v in found.items()}
    print("SHARE", share)
    assert share[12] == 1.0 and all(v >= 0.9 for v in share.values()), share


def test_line_dedup_writes_no_pairs_of_lines_that_share_a_passage(spark, monkeypatch):
    """Lines that have four fifths less two words in common meet in all pairs: what is stored grows with the lines, not with their pairs."""
    rnd, made, keep = random.Random(24), [], common.Scratch.keep

    def counted(self, df, label):
        kept = keep(self, df, label)
        made.append((kept.df.count(), label))
        return kept

    monkeypatch.setattr(common.Scratch, "keep", counted)
    monkeypatch.setattr(line_dedup, "CROWD", 8, raising=False)
    passage = prose(rnd, 62)
    own = [" ".join(f"{rnd.choice(WORDS)}{i}" for _ in range(18)) for i in range(100)]
    rows = [(i, f"{x} {passage}") for i, x in enumerate(own)] + [(100 + i, f"{x} {passage} end") for i, x in enumerate(own[:5])]
    got = {(r.doc_id, r.kept_doc_id) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(100 + i, i) for i in range(5)}
    # The first pairs are those with neighbours and hubs; of the second a line gives at most half of CROWD under a key.
    assert [n for n, label in made if label == "pairs"][1] <= 5 * len(rows), made


def test_line_dedup_short_lines_and_scripts_without_spaces(spark):
    han, thai = "天地玄黄宇宙洪荒日月盈昃辰宿列张", "กขคงจฉชซฌญฎฏฐฑฒณ"
    rows = [(1, "Read the full article\nok then\n" + han), (2, "read the FULL article!\nok then"), (3, han[:5] + "云" + han[6:] + "\n" + thai), (4, thai + "\nRead the whole article"), (5, "云腾致雨\n\n"), (6, "云腾致雨\n\n")]
    got = set(collected(line_dedup.repeated_lines(table(spark, rows))))
    assert got == {(2, 0, 1, 0), (3, 0, 1, 2), (4, 0, 3, 1)}


def test_simhash_is_the_majority_of_bits(spark):
    rng = np.random.default_rng(3)
    rows = [(n, [int(x) for x in rng.integers(-(2**63), 2**63 - 1, n)]) for n in (1, 2, 3, 40, 62, 63, 64, 65, 126, 127, 500, 2000)]
    for n, f, sig in spark.createDataFrame(rows, "n int, f array<bigint>").select("n", "f", line_dedup.long_simhash(F.col("f"))).collect():
        assert sig & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in f) > n), n
    rnd = random.Random(16)
    docs = spark.createDataFrame([(i, "\n".join(prose(rnd, n) for n in (1, 2, 7, 64, 301, 2500))) for i in range(5)], "d long, text string")
    plain = {tuple(r)[:5]: r.sig for r in line_dedup.signed_lines(docs).collect()}
    assert len(plain) == 30 and plain == {tuple(r)[:5]: r.sig for r in line_dedup.signed_lines(docs, most=5).collect()}


def test_line_signatures_shuffle_only_texts(spark):
    """Words meet in the task that has their text: one exchange, below everything that splits a text."""
    signed = line_dedup.signed_lines(spark.createDataFrame([(1, "a b c")], "d long, text string"), 8, min_chars=12, short=12)
    plan = signed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("Generate")


def test_stored_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for d in disk.localDirs() for f in Path(d.getPath()).rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(common.CLEANUP)
    kept = common.Scratch(spark, "test").keep(spark.range(5000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert kept.df.count() == 7 and spark.conf.get(common.CLEANUP) == setting
    kept.drop()


# ---- 9


@pytest.mark.parametrize("window", [50, 5])
def test_recompression(spark, window):
    rows = texts(12)
    got = {r[0]: r[1:] for r in collected(recompression.dedup_substrings(table(spark, rows), recompression.Settings(window=window)))}
    first: dict = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        assert got[i] == (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()), i


def test_recompression_edges(spark):
    assert collected(recompression.dedup_substrings(spark.createDataFrame([], "doc_id long, text string"))) == []
    one = prose(random.Random(13), 60)
    rows = [(5, one), (5, one), (None, one), (8, "x " + one)]
    got = sorted((str(r[0]), r[2]) for r in collected(recompression.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert got == [("5", 0), ("5", 0), ("8", 60), ("None", 60)]


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(14)
    vocabulary = np.random.default_rng(1).integers(1, 2**63, 40, dtype=np.uint64)
    for _ in range(20):
        shared = [rnd.randrange(3) if rnd.random() < 0.5 else rnd.randrange(40) for _ in range(60)]
        sides = [[rnd.randrange(40) for _ in range(rnd.randrange(80))] + shared + [rnd.randrange(40) for _ in range(rnd.randrange(80))] for _ in range(2)]
        names = []
        for x in sides:
            start, name, _ = recompression.anchors(vocabulary[np.array(x)], np.array([0, len(x)]))
            names.append({tuple(x[i : i + 50]): n for i, n in zip(start.tolist(), name.tolist())})
        both = names[0].keys() & names[1].keys()
        assert len(both) >= 11 and all(names[0][k] == names[1][k] for k in both)


# ---- 10


def test_forest_labels_of_any_type_and_components_of_any_size(spark):
    v = [1.0, 2.0, 3.0, -1.0]
    times = lambda k: [k * x for x in v]
    rows = [(1, times(1e200), "a"), (2, times(1.0), "a"), (3, times(1e-200), "a"), (4, times(1e307), "b"), (5, times(5e-324), "b"), (6, v, None), (7, v, ""), (8, times(3.0), "")]
    got = {r[0]: r[1:] for r in collected(forest.near_vectors(table(spark, rows, "vec_id long, embedding array<double>, label string")))}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True), 7: (1, 7, True), 8: (1, 7, False)}
    far = [(1, v, 2**40), (2, v, 2**40), (3, v, 2**40 + 2**32), (4, v, 0)]
    got = {r[0]: r[1:] for r in collected(forest.near_vectors(table(spark, far, "vec_id long, embedding array<double>, label long")))}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True)}


def vectors(seed, groups):
    rng = np.random.default_rng(seed)
    out = []
    for size, noise in groups:
        centre = rng.standard_normal(16)
        out += [(centre + noise * rng.standard_normal(16)).astype(np.float32).tolist() for _ in range(size)]
    return out


@pytest.mark.parametrize("noise", [0.02, 0.16])
def test_forest(spark, noise):
    base = vectors(15, [(1, 0)] * 150 + [(2, 0.05)] * 20 + [(90, noise)])
    rows = [(i, v, i % 2 if i < 190 else 1) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(4)]  # copies
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] + [1.0] * 15, 1), (2004, rows[0][1], None), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (None, rows[0][1], 0)]
    s = forest.Settings(leaf=32, block=40)
    got = {r[0]: r[1:] for r in collected(forest.near_vectors(table(spark, rows, "vec_id long, embedding array<float>, label int"), s))}
    good = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}
    order = lambda i: (i is None, i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, v, y) in enumerate(good):
        for j, w, z in good[:a]:
            if y == z and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i] += 1
                links[j] += 1
                x, y2 = sorted((find(i), find(j)), key=order)
                root[y2] = x
    assert len(got) == len(links)
    assert all(got[i][0] <= links[i] for i in links)
    assert sum(v[0] for v in got.values()) >= 0.97 * sum(links.values())
    if noise < 0.1:
        assert got == {i: (links[i], find(i), i == find(i)) for i in links}
    assert collected(forest.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))) == []


def test_forest_links_what_no_direction_parts(spark):
    """Scaled copies beyond two leaves are one component; so are two directions that every tree leaves together."""
    v = np.random.default_rng(5).standard_normal(16)
    rows = [(i, (v * (i + 1)).tolist(), 1) for i in range(700)]
    got = {r[0]: r[1:] for r in collected(forest.near_vectors(table(spark, rows, "vec_id long, embedding array<double>, label int")))}
    assert got == {i: (699, 0, i == 0) for i in range(700)}
    x = np.random.default_rng(6).standard_normal((90, 4))
    placed = spark.createDataFrame([(1, 4, 0, 1, 90, k) for k in range(90)], "label int, dim int, tree int, node long, n long, k long")
    near = spark.createDataFrame([(k, w.tolist()) for k, w in enumerate(x)], "k long, v array<double>")
    s, root = forest.Settings(leaf=16), list(range(90))
    scratch = forest.Scratch(spark, "test")
    found = {r.id: r.component for r in forest.components(scratch, forest.leaf_edges(scratch, placed, near, s)).df.collect()}
    want = forest.roots(forest.cosines(x, x) >= s.cosine).tolist()
    assert [found.get(k, k) for k in root] == want and len(set(want)) < 90


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = table(spark, [(9_000_001, None), (9_000_002, "")], "doc_id long, text string").select("doc_id", "text").join(spark.range(0).selectExpr("'en' lang", "'s' source", "0L n_chars"), how="left").select("doc_id", "text", "lang", "source", "n_chars")
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(docs)
    columns = docs.columns
    before = {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before and {9_000_001, 9_000_002} <= set(ids)
        assert docs.columns == columns or i == 4
        before = set(ids)
    assert {"n_tokens", "token_ids"} <= set(docs.columns)
