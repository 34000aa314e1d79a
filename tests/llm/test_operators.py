"""Each corpus operator against a plain account of the same on small tables, with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import bitslice_topk, exact_dedup, license_scan, mixing, near_dup, packing, quality, sharding, substring_dedup, url_filter

DOCS = "doc_id long, text string, source string, lang string, n_chars long"
#: Extra columns with the names that operators use themselves.
CLASH = ["digest", "keep_id", "row", "slot", "shard", "size", "bucket", "id", "comp", "score", "words", "text_a", "block", "leaf", "n", "cell", "rank"]
D = "/root/testdata/sf0.01"


def frame(spark, texts, sources=None):
    rows = [(i, t, (sources or ["s"] * len(texts))[i], "en", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# -- 1


def removed_by_hand(rows, width):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(ws)
        for s in range(len(ws) - width + 1):
            w = tuple(ws[s : s + width])
            if w in seen:
                gone[s : s + width] = [True] * width
            seen.add(w)
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out[doc] = (len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block_bytes", [None, 700])
def test_substring_dedup(spark, block_bytes):
    shared, base = words(40, 1), words(120, 2)
    texts = [" ".join(base), "\t".join(base[:50]) + "\n" + " ".join(words(30, 3)), None, "", " ".join(words(10, 4) + shared + words(10, 5)), " ".join(shared + words(5, 6) + shared), "é " * 60, " \x0b ".join(words(19, 7)), " ".join(base), "a\u00a0b " * 25]
    df = frame(spark, texts)
    got = substring_dedup.remove_repeats(df, 20, block_bytes=block_bytes, range_windows=64).collect()
    want = removed_by_hand(enumerate(texts), 20)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(x.end - x.start for x in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))
    assert substring_dedup.remove_repeats(empty(spark), 20).count() == 0


def test_substring_dedup_repeated_rows_and_null_ids(spark):
    t = " ".join(words(25, 8))
    df = spark.createDataFrame([(5, t), (5, t), (None, t)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.remove_repeats(df, 20).collect()) == [(-1, 0), (5, 25), (5, 25)]


def test_runs_round_trip():
    for n in (1, 2, 1000):
        r = np.random.default_rng(n)
        one, two = np.unique(r.integers(0, 2**61 - 1, n, dtype=np.uint64)), r.integers(0, 2**31 - 1, n, dtype=np.uint32)
        back = substring_dedup.unpack(substring_dedup.pack(one, two))
        assert (back[0] == one).all() and (back[1] == two).all()


def complements(n):
    """Two words of letters a and b, each the other's complement, that polynomials modulo a power of two take for equal."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a[:n], a[:n].translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_substring_dedup_of_complementary_words(spark, n):
    a, b = complements(n)
    common = " ".join(words(19, 77))
    texts = [f"{common} {a}", f"{common} {b}", f"{common} {a}"]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, texts), 20).collect()}
    assert got == removed_by_hand(enumerate(texts), 20) and [got[i][1] for i in range(3)] == [0, 0, 20]


def test_substring_dedup_of_two_words_in_turn(spark):
    """Windows as long as the words above, over two words."""
    a, b = ([f"w{c}" for c in x] for x in complements(2048))
    texts = [" ".join(a), " ".join(b), " ".join(a[:1500])]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, texts), 1024, block_bytes=4000).collect()}
    assert got == removed_by_hand(enumerate(texts), 1024)


def test_substring_dedup_of_a_very_long_text_and_many_blocks(spark):
    long = words(150_000, 41, 10**6)
    texts = [" ".join(words(60, 42 + i, 10**6)) for i in range(30)] + [" ".join(long)] + [" ".join(long[i : i + 200]) for i in range(0, 100_000, 10_000)] + ["y" * 1_500_000 + " z"] * 2
    for block_bytes in (None, 20_000):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, texts), 20, block_bytes=block_bytes, range_windows=4096).collect()}
        assert got == removed_by_hand(enumerate(texts), 20)


def test_substring_dedup_of_many_rows_of_one_id(spark):
    """Blocks cut within an id, by the hash of the text; the first of a passage's rows keeps it, whichever row that is."""
    shared = " ".join(words(30, 50, 10**6))
    rows = [(i, " ".join(words(50, 51 + j, 10**6)) + " " + shared) for i in (None, 7) for j in range(60)] + [(3, "few"), (9, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cuts = substring_dedup.cuts_by_bytes(df.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.lit(9000).alias("n_bytes")), 9)
    assert len(set(cuts.tolist())) < len(cuts)
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(df, 20, block_bytes=3000).collect())
    # Texts 0 to 59 stand under both ids, and the shared passage once in all.
    assert got == {(None, 0): 1, (None, 30): 59, (7, 80): 60, (3, 0): 1, (9, 30): 1}


# -- 2


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").toPandas()
    test = got[got.held_out]
    assert len(test) > 40 and (test.predicted == test.quality).mean() > 0.97
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())


def test_quality_edges(spark):
    rows = [(i, " ".join(words(50, i)) if i % 2 else "a " * 40) for i in range(60)] + [(None, "x"), (60, None), (61, ""), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "row", "x", "y")})
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.predicted == 1) == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and r.doc_id < 60)
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 60} == set(range(1, 60, 2))
    assert all(r.score == 0.5 for r in quality.score_quality(docs, labels.limit(0)).collect())
    assert quality.score_quality(empty(spark), labels).count() == 0 and quality.keep_quality(empty(spark), labels).count() == 0


def statistics_by_hand(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    n, bytes_ = len(ws), len(text.encode())
    one, size = n + 20, bytes_ + 120
    per_100 = lambda k, of: math.log1p(100 * k / of)
    of = lambda chars: sum(text.count(c) for c in chars)
    seen, lines = Counter(ws), [x for x in text.encode().split(b"\n") if len(x) > 20]
    return [
        math.log1p(n), math.log1p(sum(len(w.encode()) for w in ws) / one), per_100(of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size), per_100(of("0123456789"), size), per_100(of("#$%&*@^~+=<>{}[]\\_`"), one), per_100(of("|"), one), per_100(of("!?"), one),
        per_100(of("."), one), per_100(of(","), one), per_100(of(":;'\"()-/"), one), per_100(sum(ord(c) > 127 for c in text), size), math.log1p(n / (text.count("\n") + 1)), per_100(sum(a == b for a, b in zip(ws, ws[1:], strict=False)), one),
        math.log1p(len(seen)) - 0.8 * math.log1p(n), per_100(max(seen.values(), default=0), one), per_100(1 - len(set(lines)) / len(lines), 1) if len(lines) > 1 else 0.0,
    ]


def test_quality_statistics_and_fit_by_hand(spark):
    """The whole query against a plain account of it: statistics, class moments, shrinkage, inverse and determinant."""
    texts = ["", "a", "É é É é", "One two two. two!\n" * 5, "line of more than twenty bytes\n" * 3 + "x", "#$ | 12,34 (a) - b", "  \t\n ", "w " * 3000]
    assert np.allclose(quality.statistics(pa.array(texts)), [statistics_by_hand(t) for t in texts])
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    x = {r.doc_id: np.array(statistics_by_hand(r.text or "")) for r in docs.collect()}
    y = [(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    own = [np.array([x[i] for i, c in y if c == k]) for k in (0, 1)]
    cov = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(len(o) / len(y) * c for o, c in zip(own, cov, strict=True))

    def density(v, k):
        s = 0.8 * cov[k] + 0.2 * pooled
        s = 0.98 * s + 0.02 * np.trace(s) / len(s) * np.eye(len(s)) + 1e-9 * np.eye(len(s))
        d = v - own[k].mean(0)
        return math.log(len(own[k]) / len(y)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * d @ np.linalg.inv(s) @ d

    for r in quality.score_quality(docs, labels).collect():
        odds = density(x[r.doc_id], 1) - density(x[r.doc_id], 0)
        assert math.isclose(r.score, 1 / (1 + math.exp(min(700, max(-700, -odds)))), abs_tol=1e-5), r


def test_quality_density_by_hand():
    r = np.random.default_rng(0)
    a, b = r.normal(0, 1, (200, 3)), r.normal(1, 2, (300, 3))
    both = (a, b)
    m = quality.discriminant(np.array([200.0, 300.0]), np.stack([x.sum(0) for x in both]), np.stack([x.T @ x for x in both]), 0.2, 0.02)
    x = r.normal(0, 2, (50, 3))
    cov = [np.cov(y.T, bias=True) for y in both]
    pooled = 0.4 * cov[0] + 0.6 * cov[1]
    log = []
    for k in (0, 1):
        s = 0.8 * cov[k] + 0.2 * pooled
        s = 0.98 * s + 0.02 * np.trace(s) / 3 * np.eye(3)
        d = x - both[k].mean(0)
        log.append(math.log((0.4, 0.6)[k]) - 0.5 * math.log(np.linalg.det(s)) - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(s), d))
    assert np.allclose(m.scores(x), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-6)


# -- 3


def scanned_by_hand(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line, base, places = " " + "".join(w + " " for w in ws), set(), []
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        at = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        places += at
        if at:
            base.add(label)
    hits = []
    for i, r in enumerate(license_scan.RULES):
        if f" {r.keyword}" in line:
            for m in re.finditer(f" (?:{r.pattern})(?= )", line):
                first = line[: m.start()].count(" ")
                hits.append((first, first + m[0].count(" "), r.priority, i, r))
    stay = [h for h in hits if not any(g is not h and g[0] <= h[0] and g[1] >= h[1] and g[2] >= h[2] and ((g[0], g[1]) != (h[0], h[1]) or (-g[2], g[3]) < (-h[2], h[3])) for g in hits)]
    best = {}
    for h in stay:
        best[h[4].label] = max(best.get(h[4].label, 0), h[4].confidence)
    score = 1 - math.prod(1 - c for c in best.values())
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(best))), round(score, 9)


def test_license_scan(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "GNU General Public License v3 or MIT License. cc by cc by", "SPDX-License-Identifier: GPL-2.0-or-later", None, "", "....", "no licence here: MIT", "CC BY-NC 4.0 and cc-by", "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software; all rights reserved.", "é MIT Licenseé mit license", "mit license " * 50, "released under the BSD 3-Clause License, the Artistic License 2.0 and the zlib license", "MIT License\u00a0x", "İ apache license",
    ]
    got = license_scan.scan_licenses(frame(spark, texts + ["mit license"] * 2)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = (texts + ["mit license"] * 2)[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) == scanned_by_hand(text), text
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_license_scan_on_the_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    want = {r.doc_id: scanned_by_hand(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in license_scan.scan_licenses(docs).collect()}
    assert got == want and sum(x[1] > 0 for x in want.values()) > 5


def test_license_rules():
    rules = license_scan.RULES
    assert len(rules) >= 250 and len({(r.label, r.pattern) for r in rules}) == len(rules)
    for r in rules:
        re.compile(r.pattern)
        assert re.fullmatch("[a-z0-9]+", r.keyword)


# -- 4


def test_top_k(spark):
    r = np.random.default_rng(3)
    v = r.normal(0, 0.3, (230, 7)).astype(np.float32)
    v[10:40] = v[9]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1050, [float("nan")] * 7), (1100, [1.0]), (1101, [None] * 7), (1150, [float("inf")] * 7), (None, v[0].tolist()), (50, v[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("rank", "q", "v", "block", "score")})
    got = defaultdict(list)
    for x in bitslice_topk.top_k(df, k=5, every=50, block_rows=64, query_chunk=2).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.score, x.vec_id))
    q = {i: np.floor(256 * v[i].astype(np.float64)).astype(int) for i in range(230)}
    ids = [*range(230), 50]
    for i in range(0, 230, 50):
        want = sorted(((int(q[i] @ q[j]), j) for j in ids if j != i), key=lambda t: (-t[0], t[1]))[:5]
        assert got[i] == want
    assert set(got) == set(range(0, 230, 50))


def test_top_k_many_rows_of_one_id(spark):
    """More vectors under one id than a chunk holds, and lengths of a minority: every row is asked, and finds its own length."""
    r = np.random.default_rng(8)
    rows = [(50, x.tolist()) for x in r.normal(0, 1, (11, 4))] + [(i, x.tolist()) for i, x in enumerate(r.normal(0, 1, (30, 4)), 1)] + [(i, x.tolist()) for i, x in enumerate(r.normal(0, 1, (4, 2)), 100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in bitslice_topk.top_k(df, k=3, query_chunk=2, block_rows=8).collect())
    want = []
    for i, v in rows:
        if i % 50 == 0:
            q = lambda x: np.floor(256 * np.array(x)).astype(int)
            found = sorted(((int(q(v) @ q(w)), j) for j, w in rows if j != i and len(w) == len(v)), key=lambda t: (-t[0], t[1]))[:3]
            want += [(i, n + 1, j, score) for n, (score, j) in enumerate(found)]
    assert got == sorted(want)


def test_top_k_large_components(spark):
    """Exact as long as scores fit 64 bits, and saturated beyond."""
    big = [[1e15, -3.0], [1e5, 2.5], [-1e300, 0.0], [1e300, 1.0], [2.0, 1e6]]
    df = spark.createDataFrame([(50 * (i == 0) + i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>")
    got = [(x.rank, x.vec_id, x.score) for x in bitslice_topk.top_k(df).where("query_id = 50").orderBy("rank").collect()]
    most, q = 2**63 - 1, lambda x: max(-(2**63), min(2**63 - 1, math.floor(256 * x)))
    score = {i: max(-most - 1, min(most, sum(q(a) * q(b) for a, b in zip(big[0], big[i], strict=True)))) for i in range(1, 5)}
    assert got == [(n + 1, i, score[i]) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i)))]


def test_top_k_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, -0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in bitslice_topk.top_k(two).collect()] == [(0, 1, 1, 256 * 128)]
    assert bitslice_topk.top_k(two.limit(0)).count() == 0
    assert bitslice_topk.top_k(two.where("vec_id = 1")).count() == 0


# -- 5


def test_sharding(spark):
    texts = [None if i % 9 == 0 else "é" * (i % 7) for i in range(2003)]
    docs = frame(spark, texts)
    run = lambda: sorted(tuple(r) for r in sharding.shuffle_into_shards(sharding.described(docs), "doc_id", ("size", "text_crc32"), 40, cell_rows=100, piece_rows=20).collect())
    got = run()
    assert got == run() and len(got) == len(texts)
    by = defaultdict(list)
    for doc, size, crc, shard, slot in got:
        raw = (texts[doc] or "").encode()
        assert (size, crc) == (len(raw) + 16, zlib.crc32(raw))
        by[shard].append(slot)
    assert sorted(map(len, by.values())) == [50] * 37 + [51] * 3 and all(sorted(s) == list(range(len(s))) for s in by.values())
    # Uniform: neighbours in id are not neighbours in place.
    place = {doc: (shard, slot) for doc, _, _, shard, slot in got}
    assert abs(sum(place[i][0] == place[i + 1][0] for i in range(2002)) / 2002 - 1 / 40) < 0.02


def test_sharding_edges(spark):
    assert sharding.shard_documents(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, None)], "doc_id long, text string")
    got = sharding.shard_documents(rows, shards=3).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [1, 1, 2] and {r.law for r in got} == {"rows"}


def test_matrix_margins():
    rows, capacity = np.array([5, 0, 17, 3, 25]), np.array([10, 20, 15, 5])
    matrix = np.array([sharding.matrix_row(i, rows, capacity, 7) for i in range(5)])
    assert (matrix.sum(1) == rows).all() and (matrix.sum(0) == capacity).all()
    mean = np.mean([sharding.matrix_row(2, rows, capacity, s) for s in range(400)], axis=0)
    assert np.allclose(mean, 17 * capacity / 50, atol=0.4)
    big = sharding.split_counts(np.random.default_rng(0), np.array([2 * 10**9, 10**9]), 10**9)
    assert big.sum() == 10**9 and abs(big[0] - 2e9 / 3) < 1e6


def test_draws_beyond_the_generator_have_the_right_moments():
    capacity, draw = np.array([2 * 10**9, 7 * 10**8, 3 * 10**8]), 9 * 10**8
    r, total = np.random.default_rng(1), int(capacity.sum())
    got = np.array([sharding.split_counts(r, capacity, draw) for _ in range(1500)], float)
    assert (got.sum(1) == draw).all()
    share = capacity / total
    var = draw * share * (1 - share) * (total - draw) / (total - 1)
    assert np.allclose(got.mean(0), draw * share, atol=5 * np.sqrt(var / 1500).max()) and np.allclose(got.var(0), var, rtol=0.2)


def test_sharding_by_hand(spark):
    """The same matrix, and the two permutations, on plain lists."""
    docs = frame(spark, [f"t{i % 50}" for i in range(700)])
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(sharding.described(docs), "doc_id", ("size", "text_crc32"), 7, cell_rows=60, piece_rows=30).collect()}
    described = sharding.described(docs)
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "size", "text_crc32")]
    tie = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(("doc_id", "size", "text_crc32"))])
    marked = described.select("doc_id", F.pmod(F.xxhash64(F.lit(20), *text), F.lit(12)).alias("cell"), F.xxhash64(F.lit(21), *text).alias("one"), F.xxhash64(F.lit(22), tie).alias("two")).collect()
    cells = defaultdict(list)
    for m in marked:
        cells[m.cell].append(m)
    shard, first, capacity = sharding.destinations(700, 7, 30)
    sizes, arrived = np.array([len(cells[i]) for i in range(12)]), defaultdict(list)
    for c in range(12):
        rows = sorted(cells[c], key=lambda m: (m.one, m.doc_id))
        for piece, n in enumerate(sharding.matrix_row(c, sizes, capacity, 20).tolist()):
            arrived[piece] += [rows.pop(0) for _ in range(n)]
    want = {m.doc_id: (int(shard[p]), int(first[p]) + i) for p, ms in arrived.items() for i, m in enumerate(sorted(ms, key=lambda m: (m.two, m.doc_id)))}
    assert got == want


def test_sharding_with_many_rows_of_one_id(spark):
    docs = spark.range(900).selectExpr("IF(id % 3 = 0, null, id) AS doc_id", "repeat('x', CAST(id AS int)) AS text")
    got = sharding.shuffle_into_shards(sharding.described(docs), "doc_id", ("size", "text_crc32"), 9, cell_rows=100, piece_rows=50).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [100] * 9 and len({(r.shard, r.slot) for r in got}) == 900


@pytest.mark.parametrize(("capacity", "draw"), [([3, 5, 4], 4), ([1, 2, 9], 8), ([150, 60, 90], 140), ([150, 60, 90], 200)])
def test_large_splits_follow_the_hypergeometric_law(monkeypatch, capacity, draw):
    """As for populations that numpy's generator does not take."""
    monkeypatch.setattr(sharding, "_EXACT", 0)
    r, total, n = np.random.default_rng(3), sum(capacity), 6000
    got = np.array([sharding.split_counts(r, np.array(capacity), draw) for _ in range(n)])
    assert (got.sum(1) == draw).all() and (got >= 0).all() and (got <= capacity).all()
    for i, c in enumerate(capacity):
        for x in range(c + 1):
            p = math.comb(c, x) * math.comb(total - c, draw - x) / math.comb(total, draw) if x <= draw else 0
            assert abs((got[:, i] == x).mean() - p) <= 5 * math.sqrt(p * (1 - p) / n) + 1e-3


# -- 6


def near_by_hand(texts, k, percent):
    sets = {}
    for i, t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))} if ws else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark):
    r, texts = random.Random(5), []
    for g in range(25):
        base = words(r.choice([3, 8, 30, 120]), 100 + g, 5000)
        texts.append(" ".join(base))
        for _ in range(r.randrange(6)):
            copy = list(base)
            for _ in range(r.randrange(3)):
                copy[r.randrange(len(copy))] = "changed"
            texts.append((" " if r.random() < 0.5 else "\n").join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    chain = words(200, 9, 10**6)  # each next one is near the one before, the ends are far apart
    texts += [" ".join(chain[4 * i : 4 * i + 100]) for i in range(12)]
    texts += [None, "", " ", "One", "one", "one two", "Ä b c d", "ä b c d"] + ["same text of six words here"] * 40
    r.shuffle(texts)
    got = near_dup.near_duplicates(frame(spark, texts), k=4, percent=80, block=8).collect()
    want = near_by_hand(list(enumerate(texts)), 4, 80)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_near_duplicates_without_help_from_stars(spark):
    """A big group around many hubs, and look-alikes below the threshold that share its buckets."""
    r, base, texts = random.Random(6), words(60, 11, 10**6), []
    for i in range(150):
        copy = list(base)
        for _ in range(1 if i % 3 else 3):
            copy[r.randrange(60)] = f"c{i}"
        texts.append(" ".join(copy))
    got = near_dup.near_duplicates(frame(spark, texts), k=4, percent=80, block=16).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == near_by_hand(list(enumerate(texts)), 4, 80)


def test_near_duplicates_edges(spark):
    assert near_dup.near_duplicates(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string").withColumn("id", F.lit(1))
    got = sorted(((x.doc_id or -1), x.component_id, x.kept) for x in near_dup.near_duplicates(df).collect())
    assert got == [(-1, None, True), (2, 2, True), (2, 2, True), (7, 2, False)]
    assert sorted(x.doc_id or -1 for x in near_dup.drop_near_duplicates(df).collect()) == [-1, 2, 2]


def test_near_duplicates_null_ids_have_their_set_size(spark):
    rows = [(None, "a b c d e f"), (None, None), (None, "x"), (2, "a b c d e f")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, n_shingles={n}, component_id={i}, kept=True)" for i, n in ((None, 2), (None, 0), (None, 1), (2, 2)))


def test_near_duplicates_with_several_texts_under_one_id(spark):
    """An id is linked by each of its texts; every row comes out once."""
    base = {c: words(40, 70 + i, 10**6) for i, c in enumerate("pqrs")}
    near = lambda c, i: " ".join([*base[c][:39], f"x{i}"])
    rows = [(5, near("p", 1)), (5, near("q", 1)), (5, near("q", 1)), (1, near("p", 2)), (9, near("q", 2)), (3, near("r", 1)), (3, ""), (2, near("r", 2)), (3, "  "), (7, ""), (8, near("s", 1)), (20, near("s", 1)), (20, near("s", 2))]
    rows += [(30 + i % 2, " ".join(words(20, 900 + i, 10**6))) for i in range(12)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=4, percent=80).collect()
    comp = {5: 1, 1: 1, 9: 1, 3: 2, 2: 2, 7: 7, 8: 8, 20: 8, 30: 30, 31: 31}
    want = [(i, max(0, len(t.split()) - 3), comp[i], comp[i] == i) for i, t in rows]
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_sketch_registers():
    from docloom.llm import common

    order = near_dup.probes(512)
    assert all(sorted(p) == list(range(512)) and p[0] == i for i, p in enumerate(order.tolist()))
    s = np.random.default_rng(1).integers(0, common.P1, 30_000, dtype=np.uint64)
    make = lambda x: near_dup.sketch(np.sort(x), order)
    for n in (20_000, 600):  # every bucket filled, and most of them borrowed
        a, b = make(s[:n]), make(s[n // 4 : n // 4 + n])
        assert abs(near_dup.estimated(np.array([(a == b).sum()]), 512, np.array([n]), np.array([n]))[0] - 0.6) < 0.12
    c = make(s[25_000:])
    assert (a == c).mean() < 0.02 and (c >> near_dup.MANTISSA).max() <= 63
    # A register by hand: leading zeros after the bucket's number, the bits after the first one.
    x = (5 << 52) | (0b1011 << 40)
    assert near_dup.sketch(np.array([x], np.uint64), order)[5] == (8 << near_dup.MANTISSA) | 0b0110000000


def test_shingles_are_told_apart_whatever_the_words():
    """Words that a polynomial modulo a power of two takes for equal, and words around the length that is hashed one to one."""
    texts = [x for n in (64, 1024, 4096) for x in complements(n)]
    texts += ["x" * n for n in range(1, 20)] + ["x" * 14 + "\0", "x" * 15 + "\0", "\0", "\0\0", "a\0", "a b", "b a", "a b c", "c b a"]
    sets = list(near_dup.shingle_sets(pa.array(texts), 4))
    assert len({(int(x[0]), int(y[0])) for x, y in sets}) == len(texts)


def test_window_hashes_by_hand():
    from docloom.llm import common

    r = random.Random(3)
    low, high = (np.array([r.getrandbits(64) for _ in range(90)], np.uint64) for _ in range(2))
    for width in (1, 2, 3, 5, 20, 89, 90, 91):
        one, two = common.window_hashes(low, high, width, step=16)
        assert len(one) == len(two) == max(0, 91 - width)
        for i in range(len(one)):
            x = y = 0
            for j in range(i, i + width):
                x, y = (x * common.BASES[0] + int(low[j])) % common.P1, (y * common.BASES[1] + int(high[j])) % common.P2
            assert (x, y) == (one[i], two[i])


def test_pairs_that_agree_in_one_lane_only():
    from docloom.llm import common

    one, two = np.array([5, 5, 5, 7, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint32)
    order, same = common.sorted_pairs(one, two)
    assert same.sum() == 2 and [(int(one[i]), int(two[i])) for i in order] == [(5, 1), (5, 1), (5, 2), (5, 2), (7, 1)]
    x, y = (np.array([5, 5], np.uint64), np.array([1, 2], np.uint32)), (np.array([5, 5, 7], np.uint64), np.array([2, 3, 1], np.uint32))
    assert near_dup.common(x, y) == 1 and near_dup.intersections([x, y], [y], step=2).tolist() == [[1], [3]]


def test_joining_links():
    links = np.ones((3, 3), bool)
    got = near_dup.joining(links, np.array([1, 2, 2]), np.array([3, 1, 9]))
    assert len(got) == 3 and {x for p in got for x in p} == {1, 2, 3, 9}


def test_near_duplicates_of_complementary_words(spark):
    a, b = complements(4096)
    texts = [a[:1024], b[:1024], a, b, "one " * 5 + a, "one " * 5 + b, a]
    got = near_dup.near_duplicates(frame(spark, texts), k=4, percent=80).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == near_by_hand(list(enumerate(texts)), 4, 80)


@pytest.mark.parametrize("open_share", [0, 64])
def test_near_duplicates_with_many_hubs(spark, open_share):
    """Many look-alikes, of which some are linked and most are not, whether or not hubs are tried again."""
    r, base, texts = random.Random(16), words(70, 21, 10**6), []
    for i in range(200):
        copy = list(base)
        for j in range(1 + i % 3):
            copy[r.randrange(70) if i % 2 else 69 - j] = f"c{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(words(30, 22, 10**6) + ["x" * 30_000, f"y{i}"]) for i in range(8)]
    got = near_dup.near_duplicates(frame(spark, texts), k=5, percent=80, block=16, open_share=open_share).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == near_by_hand(list(enumerate(texts)), 5, 80)


def test_near_duplicates_of_a_very_long_text(spark):
    long = words(60_000, 31, 10**6)
    texts = [" ".join(long), " ".join(long[:59_000] + ["end"]), " ".join(long[30_000:]), "z" * 2_000_000, "z" * 2_000_000 + " ", "z" * 1_999_999]
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(frame(spark, texts), k=5, percent=80).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5}


def test_components(spark):
    links = [(2, 1), (3, 2), (9, 3), (20, 21), (21, 22), (22, 20)] + [(100 + i, 101 + i) for i in range(30)]
    nodes = spark.createDataFrame([(i,) for i in [1, 2, 3, 9, 20, 21, 22, 50, *range(100, 131)]], "id long")
    got = {r.id: r.comp for r in near_dup.components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20, 50: 50, **{i: 100 for i in range(100, 131)}}


# -- 7


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / sum(w[x] for x in free) for s in order}
        over = [s for s in free if target[s] > most * sizes[s] + 1e-9]
        if not over:
            return target
        full |= set(over)


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "Z", "é", None, "c", ""][: 3 + seed]
    texts, sources = [], []
    for i in range(160):
        s = names[min(int(r.expovariate(0.9)), len(names) - 1)]
        texts.append(None if i % 31 == 0 else " ".join(words(r.randrange(30), i)) + "\t")
        sources.append(s)
    got = mixing.placed(frame(spark, texts, sources), range_rows=10).collect()
    assert len(got) == 160
    size = [len((t or "").split()) for t in texts]
    per = Counter()
    for n, s in zip(size, sources, strict=True):
        per[s] += n
    want, taken = targets_by_hand(dict(per)), Counter()
    for x in got:
        assert x.size == size[x.doc_id] and x.source_size == per[sources[x.doc_id]] and x.taken <= 3 * x.size
        assert math.isclose(x.target, want[sources[x.doc_id]], rel_tol=1e-9, abs_tol=1e-9) and sum(c.words for c in x.copies) == x.taken
        taken[sources[x.doc_id]] += x.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in per)
    again = mixing.placed(frame(spark, texts, sources).repartition(7), range_rows=50).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_schedule(spark):
    texts = [" ".join(words(10, i)) for i in range(60)]
    plan = mixing.schedule(frame(spark, texts, [f"s{i % 3}" for i in range(60)])).collect()
    assert [r.position for r in plan] == sorted(r.position for r in plan) and all(0 <= r.position <= 1 for r in plan)
    rising = [r.position for r in plan if r.source == "s0"]
    falling = [r.position for r in plan if r.source == "s2"]
    assert np.mean(rising) > 0.5 > np.mean(falling)
    assert mixing.schedule(empty(spark)).count() == 0


def test_inverted_schedule(spark):
    for knots in mixing.SCHEDULES:
        t = np.linspace(0, 1, 100_001)
        area = np.concatenate([[0], np.cumsum(np.interp((t[1:] + t[:-1]) / 2, *zip(*knots, strict=True)))]) * 1e-5
        for share in (0.0, 0.1, 0.5, 0.63, 0.99, 1.0):
            got = spark.range(1).select(mixing.invert_schedule(F.lit(share), knots)).first()[0]
            assert abs(np.interp(got, t, area / area[-1]) - share) < 1e-4


# -- 8


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_duplicates(spark, keep):
    r = random.Random(1)
    texts = [r.choice(["a", "b", "", None, "A", "a ", f"u{i}"]) for i in range(300)]
    got = exact_dedup.exact_duplicates(frame(spark, texts), keep, radix=3, rows_per_leaf=20).collect()
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[t or ""].append(i)
    pick = max if keep == "max" else min
    for x in got:
        g = by[texts[x.doc_id] or ""]
        assert (x.keep_id, x.group_size, x.kept, bytes(x.digest)) == (pick(g), len(g), x.doc_id == pick(g), hashlib.sha256((texts[x.doc_id] or "").encode()).digest())
    assert len(got) == 300
    assert sorted(x.doc_id for x in exact_dedup.drop_exact_duplicates(frame(spark, texts), keep).collect()) == sorted(map(pick, by.values()))


def test_merge_of_runs():
    r = np.random.default_rng(4)
    runs, want = [], defaultdict(lambda: [-1, 0])
    for i in range(7):
        keys = np.sort(np.array([bytes([x]) * 32 + bytes([0] * 7 + [x % 3]) for x in r.integers(0, 9, r.integers(1, 30))], "S40"))
        ids = r.integers(0, 1000, len(keys))
        runs.append(exact_dedup.folded((keys, ids, np.ones(len(keys), np.int64)), np.maximum))
        for k, x in zip(keys.tolist(), ids.tolist(), strict=True):
            want[k] = [max(want[k][0], x), want[k][1] + 1]
    keys, ids, n = exact_dedup.merge_runs(runs, np.maximum)
    assert keys.tolist() == sorted(want) and [[int(a), int(b)] for a, b in zip(ids, n, strict=True)] == [want[k] for k in sorted(want)]


def test_tree_has_two_rounds_at_least():
    for rows in (0, 10**5, 10**7, 10**9, 10**11):
        radix, rounds = exact_dedup.tree(rows, 10**6)
        assert rounds >= 2 and 4 <= radix <= 33 and radix**rounds >= rows / 10**6 and (rounds == 2 or 32 ** (rounds - 1) < rows / 10**6)


def test_exact_duplicates_edges(spark):
    assert exact_dedup.exact_duplicates(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a"), (3, "a"), (None, "b"), (3, "c"), (3, "c")], "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.keep_id or -1, x.group_size, x.kept) for x in exact_dedup.exact_duplicates(df).collect())
    assert got == [(-1, -1, 1, True), (-1, 3, 2, False), (3, 3, 2, True), (3, 3, 2, True), (3, 3, 2, True)]


# -- 9


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_split_pattern(tokenizer):
    samples = ["", " ", "  a", "a  ", "a \n\n b", "it's we'll 'x ''s' 's", "1234 é日本 x\u00a0y", "\t\tx", "$$$ a###", "<|endoftext|>", "a" * 3000, " '", "'S", "\u2028 x\u3000", "🙂🙂 ok"]
    samples += ["a<|endoftext|>b", "<|endoftext|><|endoftext|> <|endoftext|>\n", "<|endoftext", "x <| endoftext|>", "it's<|endoftext|>'s  "]
    for s in samples:
        assert packing.encoder()(s) == tokenizer.encode(s, add_special_tokens=False).ids, s


def check_packed(rows, ids, most):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append(x)
    for doc, parts in by_doc.items():
        want = ids[doc]
        for i, x in enumerate(sorted(parts, key=lambda x: x.piece)):
            assert x.piece == i and x.length > 0
            raw = np.array(want[x.start : x.start + x.length], "<u4").tobytes()
            assert x.ids_crc32 == zlib.crc32(raw) and (x.ids is None or bytes(x.ids) == raw)
        parts.sort(key=lambda x: x.start)
        assert parts[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(parts, parts[1:], strict=False)) and parts[-1].start + parts[-1].length == len(want)
        assert (len(parts) == 1) == (len(want) <= most) and all(x.length == most for x in parts[1:])
    for parts in by_sequence.values():
        parts.sort(key=lambda x: x.offset)
        assert parts[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(parts, parts[1:], strict=False)) and parts[-1].offset + parts[-1].length <= most
    return len(by_sequence)


def test_packing(spark, tokenizer):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(300)
    rows = packing.pack_documents(docs).collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}
    assert {x.doc_id for x in rows} == set(ids)
    n = check_packed(rows, ids, 1024)
    assert n <= -(-sum(map(len, ids.values())) // 1024) * 1.02 + 1


def test_packing_edges(spark, tokenizer):
    assert packing.pack_documents(empty(spark)).count() == 0
    texts = [None, "", "x", "a b c " * 3000, "same", "same"]
    rows = packing.pack_documents(frame(spark, texts), most=64).collect()
    check_packed(rows, {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}, 64)
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert len(packing.pack_documents(twice).collect()) == 3


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    sizes = np.random.default_rng(2).integers(1, 100, 500)
    bins, offsets = packing.best_fit(sizes, (100, 3, 6000), rule=rule)
    for b in set(bins.tolist()):
        s = sizes[bins == b]
        assert s.sum() <= 100 and len(s) <= 3 and (len(s) == 1 or (s * s).sum() <= 6000)
        order = np.argsort(offsets[bins == b])
        assert (np.cumsum(s[order]) - s[order] == offsets[bins == b][order]).all()


def packed_by_hand(sizes, capacity, weights, rule):
    """Best fit over plain lists: every open or full bin is looked at for every piece."""
    bins, where = [], [None] * len(sizes)
    w = [x / c**2 for x, c in zip(weights, capacity, strict=True)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        item, best = (sizes[i], 1, sizes[i] ** 2), None
        for b, left in enumerate(bins):
            if all(r >= x for r, x in zip(left, item, strict=True)):
                score = sum(f * (r - x) ** 2 for f, r, x in zip(w, left, item, strict=True)) if rule == "residual" else -sum(f * r * x for f, r, x in zip(w, left, item, strict=True))
                if best is None or score < best[0] - 1e-12:
                    best = score, b
        if best is None:
            bins.append(list(capacity))
            best = 0, len(bins) - 1
        where[i] = best[1], capacity[0] - bins[best[1]][0]
        bins[best[1]] = [r - x for r, x in zip(bins[best[1]], item, strict=True)]
    return where


@pytest.mark.parametrize("rule", ["residual", "dot"])
@pytest.mark.parametrize("capacity", [(100, 3, 6000), (64, 16, 64 * 64), (128, 128, 128 * 128)])
def test_best_fit_by_hand(rule, capacity):
    sizes = np.random.default_rng(5).integers(1, 65, 400)
    bins, offsets = packing.best_fit(sizes, capacity, rule=rule)
    assert list(zip(bins.tolist(), offsets.tolist(), strict=True)) == packed_by_hand(sizes.tolist(), capacity, (1.0, 0.01, 0.01), rule)


@pytest.mark.parametrize(("which", "low", "high"), [(0, 20, 25), (1, 1, 4), (2, 50, 60)])
def test_each_capacity_binds(which, low, high):
    """On pieces of a kind, one capacity makes the bins many; made large, it no longer does."""
    sizes, capacity = np.random.default_rng(6).integers(low, high, 300), [100, 12, 3600]
    tight = packing.best_fit(sizes, tuple(capacity))[0].max() + 1
    capacity[which] = 10**9
    assert packing.best_fit(sizes, tuple(capacity))[0].max() + 1 < tight


def test_documents_bind_in_the_query(spark):
    """Tiny texts: a sequence of the query takes 256 of them, not 1024."""
    docs = spark.range(1500).selectExpr("id AS doc_id", "IF(id % 2 = 0, '', 'a') AS text")
    per = Counter(r.sequence_id for r in packing.pack_documents(docs).collect())
    assert max(per.values()) == 256 and sum(per.values()) == 1500 and len(per) == 6


# -- 10

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "b.net", "/e"), ("block", "B.net", "/"), ("allow", "org", "/x")]


def judged_by_hand(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, _, tail = rest.partition("/")
        path = "/" + tail if "/" in rest else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), v, h.lower() + p) for v, h, p in RULES if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://example.com", "http://EXAMPLE.com/en/x?y=/es/", "https://www.example.com/en/", "http://a.www.example.com/en/#f", "http://x.net/es/1", "http://x.net/fr", "http://b.net/english", "http://b.net/", "http://c.b.net/e", "http://com/", "http://.com/", "http://ä.com/é/",
            "http://notexample.com/en/", "ftp://a.org/xyz", "http://a.org/y", "http://a.org?/x", "a://b://c.com/", "http:///en/", "http://x.com//", "http://example.com:80/en/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls)], "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "digest", "short", "id", "best")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, RULES)).collect()}
    assert got == {i: judged_by_hand(u) for i, u in enumerate(urls + urls)}
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_frame(spark, RULES)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, []), "block").collect()} == {"block"}


def test_url_rules_without_a_path_and_very_long_urls(spark):
    rules = [("block", "com", ""), ("allow", "a.com", "/x"), ("block", "b.org", "/" + "d/" * 300)]
    urls = ["http://com", "http://x.com/y", "http://a.com/xy", "http://a.com/" + "x/" * 2000, "http://b.org/" + "d/" * 301, "http://b.org/" + "d/" * 299, "http://" + "s." * 500 + "com/" + "q" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules)).collect()}
    assert got == {0: ("com", "block"), 1: ("com", "block"), 2: ("a.com/x", "allow"), 3: ("a.com/x", "allow"), 4: ("b.org/" + "d/" * 300, "block"), 5: (None, "allow"), 6: ("com", "block")}


def test_native_operators_run_no_python(spark):
    for df in (url_filter.filter_urls(spark.read.parquet(f"{D}/pages.parquet"), url_filter.rules_frame(spark, RULES)), license_scan.scan_licenses(spark.read.parquet(f"{D}/documents.parquet"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def test_chunks_of_very_long_text():
    from docloom.llm import common

    col = pa.array(["a b", "x" * 3_000_000 + " y", None, "c"])
    got = [(a, b) for a, b, _, _ in common.chunks(col)]
    assert got == [(0, 1), (1, 2), (2, 4)]
    assert [len(s) for s, _ in near_dup.shingle_sets(col, 4)] == [1, 1, 0, 1]


def test_license_stems():
    """Every rule's mandatory part holds a stem: so does any text that it matches, here made by the pattern's shortest reading."""
    found = license_scan.stems(license_scan.RULES)
    for r in license_scan.RULES:
        shortest = r.pattern
        while "(?:" in shortest:
            shortest = re.sub(r"\(\?:([^()|]*)[^()]*\)(\??)", lambda m: "" if m[2] else m[1], shortest, count=1)
        shortest = re.sub(r"\[(.)[^]]*\](\??)", lambda m: "" if m[2] else m[1], shortest)
        shortest = re.sub(r".\?", "", shortest)
        assert re.fullmatch(r.pattern, shortest), r
        assert any(x in f" {shortest} " for x in found), r
    assert len(found) < 40


def readings(pattern):
    """Every text that a rule's pattern matches."""
    at = 0

    def choice():
        nonlocal at
        out = []
        while True:
            out += sequence()
            if at == len(pattern) or pattern[at] == ")":
                return out
            at += 1

    def sequence():
        nonlocal at
        out = [""]
        while at < len(pattern) and pattern[at] not in "|)":
            if pattern.startswith("(?:", at):
                at += 3
                piece = choice()
                at += 1
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                low, high = pattern[at + 1], pattern[end - 1]
                piece, at = [chr(c) for c in range(ord(low), ord(high) + 1)], end + 1
            else:
                piece, at = [pattern[at]], at + 1
            if at < len(pattern) and pattern[at] == "?":
                piece, at = [*piece, ""], at + 1
            out = [a + b for a in out for b in piece]
        return out

    return choice()


def test_license_keywords_and_stems_lose_no_match():
    """Whatever a rule matches holds its keyword at the start of a word, and a stem."""
    found = license_scan.stems(license_scan.RULES)
    for r in license_scan.RULES:
        for text in readings(r.pattern):
            assert f" {r.keyword}" in f" {text} " and any(x in f" {text} " for x in found), (r, text)
        assert re.fullmatch(r.pattern, text), (r, text)


def test_license_names_within_a_word(spark):
    texts = {"OpenRAIL-M license": ("openrail", 0.7), "under BigScience Open RAIL M": ("openrail", 0.7), "released under the 0BSD license": ("0bsd", 0.95), "0BSD": ("0bsd", 0.7), "Zero-Clause BSD": ("0bsd", 0.7)}
    got = license_scan.scan_licenses(frame(spark, list(texts))).collect()
    assert {list(texts)[r.doc_id]: (r.labels, round(r.score, 9)) for r in got} == texts


def test_license_versions_and_grants(spark):
    texts = {
        "Eclipse Public License v2.0": ("epl-2.0", 0.7), "Eclipse Public License": ("epl", 0.7), "European Union Public Licence v1.1": ("eupl-1.1", 0.7), "European Union Public Licence V. 1.2": ("eupl-1.2", 0.7), "European Union Public Licence 1.0": ("eupl", 0.7),
        "Academic Free License v2.1": ("afl", 0.7), "GPL v. 2": ("gpl-2.0", 0.7), "released under the SIL Open Font License v1.1": ("ofl-1.1", 0.95), "distributed under the terms of the UPL: Universal Permissive License": ("upl", 0.7),
        "licensed under CC0 1.0": ("cc0-1.0", 0.95), "released under the OpenRAIL-M license": ("openrail", 0.95),
    }
    got = license_scan.scan_licenses(frame(spark, list(texts))).collect()
    assert {list(texts)[r.doc_id]: (r.labels, round(r.score, 9)) for r in got} == texts
