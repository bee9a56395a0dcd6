"""The quality classifier: statistics and trees against plain versions, held-out accuracy, odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from skilltide.llm import quality_trees as q

SF = "/root/testdata/sf0.01"


def plain(text):
    """Some of the statistics, one text at a time."""
    data = text.encode()
    n, ws = len(data), data.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    raw, lines = data.split(), [x for x in data.split(b"\n") if x]
    count, pairs, by_line = Counter(ws), Counter(zip(ws, ws[1:])), Counter(lines)
    share = lambda c, k: len(c) / max(1, k)
    weigh = lambda c: sum(len(x) * k for x, k in c.items() if k > 1) / max(1, sum(len(x) * k for x, k in c.items()))
    most = lambda c, k: max(c.values(), default=0) / max(1, k)
    return {
        0: np.log1p(n), 1: np.log1p(len(ws)), 2: np.log1p(len(lines)), 3: sum(48 <= b <= 57 for b in data) / max(1, n), 8: sum(b > 127 for b in data) / max(1, n),
        44: np.mean([len(w) for w in ws] or [0]), 48: np.mean([65 <= w[0] <= 90 for w in raw] or [0]), 53: sum(a == b for a, b in zip(ws, ws[1:])) / max(1, len(ws)),
        54: share(count, len(ws)), 55: weigh(count), 56: most(count, len(ws)), 57: share(pairs, len(ws) - 1), 59: most(pairs, len(ws) - 1), 60: share(by_line, len(lines)), 61: weigh(by_line), 62: most(by_line, len(lines)),
    }


def test_statistics_equal_plain_ones():
    random.seed(4)
    word = lambda: "".join(random.choice("abcABC1é!|$") for _ in range(random.randint(1, 4)))
    said = ["", " ", "\n\n", "a", "A\n", "\x00"] + ["".join(word() + random.choice([" ", "  ", "\n", "\t"]) for _ in range(random.randint(0, 60))) for _ in range(60)]
    for chunk in (said, said[::-1], said[3:4], said[:1]):
        got = q.statistics([t.encode() for t in chunk])
        assert np.isfinite(got).all()
        for row, text in zip(got, chunk, strict=True):
            for j, value in plain(text).items():
                assert row[j] == pytest.approx(value), (j, text)


def walk(trees, row):
    out = trees.start
    for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
        at = 0
        while at < len(f):
            at = 2 * at + (2 if row[f[at]] > t[at] else 1)
        out += v[at - len(f)]
    return 1 / (1 + np.exp(-out))


def test_flat_trees_equal_a_walk_and_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 6)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = q.Trees.fit(x[:1000], y[:1000], trees=30)
    p = trees.probabilities(x)
    assert p == pytest.approx([walk(trees, r) for r in x])
    assert ((p >= 0.5) == y)[1000:].mean() > 0.95


def test_first_split_equals_brute_force():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    y = (x[:, 1] > 4).astype(float)
    g, h = y.mean() - y, np.full(200, y.mean() * (1 - y.mean()))
    trees = q.Trees.fit(x, y, trees=1, depth=1)
    p = 1 / (1 + np.exp(-trees.start))
    g, h = p - y, np.full(200, p * (1 - p))
    gain = {(j, t): sum(g[m].sum() ** 2 / (h[m].sum() + q.SMOOTH) for m in (x[:, j] <= t, x[:, j] > t)) for j in range(3) for t in range(8)}
    assert (trees.feature[0, 0], trees.threshold[0, 0]) == max(gain, key=gain.get)


def test_trees_of_one_kind_or_nothing():
    assert q.Trees.fit(np.zeros((0, 1)), np.zeros(0)).probabilities(np.zeros((2, 64))).tolist() == [0.5, 0.5]
    assert q.Trees.fit(np.zeros((5, 1)), np.ones(5)).probabilities(np.zeros((1, 1)))[0] > 0.8
    assert q.Trees.fit(np.zeros((50, 2)), np.arange(50) % 2.0).probabilities(np.zeros((1, 2)))[0] == pytest.approx(0.5)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in q.op12_quality_trees(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) >= 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", 1.0), (1, "same", "x", 1.0), (None, "same", None, None), (3, "", "y", 2.0), (3, "", "y", 2.0), (4, "long " * 200_000, "z", 0.0)], "doc_id long, text string, quality string, score double").repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 1), (4, 7, 1)], "doc_id long, quality int, text int")
    trees = q.train(docs, labels)
    assert trees.start == pytest.approx(0) and len(trees.value) <= q.TREES  # one of each kind: repeats, nulls and 7 teach nothing
    got = q.score(docs, trees)
    assert got.columns == ["doc_id", "text", "quality", "score", "predicted"] and got.count() == 6
    assert q.score(docs.limit(0), trees).collect() == []
    none = q.train(docs, labels.limit(0))
    assert {(r.score, r.predicted) for r in q.score(docs, none).collect()} == {(0.5, 1)}


def test_sample_is_bounded(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('a b ', int(id % 7)) AS text")
    labels = spark.range(300).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    assert abs(q.train(docs, labels, 40).start) < 1.5
    assert (q.train(docs, labels, 40).value == q.train(docs.repartition(5), labels.repartition(3), 40).value).all()
