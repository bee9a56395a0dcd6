"""Hard negatives against brute force over all rows."""

import math

import numpy as np
import pytest

from skilltide.llm import hard_negatives as h

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    held = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        new = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        held[i] = min(held.get(i, new), new)
    out = set()
    for a in (i for i in held if i % every == 0):
        label, q = held[a]
        scores = {i: sum(x * y for x, y in zip(q, v)) for i, (_, v) in held.items() if i != a and len(v) == len(q)}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if held[i][0] == label][:5]:
            fine = [i for i in order if held[i][0] != label and 30 * scores[p] <= 100 * scores[i] <= 90 * scores[p]]
            out |= {(a, p, r + 1, i, scores[p], scores[i]) for r, i in enumerate(fine[:10])}
    return out


def mined(spark, rows, every=100, schema=SCHEMA):
    got = h.mine(h.prepared(spark.createDataFrame(rows, schema).repartition(3)), f"vec_id % {every} = 0")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def vectors(seed, n, dim=6, spread=0.4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    return [(int(i), (centre[i % 4] * spread + rng.normal(size=dim) * 0.3).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(n)]


def test_tree_finds_what_a_scan_finds(monkeypatch):
    monkeypatch.setattr(h, "LEAF", 64)
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(900, 5)) * 40)
    x[100:300] = x[0]  # equal rows stay in one leaf
    norm = float(np.sqrt((x * x).sum(1).max()))
    unit = h.Unit.unpack(h.Unit.fit(np.arange(900), rng.integers(0, 3, 900), x, norm).pack())
    assert len(unit.tree.leaves) > 8
    for i in range(0, 900, 60):
        q = x[i]
        scores = dict(enumerate((x @ q).tolist()))
        label = dict(zip(unit.ids.tolist(), unit.labels.tolist()))
        for low, high, same in ((-math.inf, math.inf, True), (scores[i] * 0.3, scores[i] * 0.9, False), (1.0, 1.0, False), (5.0, -5.0, True)):
            ask = h.Ask(i, 0, 1, same, low, high)
            want = sorted((-s, j) for j, s in scores.items() if low <= s <= high and (label[j] == 1) == same and not (same and j == i))[:10]
            assert [(-s, int(j)) for s, j in unit.nearest(q, ask, 10, {})] == want


def test_traversal_leaves_most_of_clustered_rows_alone(monkeypatch):
    monkeypatch.setattr(h, "LEAF", 64)
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(size=(40, 8))[rng.integers(0, 40, 8000)] * 300 + rng.normal(size=(8000, 8)) * 3)
    unit = h.Unit.fit(np.arange(8000), np.arange(8000) % 2, x, float(np.sqrt((x * x).sum(1).max())))
    visited = []
    for i in range(0, 8000, 400):
        known = {}
        list(unit.nearest(x[i], h.Ask(i, 0, 0, True, -math.inf, math.inf), 5, known))
        visited.append(len(known))
    assert np.mean(visited) < 0.5 * len(unit.tree.leaves)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = vectors(seed, 400)
    assert mined(spark, rows, 20) == brute(rows, 20)


def test_cells_units_blocks_and_rounds(spark, monkeypatch):
    for name, value in (("CELL", 25), ("BLOCK", 3), ("RUN", 2), ("NEAR", 30), ("LEAF", 4), ("SAMPLE", 60)):
        monkeypatch.setattr(h, name, value)
    rows = vectors(5, 300) + [(1000 + i, [0.5] * 6, i % 3) for i in range(120)]  # a cell of equal rows
    index = h.Index(h.prepared(spark.createDataFrame(rows, SCHEMA)), 60)
    assert index.held[index.upper.leaves].sum() == 420 and len(index.upper.leaves) > 3 and index.units.count() > 8
    assert mined(spark, rows, 20) == brute(rows, 20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(7, 60) + [(None, [1.0] * 6, 1), (200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (300, [nan] * 6, 1), (301, [inf] * 6, 2), (400, [0.0] * 6, 1), (500, [0.1] * 6, None)]
    rows += [(600, [-1e-7, 0.2, 0.3], 0), (601, [0.1, 0.2, 0.3], 0), (602, [0.1, 0.1, 0.3], 1), (700, [], 1), (10, [0.3] * 6, 2), (10, [0.3] * 6, 2), (11, [0.1] * 6, 3)]
    rows += [(800, [1.0, 0.0], 0), (801, [0.0, 1.0], 0), (803, [0.0, -1.0], 5)]  # a positive of score 0: negatives of score 0
    rows += [(900 + i, [0.25] * 6, i % 2) for i in range(30)]  # ties
    assert mined(spark, rows, 10) == brute(rows, 10)
    clash = [(*r, "x", 1.5) for r in rows]
    assert mined(spark, clash, 10, SCHEMA + ", v string, anchor_id double") == brute(rows, 10)


def test_empty(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(100, [1.0], 3)]) == set()
    assert mined(spark, [(i, [0.5, 0.1 * i], i % 2) for i in range(1, 20)]) == set()  # no anchors


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = [tuple(r) for r in h.op13_hard_negatives(spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_the_floor_of_the_first_round_keeps_far_cells_out(spark, monkeypatch):
    for name, value in (("CELL", 40), ("NEAR", 100), ("LEAF", 8)):
        monkeypatch.setattr(h, name, value)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(12, 6)) * 3
    rows = [(i, (centre[i % 12] + rng.normal(size=6) * 0.05).astype(np.float32).tolist(), i % 2) for i in range(600)]
    seen, routed = [], h.Index._routed

    def counted(self, asks, first):
        out = routed(self, asks, first)
        seen.append((first, out.count(), asks.count() * len(self.upper.leaves)))
        return out

    monkeypatch.setattr(h.Index, "_routed", counted)
    assert mined(spark, rows, 20) == brute(rows, 20)
    # the search for positives: both rounds together leave a third of the cells out at least; without the floor they visit all
    assert [f for f, *_ in seen[:2]] == [True, False] and seen[0][1] + seen[1][1] < 2 / 3 * seen[0][2]
