"""The best candidates against all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from skilltide.operators import routing


def cosine(a, b):
    fine = lambda v: v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)
    if not fine(a) or not fine(b) or not any(a) or not any(b):
        return 0.0
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize("block", [20_000, 4])
def test_best_of_all_and_of_each_category(spark, monkeypatch, block):
    monkeypatch.setattr(routing, "SMALL", block)
    rng = np.random.default_rng(4)
    draw = lambda: rng.integers(-2, 3, 3).astype(float).tolist()  # noqa: E731  few values, so that there are ties
    odd = [None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [float("nan"), 1.0, 1.0]]
    queries = [(i, draw()) for i in range(40)] + [(100 + i, v) for i, v in enumerate(odd)]
    jobs = [(f"n{i:02d}", random.Random(i).choice(["a", "b", "c", None]), draw()) for i in range(17)] + [(f"o{i}", "d", v) for i, v in enumerate(odd[:4])]
    q, c = spark.createDataFrame(queries, "job_id long, v array<double>"), spark.createDataFrame(jobs, "name string, category string, v array<double>")
    rank = {i: sorted(((-round(cosine(v, w), 9), n, c) for n, c, w in jobs)) for i, v in queries}
    got = {(r.job_id, r.rank): (r.name, r.category, round(r.score, 9)) for r in routing.cosine_candidates(q, c, 4).collect()}
    assert got.keys() == {(i, n) for i, _ in queries for n in range(1, 5)}
    assert all(got[i, n + 1][2] == pytest.approx(-rank[i][n][0], abs=1e-6) for i, _ in queries for n in range(4))
    found = routing.cosine_candidates(q, c, 2, 2, 1e-6).collect()
    for i, _ in queries:
        own = {r.name for r in found if r.job_id == i}
        kth = lambda rows: rows[min(2, len(rows)) - 1][0]
        want = {n for s, n, _ in rank[i] if s <= kth(rank[i]) + 1e-9} | {n for c in "abcd" for rows in [[x for x in rank[i] if x[2] == c]] for s, n, _ in rows if s <= kth(rows) + 1e-9} | {n for rows in [[x for x in rank[i] if x[2] is None]] for s, n, _ in rows if s <= kth(rows) + 1e-9}
        assert own == want
    assert routing.cosine_candidates(q, c.limit(0), 3).count() == 0 and routing.cosine_candidates(q.limit(0), c, 3).count() == 0


def test_routes_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(40, 3))
    queries = [(i, (centre[i % 40] + rng.normal(size=3) * 0.4).tolist()) for i in range(80)]
    jobs = [(f"n{i:02d}", f"c{i % 4}", v.tolist()) for i, v in enumerate(centre)]
    q, c = spark.createDataFrame(queries, "job_id long, v array<double>"), spark.createDataFrame(jobs, "name string, category string, v array<double>")
    few, every = routing.ladder_candidates(q, c), routing.cosine_candidates(q, c, 40)
    assert few.count() < every.count()
    assert sorted(map(tuple, routing.route(few).collect())) == sorted(map(tuple, routing.route(every).collect()))
    assert sorted(map(tuple, routing.category_scores(few).collect())) == sorted(map(tuple, routing.category_scores(every).collect()))


def test_titles_equal_all_pairs(spark):
    random.seed(5)
    word = lambda: "".join(random.choice("abc工程") for _ in range(random.randint(1, 6)))
    titles = [(i, " ".join(word() for _ in range(random.randint(1, 3)))) for i in range(60)] + [(100, ""), (101, None), (102, "a"), (103, "zz")]
    jobs = [(w, c) for w, c in {(word(), random.choice(["x", "y", None])) for _ in range(25)}] + [("a", "x"), ("", "x")]
    grams = lambda t: Counter(t[i : i + 2] for i in range(max(1, len(t) - 1)))
    size = lambda g: math.sqrt(sum(n * n for n in g.values()))
    want = set()
    for i, t in titles:
        rows = []
        for w, c in jobs:
            if t and w:
                a, b = grams(t), grams(w)
                s = sum(n * b[g] for g, n in a.items()) / size(a) / size(b)
                if s >= 0.3 - 1e-9:
                    rows.append((-round(s, 9), w, c or ""))
        want |= {(i, n + 1, -r[0]) for n, r in enumerate(sorted(rows)[:3])}
    got = routing.gram_topk(spark.createDataFrame(titles, "job_id int, title string"), spark.createDataFrame(jobs, "name string, category string"), 3).collect()
    assert {(r.job_id, r["rank"], round(r.score, 9)) for r in got} == want and len(want) > 30
