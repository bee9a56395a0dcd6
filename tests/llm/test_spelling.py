"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from skilltide.llm import spelling

LOWER = {i: i + 32 for i in range(65, 91)}


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more).repartition(3)


def counts(rows, every):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            if doc is not None:
                h = zlib.crc32(f"{doc}:{w}".encode())
                if h % every == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return total


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=199, times=5):
    n = {w: k for w, k in counts(rows, every).items() if len(w) >= 6 and k >= times}
    out, form = {}, {}
    for w in n:
        near = sorted((-n[u], u) for u in n if one_edit(u, w))
        form[w] = near[0][1] if near and -near[0][0] >= 5 * n[w] else None
        out[w] = [n[w], len(near)]
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (*out[w], form[w], n[form[w]] if form[w] else None, root)
    return out


def found(spark, rows, every=199, times=5):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs(spark, rows), every, times=times).collect()}


def planted(seed, n=300, letters="abÀÿ"):
    random.seed(seed)
    word = lambda: "".join(random.choice(letters) for _ in range(random.randint(4, 9)))
    held = [word() for _ in range(25)]
    text = lambda: random.choice([" ", ", ", "\n", "中", "_"]).join(random.choice(held) if random.random() < 0.8 else word() for _ in range(random.randint(0, 60)))
    return [(random.randint(0, 10**9), text()) for _ in range(n)] + [(7, None), (None, "ababab " * 9), (8, ""), (9, "Ababab×ABABAB" * 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = planted(seed)
    want = brute(rows, 7, 2)
    assert found(spark, rows, 7, 2) == want
    assert sum(v[2] is not None for v in want.values()) > 10


def test_chains_of_forms(spark):
    times = {"abcdefg": 625, "abcdefh": 125, "abcdexh": 25, "abcyexh": 5, "zbcyexh": 1}
    rows = [(None, " ".join([w] * k)) for w, k in times.items()]
    assert found(spark, rows, times=1) == brute(rows, times=1)
    assert found(spark, rows, times=1)["zbcyexh"] == (1, 1, "abcyexh", 5, "abcdefg")


def test_small_shards_and_hot_halves(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD", 4)
    monkeypatch.setattr(spelling, "STEP", 3)
    monkeypatch.setattr(spelling, "HELD", 5)
    rows = planted(3, 120, "ab")
    assert found(spark, rows, 5, 1) == brute(rows, 5, 1)


def test_ties_repeats_long_runs_and_clashing_columns(spark):
    long = "q" * 3000
    rows = [(None, "abcdef abcdeg abcdeh " * 5), (None, "abcdex"), (4, f"{long} {long}r"), (4, f"{long} {long}r")] * 5
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows)["abcdex"][2] == "abcdef"
    clash = [(*r, "x", 1) for r in rows]
    got = spelling.variants(docs(spark, clash, ", word string, n int")).collect()
    assert {r.word: r.n for r in got} == {w: v[0] for w, v in brute(rows).items()}


def test_empty(spark):
    assert spelling.variants(docs(spark, [])).collect() == []
    assert spelling.variants(docs(spark, [(1, None), (2, "a b c")])).collect() == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.op11_spelling_variants(spark, sf).collect()}
    assert got == brute(rows)
