"""Keyword automata against plain searches, in one block and in many."""

import random
import re

import pytest

from skilltide.operators import extract, keywords

DICTIONARY = "skill_keyword string, normalized_skill string, kg_display_skill string"


def plain_mentions(text, entries):
    """Longest keyword first, of equal length the larger; a match never overlaps an earlier one."""
    found = []
    for word in sorted(entries, key=lambda w: (len(w), w.lower()), reverse=True):
        if re.fullmatch(r"[A-Za-z0-9_+#. /-]+", word):
            pattern = rf"(?<![A-Za-z0-9_+#.-]){re.escape(word)}(?![A-Za-z0-9_+#.-])"
        elif len(word) > 1:
            pattern = re.escape(word)
        else:
            continue
        for m in re.finditer(pattern, text, re.IGNORECASE):
            if not any(m.start() < b and a < m.end() for a, b, _ in found):
                found.append((*m.span(), word))
    return found


def words(seed, n):
    random.seed(seed)
    return [("".join(random.choice("ab Cé中.") for _ in range(random.randint(1, 5)))).strip() for _ in range(n)]


@pytest.mark.parametrize("block", [100_000, 7, 1])
def test_mentions_equal_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(keywords, "BLOCK", block)
    held = {w.lower(): w for w in words(1, 40 if block > 1 else 8) if w}.values()
    texts = ["".join(random.choice("aAbBcC éÉ中.-") for _ in range(random.randint(0, 30))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "job_id int, text string")
    entries = spark.createDataFrame([(w, w, "f") for w in held], DICTIONARY)
    got = sorted((r.job_id, r.span_start, r.span_end, r.skill_keyword, r.span_text) for r in extract.dictionary_mentions(rows, entries).collect())
    assert got == sorted((i, a, b, w, t[a:b]) for i, t in enumerate(texts) for a, b, w in plain_mentions(t, list(held))) and len(got) > 20


def test_signs_that_only_patterns_take_for_each_other(spark):
    entries = spark.createDataFrame([("sql", "SQL", "f"), ("k8s", "K8s", "f"), ("id号", "ID", "f"), ("μm级", "um", "f")], DICTIONARY)
    said = ["ſql", "K8s", "ıd号 ", "µm级 x", "İD号"]
    rows = spark.createDataFrame([(t,) for t in said], "text string")
    got = {(r.text, r.skill_keyword) for r in extract.dictionary_mentions(rows, entries).collect()}
    assert got == {(t, w) for t in said for w in ("sql", "k8s", "id号", "μm级") for _ in plain_mentions(t, [w])} and len(got) >= 4


@pytest.mark.parametrize("block", [100_000, 3])
def test_contained_equals_substrings(spark, monkeypatch, block):
    monkeypatch.setattr(keywords, "BLOCK", block)
    held = [(w, f"job{i % 3}") for i, w in enumerate(words(2, 12))] + [("", "none"), ("ab", "other"), (None, "none")]
    texts = words(3, 50) + ["", None, "ab" * 500, "ab", "ab"]
    rows = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)], "n int, text string, `odd name` double")
    got = sorted((r.n, r["odd name"], r.keyword, r.job) for r in keywords.contained(rows, spark.createDataFrame(held, "keyword string, job string")).collect())
    assert got == sorted((i, 1.5, w, j) for i, t in enumerate(texts) for w, j in held if w and t and w in t) and len(got) > 10
    assert keywords.contained(rows, spark.createDataFrame([], "keyword string, job string")).count() == 0
    assert keywords.contained(rows.limit(0), spark.createDataFrame(held, "keyword string, job string")).count() == 0


def test_blocks_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(keywords, "BLOCK", 64)
    got = list(keywords.blocks(spark.range(0, 1000, 1, 7).selectExpr("string(id) AS keyword")))
    assert max(b.num_rows for b in got) == 64 and sorted(int(x) for b in got for x in b["keyword"].to_pylist()) == list(range(1000))
