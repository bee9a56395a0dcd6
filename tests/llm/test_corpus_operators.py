"""Dedup, decontamination, Jaccard join, nearest neighbours and the pipeline against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from skilltide.llm import ann_tree, components, decontaminate, jaccard_join, suffix_dedup
from skilltide.llm.gsaca import suffix_array

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_suffix_array():
    random.seed(2)
    for _ in range(500):
        x = [random.randint(0, random.choice([0, 1, 3, 9])) for _ in range(random.randint(0, 40))]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def brute_dedup(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def check_dedup(spark, rows):
    from pyspark.sql import functions as F

    found = suffix_dedup.unrepeated(docs(spark, rows)).withColumn("h", F.sha2("kept", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in found} == brute_dedup(rows)


def shared_passages(seed, n=60):
    """Texts with copies, near copies, passages in other surroundings, runs of one sign and words without spaces."""
    random.seed(seed)
    word = lambda: "".join(random.choice("abcdeé") for _ in range(random.randint(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    lines, bases = [text(20) for _ in range(4)] + ["x" * 150, "ab" * 90, "long" * 60], [text(60) for _ in range(5)]
    out = []
    for _ in range(n):
        kind = random.random()
        if kind < 0.3:
            words = random.choice(bases).split(" ")
            for _ in range(random.randint(0, 4)):
                words[random.randrange(len(words))] = word()
            out.append(" ".join(words))
        elif kind < 0.8:
            out.append("".join(text(random.randint(0, 15)) + random.choice(["", " ", "\n"]) + random.choice(lines) for _ in range(random.randint(1, 3))) + text(3))
        else:
            out.append(random.choice(["", "x" * 99, "x" * 100, "x" * 350, text(40)]))
    return [(random.randint(0, 10**6) * 100 + i, t) for i, t in enumerate(out)] + [(5, None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dedup_equals_brute_force(spark, seed):
    check_dedup(spark, shared_passages(seed))


def test_dedup_with_split_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3)
    monkeypatch.setattr(suffix_dedup, "HELD", 200)
    check_dedup(spark, shared_passages(4, 80))


def test_dedup_tells_runs_of_a_common_anchor_apart_before_arrays(spark, monkeypatch):
    """An anchor with more runs than an array holds leaves no row for each of its windows."""
    inner, stored = suffix_dedup.staged, {}
    monkeypatch.setattr(suffix_dedup, "staged", lambda df, name, *a: stored.setdefault(name, inner(df, name, *a)))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 8)
    random.seed(6)
    word = lambda: "".join(random.choice("abcde") for _ in range(6))
    text = lambda k: " ".join(word() for _ in range(k))
    line, lead, near = text(8), [text(4) for _ in range(4)], [text(1) for _ in range(40)]
    rows = [(i, f"{text(12)} {lead[i % 4] if i % 5 == 0 else text(4)} {line} {text(12)}") for i in range(200)]
    check_dedup(spark, rows)
    runs, windows = stored["runs"].where("salt > 0").count(), stored["sorted-runs"].where("w IS NOT NULL").count()
    assert runs > 50 and windows < runs
    stored.clear()
    # pieces that share all but the ends are more than an array holds, and still meet
    line = text(14)
    check_dedup(spark, [(i, f"{text(9)} {near[i % 40]} {line} {near[i % 7]} {text(9)}") for i in range(120)])
    assert stored["pieces"].where("salt > 0").count()


def test_dedup_of_odd_tables(spark):
    assert suffix_dedup.unrepeated(docs(spark, [])).count() == 0
    extra = spark.createDataFrame([(1, "a" * 120, "x"), (None, "a" * 120, "y"), (2, "a" * 110, "z")], "doc_id long, text string, kept string")
    rows = {r.doc_id: r for r in suffix_dedup.unrepeated(extra).collect()}
    assert (rows[1].n_removed, rows[2].n_removed, rows[None].n_removed) == (119, 110, 0) and rows[2].kept_text == ""


def test_dedup_of_repeated_rows_and_clashing_columns(spark):
    line = "".join(f"{i} " for i in range(60))
    rows = [(1, line), (2, "b " + line), (2, "b " + line), (2, "c " + line), (3, None), (3, None)]
    clash = docs(spark, rows).selectExpr("doc_id", "text", "doc_id AS _doc", "1 AS spans", "2 AS row", "3 AS k", "text AS _least", "4 AS `a.b`")
    found = suffix_dedup.unrepeated(clash)
    assert found.columns[:8] == clash.columns
    got = sorted((r.doc_id, r.text or "", r.n_removed, r._doc, r.spans, r.row) for r in found.collect())
    n = len(line)
    assert got == [(1, line, 0, 1, 1, 2), (2, "b " + line, n, 2, 1, 2), (2, "b " + line, n, 2, 1, 2), (2, "c " + line, 0, 2, 1, 2), (3, "", 0, 3, 1, 2), (3, "", 0, 3, 1, 2)]


def brute_items(texts, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").encode().translate(LOWER))
        for s in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(i))
    out = {}
    for i, t in texts:
        w, found = WORD.findall((t or "").encode().translate(LOWER)), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    found |= windows[k]
                    hit[s : s + n] = [1] * n
        out[i] = (len(w), sum(hit), sorted(found), sum(hit) > 0 and 20 * sum(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    random.seed(3)
    word = lambda: random.choice("a b c d e f g h".split()) * random.choice([1, 1, 2])
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(random.choice([1, 2, 3, 5, 12, 13, 14, 30]))) for i in range(20)] + [(50, None), (51, "..."), (3, "zz yy xx ww vv"), (60, "unseen" + " unseen" * 20)]
    texts = [(i, text(random.randint(0, 60)) + ". " + random.choice(items)[1].upper() if random.random() < 0.6 and i else text(30)) for i in range(60) if True] if all(t for _, t in items[:20]) else []
    texts = [(i, (t or "")) for i, t in texts if t is not None] + [(900, None), (901, ""), (902, "é É à"), (903, "zz  yy,xx ww--vv")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    assert found == brute_items(texts, items)
    assert {r.n_hit for r in decontaminate.contamination(docs(spark, texts), bench.where("false")).collect()} == {0}
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0


def test_decontamination_of_repeated_rows_and_clashing_columns(spark):
    said = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, said, "x"), (1, said, "x"), (None, said, "y"), (2, "", "z")], "item_id long, text string, words string")
    rows = docs(spark, [(1, said), (1, said), (None, said), (2, None)]).selectExpr("*", "7 AS n_words", "'s' AS spans", "8 AS items", "9 AS n_hit", "10 AS w")
    found = decontaminate.contamination(rows, bench)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"], r.w) for r in found.collect())
    assert got == [(0, 20, 20, ["1"], 10), (1, 20, 20, ["1"], 10), (1, 20, 20, ["1"], 10), (2, 0, 0, [], 10)]


def test_decontamination_takes_many_candidates_in_steps(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "STEP", 3)
    items = [(i, " ".join(["same"] * 13)) for i in range(2)] + [(5, " ".join(["same"] * 12 + ["end"]))]
    texts = [(1, " ".join(["same"] * 40 + ["end"])), (2, "same same")]
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == brute_items(texts, items)


def brute_components(rows, size, threshold):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= threshold * (len(sets[a]) + len(sets[b]) - c):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_copies(seed):
    random.seed(seed)
    out = []
    for _ in range(4):
        base = [f"w{random.randint(0, 2000)}" for _ in range(random.choice([12, 40, 120]))]
        for _ in range(40):
            words = list(base)
            for _ in range(random.randint(0, 4)):
                at, kind = random.randrange(len(words)), random.random()
                words[at : at + 1] = [f"w{random.randint(0, 2000)}"] if kind < 0.6 else [] if kind < 0.8 else [words[at], "more"]
            out.append(" ".join(words))
    out += ["", "  ", None, "one", "ONE", "a b c", "a b c d", "a  b\tc\nd", "e" * 5000]
    return [(i * 7 % 9973, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "family", "size", "threshold"), [(1, 64, 4, 85), (2, 8, 4, 85), (3, 8, 5, 80)])
def test_jaccard_equals_brute_force(spark, monkeypatch, seed, family, size, threshold):
    monkeypatch.setattr(jaccard_join, "FAMILY", family)
    rows = near_copies(seed)
    found = jaccard_join.near_duplicates(docs(spark, rows), size, threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, size, threshold)


def test_jaccard_of_a_root_far_from_its_family(spark, monkeypatch):
    """30 has the least id of a family, is too far from its centre, and 20 holds all that 30 shares with 31."""
    monkeypatch.setattr(jaccard_join, "FAMILY", 8)
    base, tail, own, filler = ([f"{k}{i}" for i in range(n)] for k, n in (("c", 200), ("w", 45), ("q", 14), ("f", 500)))
    rows = [(i, [f"a{i}x{j}" for j in range(5)] + filler + ["z"] + base[162:] + ["z"] + tail) for i in range(20)]
    rows += [(20, base[:150] + tail + ["z"] + filler), (30, base[:150] + tail + own), (31, base[:162] + tail)]
    rows += [(40 + j, base[: 195 - j] + [f"m{j}"] + base[196 - j :] + (own if j < 2 else [])) for j in range(12)]
    rows = [(i, " ".join(x)) for i, x in rows]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(spark, rows)).collect()}
    assert found == brute_components(rows, 4, 85) and found[31][1] == 30


def test_jaccard_of_odd_tables(spark):
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A B c d e"), (2, "z y x w v"), (3, "z y x w v"), (4, "far " * 300_000), (5, "FAR " * 300_000 + "end")]
    clash = docs(spark, rows).selectExpr("*", "7 AS own", "8 AS n", "9 AS _key")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.near_duplicates(clash).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_components(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    random.seed(1)
    links = [(i, i + 1) for i in range(50)] + [(100 + random.randint(0, 30), 100 + random.randint(0, 30)) for _ in range(25)] + [(7, 7)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    assert found == {x: top(x) for x in list(up)}


def vectors(spark, x, ids=None):
    rows = [(int(i), v) for i, v in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def recall(found, x, k=20):
    """Share of true neighbours found by all queries; checks ranks, scores and order."""
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    x, right = x.astype(float), []
    assert set(by) == set(range(0, len(x), 20))
    for q, rows in by.items():
        rows.sort(key=lambda r: r["rank"])
        scores = (x * x[q]).sum(1)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -scores))[:k]
        right.append(len({r.vec_id for r in rows} & set(best.tolist())) / k)
        assert [r["rank"] for r in rows] == list(range(1, k + 1)) and np.allclose([r.score for r in rows], scores[[r.vec_id for r in rows]], atol=1e-12)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
    return np.mean(right)


def test_neighbours_reach_the_recall(spark, monkeypatch):
    for name, value in (("CELL", 100), ("BLOCK", 20), ("RUN", 2), ("STEP", 7)):
        monkeypatch.setattr(ann_tree, name, value)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (5, 16))[rng.integers(0, 5, 800)] + rng.normal(0, 0.4, (800, 16)), np.tile(rng.normal(0, 1, (1, 16)), (300, 1))]).astype(np.float32)
    odd = [None, [], [float("nan")] * 16, [0.0] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    df = vectors(spark, x.tolist()).unionByName(vectors(spark, odd, range(5000, 5000 + len(odd))))
    assert recall(ann_tree.nearest(df).collect(), x) >= 0.9


def test_many_neighbours_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann_tree, "BLOCK", 20)
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 1, (200, 16))[rng.integers(0, 200, 20_000)] + rng.normal(0, 0.3, (20_000, 16))).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    assert recall(ann_tree.nearest(rows).collect(), x) >= 0.9


def test_few_vectors(spark):
    found = ann_tree.nearest(vectors(spark, [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0]], [0, 1, 2])).collect()
    assert [(r.vec_id, r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert ann_tree.nearest(vectors(spark, [])).count() == 0
    assert ann_tree.nearest(vectors(spark, [[1.0]], [20])).count() == 0


def test_vectors_with_repeated_ids_ties_and_lengths(spark):
    rows = [([1.0, 0.0], 0), ([1.0, 0.0], 0), ([2.0, 0.0], 3), ([2.0, 0.0], 1), ([2.0, 0.0], 3), ([0.0, 1.0], 2), ([1.0] * 3, 20), ([2.0] * 3, 5), ([0.0] * 3, 6)]
    df = vectors(spark, [v for v, _ in rows], [i for _, i in rows]).selectExpr("*", "1 AS score")
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann_tree.nearest(df).collect())
    assert found == [(0, 1, 1, 2.0), (0, 2, 3, 2.0), (0, 3, 3, 2.0), (0, 4, 2, 0.0), (20, 1, 5, 6.0)]


def test_pipeline_stages_of_odd_tables(spark):
    import corpus_pipeline as pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    said = " ".join(f"word{i}" for i in range(30))
    rows = [(1, said, "en", "s", 9), (1, said, "en", "s", 9), (2, said, None, "s", 9), (None, said, "en", None, None), (3, None, "en", "s", 0), (4, "", None, "s", 0), (5, "12 3!", "de", "s", 5), (6, said + " end", "en", "s", 9), (6, "another", "en", "s", 9)]
    kept = {
        "language ID": [1, 1, 2, None, 6, 6],
        "n-gram Jaccard join": [1, None, 3, 4, 5, 6],
        "suffix-array dedup": [1, 1, None, 3, 4, 5, 6, 6],
        "benchmark decontamination": [1, 1, 2, None, 3, 4, 5, 6, 6],
        "byte-level BPE": [1, 1, 2, None, 3, 4, 5, 6, 6],
    }
    order = lambda ids: sorted(ids, key=lambda i: i or 0)
    for name, stage in pipeline.STAGES:
        found = stage(spark, spark.createDataFrame(rows, columns), SF).collect()
        assert order(r.doc_id for r in found) == order(kept[name]), name
        assert stage(spark, spark.createDataFrame([], columns), SF).count() == 0, name
        if name == "language ID":
            assert {r.lang for r in found} == {"en"}  # null in 2
        if name == "n-gram Jaccard join":
            assert [r.text for r in found if r.doc_id == 6] == ["another"]
    unlabelled = spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in rows], columns)
    assert order(r.doc_id for r in pipeline.identify_language(spark, unlabelled, SF).collect()) == order(kept["language ID"])


def test_pipeline_leaves_one_copy(spark, tmp_path, monkeypatch):
    import corpus_pipeline as pipeline
    from skilltide.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    assert pipeline.run(spark, SF).count() > 0
    assert [p.name[:4] for p in tmp_path.iterdir()] == ["byte"]


def test_pipeline_keeps_and_drops(spark):
    from pyspark.sql import functions as F

    import corpus_pipeline as pipeline
    from skilltide.llm.common import staged

    kept = docs_in = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        before = kept
        kept = staged(stage(spark, before, SF), "t")
        seen[name] = (before, kept)
        if name != pipeline.STAGES[-1][0]:
            assert kept.columns == docs_in.columns
    from skilltide.llm import language_id

    before, after = seen["language ID"]
    judged = language_id.predict(before, language_id.train(before.where(~language_id.held_out(F.col("doc_id"))))).collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= 0.5}
    before, after = seen["n-gram Jaccard join"]
    groups = brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert {r.doc_id for r in after.collect()} == {c for _, c in groups.values()}
    before, after = seen["suffix-array dedup"]
    dedup = brute_dedup([(r.doc_id, r.text) for r in before.collect()])
    for r in after.collect():
        assert dedup[r.doc_id][1] == 0 or len(r.text.encode()) <= dedup[r.doc_id][0] - dedup[r.doc_id][1]
    before, after = seen["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = brute_items([(r.doc_id, r.text) for r in before.collect()], items)
    assert {r.doc_id for r in after.collect()} == {i for i, v in judged.items() if not v[3]}
    assert kept.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and kept.count() == after.count()
