"""Quality scores by gradient-boosted trees over statistics of documents.

Statistics come from whole texts, in numpy over the bytes of many texts at once: sizes, shares of
byte classes and of each ASCII sign, lengths and repeats of words, word pairs and lines. Trees are
fitted on histograms of the statistics' bins, a level of a tree at a time, and flattened: each tree
is a full binary tree in arrays of features, thresholds and leaf values, so that all rows walk all
trees in step, one lookup for each level.

The trees are fitted on at most SAMPLE labelled documents, the first by a hash of doc_id; that
bounds what reaches the driver. Scoring reads all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, blobs, slices, table, tidy
from .words import VISIBLE, span_hash, words

SAMPLE = 16_000
TREES, DEPTH, BINS, RATE, SMOOTH, LEAST = 80, 4, 64, 0.2, 1.0, 20
#: A score of this or more is the better quality.
BAR = 0.3

_SIGNS = [b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]


def _flags(*ranges: tuple[int, int]) -> np.ndarray:
    held = np.zeros(256)
    for a, b in ranges:
        held[a : b + 1] = 1
    return held


#: Digits, upper-case letters, letters, white space, control bytes, bytes beyond ASCII, signs.
_CLASSES = np.array([_flags((48, 57)), _flags((65, 90)), _flags((65, 90), (97, 122)), _flags((32, 32), (9, 13)), _flags((0, 8), (14, 31), (127, 127)), _flags((128, 255)), _flags((33, 47), (58, 64), (91, 96), (123, 126))]).T


def _repeats(owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int) -> list[np.ndarray]:
    """By owner: the share of distinct hashes, the share of the weight in those that recur, the largest share of one."""
    total, held = np.bincount(owner, minlength=n), np.bincount(owner, weight, n)
    order = np.lexsort((hashes, owner))
    o, h, w = owner[order], hashes[order], weight[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(o)))
    most = np.zeros(n)
    np.maximum.at(most, o[first], times)
    recurs = np.bincount(o, w * (np.repeat(times, times) > 1), n)
    return [np.bincount(o[first], minlength=n) / np.maximum(1, total), recurs / np.maximum(1, held), most / np.maximum(1, total)]


def statistics(data: list[bytes]) -> np.ndarray:
    """A row of numbers for each text; all are finite, also for empty texts."""
    n = len(data)
    size = np.array([len(b) for b in data], np.int64)
    raw = np.frombuffer(b" ".join([b"", *data, b""]), np.uint8)
    begins = np.cumsum(np.concatenate([[1], size + 1]))[:n]
    owner = np.repeat(np.arange(n), size)
    inside = np.arange(len(owner)) + (np.arange(n) + 1)[owner]
    by_byte = np.bincount(owner * 256 + raw[inside], minlength=n * 256).reshape(n, 256)
    some = np.maximum(1, size)[:, None]
    shares = by_byte / some
    classes = shares @ _CLASSES
    found = words(data, VISIBLE)
    own, length = found.owner, (found.ends - found.starts).astype(np.float64)
    many = np.bincount(own, minlength=n)
    mean = lambda x: np.bincount(own, x, n) / np.maximum(1, many)
    first, last = raw[found.starts], raw[found.ends - 1]
    upper, second = (first >= 65) & (first <= 90), raw[np.minimum(found.starts + 1, len(raw) - 1)]
    pairs = np.flatnonzero(own[1:] == own[:-1]) if len(own) else np.zeros(0, np.int64)
    pair_hash = found.hashes[pairs] * np.uint64(3) ^ found.hashes[pairs + 1]
    same = np.bincount(own[pairs], found.hashes[pairs] == found.hashes[pairs + 1], n) / np.maximum(1, many)
    # lines that are not empty
    breaks = np.flatnonzero(raw == 10)
    cuts = np.sort(np.concatenate([begins - 1, begins + size, breaks]))
    a, b = cuts[:-1] + 1, cuts[1:]
    held = (b > a) & (np.searchsorted(begins, a, "right") > 0)
    a, b = a[held], b[held]
    of = np.searchsorted(begins, a, "right") - 1
    line_hash = span_hash(raw, a, b) if len(a) else np.zeros(0, np.uint64)
    lines = np.bincount(of, minlength=n)
    columns = [
        np.log1p(size), np.log1p(many), np.log1p(lines), *classes.T, classes[:, 1] / np.maximum(classes[:, 2], 1e-9), shares[:, _SIGNS].max(1), *shares[:, _SIGNS].T,
        mean(length), np.sqrt(np.maximum(0, mean(length**2) - mean(length) ** 2)), mean(length <= 3), mean(length >= 20), mean(upper), mean(upper & (second >= 65) & (second <= 90)), mean(VISIBLE[last] & (_CLASSES[last, 6] > 0)), mean(_CLASSES[first, 0] > 0), mean((length == 1) & (_CLASSES[first, 6] > 0)),
        same, *_repeats(own, found.hashes, length, n), *_repeats(own[pairs], pair_hash, np.ones(len(pairs)), n), *_repeats(of, line_hash, (b - a).astype(np.float64), n), np.log1p(size / np.maximum(1, lines)),
    ]
    return np.column_stack(columns) if n else np.zeros((0, len(columns)))


@dataclass
class Trees:
    """feature and threshold: a row for each tree, nodes in the order of a heap; value: its leaves; start: the score before the trees."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
        """y: 0 or 1. Without rows, or with rows of one kind, there are no trees."""
        start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        inner = (1 << depth) - 1
        feature, threshold, value = [np.zeros((0, inner), np.int64)], [np.zeros((0, inner))], [np.zeros((0, inner + 1))]
        if not 0 < y.sum() < len(y):
            return Trees(feature[0], threshold[0], value[0], start)
        n, wide = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(wide)]
        codes = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
        places = codes + np.arange(wide) * bins  # of each row and statistic: the bin's place in a node's histogram
        ends = np.array([len(e) for e in edges])
        possible = (np.arange(bins)[None] < ends[:, None]).ravel()
        score = np.full(n, start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            f, t, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
            for level in range(depth):
                first, nodes = (1 << level) - 1, 1 << level
                where = ((at - first)[:, None] * (wide * bins) + places).ravel()
                left = [np.bincount(where, np.repeat(v, wide), nodes * wide * bins).reshape(nodes, wide, bins).cumsum(2) for v in (g, h, np.ones(n))]
                total = [v[:, :1, -1:] for v in left]
                gain = left[0] ** 2 / (left[1] + SMOOTH) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + SMOOTH) - total[0] ** 2 / (total[1] + SMOOTH)
                fine = possible.reshape(1, wide, bins) & (left[2] >= LEAST) & (total[2] - left[2] >= LEAST)
                gain = np.where(fine, gain, -np.inf).reshape(nodes, -1)
                best = gain.argmax(1)
                for node in np.flatnonzero(gain[np.arange(nodes), best] > 1e-6):
                    j, c = divmod(int(best[node]), bins)
                    f[first + node], t[first + node] = j, edges[j][c]
                at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
            leaf = at - inner
            v = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + SMOOTH)
            score += v[leaf]
            feature.append(f[None])
            threshold.append(t[None])
            value.append(v[None])
        return Trees(np.concatenate(feature), np.concatenate(threshold), np.concatenate(value), start)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, by row; all trees in step."""
        number, inner = self.feature.shape
        out, every = np.full(len(x), self.start), np.arange(number)[None]
        for a in range(0, len(x), 4096):
            rows = x[a : a + 4096]
            at, own = np.zeros((len(rows), number), np.int64), np.arange(len(rows))[:, None]
            while number and at[0, 0] < inner:  # all are on one level
                at = 2 * at + 1 + (rows[own, self.feature[every, at]] > self.threshold[every, at])
            out[a : a + 4096] += self.value[every, at - inner].sum(1)
        return 1 / (1 + np.exp(-out))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from labels (doc_id, quality) and the texts of docs (doc_id, text).

    Labels other than 0 and 1, and rows without doc_id, teach nothing; repeated labels count once,
    and contradicting ones each. Of a doc_id with several texts the least statistics teach. A null
    text counts as empty.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)
    # about twice the sample by a share of the hash, so that no more than that is sorted
    some = known.where(place * max(1, known.count()) <= 2 * sample).distinct().orderBy(place, "doc_id", "quality").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = statistics(blobs(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # at most sample rows of two numbers are broadcast
    made = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text").mapInArrow(tidy(run), f"doc_id {kind}, quality int, x array<double>")
    rows = made.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    x = np.array(rows["x"].to_pylist()) if rows.num_rows else np.zeros((0, 1))
    return Trees.fit(x, rows["quality"].to_numpy().astype(np.float64))


def score(docs: DataFrame, trees: Trees, text: str = "text", bar: float = BAR) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= bar, else 0).

    Null texts count as empty and are scored too. Columns of docs with those names are replaced, all
    others pass; repeated rows are scored each, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in {"score", "predicted"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                p = shared.value.probabilities(statistics(blobs(part, text)))
                yield added(part, score=pa.array(p, pa.float64()), predicted=pa.array(p >= bar).cast(pa.int32()))

    return docs.mapInArrow(tidy(run), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["score double", "predicted int"]))


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in learning: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op12_quality_trees(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), trees).drop("text")
