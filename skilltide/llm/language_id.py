"""Language ID by a byte convolutional network: filters of several widths over bytes, max pooling
and a softmax layer, trained in numpy on labelled documents and applied to fixed-length windows.

Windows cover whole texts. The network is fitted on a sample of at most SAMPLE documents of each
language, the first by a hash of doc_id, and WINDOWS evenly spaced windows of each; that bounds
what reaches the driver by the number of languages. Everything else reads all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import added, blobs, slices, table, texts, tidy

WIDTHS, FILTERS, LENGTH = (2, 3, 4), 8, 192
SAMPLE, WINDOWS = 600, 4
UNKNOWN = "und"


@dataclass
class ByteConvNet:
    """filters[w]: a row of FILTERS weights by place and byte; the softmax layer's weights and bias by language."""

    langs: list[str]
    filters: dict[int, np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fit(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 7) -> ByteConvNet:
        """windows: uint8, a row each; labels: places in langs. Adam on cross entropy."""
        rng = np.random.default_rng(seed)
        net = ByteConvNet(langs, {w: rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS}, rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(langs))), np.zeros(len(langs)))
        held = [*net.filters.values(), net.dense, net.bias]
        first, second, step = [np.zeros_like(x) for x in held], [np.zeros_like(x) for x in held], 0
        weight = len(labels) / np.maximum(1, np.bincount(labels, minlength=len(langs))) / len(langs)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                x, y = windows[order[at : at + batch]], labels[order[at : at + batch]]
                pooled, where = [], []
                for w, f in net.filters.items():
                    z = sum(f[j][x[:, j : x.shape[1] - w + 1 + j]] for j in range(w))
                    where.append(z.argmax(1))
                    pooled.append(np.take_along_axis(z, where[-1][:, None], 1)[:, 0])
                h = np.tanh(np.concatenate(pooled, 1))
                d = _softmax(h @ net.dense + net.bias)
                d[np.arange(len(y)), y] -= 1
                d *= weight[y][:, None] / len(y)
                back = d @ net.dense.T * (1 - h**2)
                grads = []
                for i, w in enumerate(WIDTHS):
                    g, own = np.zeros((w, 256, FILTERS)), back[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(x, where[i] + j, 1), np.arange(FILTERS)[None]), own)
                    grads.append(g)
                step += 1
                for p, g, m, v in zip(held, [*grads, h.T @ d + 1e-4 * net.dense, d.sum(0)], first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return net

    def tables(self) -> ConvTables:
        one = {w: f.astype(np.float32) for w, f in self.filters.items()}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        return ConvTables(pair(*one[2]), pair(one[3][0], one[3][1]), one[3][2], pair(one[4][0], one[4][1]), pair(one[4][2], one[4][3]), self)


@dataclass
class ConvTables:
    """Sums of filter weights by pairs of bytes, so that a filter of width 4 is two lookups."""

    two: np.ndarray
    three: np.ndarray
    third: np.ndarray
    four: np.ndarray
    fourth: np.ndarray
    net: ByteConvNet

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """A row for each window; place by place over all windows at once."""
        by_place = np.ascontiguousarray(windows.T).astype(np.intp)
        pairs = by_place[:-1] * 256 + by_place[1:]
        best = [np.full((len(windows), FILTERS), -np.inf, np.float32) for _ in WIDTHS]
        a, b = np.empty_like(best[0]), np.empty_like(best[0])
        for p in range(len(pairs)):
            np.maximum(best[0], self.two.take(pairs[p], 0, a, "clip"), best[0])
            if p + 1 < len(pairs):
                np.add(self.three.take(pairs[p], 0, a, "clip"), self.third.take(by_place[p + 2], 0, b, "clip"), a)
                np.maximum(best[1], a, best[1])
            if p + 2 < len(pairs):
                np.add(self.four.take(pairs[p], 0, a, "clip"), self.fourth.take(pairs[p + 2], 0, b, "clip"), a)
                np.maximum(best[2], a, best[2])
        return _softmax(np.tanh(np.concatenate(best, 1).astype(np.float64)) @ self.net.dense + self.net.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def cut(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, filled up with zeros; of each, its text and number of bytes."""
    n = np.array([len(b) for b in data], np.int64)
    many = -(-n // LENGTH)
    owner = np.repeat(np.arange(len(data)), many)
    joined = b"".join(b + bytes(-len(b) % LENGTH) for b in data)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    return np.frombuffer(joined, np.uint8).reshape(-1, LENGTH), owner, np.minimum(LENGTH, n[owner] - place * LENGTH)


def train(labelled: DataFrame, sample: int = SAMPLE, each: int = WINDOWS) -> ByteConvNet | None:
    """A network for the languages in labelled (doc_id, text, lang); None if there are none.

    Rows without doc_id, text or lang, and empty texts, teach nothing; rows that say the same count once.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text <> '' AND doc_id IS NOT NULL")
    # about twice the sample by a share of the hash, so that no more than that is ranked of a language
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each output of the network, which the driver fits and all workers hold
    some = labelled.join(F.broadcast(counts), "lang").where(place * F.col("n") <= 2 * sample).select("doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[text[at : at + LENGTH].ljust(LENGTH, b"\0") for at in np.unique(np.linspace(0, max(0, len(text) - LENGTH), each).astype(int))] for text in blobs(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "lang", "windows"])

    kind = labelled.schema["doc_id"].dataType.simpleString()
    made = some.mapInArrow(tidy(run), f"doc_id {kind}, lang string, windows array<binary>").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id", "windows"))
    rows = made.withColumn("rank", rank).where(F.col("rank") <= sample).select("doc_id", "lang", F.explode("windows").alias("window")).toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("window", "ascending")])
    langs = sorted(set(rows["lang"].to_pylist()))
    place = {x: i for i, x in enumerate(langs)}
    windows = np.frombuffer(b"".join(rows["window"].to_pylist()), np.uint8).reshape(-1, LENGTH)
    return ByteConvNet.fit(windows, np.array([place[x] for x in rows["lang"].to_pylist()]), langs)


def _has_letter(text: str) -> bool:
    return re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text))


def predict(docs: DataFrame, net: ByteConvNet | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (mean probability over all windows, by their bytes).

    Texts that are null or have no letter are `und` with score 0, and all are if net is None.
    Columns of docs with those names are replaced; repeated rows are judged each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in {"lang_pred", "score"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables() if net else None
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                langs, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if tables:
                    windows, owner, size = cut(blobs(part, text))
                    total = np.zeros((part.num_rows, len(net.langs)))
                    for at in range(0, len(windows), 2048):
                        np.add.at(total, owner[at : at + 2048], tables.probabilities(windows[at : at + 2048]) * size[at : at + 2048, None])
                    total /= np.maximum(1, total.sum(1, keepdims=True))
                    best = total.argmax(1)
                    for i, said in enumerate(texts(part, text)):
                        if _has_letter(said):
                            langs[i], scores[i] = net.langs[best[i]], min(1.0, total[i, best[i]])
                yield added(part, lang_pred=pa.array(langs, pa.string()), score=pa.array(scores, pa.float64()))

    return docs.mapInArrow(tidy(run), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string", "score double"]))


def held_out(doc_id: Column) -> Column:
    """Whether a document takes no part in learning: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), net).drop("text")
