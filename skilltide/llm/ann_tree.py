"""Approximate nearest neighbours by a hierarchical k-means tree.

The upper levels of the tree are fitted on a sample of at most about SAMPLE vectors, down to cells
of about CELL vectors each, BRANCH cells at least; they are broadcast, and the sample bounds their
size. Every vector goes to the cell it descends to. A cell's vectors are dealt over as many units
as hold about CELL each, and each unit fits the lower levels on all vectors it holds, down to leaves
of about LEAF. So leaves are as many as the table needs, and a hot vector is dealt over many units.

A query walks the upper levels best bin first, through a priority queue by the inner product with
the centres, and visits a number of cells; in their units it walks the lower levels the same way
and visits a number of leaves of each. Both numbers are widened until the queries of a calibration
sample, whose true neighbours come from brute force over all vectors, reach the wanted recall.

Queries of a cell come in blocks, and a block meets a run of units as a stream: one unit is in
memory at a time, and k rows for each query leave the run.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, staged, table, tidy

SAMPLE, LEAF, BRANCH = 20_000, 32, 8
#: Vectors in a unit, queries in a block, and units that one block meets in one run. They change the dealing only.
CELL, BLOCK, RUN = 8192, 4096, 64
#: Queries that calibrate, and the recall they have to reach.
CALIBRATION, RECALL = 200, 0.95
#: Queries scored at a time.
STEP = 256


@dataclass
class Tree:
    """centres: a row for each node; below: first child and end of the children of each, equal for a leaf; leaf: its number, or -1."""

    centres: np.ndarray
    below: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, limit: int = LEAF, seed: int = 11) -> Tree:
        """Nodes of more rows than limit are split, unless their rows are equal."""
        rng = np.random.default_rng(seed)
        centres, below, todo = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [(0, 0)], [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if len(rows) <= limit:
                continue
            means, labels = _kmeans(x[rows], min(BRANCH, -(-len(rows) // limit) + 1), rng)
            if len(means) < 2:
                continue
            below[at] = (len(centres), len(centres) + len(means))
            for i, mean in enumerate(means):
                todo.append((len(centres), rows[labels == i]))
                centres.append(mean)
                below.append((0, 0))
        below = np.array(below)
        ends = below[:, 0] == below[:, 1]
        return Tree(np.array(centres), below, np.where(ends, np.cumsum(ends) - 1, -1))

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row descends to, by nearest centres."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            a, b = self.below[at]
            if a == b:
                out[rows] = self.leaf[at]
            elif len(rows):
                c = self.centres[a:b]
                near = (x[rows] @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
                todo += [(a + i, rows[near == i]) for i in range(b - a)]
        return out

    def walk(self, scores: list[float], held: list[int], visits: int, least: int) -> Iterator[int]:
        """Leaves, best bin first, by the inner products of a query with the centres.

        Until visits leaves that hold vectors, and least vectors in them, were visited.
        """
        below, leaf = self.below.tolist(), self.leaf.tolist()
        queue, seen, n = [(0.0, 0)], 0, 0
        while queue and (seen < visits or n < least):
            _, at = heapq.heappop(queue)
            a, b = below[at]
            if a == b:
                if held[leaf[at]]:
                    seen, n = seen + 1, n + held[leaf[at]]
                    yield leaf[at]
            else:
                for node in range(a, b):
                    heapq.heappush(queue, (-scores[node], node))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's rounds from distinct rows; empty means are dropped."""
    means = np.unique(x[rng.choice(len(x), min(len(x), 4 * k), replace=False)], axis=0)
    means = means[rng.choice(len(means), min(k, len(means)), replace=False)]
    for _ in range(rounds):
        labels = (x @ means.T - 0.5 * (means**2).sum(1)).argmax(1)
        n = np.bincount(labels, minlength=len(means))
        order = np.argsort(labels, kind="stable")
        held = np.flatnonzero(n)
        means = np.add.reduceat(x[order], (np.cumsum(n) - n)[held]) / n[held, None]
    labels = (x @ means.T - 0.5 * (means**2).sum(1)).argmax(1)
    held = np.unique(labels)
    return means[held], np.searchsorted(held, labels)


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same for equal rows wherever they stand."""
    return np.add.reduce(rows * query, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array<double>) of vectors that take part: not null, not zero, finite throughout."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(fine)


@dataclass
class Unit:
    """Some vectors of a cell in order of their leaves, with the lower levels of the tree."""

    ids: np.ndarray
    x: np.ndarray
    cuts: np.ndarray
    tree: Tree

    @staticmethod
    def fit(ids: np.ndarray, x: np.ndarray) -> Unit:
        order = np.lexsort((*x.T, ids))  # whatever the order in which rows come
        ids, x = ids[order], x[order]
        tree = Tree.fit(x)
        leaf = tree.assign(x)
        order = np.argsort(leaf, kind="stable")
        return Unit(ids[order], x[order], np.searchsorted(leaf[order], np.arange(tree.leaves + 1)), tree)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=self.x, cuts=self.cuts, centres=self.tree.centres, below=self.tree.below, leaf=self.tree.leaf)
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Unit:
        held = np.load(io.BytesIO(data))
        return Unit(held["ids"], held["x"], held["cuts"], Tree(held["centres"], held["below"], held["leaf"]))

    def visited(self, queries: np.ndarray, visits: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """By leaf, the queries that visit it and at which place in their order."""
        held, leaves = np.diff(self.cuts).tolist(), self.tree.leaves
        found: list[tuple[list[int], list[int]]] = [([], []) for _ in range(leaves)]
        for i, scores in enumerate((queries @ self.tree.centres.T).tolist()):
            for place, leaf in enumerate(self.tree.walk(scores, held, visits, least)):
                found[leaf][0].append(i)
                found[leaf][1].append(place)
        return [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in found]


class Best:
    """The k best of each of some queries so far: ids, scores and a mark, by score, then id."""

    def __init__(self, own: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.own, self.queries, self.k = own, queries, k
        self.ids, self.marks = np.zeros((len(own), k), np.int64), np.zeros((len(own), k), np.int64)
        self.scores = np.full((len(own), k), -np.inf)

    def add(self, at: int, ids: np.ndarray, x: np.ndarray, rough: np.ndarray, marks: np.ndarray | None = None) -> None:
        """Takes in rows for the queries from at on; rough: inner products by query and row, -inf where a row is not visited."""
        k, own, queries = self.k, self.own[at : at + len(rough)], self.queries[at : at + len(rough)]
        rough[own[:, None] == ids] = -np.inf
        bar = self.scores[at : at + len(rough), -1]
        if len(ids) > k:
            bar = np.maximum(bar, np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k])
        slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(bar), bar, 0.0)))
        i, j = np.nonzero((rough >= (bar - slack)[:, None]) & np.isfinite(rough))
        exact = exact_scores(x[j], queries[i])
        here, n = np.unique(i), len(self.ids[0])
        # what was held before competes with the new rows
        i = np.concatenate([i, np.repeat(here, n)])
        exact = np.concatenate([exact, self.scores[at + here].ravel()])
        found = np.concatenate([ids[j], self.ids[at + here].ravel()])
        mark = np.concatenate([np.zeros(len(j), np.int64) if marks is None else marks[i[: len(j)], j], self.marks[at + here].ravel()])
        order = np.lexsort((found, -exact, i))
        i, exact, found, mark = i[order], exact[order], found[order], mark[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        for held, new in ((self.ids, found), (self.scores, exact), (self.marks, mark)):
            held[at + i[keep], place[keep]] = new[keep]

    def rows(self) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(self.own[i], pa.int64()), pa.array(self.ids[i, j], pa.int64()), pa.array(self.scores[i, j], pa.float64()), pa.array(self.marks[i, j], pa.int64())], names=["query_id", "vec_id", "score", "mark"])


FOUND = "query_id long, vec_id long, score double, mark long"


def cells(upper: Tree, held: np.ndarray, queries: np.ndarray, visits: int, least: int) -> list[list[int]]:
    """The cells of each query, best bin first, as many as asked for, and enough to hold least vectors."""
    counts = held.tolist()
    return [list(upper.walk(scores, counts, visits, least)) for scores in (queries @ upper.centres.T).tolist()] if len(queries) else []


class Index:
    """A tree over all valid vectors of one length; the units are a table in the shared folder."""

    def __init__(self, vectors: DataFrame, k: int = 20, sample: int = SAMPLE) -> None:
        """vectors: vec_id and v, as from valid(), all of one length."""
        spark = vectors.sparkSession
        shared_dir(spark)
        self.k, self.vectors = k, vectors
        n = vectors.count()
        share = max(1, min(1 << 20, (sample << 20) // max(1, n)))
        rows = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) < share).select("v").toArrow()
        x = _matrix(rows["v"].combine_chunks()) if rows.num_rows else np.zeros((1, 1))
        cells = max(BRANCH, -(-n // CELL))
        self.upper = Tree.fit(x[np.lexsort(x.T)], max(LEAF, len(x) // cells))
        shared = spark.sparkContext.broadcast(self.upper)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng(TaskContext.get().partitionId())
            for batch in batches:
                cell = shared.value.assign(_matrix(batch.column("v"))) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(rng.random(batch.num_rows)), batch.column("vec_id"), batch.column("v")], names=["cell", "deal", "vec_id", "v"])

        # stored, so that the dealing by deal is the same for all that read it
        assigned = staged(vectors.mapInArrow(tidy(assign), "cell int, deal double, vec_id long, v array<double>"), "ann-cells")
        counts = assigned.groupBy("cell").count()
        self.held = np.zeros(self.upper.leaves, np.int64)  # of each cell; the sample bounds their number
        for row in counts.collect():
            self.held[row["cell"]] = row["count"]

        def fit(rows: pa.Table) -> pa.Table:
            unit = Unit.fit(rows["vec_id"].to_numpy(), _matrix(rows["v"].combine_chunks()))
            return pa.table({"cell": rows["cell"].slice(0, 1), "unit": rows["unit"].slice(0, 1), "data": pa.array([unit.pack()], pa.binary())})

        units = F.ceil(F.col("count") / CELL)
        dealt = assigned.join(counts, "cell").withColumn("unit", F.floor(F.col("deal") * units).cast("int"))
        self.units = staged(dealt.select("cell", "unit", "vec_id", "v").groupBy("cell", "unit").applyInArrow(fit, "cell int, unit int, data binary"), "ann-units", "uncompressed")

    def calibrate(self, queries: DataFrame, recall: float = RECALL, number: int = CALIBRATION) -> tuple[int, int]:
        """The least numbers of cells, and of leaves in each unit, with which a sample of queries reaches the recall.

        Half of the neighbours that may be missed are allowed to the cells, half to the leaves.
        """
        some = queries.orderBy(F.xxhash64("query_id", F.lit(2)), "query_id").limit(number).toArrow()
        if not some.num_rows:
            return 1, 1
        x, own, k = _matrix(some["v"].combine_chunks()), some["query_id"].to_numpy(), self.k
        places = [{cell: r for r, cell in enumerate(order)} for order in cells(self.upper, self.held, x, self.upper.leaves, 0)]
        ranks = np.array([[p.get(cell, 0) for cell in range(self.upper.leaves)] for p in places])
        shared = queries.sparkSession.sparkContext.broadcast((x, own, ranks))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, own, ranks = shared.value
            best = Best(own, x, k)
            for batch in batches:
                for cell, data in zip(batch.column("cell").to_pylist(), batch.column("data"), strict=True):
                    unit = Unit.unpack(data.as_py())
                    place = np.zeros((len(x), unit.tree.leaves), np.int64)
                    for leaf, (who, when) in enumerate(unit.visited(x, unit.tree.leaves, 0)):
                        place[who, leaf] = when
                    marks = (ranks[:, cell, None] << 32) + np.repeat(place, np.diff(unit.cuts), axis=1)
                    for at in range(0, len(x), STEP):
                        best.add(at, unit.ids, unit.x, x[at : at + STEP] @ unit.x.T, marks[at : at + STEP])
            yield best.rows()

        marks = top(self.units.mapInArrow(tidy(exact), FOUND), k).select("mark").toPandas()["mark"].to_numpy()
        if not len(marks):
            return 1, 1
        both = (1 + recall) / 2
        return tuple(int(np.quantile(m, both, method="higher")) + 1 for m in (marks >> 32, marks & 0xFFFFFFFF))

    def search(self, queries: DataFrame, recall: float = RECALL) -> DataFrame:
        """query_id, rank, vec_id and score of each query's k nearest; queries: query_id and v, of indexed length.

        A query_id with several rows asks once, with its least vector. Rows with the vec_id of a
        query are not among its neighbours; other vec_ids with several rows are there for each.
        """
        spark, k = queries.sparkSession, self.k
        queries = staged(queries.groupBy("query_id").agg(F.min("v").alias("v")), "ann-queries")
        visits, leaves = self.calibrate(queries, recall)
        shared = spark.sparkContext.broadcast((self.upper, self.held))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng(TaskContext.get().partitionId())
            for batch in batches:
                found = cells(*shared.value, _matrix(batch.column("v")), visits, k + 1)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("v"), pa.array(found, pa.list_(pa.int32())), pa.array(rng.random(batch.num_rows))], names=["query_id", "q", "cells", "deal"])

        asked = queries.mapInArrow(tidy(route), "query_id long, q array<double>, cells array<int>, deal double")
        asked = staged(asked.select("query_id", "q", "deal", F.explode("cells").alias("cell")), "ann-asked")
        counts = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        runs = self.units.groupBy("cell").agg(F.floor((F.count("*") - 1) / RUN).cast("int").alias("last_run"))  # a row for each cell, as counts

        def pack(rows: pa.Table) -> pa.Table:
            out = io.BytesIO()
            order = np.argsort(rows["query_id"].to_numpy())
            np.savez(out, own=rows["query_id"].to_numpy()[order], q=_matrix(rows["q"].combine_chunks())[order])
            return pa.table({"cell": rows["cell"].slice(0, 1), "block": rows["block"].slice(0, 1), "data": pa.array([out.getvalue()], pa.binary())})

        blocks = asked.join(counts, "cell").withColumn("block", F.floor(F.col("deal") * F.col("blocks")).cast("int"))
        blocks = blocks.select("cell", "block", "query_id", "q").groupBy("cell", "block").applyInArrow(pack, "cell int, block int, data binary")
        # each block of queries once for each run of units, before them; each unit once for each block
        left = blocks.join(runs, "cell").select("cell", "block", F.explode(F.sequence(F.lit(0), "last_run")).alias("run"), F.lit(-1).alias("unit"), "data")
        right = self.units.join(counts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.floor(F.col("unit") / RUN).cast("int").alias("run"), "unit", "data")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                for number, data in zip(batch.column("unit").to_pylist(), batch.column("data"), strict=True):
                    if number < 0:
                        if best is not None:
                            yield best.rows()
                        held = np.load(io.BytesIO(data.as_py()))
                        best = Best(held["own"], held["q"], k)
                        continue
                    unit = Unit.unpack(data.as_py())
                    for at in range(0, len(best.own), STEP):
                        q = best.queries[at : at + STEP]
                        rough = np.full((len(q), len(unit.ids)), -np.inf)
                        for leaf, (who, _) in enumerate(unit.visited(q, leaves, k + 1)):
                            a, b = unit.cuts[leaf], unit.cuts[leaf + 1]
                            if len(who):
                                rough[who, a:b] = q[who] @ unit.x[a:b].T
                        best.add(at, unit.ids, unit.x, rough)
            if best is not None:
                yield best.rows()

        both = left.unionByName(right).repartition("cell", "block", "run").sortWithinPartitions("cell", "block", "run", "unit")
        return top(both.select("unit", "data").mapInArrow(tidy(score), FOUND), k).select("query_id", "rank", "vec_id", "score")


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of the rows of vectors (vec_id, embedding) that queries selects.

    Vectors that are null, zero, or hold nulls or numbers that are not finite take no part.
    Vectors of different lengths have no inner product, so each length has an index of its own.
    An empty table gives no rows.
    """
    rows, out = valid(vectors), None
    for dim in [r["dim"] for r in rows.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]:
        own = rows.where(F.size("v") == dim)
        found = Index(own, k).search(own.where(queries).select(F.col("vec_id").alias("query_id"), "v"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def op6_ann_tree(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
