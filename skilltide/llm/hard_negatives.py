"""Hard negatives: windows of inner products, searched in vantage-point trees.

Vectors get one more component that gives all of them the largest norm M, anchors get a zero there.
Then the squared distance of an anchor q and a row x is |q|^2 + M^2 - 2 q.x: the largest inner product
is the nearest row, and a window of scores is a ring of distances around the anchor.

The upper tree is fitted on at most SAMPLE vectors and broadcast. Every vector goes to the cell it
descends to; cells are dealt over units of about CELL vectors, and each unit has a tree of its own
over all its vectors. Of every cell the least and largest distance to each vantage point above it is
taken over all its vectors, so a search knows which scores a cell can hold. A search goes over
nodes and rows in one queue, nearest first, leaves out what lies outside the ring, and stops when
it has its k rows. First it visits the cells that come first and hold NEAR rows; the k-th score found
there is a floor, and only cells that can reach it and meet the ring are visited after that. No
cell is left out otherwise, so results are exact.

Searches of a cell come in blocks, and a block meets a run of units as a stream: one unit is in
memory at a time, and k rows for each search leave the run.
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

#: Vectors that the upper tree is fitted on, in a cell of theirs at least, in a leaf of a unit.
SAMPLE, FEWEST, LEAF = 20_000, 8, 256
#: Vectors in a unit, searches in a block, units that one block meets in one run, rows that the cells of the first round hold.
CELL, BLOCK, RUN, NEAR = 8192, 4096, 64, 16_384
POSITIVES, NEGATIVES = 5, 10


def prepared(vectors: DataFrame, flip: int = 7, labels: int = 10, scale: int = 256) -> DataFrame:
    """vec_id, label and v (array<double>) of the rows that take part; vectors: vec_id, embedding, label.

    Rows with a null vec_id, label or vector, an empty vector or one with a null or non-finite
    component take no part. Where flip divides vec_id, label becomes (label + 1) % labels. Each
    component x becomes floor(scale * x). A vec_id with several rows counts once, with the least of
    label and vector. Inner products are exact while they stay below 2**53.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(fine)
    label = F.when(F.col("vec_id") % flip == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    # beyond 2**53 every double is whole, and floor() to long would overflow
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)
    rows = rows.select("vec_id", label.alias("label"), F.transform("v", whole).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


@dataclass
class Tree:
    """Nodes of a vantage-point tree over vectors augmented to the norm M; a row of each array for each node.

    point: its vantage point, without the added component, which is in extra; below: its nearer child,
    the farther one follows it, or 0 for a leaf; span: the least and largest distance of its rows to
    the vantage point of the node above; rows: where its rows start and end in the order of the tree.
    """

    norm: float
    point: np.ndarray
    extra: np.ndarray
    below: np.ndarray
    span: np.ndarray
    rows: np.ndarray
    lists: tuple[list, list] | None = None

    @staticmethod
    def extras(x: np.ndarray, norm: float) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(1)))

    @staticmethod
    def fit(x: np.ndarray, norm: float, limit: int, seed: int = 5) -> tuple[Tree, np.ndarray]:
        """The tree, and the order of the rows in it. Nodes of more than limit rows are halved by distance, unless their rows are equal."""
        rng = np.random.default_rng(seed)
        extra, order = Tree.extras(x, norm), np.arange(len(x))
        point, held, below, span, rows, todo = [np.zeros(x.shape[1])], [0.0], [0], [(0.0, np.inf)], [(0, len(x))], [0]
        while todo:
            node = todo.pop()
            a, b = rows[node]
            if b - a <= limit:
                continue
            own = order[a:b]
            # of some rows the one that spreads a sample of the node most
            tried, some = own[rng.integers(0, b - a, 4)], own[rng.integers(0, b - a, 64)]
            spread = [np.std(distances(x[some], extra[some], x[t], extra[t], norm)) for t in tried]
            at = tried[int(np.argmax(spread))]
            d = distances(x[own], extra[own], x[at], extra[at], norm)
            by = np.argsort(d, kind="stable")
            cut = int(np.searchsorted(d[by], d[by[(b - a) // 2]]))  # equal distances stay together
            cut = cut if cut else int(np.searchsorted(d[by], d[by[0]], "right"))
            if cut == b - a:
                continue
            order[a:b], d = own[by], d[by]
            point[node], held[node], below[node] = x[at], extra[at], len(point)
            for start, end in ((0, cut), (cut, b - a)):
                todo.append(len(point))
                point.append(np.zeros(x.shape[1]))
                held.append(0.0)
                below.append(0)
                span.append((float(d[start]), float(d[end - 1])))
                rows.append((a + start, a + end))
        return Tree(norm, np.array(point), np.array(held), np.array(below), np.array(span), np.array(rows)), order

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.below == 0)

    def unseen(self) -> np.ndarray:
        """For each node: no rows, and no distances."""
        return np.tile((0.0, np.inf, -np.inf), (len(self.below), 1))

    def assign(self, x: np.ndarray, seen: np.ndarray | None = None) -> np.ndarray:
        """The leaf that each row descends to, by the nearer span.

        seen takes up, by node, the rows that pass and their distances to the vantage point above.
        """
        out, seen = np.zeros(len(x), np.int64), self.unseen() if seen is None else seen
        extra, todo = Tree.extras(x, self.norm), [(0, np.arange(len(x)), np.zeros(len(x)))]
        while todo:
            node, own, d = todo.pop()
            if not len(own):
                continue
            seen[node] = seen[node, 0] + len(own), min(seen[node, 1], d.min()), max(seen[node, 2], d.max())
            child = self.below[node]
            if not child:
                out[own] = node
                continue
            d = distances(x[own], extra[own], self.point[node], self.extra[node], self.norm)
            far = d > (self.span[child, 1] + self.span[child + 1, 0]) / 2
            todo += [(child, own[~far], d[~far]), (child + 1, own[far], d[far])]
        return out

    def walk(self, q: np.ndarray, low: float, high: float) -> Iterator[tuple[float, int]]:
        """Leaves in which scores from low to high can be, by the largest score each can hold; -score and node."""
        square, slack = float(q @ q) + self.norm**2, 1e-6 * (self.norm + float(np.sqrt(q @ q)) + 1)
        to = np.sqrt(np.maximum(0.0, square - 2 * (self.point @ q))).tolist()
        if self.lists is None:
            self.lists = self.below.tolist(), self.span.tolist()
        below, span = self.lists
        score = lambda d: (square - d * d) / 2
        queue = [(-np.inf, 0, 0.0, np.inf)]
        while queue:
            best, node, near, far = heapq.heappop(queue)
            child = below[node]
            if not child:
                yield best, node
                continue
            d = to[node]
            for node in (child, child + 1):
                a, b = span[node]
                if a > b:
                    continue  # holds nothing
                n, f = max(near, d - b - slack, a - d - slack), min(far, d + b + slack)
                if score(n) >= low - 1 and (not np.isfinite(f) or score(f) <= high + 1):
                    heapq.heappush(queue, (-score(n) - 1, node, n, f))


def distances(x: np.ndarray, extra: np.ndarray, point: np.ndarray, more: float, norm: float) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 * norm * norm - 2 * (x @ point + extra * more)))


@dataclass
class Unit:
    """Some vectors in the order of their tree."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    tree: Tree

    @staticmethod
    def fit(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norm: float) -> Unit:
        first = np.argsort(ids, kind="stable")  # whatever the order in which rows come
        tree, order = Tree.fit(x[first], norm, LEAF)
        order = first[order]
        return Unit(ids[order], labels[order], x[order], tree)

    def pack(self) -> bytes:
        out, t = io.BytesIO(), self.tree
        np.savez(out, ids=self.ids, labels=self.labels, x=self.x, norm=t.norm, point=t.point, extra=t.extra, below=t.below, span=t.span, rows=t.rows)
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Unit:
        h = np.load(io.BytesIO(data))
        return Unit(h["ids"], h["labels"], h["x"], Tree(float(h["norm"]), h["point"], h["extra"], h["below"], h["span"], h["rows"]))

    def leaf(self, node: int, q: np.ndarray, ask: Ask) -> tuple[np.ndarray, np.ndarray]:
        """Negative scores and vec_ids of the rows of a leaf that ask can take, whatever its window, best first."""
        a, b = self.tree.rows[node]
        scores, ids = -(self.x[a:b] @ q), self.ids[a:b]
        fine = (self.labels[a:b] == ask.label) == ask.same
        if ask.same:
            fine &= ids != ask.own
        scores, ids = scores[fine], ids[fine]
        order = np.lexsort((ids, scores))
        return scores[order], ids[order]

    def nearest(self, q: np.ndarray, ask: Ask, k: int, known: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, int]]:
        """Score and vec_id of the k best rows for ask, one after another, largest score first, then smallest vec_id.

        known: leaves as leaf() gives them, kept for other windows of the same anchor and kind.
        """
        queue: list[tuple[float, int]] = []
        given = 0
        for best, node in self.tree.walk(q, ask.low, ask.high):
            while queue and queue[0][0] < best:
                yield -queue[0][0], heapq.heappop(queue)[1]
                given += 1
                if given == k:
                    return
            if node not in known:
                known[node] = self.leaf(node, q, ask)
            scores, ids = known[node]
            a = int(scores.searchsorted(-ask.high))
            b = min(a + k, int(scores.searchsorted(-ask.low, "right")))
            for row in zip(scores[a:b].tolist(), ids[a:b].tolist(), strict=True):
                heapq.heappush(queue, row)
        while queue and given < k:
            s, i = heapq.heappop(queue)
            yield -s, i
            given += 1


@dataclass
class Ask:
    """A search of the anchor own for rows of its label, or of others, with scores from low to high."""

    own: int
    positive: int
    label: int
    same: bool
    low: float
    high: float


ASK = "anchor_id long, positive_id long, label long, same boolean, low double, high double"
FOUND = "anchor_id long, positive_id long, vec_id long, score double"


def _asks(rows: pa.Table | pa.RecordBatch) -> list[Ask]:
    return [Ask(*r) for r in zip(*(rows.column(c).to_pylist() for c in ("anchor_id", "positive_id", "label", "same", "low", "high")), strict=True)]


class Index:
    """Vantage-point trees over all vectors of one length; the units are a table in the shared folder."""

    def __init__(self, vectors: DataFrame, sample: int = SAMPLE) -> None:
        """vectors: vec_id, label and v, as from prepared(), all of one length."""
        spark = vectors.sparkSession
        shared_dir(spark)
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        n, most = vectors.agg(F.count("*"), F.max(square)).first()
        norm = float(np.sqrt(most or 0.0))
        share = max(1, min(1 << 20, (sample << 20) // max(1, n)))
        rows = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) < share).orderBy("vec_id").select("v").toArrow()
        x = _matrix(rows["v"]) if rows.num_rows else np.zeros((1, 1))
        self.upper, _ = Tree.fit(x, norm, max(FEWEST, len(x) // max(1, -(-n // CELL))))
        shared = spark.sparkContext.broadcast(self.upper)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng(TaskContext.get().partitionId())
            for batch in batches:
                cell = shared.value.assign(_matrix(batch.column("v"))) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(rng.random(batch.num_rows)), batch.column("vec_id"), batch.column("label"), batch.column("v")], names=["cell", "deal", "vec_id", "label", "v"])

        # stored, so that the dealing by deal is the same for all that read it
        assigned = staged(vectors.select("vec_id", "label", "v").mapInArrow(tidy(assign), "cell int, deal double, vec_id long, label long, v array<double>"), "vantage-cells")

        def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each node that rows of a task pass: their number, and the least and largest distance to the vantage point above."""
            seen = shared.value.unseen()
            for batch in batches:
                if batch.num_rows:
                    shared.value.assign(_matrix(batch.column("v")), seen)
            node = np.flatnonzero(seen[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), *(pa.array(seen[node, i], pa.float64()) for i in range(3))], names=["node", "n", "low", "high"])

        # spans that were fitted on the sample become those of all vectors; the sample bounds the number of nodes
        widest = assigned.select("v").mapInArrow(tidy(spans), "node int, n double, low double, high double").groupBy("node").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        held = self.upper.unseen()
        for row in widest.collect():
            held[row["node"]] = row["n"], row["low"], row["high"]
        self.held, span = held[:, 0], held[:, 1:].copy()
        span[0] = 0.0, np.inf
        self.upper.span = span

        def fit(rows: pa.Table) -> pa.Table:
            unit = Unit.fit(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"]), norm)
            return pa.table({"cell": rows["cell"].slice(0, 1), "unit": rows["unit"].slice(0, 1), "data": pa.array([unit.pack()], pa.binary())})

        counts = assigned.groupBy("cell").count()
        dealt = assigned.join(counts, "cell").withColumn("unit", F.floor(F.col("deal") * F.ceil(F.col("count") / CELL)).cast("int"))
        self.units = staged(dealt.select("cell", "unit", "vec_id", "label", "v").groupBy("cell", "unit").applyInArrow(fit, "cell int, unit int, data binary"), "vantage-units", "uncompressed")

    def search(self, asks: DataFrame, k: int) -> DataFrame:
        """anchor_id, positive_id, rank, vec_id and score of the k best rows of each ask (columns as ASK, and q)."""
        asks = staged(asks, "vantage-asks")
        near = staged(_top(self._visit(self._routed(asks, True), k), k).drop("rank"), "vantage-near")
        floor = near.groupBy("anchor_id", "positive_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        on = ["anchor_id", "positive_id"]
        rest = asks.join(floor.select(*on, "least"), on, "left")
        return _top(near.select(*on, "vec_id", "score").unionByName(self._visit(self._routed(rest, False), k).select(*on, "vec_id", "score")), k)

    def _routed(self, asks: DataFrame, first: bool) -> DataFrame:
        """asks by cell: the cells of the first round, or all others that can reach the least score so far."""
        shared = asks.sparkSession.sparkContext.broadcast((self.upper, self.held))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            upper, held = shared.value
            rng = np.random.default_rng(TaskContext.get().partitionId())
            for batch in batches:
                out = []
                least = [None] * batch.num_rows if first else batch.column("least").to_pylist()
                for ask, q, reached in zip(_asks(batch), _matrix(batch.column("q")), least, strict=True):
                    seen, cells = 0, []
                    for best, node in upper.walk(q, ask.low, ask.high):
                        if first == (seen < NEAR) and not (reached is not None and -best < reached):
                            cells.append(node)
                        seen += held[node]
                        if first and seen >= NEAR:
                            break
                    out.append(cells)
                columns = [batch.column(c) for c in ("anchor_id", "positive_id", "label", "same", "low", "high", "q")]
                if not first:  # rows under what the first round reached are not among the best
                    columns[4] = pa.array([x if r is None else max(x, r) for x, r in zip(batch.column("low").to_pylist(), least, strict=True)], pa.float64())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.int32())), pa.array(rng.random(batch.num_rows))], names=["anchor_id", "positive_id", "label", "same", "low", "high", "q", "cells", "deal"])

        routed = asks.mapInArrow(tidy(route), f"{ASK}, q array<double>, cells array<int>, deal double")
        return staged(routed.select("*", F.explode("cells").alias("cell")).drop("cells"), "vantage-routed")

    def _visit(self, routed: DataFrame, k: int) -> DataFrame:
        """The k best rows of each ask in each run of units that it visits."""
        counts = routed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        runs = self.units.groupBy("cell").agg(F.floor((F.count("*") - 1) / RUN).cast("int").alias("last_run"))  # a row for each cell, as counts

        def pack(rows: pa.Table) -> pa.Table:
            out = io.BytesIO()
            rows = rows.sort_by([("anchor_id", "ascending"), ("positive_id", "ascending")])
            np.savez(out, q=_matrix(rows["q"]), **{c: rows[c].to_numpy() for c in ("anchor_id", "positive_id", "label", "same", "low", "high")})
            return pa.table({"cell": rows["cell"].slice(0, 1), "block": rows["block"].slice(0, 1), "data": pa.array([out.getvalue()], pa.binary())})

        blocks = routed.join(counts, "cell").withColumn("block", F.floor(F.col("deal") * F.col("blocks")).cast("int")).drop("deal", "blocks")
        blocks = blocks.groupBy("cell", "block").applyInArrow(pack, "cell int, block int, data binary")
        # each block of asks once for each run of units, before them; each unit once for each block
        left = blocks.join(runs, "cell").select("cell", "block", F.explode(F.sequence(F.lit(0), "last_run")).alias("run"), F.lit(-1).alias("unit"), "data")
        right = self.units.join(counts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.floor(F.col("unit") / RUN).cast("int").alias("run"), "unit", "data")

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asks, q, best, own = [], None, [], None
            for batch in batches:
                for *at, number, data in zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "run", "unit")), batch.column("data"), strict=True):
                    if number >= 0 and at != own:
                        continue  # the deal left this block without searches
                    if number < 0:
                        own = at
                        yield from _rows(asks, best)
                        h = np.load(io.BytesIO(data.as_py()))
                        asks, q = [Ask(*r) for r in zip(*(h[c].tolist() for c in ("anchor_id", "positive_id", "label", "same", "low", "high")), strict=True)], h["q"]
                        best = [[] for _ in asks]
                        continue
                    unit = Unit.unpack(data.as_py())
                    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                    for i, ask in enumerate(asks):
                        if i and (ask.own, ask.same) != (asks[i - 1].own, asks[i - 1].same):
                            known = {}
                        if len(best[i]) == k:
                            ask.low = max(ask.low, -best[i][-1][0])
                        found = [(-s, v) for s, v in unit.nearest(q[i], ask, k, known)]
                        best[i] = sorted(best[i] + found)[:k]
            yield from _rows(asks, best)

        both = left.unionByName(right).repartition("cell", "block", "run").sortWithinPartitions("cell", "block", "run", "unit")
        return both.select("cell", "block", "run", "unit", "data").mapInArrow(tidy(search), FOUND)


def _rows(asks: list[Ask], best: list[list[tuple[float, int]]]) -> Iterator[pa.RecordBatch]:
    rows = [(a.own, a.positive, v, -s) for a, found in zip(asks, best, strict=True) for s, v in found]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["anchor_id", "positive_id", "vec_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; rows as from prepared().

    Of each row that anchors selects: its first positives other rows of the same label, and for each of
    them the first negatives rows of other labels whose score is low to high hundredths of the
    positive's; fewer if there are fewer. Larger scores come first, then smaller vec_ids. Vectors of
    different lengths have no inner product, so each length is searched by itself. An empty table
    gives no rows.
    """
    spark, out = rows.sparkSession, None
    rows = staged(rows, "vantage-rows")
    for dim in [r["dim"] for r in rows.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]:
        own = rows.where(F.size("v") == dim)
        index = Index(own)
        asked = own.where(anchors).select(F.col("vec_id").alias("anchor_id"), "label", F.col("v").alias("q"))
        every = F.lit(float("inf"))
        first = asked.select("anchor_id", F.lit(0).cast("long").alias("positive_id"), "label", F.lit(True).alias("same"), (-every).alias("low"), every.alias("high"), "q")
        near = staged(index.search(first, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "vantage-positives")
        s = F.col("positive_score")
        # scores are whole numbers: 100 * score within low * s and high * s
        window = near.join(asked, "anchor_id").where(low * s <= high * s)
        second = window.select("anchor_id", "positive_id", "label", F.lit(False).alias("same"), (F.lit(low) * s / 100).alias("low"), (F.lit(high) * s / 100).alias("high"), "q")
        found = index.search(second, negatives).join(near, ["anchor_id", "positive_id"])
        found = found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("positive_score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(prepared(table(spark, sf_dir, "embeddings")))
