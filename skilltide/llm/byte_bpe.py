"""Byte-level BPE encoding and decoding.

Each pre-token is encoded over a segment tree whose leaves are byte positions: a leaf holds
the rank of the pair that starts at a live position, an inner node the smaller value of its
children, so the root leads to the leftmost pair of least rank. A merge updates the leaves of
the merged position, of the one that goes and of the live neighbour before, each in log steps.
Many pre-tokens of like length are worked on in step, a row of a numpy array each.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, slices, table, texts, tidy

NONE = np.int32(2**31 - 1)
#: Pre-tokens that a worker keeps, and cells of a tree array worked on at a time.
HELD, CELLS = 500_000, 1 << 19
_held: dict[str, ByteBPE] = {}


class ByteBPE:
    """Encoder and decoder for a file of base64 tokens and ranks."""

    def __init__(self, path: str, held: int = HELD) -> None:
        import public_tokenizers
        import regex

        self.split = regex.compile(public_tokenizers.PATTERN).findall
        with open(path, "rb") as file:
            rows = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a << 32 | b, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] + [2**62], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] + [NONE], np.int32)
        top = max(self.ranks.values()) + 1
        tokens = [b""] * top
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_size)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.held = held
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.sizes, self.starts, self.flat, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none; ids under 0 are absent."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = 2**61
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def _merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: a row for each pre-token, -1 behind its end, as many columns as a power of two. Returns ids and which are live."""
        rows, width = ids.shape
        levels = width.bit_length() - 1
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (rows, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (rows, 1))
        live = ids >= 0
        tree = np.full((rows, 2 * width), NONE, np.int32)
        tree[:, width : 2 * width - 1] = self._pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(rows, -1)
        for level in range(levels - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

        def put(r: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            node = leaf + width
            tree[r, node] = rank
            for _ in range(levels):
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        r = np.flatnonzero(tree[:, 1] != NONE)
        while r.size:
            least = tree[r, 1]
            node = np.ones(r.size, np.int64)
            for _ in range(levels):
                node = 2 * node
                node += tree[r, node] != least
            i = node - width
            j = after[r, i]
            k = after[r, j]
            ids[r, i], after[r, i], live[r, j] = least, k, False
            inside = k < width
            before[r[inside], k[inside]] = i[inside]
            right = np.where(inside, ids[r, np.minimum(k, width - 1)], -1)
            put(r, j, np.full(r.size, NONE, np.int32))
            put(r, i, self._pair(least, right))
            p = before[r, i]
            has = p >= 0
            if has.any():
                put(r[has], p[has], self._pair(ids[r[has], p[has]], least[has]))
            r = r[tree[r, 1] != NONE]
        return ids, live

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[at] = np.array([whole], np.int32)
            elif piece:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(at)
        for width, members in by_width.items():
            step = max(1, CELLS // width)
            for first in range(0, len(members), step):
                part = members[first : first + step]
                size = np.array([len(pieces[at]) for at in part])
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.arange(width) < size[:, None]] = self.single[np.frombuffer(b"".join(pieces[at] for at in part), np.uint8)]
                ids, live = self._merge(ids)
                flat, ends = ids[live], np.cumsum(live.sum(1))
                for at, end, start in zip(part, ends, ends - live.sum(1), strict=True):
                    out[at] = flat[start:end]
        return out

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.index]
        if not new:
            return
        if len(self.index) + len(new) > self.held and self.index:
            self._forget()
            new = list(pieces)
        found = self.encode_pieces([p.encode() for p in new])
        n, size = len(self.index), np.array([len(x) for x in found], np.int64)
        total = int(size.sum())
        while n + len(new) > len(self.sizes):
            self.sizes, self.starts = np.concatenate([self.sizes, self.sizes]), np.concatenate([self.starts, self.starts])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.sizes[n : n + len(new)] = size
        self.starts[n : n + len(new)] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + total] = np.concatenate(found)
        self.used += total
        self.index.update(zip(new, range(n, n + len(new)), strict=True))

    def encode(self, batch_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and the number of ids of each text."""
        split = [self.split(t) for t in batch_texts]
        self._learn(set().union(*split))
        at = np.fromiter((i for pieces in split for i in map(self.index.__getitem__, pieces)), np.int64)
        size = self.sizes[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.starts[at] - ends + size, size) + np.arange(ends[-1] if ends.size else 0)]
        per_piece = np.concatenate([[0], ends])
        return ids, np.diff(per_piece[np.cumsum([0] + [len(p) for p in split])])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of counts[i] ids."""
        size = self.token_size[ids]
        ends = np.cumsum(size)
        data = self.token_bytes[np.repeat(self.token_start[ids] - ends + size, size) + np.arange(ends[-1] if ends.size else 0)].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def codec(path: str) -> ByteBPE:
    return _held.get(path) or _held.setdefault(path, ByteBPE(path))


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with ids array<int> in place of the text, and the bytes decoded from the ids if asked for.

    Null and empty texts have no ids. Columns of docs named ids or decoded are replaced.
    Nothing is shuffled; repeated rows are encoded each.
    """
    kept = [f for f in docs.schema if f.name not in {text, "ids", "decoded"}]
    docs = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                ids, counts = bpe.encode(texts(part, "ids"))
                more = {"decoded": pa.array(bpe.decode(ids, counts), pa.binary())} if decoded else {}
                yield added(part, ids=_lists(ids, counts), **more)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["ids array<int>"] + ["decoded binary"] * decoded
    return docs.mapInArrow(tidy(run), ", ".join(fields))


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with the decoded bytes (binary) in place of the ids; null counts as no ids."""
    kept = [f for f in encoded.schema if f.name not in {ids, "decoded"}]
    encoded = encoded.select(*(F.col(f"`{f.name}`") for f in kept), F.coalesce(F.col(f"`{ids}`").cast("array<int>"), F.array().cast("array<int>")).alias("decoded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.column("decoded")
                counts = np.array([len(x) for x in column], np.int64)
                yield added(part, decoded=pa.array(bpe.decode(column.flatten().to_numpy(zero_copy_only=False), counts), pa.binary()))

    return encoded.mapInArrow(tidy(run), ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["decoded binary"]))


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    both = encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
