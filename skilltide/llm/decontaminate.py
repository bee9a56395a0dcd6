"""Benchmark decontamination as a prefix-filtered set join.

Benchmark texts are cut into item-sized windows of words, and each window into shingles. A
document holds a window only if it holds all its shingles, so that a prefix of one shingle is
necessary and enough to find it: the rarest, by counts over all documents. Occurrences of a
prefix shingle give candidates; the shingle's place in the window gives the start, which has to
lie inside the document with room for the window; the words there are then compared one by one,
first by their hashes, then by their bytes, so that colliding hashes never make a hit.

The benchmark's windows are broadcast in blocks of a fixed number of windows, as many blocks as
the benchmark needs, so no broadcast grows with a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added, blobs, slices, staged, table, tidy
from .words import ALNUM, same_bytes, shingles, words

WINDOW, SHINGLE = 13, 4
#: Windows in one block, of about 300 bytes each.
BLOCK = 100_000
#: Candidates compared at a time.
STEP = 1 << 16


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Columns item_id and words (binary: a window's lower-case words with single spaces), distinct.

    An item of fewer words than a window, but not none, is one window. Rows without item_id or
    text have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = words(blobs(part), ALNUM)
                raw = found.data.tobytes()
                said = [raw[a:b] for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True)]
                ids, out = [], []
                for item, a, b in zip(part.column("item_id").to_pylist(), found.first[:-1], found.first[1:], strict=True):
                    for start in range(a, max(b - window, a) + 1) if b > a else ():
                        ids.append(item)
                        out.append(b" ".join(said[start : min(start + window, b)]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], names=["item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(tidy(run), "item_id string, words binary").distinct()


@dataclass
class Block:
    """Windows as rows of word hashes with their lengths and items; first: the place of each window's first word in starts and ends of data."""

    words: np.ndarray
    size: np.ndarray
    items: list[list[str]]
    first: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def equal(self, windows: np.ndarray, found, places: np.ndarray) -> np.ndarray:
        """Whether the words of windows and those from places on in found have the same bytes."""
        size = self.size[windows]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        own, theirs = np.repeat(self.first[windows], size) + inside, np.repeat(places, size) + inside
        n = self.ends[own] - self.starts[own]
        same = n == found.ends[theirs] - found.starts[theirs]
        same[same] = same_bytes(self.data, self.starts[own[same]], found.data, found.starts[theirs[same]], n[same])
        return np.logical_and.reduceat(same, np.cumsum(size) - size) if len(size) else same


def read_block(windows: DataFrame) -> Block:
    by_words: dict[bytes, list[str]] = {}
    for row in windows.collect():
        by_words.setdefault(bytes(row["words"]), []).append(row["item_id"])
    found = words(list(by_words), ALNUM)
    first, size = found.first[:-1], np.diff(found.first)
    held = np.zeros((len(by_words), max([WINDOW, *size])), np.uint64)
    held[np.arange(held.shape[1]) < size[:, None]] = found.hashes
    return Block(held, size, [sorted(x) for x in by_words.values()], first, found.data, found.starts.astype(np.int32), found.ends.astype(np.int32))


class Lookup:
    """Places of many hashes in a sorted array, -1 if absent; a small table of bits answers most."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = np.zeros(1 << 20, bool)
        self.bits[keys & np.uint64((1 << 20) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes that are keys, and which keys."""
        at = np.flatnonzero(self.bits[hashes & np.uint64((1 << 20) - 1)])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


def window_shingles(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all shingles of all windows: number of words, hash, window, offset. Shorter windows are one shingle."""
    out = []
    for n in np.unique(block.size):
        rows = np.flatnonzero(block.size == n)
        size = min(SHINGLE, int(n))
        for offset in range(int(n) - size + 1):
            h = np.concatenate([shingles(block.words[r, offset : offset + size], size) for r in rows])
            out.append((np.full(len(rows), size), h, rows, np.full(len(rows), offset)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def rarity(docs: DataFrame, block: Block) -> tuple[np.ndarray, ...]:
    """window_shingles() and the number of occurrences of each in all documents."""
    size, h, row, offset = window_shingles(block)
    lookups = {int(n): Lookup(np.unique(h[size == n])) for n in np.unique(size)}
    shared = docs.sparkSession.sparkContext.broadcast(lookups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {n: np.zeros(len(x.keys), np.int64) for n, x in shared.value.items()}
        for batch in batches:
            for part in slices(batch):
                found = words(blobs(part), ALNUM)
                for n, lookup in shared.value.items():
                    at, key = lookup.find(shingles(found.hashes, n))
                    inside = found.owner[at] == found.owner[at + n - 1]
                    totals[n] += np.bincount(key[inside], minlength=len(lookup.keys))
        rows = [(n, k, t[k]) for n, t in totals.items() for k in np.flatnonzero(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["size", "key", "n"])

    counts = np.zeros(len(h), np.int64)
    by_key = {(r["size"], r["key"]): r["n"] for r in docs.select("text").mapInArrow(tidy(run), "size long, key long, n long").groupBy("size", "key").agg(F.sum("n").alias("n")).collect()}
    for n, lookup in lookups.items():
        of = np.flatnonzero(size == n)
        counts[of] = [by_key.get((n, int(k)), 0) for k in np.searchsorted(lookup.keys, h[of])]
    return size, h, row, offset, counts


@dataclass
class Prefixes:
    """Of each shingle length: the prefix shingles, and for each the windows and offsets (from, to)."""

    lookups: dict[int, tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]]
    block: Block


def choose(docs: DataFrame, block: Block) -> Prefixes:
    size, h, row, offset, counts = rarity(docs, block)
    order = np.lexsort((h, counts, row))
    prefix = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
    prefix = prefix[counts[prefix] > 0]  # an absent shingle rules its window out
    lookups = {}
    for n in np.unique(size[prefix]):
        own = prefix[size[prefix] == n]
        own = own[np.argsort(h[own], kind="stable")]
        keys, start = np.unique(h[own], return_index=True)
        lookups[int(n)] = (Lookup(keys), np.append(start, len(own)), row[own], offset[own])
    return Prefixes(lookups, block)


def occurrences(found, prefixes: Prefixes) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of all occurrences."""
    block, starts, rows = prefixes.block, [], []
    n_words = len(found.hashes)
    for n, (lookup, start, row, offset) in prefixes.lookups.items():
        at, key = lookup.find(shingles(found.hashes, n))
        many = start[key + 1] - start[key]
        before = np.cumsum(many) - many
        cuts = np.append(np.flatnonzero(np.diff(before // STEP, prepend=-1)), len(at))  # a place has no more candidates than there are windows
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            m = many[a:b]
            each = np.repeat(start[key[a:b]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            w, s = row[each], np.repeat(at[a:b], m) - offset[each]
            last = s + block.size[w] - 1
            fits = (s >= 0) & (last < n_words)
            w, s, last = w[fits], s[fits], last[fits]
            fits = found.owner[s] == found.owner[last]
            w, s = w[fits], s[fits]
            for i in range(block.words.shape[1]):
                same = (block.size[w] <= i) | (found.hashes[np.minimum(s + i, n_words - 1)] == block.words[w, i])
                w, s = w[same], s[same]
            same = block.equal(w, found, s)
            w, s = w[same], s[same]
            starts.append(s)
            rows.append(w)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *rows])


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, spans (array<int>: start and end, in words, of each occurrence of a window,
    sorted) and items (the item_ids whose windows occur, sorted as strings).

    Null and empty texts have no words. Columns of docs with those names are replaced, repeated
    rows are searched each, and an empty benchmark finds nothing.
    """
    windows = staged(item_windows(benchmark), "windows")
    n = windows.count()
    blocks = max(1, -(-n // BLOCK))
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in {"n_words", "spans", "items"}))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for at in range(blocks):
        block = read_block(windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == at))
        shared = docs.sparkSession.sparkContext.broadcast(choose(docs, block) if len(block.size) else None)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            prefixes = shared.value
            for batch in batches:
                for part in slices(batch):
                    found = words(blobs(part), ALNUM)
                    spans, items = part.column("spans").to_pylist(), part.column("items").to_pylist()
                    if prefixes is not None:
                        s, w = occurrences(found, prefixes)
                        owner = found.owner[s]
                        order = np.lexsort((s, owner))
                        s, w, owner = s[order], w[order], owner[order]
                        for doc in np.unique(owner):
                            a, b = np.searchsorted(owner, [doc, doc + 1])
                            first = s[a:b] - found.first[doc]
                            pairs = np.stack([first, first + prefixes.block.size[w[a:b]]], 1)
                            spans[doc] = np.unique(np.concatenate([np.reshape(spans[doc], (-1, 2)).astype(np.int64), pairs]), axis=0).ravel().tolist()
                            items[doc] = sorted({x for v in np.unique(w[a:b]) for x in prefixes.block.items[v]}.union(items[doc]))
                    yield added(part, n_words=pa.array(np.diff(found.first), pa.int64()), spans=pa.array(spans, pa.list_(pa.int32())), items=pa.array(items, pa.list_(pa.string())))

        out = out.mapInArrow(tidy(run), ", ".join([*kept, "n_words long", "spans array<int>", "items array<string>"]))
        if at + 1 < blocks:
            out = staged(out, "items")
    return out




def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """find_items() with n_hit (words in any occurrence) and contaminated (n_hit > 0 and share * n_hit >= n_words), without the spans."""
    found = find_items(docs, benchmark)
    spans = F.arrays_zip(F.filter("spans", lambda x, i: i % 2 == 0).alias("a"), F.filter("spans", lambda x, i: i % 2 == 1).alias("b"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    n_hit = F.aggregate(spans, zero, lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).alias("n")))["n"]
    found = found.withColumn("n_hit", n_hit).drop("spans")
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
