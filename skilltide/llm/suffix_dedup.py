"""Suffix-array dedup: removes each byte covered by a string of LENGTH bytes that starts earlier,
in a smaller doc_id or before in the same document.

1. Each document is cut at anchors: the least of all hashes of GRAM bytes in a window of LENGTH.
   Equal windows have the same anchor at the same place, so only windows with equal anchors are
   compared. An anchor stands for a run of windows; runs equal as a whole are settled by their
   hash, first inside each task, then over all, where they pass in order and only BLOCK of an
   anchor are held. That leaves runs whose anchor recurs but which differ.
2. Their bytes are fetched, and blocks of them go to suffix arrays (gsaca). The symbols are short
   strings that end at white space or after STEP bytes without, so that where a symbol starts
   depends only on the bytes before; windows between symbol starts are their next suffix, up to
   what is left of LENGTH, and the bytes before it. Equal neighbours in the array are repeats.
3. An anchor with more runs than BLOCK is told apart further: its runs are cut into pieces of up to
   PIECE windows by their distance from the anchor, and only pieces with equal bytes around it, those
   that all their windows share, can hold equal windows. Pieces are settled like runs. Where more than
   BLOCK still meet, they are dealt over several arrays; of each kind of window, the first of each
   array then meet by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import blobs, keyed, slices, staged, table, tidy
from .gsaca import suffix_array
from .words import mix, rolling_hash, span_hash, sums

LENGTH, GRAM, STEP = 100, 32, 16
#: Runs of one anchor in an array, bytes in an array, anchors settled at a time in a task.
BLOCK, BYTES, HELD = 1500, 1 << 18, 2_000_000
#: Windows in a piece of a run.
PIECE = 16
SPAN = "doc_id long, s int, e int, k long, salt int"


def anchor_runs(data: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all texts: text, first window, number of windows, anchor's hash, and the hash of the run's bytes and anchor place."""
    flat = np.frombuffer(b"".join(data), np.uint8)
    size = np.array([len(b) for b in data], np.int64)
    ends = np.cumsum(size)
    none = np.zeros(0, np.int64)
    if len(flat) < LENGTH:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    n = len(flat) - GRAM + 1
    grams = rolling_hash(sums(flat), np.arange(n), np.arange(GRAM, len(flat) + 1))  # chooses anchors, decides nothing
    least = grams >> np.uint64(32) << np.uint64(32) | np.arange(n, dtype=np.uint64)  # by hash, then leftmost
    reach, width = 1, LENGTH - GRAM + 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[: len(flat) - LENGTH + 1], least[width - reach : width - reach + len(flat) - LENGTH + 1])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    many = np.maximum(0, size - LENGTH + 1)
    window = np.repeat(ends - size - np.cumsum(many) + many, many) + np.arange(many.sum())
    owner = np.repeat(np.arange(len(data)), many)
    own = anchor[window]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])])) if len(own) else none
    count = np.diff(np.append(first, len(own)))
    start = window[first]
    h = span_hash(flat, start, start + count + LENGTH - 1) + mix((own[first] - start).astype(np.uint64))
    return owner[first], start - (ends - size)[owner[first]], count, grams[own[first]], h


def merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans put together where they meet or overlap; all have LENGTH bytes at least, so order by start is enough."""
    order = np.lexsort((e, s, doc))
    doc, s, e = doc[order], s[order], e[order]
    if not len(doc):
        return doc, s, e
    docs = np.concatenate([[True], doc[1:] != doc[:-1]])
    lift = (np.cumsum(docs) - 1) * (int(e.max()) + 2)
    top = np.maximum.accumulate(e + lift)
    first = np.flatnonzero(np.concatenate([[True], s[1:] + lift[1:] > top[:-1]]))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], s[first], top[last] - lift[last]


def run_pieces(runs: list[bytes], k: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of runs and their anchors' hashes: run, first window in it, number of windows, key and hash of each piece. Equal windows are in pieces of one key."""
    size = np.array([len(r) for r in runs], np.int64)
    flat = np.frombuffer(b"".join(runs), np.uint8)
    ends = np.cumsum(size)
    begins = ends - size
    n = len(flat) - GRAM + 1
    owner = np.repeat(np.arange(len(runs)), size)[:n]
    grams = rolling_hash(sums(flat), np.arange(n), np.arange(GRAM, len(flat) + 1))
    hits = np.flatnonzero((grams == k.view(np.uint64)[owner]) & (ends[owner] - np.arange(n) >= GRAM))
    anchor = hits[np.unique(owner[hits], return_index=True)[1]]  # the leftmost is the one that the windows chose
    many = size - LENGTH + 1
    own = np.repeat(np.arange(len(runs)), many)
    window = np.repeat(begins - np.cumsum(many) + many, many) + np.arange(many.sum())
    band = (anchor[own] - window) // PIECE
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (band[1:] != band[:-1])]))
    count = np.diff(np.append(first, len(own)))
    start, run, band = window[first], own[first], band[first]
    core = anchor[run] - band * PIECE  # in all windows of the band, as far as the first of them reaches
    key = mix(span_hash(flat, core, core + LENGTH - PIECE + 1) ^ mix(k.view(np.uint64)[run] + band.astype(np.uint64)))
    h = span_hash(flat, start, start + count + LENGTH - 1) + mix((anchor[run] - start).astype(np.uint64))
    return run, start - begins[run], count, key, h


def _rows(doc: np.ndarray, s: np.ndarray, e: np.ndarray, k: np.ndarray | None = None, salt: np.ndarray | None = None, run: list | None = None) -> pa.RecordBatch:
    none = [None] * len(doc)
    own = [pa.array(doc, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(none if k is None else k, pa.int64()), pa.array(none if salt is None else salt, pa.int32())]
    return pa.RecordBatch.from_arrays([*own, pa.array(none if run is None else run, pa.binary())], names=["doc_id", "s", "e", "k", "salt", "run"])


def _firsts(k: np.ndarray, h: np.ndarray, doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each run, by document and start, and of its later ones; copies of a row are neither."""
    order = np.lexsort((s, doc, h, k))
    new = np.concatenate([[True], (np.diff(k[order]) != 0) | (np.diff(h[order]) != 0)])[: len(order)]
    other = np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(s[order]) != 0)])[: len(order)]
    return order[new], order[~new & other]


def settle_whole(runs: DataFrame) -> DataFrame:
    """Of runs (k, h, doc_id, s, n, and run where they bring their bytes): spans of those that repeat an earlier one (k null), and the first ones whose k has others."""
    brought = "run" in runs.columns

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order. Of an anchor, no more than BLOCK runs wait until it is known whether there are more."""
        last = None
        wait = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, object)]
        gone_k, gone = None, 0  # an anchor of which so many runs have left already
        for batch in batches:
            k, h, doc, s, n = (batch.column(c).to_numpy() for c in ("k", "h", "doc_id", "s", "n"))
            run = batch.column("run").to_numpy(zero_copy_only=False) if brought else np.full(len(k), None)
            ready = n < 0
            yield _rows(doc[ready], s[ready], s[ready] - n[ready])
            k, h, doc, s, n, run = (x[~ready] for x in (k, h, doc, s, n, run))
            if not len(k):
                continue
            same = [np.concatenate([[last is not None and last[i] == x[0]], x[1:] == x[:-1]]) for i, x in enumerate((k, h, doc, s))]
            again = same[0] & same[1]
            copy = again & same[2] & same[3]  # of a row
            last = (k[-1], h[-1], doc[-1], s[-1])
            yield _rows(*merged(*(x[again & ~copy] for x in (doc, s, s + n + LENGTH - 1))))
            k, doc, s, n, run = (np.concatenate([w, x[~again]]) for w, x in zip(wait, (k, doc, s, n, run), strict=True))
            if not len(k):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(cuts, len(k)))
            before = np.where(k[cuts] == gone_k, gone, 0) if gone_k is not None else np.zeros(len(cuts), np.int64)
            many = np.repeat(size + before, size)
            place = np.arange(len(k)) - np.repeat(cuts - before, size)
            salt = np.where(many > BLOCK, place // BLOCK + 1, 0)  # 0: all runs of the anchor are in one array
            leaves = many > 1
            if many[-1] > BLOCK:
                gone_k, gone, wait = k[-1], int(many[-1]), [x[:0] for x in (k, doc, s, n, run)]
            else:
                wait = [x[cuts[-1] :] for x in (k, doc, s, n, run)]
                leaves[cuts[-1] :] = False
            yield _rows(doc[leaves], s[leaves], s[leaves] + n[leaves] + LENGTH - 1, k[leaves], salt[leaves].astype(np.int32), run[leaves])
        k, doc, s, n, run = wait
        if len(k) > 1:
            yield _rows(doc, s, s + n + LENGTH - 1, k, np.zeros(len(k), np.int32), run)

    return runs.repartition("k").sortWithinPartitions("k", "h", "doc_id", "s").mapInArrow(tidy(whole), SPAN + ", run binary")


def settle_runs(docs: DataFrame) -> DataFrame:
    """Spans (k null) that repeat an earlier run as a whole, and the first of those runs whose anchor has others (k, salt)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def settled() -> Iterator[pa.RecordBatch]:
            k, h, doc, s, n = (np.concatenate(x) for x in zip(*held, strict=True))
            keep, gone = _firsts(k, h, doc, s)
            d, a, b = merged(doc[gone], s[gone], s[gone] + n[gone] + LENGTH - 1)
            # settled spans travel under keys of their own
            for rows in ((k[keep], h[keep], doc[keep], s[keep], n[keep]), (mix(d.view(np.uint64) + a.astype(np.uint64)), np.zeros(len(d), np.uint64), d, a, a - b)):
                yield pa.RecordBatch.from_arrays([pa.array(rows[0].view(np.int64), pa.int64()), pa.array(rows[1].view(np.int64), pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int32())], names=["k", "h", "doc_id", "s", "n"])

        for batch in batches:
            for part in slices(batch, limit=1 << 19):
                owner, s, n, k, h = anchor_runs(blobs(part))
                held.append((k, h, part.column("doc_id").to_numpy()[owner], s, n))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from settled()
                    held = []
        if held:
            yield from settled()

    runs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(tidy(local), "k long, h long, doc_id long, s int, n int")
    return settle_whole(runs).drop("run")


def split_runs(runs: DataFrame) -> DataFrame:
    """Spans and pieces like those of settle_runs(), and the bytes of the pieces, of runs (k, doc_id, s, run)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "run", limit=1 << 19):
                data = blobs(part, "run")
                run, at, n, k, h = run_pieces(data, part.column("k").to_numpy())
                out = [data[r][a : a + c + LENGTH - 1] for r, a, c in zip(run.tolist(), at.tolist(), n.tolist(), strict=True)]
                own = [pa.array(k.view(np.int64)), pa.array(h.view(np.int64)), pa.array(part.column("doc_id").to_numpy()[run]), pa.array(part.column("s").to_numpy()[run] + at, pa.int32()), pa.array(n, pa.int32()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(own, names=["k", "h", "doc_id", "s", "n", "run"])

    return settle_whole(runs.select("k", "doc_id", "s", "run").mapInArrow(tidy(cut), "k long, h long, doc_id long, s int, n int, run binary"))


def repeats(runs: list[bytes], doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of runs: run, place in it, and whether an equal one starts earlier; and a hash of each window."""
    size = np.array([len(r) for r in runs], np.int64)
    flat = np.frombuffer(b"".join(runs) + bytes(LENGTH + STEP), np.uint8)
    ends = np.cumsum(size)
    begins = ends - size
    total = int(ends[-1])
    owner = np.repeat(np.arange(len(runs)), size)
    place = np.arange(total) - begins[owner]
    space = (flat[:total] == 32) | (flat[:total] == 10)
    last_space = np.maximum.accumulate(np.where(space, np.arange(total), -1))
    before = np.concatenate([[-1], last_space[:-1]])  # last space before each byte
    clear = np.arange(total) - np.maximum(before, begins[owner] - 1) - 1  # bytes without, up to here
    starts = np.flatnonzero((place > 0) & (clear == 0) | (clear >= STEP))
    if not len(starts):
        starts = np.array([0])
    # symbols: bytes up to the next start, as two numbers and a length
    up_to = np.minimum(np.append(starts[1:], total), ends[owner[starts]])
    length = np.minimum(up_to - starts, STEP)
    raw = flat[starts[:, None] + np.arange(STEP)].copy()
    raw[np.arange(STEP) >= length[:, None]] = 0
    halves = raw.view(">u8").astype(np.uint64)
    order = np.lexsort((length, halves[:, 1], halves[:, 0]))
    sorted_halves, sorted_length = halves[order], length[order]
    differ = np.concatenate([[True], (sorted_halves[1:] != sorted_halves[:-1]).any(1) | (sorted_length[1:] != sorted_length[:-1])])
    symbol = np.zeros(len(starts), np.int64)
    symbol[order] = np.cumsum(differ)
    breaks = np.flatnonzero(np.diff(owner[starts])) + 1
    sa = np.array(suffix_array(np.insert(symbol, breaks, 0).tolist()), np.int64)
    real = np.insert(np.arange(len(starts)), breaks, -1)[sa]
    real = real[real >= 0]
    rank = np.empty(len(starts), np.int64)
    rank[real] = np.arange(len(real))
    # bytes that neighbours in the array share, up to the end of either run
    here = starts[real]
    room = np.minimum(LENGTH, ends[owner[here]] - here)
    common = np.zeros(len(real), np.int64)
    for a in range(1, len(real), 4096):
        x, y = here[a : a + 4096], here[a - 1 : a + 4095][: len(here[a : a + 4096])]
        unlike = flat[x[:, None] + np.arange(LENGTH)] != flat[y[:, None] + np.arange(LENGTH)]
        common[a : a + 4096] = np.where(unlike.any(1), unlike.argmax(1), LENGTH)
    common[1:] = np.minimum(common[1:], np.minimum(room[1:], room[:-1]))
    # windows: their next symbol start, and the bytes before it
    window = np.flatnonzero(ends[owner] - np.arange(total) >= LENGTH)
    next_space = np.minimum.accumulate(np.where(space, np.arange(total), total + STEP)[::-1])[::-1]
    r = np.minimum(next_space[window] - window + 1, STEP)
    suffix = rank[np.searchsorted(starts, window + r)]
    kind = np.zeros(len(window), np.int64)
    for i in np.unique(r):
        own = r == i
        kind[own] = np.cumsum(common < LENGTH - i)[suffix[own]]
    lead = flat[window[:, None] + np.arange(STEP)].copy()
    lead[np.arange(STEP) >= r[:, None]] = 0
    head = lead.view(">u8").astype(np.uint64)
    key = mix(head[:, 0] + np.uint64(0x9E3779B97F4A7C15)) + mix(head[:, 1] ^ mix(kind.astype(np.uint64) * np.uint64(STEP + 1) + r.astype(np.uint64)))
    run, at = owner[window], place[window]
    order = np.lexsort((s[run] + at, doc[run], key))
    parts = (head[:, 0], head[:, 1], kind, r)
    same = lambda x: x[order][1:] == x[order][:-1]
    equal = same(key)
    if (equal & ~np.logical_and.reduce([same(x) for x in parts])).any():  # colliding keys
        order = np.lexsort((s[run] + at, doc[run], *parts))
        equal = np.logical_and.reduce([same(x) for x in parts])
    again = np.zeros(len(window), bool)
    again[order[1:]] = equal
    return run, at, again, window


def sort_runs(runs: DataFrame) -> DataFrame:
    """Spans that suffix arrays find (w null); for anchors dealt over several arrays, also the first of each kind of window (w: hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int, bytes]] = []

        def one() -> Iterator[pa.RecordBatch]:
            k, salt, doc, s = (np.array([x[i] for x in held], np.int64) for i in range(4))
            data = [x[4] for x in held]
            own, at, again, window = repeats(data, doc, s)
            start = s[own] + at
            d, a, b = merged(doc[own[again]], start[again], start[again] + LENGTH)
            first = ~again & (salt[own] > 0)
            w = span_hash(np.frombuffer(b"".join(data), np.uint8), window[first], window[first] + LENGTH)
            for columns in ((d, a, b, None, None), (doc[own[first]], start[first], start[first] + LENGTH, k[own[first]], w.view(np.int64))):
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), *(pa.array([None] * len(d) if x is None else x, pa.int64()) for x in columns[3:])], names=["doc_id", "s", "e", "k", "w"])

        size, before = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("k", "salt", "doc_id", "s", "run")), strict=True):
                if before != row[:2] and before is not None and (size >= BYTES or row[1] or before[1]):
                    yield from one()
                    held, size = [], 0
                held.append(row)
                size, before = size + len(row[4]), row[:2]
        if held:
            yield from one()

    return runs.repartition("k", "salt").sortWithinPartitions("k", "salt").mapInArrow(tidy(run), "doc_id long, s int, e int, k long, w long")


def fetch_runs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the runs in wanted: k, salt, doc_id, s and run."""
    lists = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("k", "salt", "s", "e")).alias("runs"))  # as many as the document has anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = [(r["k"], r["salt"], doc, r["s"], text[r["s"] : r["e"]]) for doc, text, runs in zip(part.column("doc_id").to_pylist(), blobs(part), part.column("runs").to_pylist(), strict=True) for r in runs]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=["k", "salt", "doc_id", "s", "run"])

    return docs.join(lists, "doc_id").select("doc_id", "text", "runs").mapInArrow(tidy(run), "k long, salt int, doc_id long, s int, run binary").dropDuplicates(["k", "salt", "doc_id", "s"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of s and e, bytes) of all documents (doc_id long, text) with repeats; spans may overlap."""
    found = staged(settle_runs(docs), "runs")
    # a shuffle of its own brings runs together that the fetch has in other partitions; copies of a row give the same run
    fetched = staged(fetch_runs(docs.where("text IS NOT NULL"), found.where("k IS NOT NULL")), "fetched-runs")
    pieces = staged(split_runs(fetched.where("salt > 0")), "pieces")
    sorted_runs = staged(sort_runs(fetched.where("salt = 0").unionByName(pieces.where("k IS NOT NULL").select(*fetched.columns))), "sorted-runs")
    rank = F.row_number().over(Window.partitionBy("k", "w").orderBy("doc_id", "s"))  # a row for each array
    met = sorted_runs.where("w IS NOT NULL").withColumn("rank", rank).where("rank > 1")
    spans = found.where("k IS NULL").unionByName(pieces.where("k IS NULL"), True).select("doc_id", "s", "e").unionByName(sorted_runs.where("w IS NULL").select("doc_id", "s", "e")).unionByName(met.select("doc_id", "s", "e"))
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


ADDED = {"kept": "binary", "kept_text": "string", "n_bytes": "long", "n_removed": "long", "n_spans": "long"}


def unrepeated(docs: DataFrame) -> DataFrame:
    """docs with kept (binary: the bytes left), kept_text (their whole characters), n_bytes, n_removed and n_spans (maximal removed runs).

    Null texts count as empty, and texts of fewer than LENGTH bytes stay whole. Rows that repeat a
    doc_id and its text count as one document and lose the same bytes. Rows with a null doc_id, and
    those whose doc_id has another, lesser text, stay whole and remove nothing. Columns of docs with
    the names of results are replaced, all others pass; an empty table gives an empty one.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ADDED))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    said = keyed(docs.select("doc_id", "text", F.struct(*others).alias("row"))).select(F.col("_key").cast("long").alias("doc_id"), "text", "row")
    both = said.join(repeated_spans(said.select("doc_id", "text")), "doc_id", "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                kept, left, counts = [], [], []
                for data, spans in zip(blobs(part), part.column("spans").to_pylist(), strict=True):
                    _, s, e = merged(*np.array([(0, x["s"], x["e"]) for x in spans or ()], np.int64).reshape(-1, 3).T)
                    cuts = [0, *np.stack([s, e], 1).ravel().tolist(), len(data)]
                    pieces = [data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
                    kept.append(b"".join(pieces))
                    left.append("".join(p.decode(errors="ignore") for p in pieces))
                    counts.append((len(data), int((e - s).sum()), len(s)))
                own = [part.column("row"), part.column("text"), pa.array(kept, pa.binary()), pa.array(left, pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3))]
                yield pa.RecordBatch.from_arrays(own, names=["row", "text", *ADDED])

    schema = T.StructType([both.schema["row"], both.schema["text"]])
    for name, kind in ADDED.items():
        schema = schema.add(name, kind)
    found = both.mapInArrow(tidy(run), schema)
    return found.select(*(F.col("text" if c == "text" else f"row.`{c}`") for c in docs.columns), *ADDED)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = unrepeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
