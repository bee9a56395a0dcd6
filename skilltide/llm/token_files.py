"""Token ids as files: canonical length-limited Huffman codes of ids from global counts, in
independent blocks with bit-offset checkpoints, decoded by table.

A file set is a folder with two Parquet tables, so that any store that Spark writes to can hold it,
and its path is all that a reader needs. book has a row for each id that occurs: id, and length of
its code word in bits; the code words follow from these. blocks holds whole documents, about BLOCK
ids in a row:

    part, seq       range partition, and place in it of the block's first document
    doc_ids, sizes  of its documents, with the end id
    checkpoints     bit offset of every STRIDE-th id
    payload         the code words behind each other, high bit first, filled up to 32 bits

The blocks' order is that of (part, seq), and that is ascending doc_id order.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blobs, fresh, give_back, slices, staged, table, tidy
from .words import VISIBLE, same_bytes, span_hash, words

BLOCK, STRIDE = 1 << 16, 128
#: Units of which a worker keeps bytes and ids, of about 50 bytes each; results do not depend on it.
HELD, HELD_BYTES = 3_000_000, 1 << 28
_held: dict[str, WordIds] = {}


def _forget_units() -> None:
    """Gives a worker's units back: writing and reading files needs none."""
    if _held:
        _held.clear()
        give_back()


def _roomy(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n items."""
    while n > len(x):
        x = np.concatenate([x, np.zeros_like(x)])
    return x


def _put(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their rows with others put in place."""
    place = np.searchsorted(known[0], keys)
    return np.insert(known[0], place, keys), np.insert(known[1], place, rows)


#: a-z and 0-9
PLAIN = np.isin(np.arange(256), [*range(97, 123), *range(48, 58)])


class WordIds:
    """Encodes texts with the tokenizers library, each distinct unit once per worker.

    For tokenizers that lower-case, in which no token reaches over a space or line feed, nor from
    an ASCII letter or digit to a sign behind it, and in which tokens with END end a run of
    letters. A unit is a word between white space, or such a word without the signs that end it,
    or these signs. Units are found by 64-bit hashes in sorted arrays and compared by their bytes;
    texts in which a hash finds another unit go whole. New ones of a-z only, of
    which the normalizer and the byte level change nothing, are encoded many in one text, without
    those two; others alone. Texts with ``<|`` may hold special strings and go whole.
    """

    END = "</w>"

    def __init__(self, path: str, held: int = HELD) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.END)]] = True
        self.held = held
        self._forget()

    def _forget(self) -> None:
        # sorted hashes and their rows: most of them, and the recent ones, which are put to them now and then
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2
        self.start, self.size, self.units = np.zeros(1024, np.int32), np.zeros(1024, np.int32), 0
        self.flat, self.used = np.zeros(1024, np.uint32), 0
        self.said, self.said_at, self.said_size, self.said_used = np.zeros(1024, np.uint8), np.zeros(1024, np.int32), np.zeros(1024, np.int32), 0
        self.near, self.near_at = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)

    def _alone(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units behind each other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], np.int64), np.array([len(ids) for ids in found], np.int64)

    def _lines(self, tokenizer, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As _alone(), for units of letters, many in one text; where one does not end once, the numbers are not of units."""
        lines = [b" ".join(units[i : i + 200]).decode() for i in range(0, len(units), 200)]
        ids = np.array([i for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], np.int64)
        return ids, np.diff(np.append(-1, np.flatnonzero(self.ends[ids])))

    def _encode(self, units: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _alone(); plain: whether a unit is of a-z only."""
        kinds = np.where(plain, 0, [2 if is_plain or not u.decode().isalpha() else 1 for u, is_plain in zip(units, plain.tolist(), strict=True)])
        by_kind = [[u for u, k in zip(units, kinds.tolist(), strict=True) if k == kind] for kind in range(3)]
        size, out = np.zeros(len(units), np.int64), [np.zeros(0, np.int64)] * 3
        for kind, tokenizer in enumerate((self.bare, self.tokenizer)):
            ids, n = self._lines(tokenizer, by_kind[kind])
            if len(n) != len(by_kind[kind]):  # a letter that is not one in lower case
                ids, n = self._alone(by_kind[kind])
            out[kind], size[kinds == kind] = ids, n
        out[2], size[kinds == 2] = self._alone(by_kind[2])
        of = np.repeat(kinds, size)
        ids = np.zeros(len(of), np.int64)
        for kind in range(3):
            ids[of == kind] = out[kind]
        return ids, size

    def _rows(self, units: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The rows of start and size of units, given by ascending hash and place in data; new ones are encoded."""
        row = np.full(len(units), -1, np.int64)
        for keys, rows in self.known:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, units), len(keys) - 1)
                row = np.where(keys[at] == units, rows[at], row)
        new = np.flatnonzero(row < 0)
        if len(new):
            raw, others = data.tobytes(), np.append(0, np.cumsum((data < 97) | (data > 122)))
            plain = others[ends[new]] == others[starts[new]]
            ids, size = self._encode([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], plain)
            self.flat, self.start, self.size = (_roomy(x, n) for x, n in ((self.flat, self.used + len(ids)), (self.start, self.units + len(new)), (self.size, self.units + len(new))))
            row[new] = np.arange(self.units, self.units + len(new))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[row[new]], self.size[row[new]] = self.used + np.cumsum(size) - size, size
            n = ends[new] - starts[new]
            self.said, self.said_at, self.said_size = (_roomy(x, k) for x, k in ((self.said, self.said_used + int(n.sum())), (self.said_at, self.units + len(new)), (self.said_size, self.units + len(new))))
            self.said_at[row[new]], self.said_size[row[new]] = self.said_used + np.cumsum(n) - n, n
            self.said[self.said_used : self.said_used + n.sum()] = data[np.repeat(starts[new] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            self.said_used += int(n.sum())
            self.used, self.units = self.used + len(ids), self.units + len(new)
            most, recent = self.known
            recent = _put(recent, units[new], row[new])
            self.known = [most, recent] if len(recent[0]) < max(50_000, len(most[0]) // 8) else [_put(most, *recent), (recent[0][:0], recent[1][:0])]
        return row

    def encode(self, blobs: list[bytes], alone: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts behind each other, and how many each has. alone: texts that go whole."""
        whole = {i: self._alone([b])[0] for i, b in enumerate(blobs) if b"<|" in b or i in alone}
        found = words([b"" if i in whole else b for i, b in enumerate(blobs)], VISIBLE)
        data = found.data
        kept = PLAIN[data]
        last = np.maximum.accumulate(np.where(kept | (data > 127), np.arange(len(data), dtype=np.int32), np.int32(0)))[found.ends - 1] + 1  # behind the last that is no sign
        cut = (last > found.starts) & (last < found.ends) & kept[last - 1]
        starts, ends = np.concatenate([found.starts, last[cut]]), np.concatenate([np.where(cut, last, found.ends), found.ends[cut]])
        owner = np.concatenate([found.owner, found.owner[cut]])
        order = np.argsort(starts, kind="stable")
        starts, ends, owner = starts[order], ends[order], owner[order]
        hashes = span_hash(data, starts, ends)
        slot = (hashes >> np.uint64(48)).astype(np.int64)  # frequent units are found in a small table first
        row = np.where(self.near[slot] == hashes, self.near_at[slot], -1)
        rare = np.flatnonzero(row < 0)
        units, first, which = np.unique(hashes[rare], return_index=True, return_inverse=True)
        if self.units and (self.units + len(units) > self.held or self.said_used > HELD_BYTES):
            self._forget()
            return self.encode(blobs, alone)
        row[rare] = self._rows(units, starts[rare[first]], ends[rare[first]], found.data)[which]
        self.near[slot[rare]], self.near_at[slot[rare]] = hashes[rare], row[rare]
        n = ends - starts
        same = self.said_size[row] == n
        long = np.flatnonzero(same & (n > 8))  # shorter ones of one length have hashes of their own
        same[long] = same_bytes(self.said, self.said_at[row[long]], found.data, starts[long], n[long])
        if not same.all():
            return self.encode(blobs, alone.union(owner[~same].tolist()))
        size = self.size[row]
        last = np.cumsum(size, dtype=np.int32)
        ids = self.flat[np.repeat(self.start[row] - last + size, size) + np.arange(last[-1] if len(last) else 0, dtype=np.int32)]
        counts = np.bincount(owner, size, len(blobs)).astype(np.int64)
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            parts = [np.array(whole.get(i, p), np.uint32) for i, p in enumerate(parts)]
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts


def tokenize(docs: DataFrame, tokenizer_path: str, end: int = 1) -> tuple[DataFrame, str]:
    """A stored table of part, seq, doc_id and ids (binary) in ascending doc_id order, and the ids' dtype.

    The first row of each Arrow batch has the batch's counts of ids (counts: binary), a column of its own.

    Null texts count as empty, null doc_ids come first, rows of one doc_id go by a hash of the text.
    """
    from tokenizers import Tokenizer

    dtype = "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _held.get(tokenizer_path) or _held.setdefault(tokenizer_path, WordIds(tokenizer_path))
        part, seq, last = TaskContext.get().partitionId(), 0, np.array([end], dtype).tobytes()
        for batch in batches:
            for piece in slices(batch):
                found, counts = encoder.encode(blobs(piece))
                flat, cuts = found.astype(dtype), np.cumsum(np.append(0, counts))
                ids = [flat[a:b].tobytes() + last for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                n = np.bincount(flat)
                held = np.flatnonzero(n)
                held_counts = np.stack([held, n[held]]).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part), pa.int32()), pa.array(np.arange(seq, seq + len(ids)), pa.int64()), piece.column("doc_id"), pa.array(ids, pa.binary()), pa.array([held_counts] + [None] * (len(ids) - 1), pa.binary())], names=["part", "seq", "doc_id", "ids", "counts"])
                seq += len(ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return staged(rows.mapInArrow(tidy(run), f"part int, seq long, doc_id {kind}, ids binary, counts binary"), "token-ids", "snappy"), dtype


def count_ids(ids: DataFrame, end: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and their counts over all documents; as many rows as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column("counts").to_pylist():
                held, n = np.frombuffer(raw, "<u4").reshape(2, -1)
                total = np.pad(total, (0, max(0, (int(held[-1]) + 1 if len(held) else 0) - len(total))))
                total[held] += n
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["id", "n"])

    counted = ids.select("counts").where("counts IS NOT NULL").mapInArrow(tidy(run), "id long, n long")
    last = ids.agg(F.lit(end).cast("long").alias("id"), F.count("*").alias("n")).where("n > 0")  # each document's end id
    rows = counted.union(last).groupBy("id").agg(F.sum("n").alias("n")).toPandas().sort_values("id")
    return rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Best code lengths of at most limit bits, by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if 1 << limit < n:
        raise ValueError("the limit is too small for so many ids")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order]
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = level[0 : len(level) // 2 * 2 : 2] + level[1 : len(level) // 2 * 2 : 2]
        both = np.concatenate([leaves, packages])
        by_weight = np.argsort(both, kind="stable")
        level = both[by_weight]
        is_leaf.append(by_weight < n)
    out, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        own = int(leaf[:take].sum())
        out[order[:own]] += 1
        take = 2 * (take - own)
    return out


@dataclass
class CodeBook:
    """ids, ascending, and their code lengths; the code words follow from these."""

    ids: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, counts: np.ndarray) -> CodeBook:
        limit = max(16, int(len(ids) - 1).bit_length() + 2)
        return CodeBook(ids, code_lengths(counts, limit))

    def canonical(self) -> tuple[np.ndarray, np.ndarray]:
        """Places by ascending code word, and the code words in that order."""
        order = np.lexsort((self.ids, self.lengths))
        size = self.lengths[order]
        top = int(size[-1]) if len(size) else 1
        steps = np.left_shift(1, top - size)
        return order, (np.cumsum(steps) - steps) >> (top - size)

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Code word and length by id."""
        order, code = self.canonical()
        words, size = np.zeros(int(self.ids.max(initial=0)) + 1, np.uint64), np.zeros(int(self.ids.max(initial=0)) + 1, np.int64)
        words[self.ids[order]] = code.astype(np.uint64)
        size[self.ids] = self.lengths
        return words, size

    def decoder(self) -> tuple[np.ndarray, np.ndarray, int]:
        """By the next bits of a stream: id and length; and how many bits."""
        order, _ = self.canonical()
        size = self.lengths[order]
        top = int(size[-1]) if len(size) else 1
        many = np.left_shift(1, top - size)
        ids, sizes = np.zeros(1 << top, np.int32), np.ones(1 << top, np.int32)
        ids[: many.sum()], sizes[: many.sum()] = np.repeat(self.ids[order], many), np.repeat(size, many)
        return ids, sizes, top


def pack(ids: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code words of ids behind each other, and the bit offset of every STRIDE-th."""
    size = sizes[ids]
    ends = np.cumsum(size)
    at = ends - size
    value = words[ids] << (64 - size - (at & 31)).astype(np.uint64)
    cell, n = at >> 5, (int(ends[-1]) + 31 >> 5) + 1 if len(ids) else 1
    # code words share no bits, so sums put them together
    held = np.bincount(cell, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(cell + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:n]
    return held[: n - 1].astype(">u4").tobytes(), at[::STRIDE]


def unpack(blocks: list[tuple[bytes, np.ndarray, int]], decoder: tuple[np.ndarray, np.ndarray, int]) -> list[np.ndarray]:
    """The ids of blocks (payload, checkpoints, number of ids): all strides of all blocks in step."""
    ids, sizes, top = decoder
    starts = np.cumsum([0] + [len(p) // 4 for p, _, _ in blocks])
    data = np.frombuffer(b"".join(p for p, _, _ in blocks) + b"\0" * 8 * (STRIDE + 1), ">u4").astype(np.uint64)
    at = np.concatenate([c.astype(np.int64) + 32 * s for (_, c, _), s in zip(blocks, starts, strict=False)]) if blocks else np.zeros(0, np.int64)
    out = np.zeros((STRIDE, len(at)), np.int32)
    last = 32 * (len(data) - 2)
    for row in out:
        cell = at >> 5
        window = data[cell] << np.uint64(32) | data[cell + 1]
        bits = (window >> (64 - top - (at & 31)).astype(np.uint64)).astype(np.int64) & (1 << top) - 1
        row[:] = ids[bits]
        at = np.minimum(at + sizes[bits], last)
    lanes = np.cumsum([0] + [len(c) for _, c, _ in blocks])
    return [out[:, a:b].T.ravel()[:n] for (_, _, n), a, b in zip(blocks, lanes[:-1], lanes[1:], strict=True)]


def write(ids: DataFrame, dtype: str, end: int = 1, path: str | None = None) -> str:
    """Writes tokenize()'s table as a file set and gives its path, a new one in the shared folder if none is given."""
    spark = ids.sparkSession
    path = path or fresh(spark, "token-file")
    book = CodeBook.of(*count_ids(ids, end))
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(book.ids, book.lengths, strict=True)], "id long, length int").coalesce(1).write.parquet(f"{path}/book")  # as many rows as the vocabulary at most
    shared = ids.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_units()
        words, sizes = shared.value.encoder()
        held: list[tuple[int, int, object, np.ndarray]] = []
        n_ids = 0

        def block() -> pa.RecordBatch:
            payload, marks = pack(np.concatenate([x[3] for x in held]).astype(np.int64), words, sizes)
            columns = [pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]], pa.int64()), pa.array([[x[2] for x in held]], pa.list_(doc_type)), pa.array([[len(x[3]) for x in held]], pa.list_(pa.int64())), pa.array([marks.astype("<i8").tobytes()], pa.binary()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_ids", "sizes", "checkpoints", "payload"])

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for part, seq, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "doc_id", "ids")), strict=True):
                if held and (part != held[0][0] or seq != held[-1][1] + 1 or n_ids >= BLOCK):
                    yield block()
                    held, n_ids = [], 0
                held.append((part, seq, doc, np.frombuffer(raw, dtype)))
                n_ids += len(raw) // np.dtype(dtype).itemsize
        if held:
            yield block()

    kind = ids.schema["doc_id"].dataType.simpleString()
    rows = ids.drop("counts").mapInArrow(tidy(run), f"part int, seq long, doc_ids array<{kind}>, sizes array<long>, checkpoints binary, payload binary")
    rows.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    return path


def read_book(spark: SparkSession, path: str) -> CodeBook:
    rows = spark.read.parquet(f"{path}/book").orderBy("id").toPandas()
    return CodeBook(rows["id"].to_numpy(np.int64), rows["length"].to_numpy(np.int64))


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, doc_id, n_tokens and ids (array<int>) of each document in the file set at path."""
    return _read(spark, path, "ids array<int>", lambda ids: pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """As read(), with ids_crc32 over the ids as little-endian unsigned 32-bit integers instead of the ids."""
    return _read(spark, path, "ids_crc32 long", lambda ids: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()))


def _read(spark: SparkSession, path: str, field: str, made) -> DataFrame:
    files, shared = spark.read.parquet(f"{path}/blocks"), spark.sparkContext.broadcast(read_book(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_units()
        decoder = shared.value.decoder()
        for batch in batches:
            for first in range(0, batch.num_rows, 16):
                piece = batch.slice(first, 16)
                sizes = [np.array(x, np.int64) for x in piece.column("sizes").to_pylist()]
                blocks = [(p, np.frombuffer(c, "<i8"), int(s.sum())) for p, c, s in zip(piece.column("payload").to_pylist(), piece.column("checkpoints").to_pylist(), sizes, strict=True)]
                ids = [x for whole, s in zip(unpack(blocks, decoder), sizes, strict=True) for x in np.split(whole, np.cumsum(s)[:-1])]
                n = [len(s) for s in sizes]
                seq = np.repeat(piece.column("seq").to_numpy(), n) + np.concatenate([np.arange(k) for k in n])
                columns = [pa.array(np.repeat(piece.column("part").to_numpy(), n), pa.int32()), pa.array(seq, pa.int64()), piece.column("doc_ids").flatten(), pa.array(np.concatenate(sizes), pa.int64()), made(ids)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "n_tokens", field.split()[0]])

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return files.mapInArrow(tidy(run), f"part int, seq long, doc_id {kind}, n_tokens long, {field}")


def with_starts(documents: DataFrame, path: str) -> DataFrame:
    """documents, as read from path, with start, the number of ids of all documents before it: sums by part from the blocks' sizes, then inside each part."""
    parts = documents.sparkSession.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = documents.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(parts, "part").withColumn("start", F.col("base") + F.col("own")).drop("base", "own")


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids, dtype = tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    path = write(ids, dtype)
    return with_starts(read_checksums(spark, path), path).select("doc_id", "start", "n_tokens", "ids_crc32")
