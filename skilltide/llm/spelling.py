"""Spelling variants: words at one edit from each other, by Aho-Corasick automata over halves of words.

A word is cut in two, and a word at one inserted, deleted or replaced sign from it holds one of
the two as it is: the first at its start or the second at its end. Halves are dealt by hash over
shards of about SHARD each, and a shard keeps an automaton over its halves. Every word is scanned by
the shards that can hold a half of a partner: a word of m signs has partners of m - 1 to m + 1, so
its start counts in two lengths, and its end in two. A half that more than SHARD words share is
dealt over parts, and the words that begin or end with it are scanned by each part.

A hit counts if it lies at the right end and the lengths agree; of the words with that half,
those are looked up that agree in a quarter more, and the edits between the two are compared. A
pair that agrees in its first half is left to that half's shard, so each is found once. What
leaves a shard is a row for each scanned word: the number of its partners and the best of them.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged, table, texts, tidy

#: Halves in a shard, words scanned at a time, results of a task that are held before they go on, signs of a word that are compared in numpy.
SHARD, STEP, HELD, WIDE = 8192, 8192, 300_000, 64
LEAST_SIGNS, LEAST_TIMES, TIMES_MORE = 6, 5, 5
_OUTSIDE = ord(" ")
#: By Latin-1 byte: letters [A-Za-zÀ-ÿ], A-Z in lower case, a space for all others.
_LETTERS = bytes((b + 32 if 65 <= b <= 90 else b) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 else _OUTSIDE for b in range(256))


def runs(text: str) -> list[bytes]:
    """The letter runs of a text, a byte for each code point; signs beyond Latin-1 become `?`, which is no letter."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def misspelt(key: bytes, run: bytes, every: int) -> bytes:
    """run, or run without a sign where every divides the crc32 of key and run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(key))
    return run if h % every else run[: (at := h % len(run))] + run[at + 1 :]


def word_counts(docs: DataFrame, every: int = 199, signs: int = LEAST_SIGNS) -> DataFrame:
    """word and n: how often each result of at least signs code points occurs in docs (doc_id, text).

    A null text has no runs. Where doc_id is null there is no key, and no sign is deleted.
    Repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        crc, get = zlib.crc32, total.get

        def flush() -> pa.RecordBatch:
            words = b"\n".join(total).decode("latin-1").split("\n") if total else []
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("key").to_pylist(), texts(part), strict=True):
                    key = None if doc is None else b"%s:" % doc.encode()
                    start = key and crc(key)
                    for w, k in Counter(runs(text)).items():
                        if len(w) < signs:
                            continue
                        if key is not None and not crc(w if w.isascii() else w.decode("latin-1").encode(), start) % every:
                            w = misspelt(key, w, every)
                            if len(w) < signs:
                                continue
                        total[w] = get(w, 0) + k
                if len(total) > HELD:
                    yield flush()
        yield flush()

    said = docs.select(F.col("doc_id").cast("string").alias("key"), "text")
    return said.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Shard:
    """An automaton over halves: of each, the words that start (kind 0) or end (kind 1) with it."""

    def __init__(self, kinds: list[int], words: list[str], times: list[int]) -> None:
        import ahocorasick

        self.words, self.times = words, np.array(times, np.int64)
        self.kinds = np.array(kinds, np.int64)
        self.order = np.argsort(np.argsort(np.array(words, object), kind="stable")) if words else np.zeros(0, np.int64)
        self.rows, self.size = _matrix(words)
        self.index: dict[tuple, list[int]] = defaultdict(list)
        self.automaton = ahocorasick.Automaton()
        ends: dict[str, int] = defaultdict(int)
        for i, (kind, w) in enumerate(zip(kinds, words, strict=True)):
            h = len(w) // 2
            half, rest = (w[h:], w[:h]) if kind else (w[:h], w[h:])
            q = len(rest) // 2
            self.index[kind, half, len(w), 0, rest[:q]].append(i)
            self.index[kind, half, len(w), 1, rest[q:]].append(i)
            ends[half] |= 1 << kind
        for half, mark in ends.items():
            self.automaton.add_word(half, (len(half), mark))
        if words:
            self.automaton.make_automaton()

    def candidates(self, word: str) -> list[int]:
        """Places of words that share a half and a quarter with word where an edit of the rest leaves them."""
        out, size, find = [], len(word), self.index.get
        for last, (n, mark) in self.automaton.iter(word):
            for kind in (0, 1):
                if not mark >> kind & 1 or (last != size - 1 if kind else last != n - 1):
                    continue
                half, rest = word[size - n :] if kind else word[:n], word[: size - n] if kind else word[n:]
                for length in (2 * n - 1, 2 * n) if kind else (2 * n, 2 * n + 1):
                    if -1 <= length - size <= 1:
                        q = (length - n) // 2
                        out += find((kind, half, length, 0, rest[:q]), ())
                        out += find((kind, half, length, 1, rest[len(rest) - (length - n - q) :]), ())
        return out

    def near(self, scanned: list[str]) -> pa.RecordBatch:
        """Of each scanned word that has partners here: their number, and the best, as its n and the word."""
        who, what = [], []
        if self.words:
            for i, word in enumerate(scanned):
                found = self.candidates(word)
                what += found
                who += [i] * len(found)
        pairs = np.unique(np.array(who, np.int64) * (len(self.words) or 1) + np.array(what, np.int64))
        who, what = pairs // (len(self.words) or 1), pairs % (len(self.words) or 1)
        rows, size = _matrix(scanned)
        keep = np.zeros(len(who), bool)
        for at in range(0, len(who), 1 << 16):
            a, b = who[at : at + (1 << 16)], what[at : at + (1 << 16)]
            before, behind = _common(rows[a], size[a], self.rows[b], self.size[b])
            for k in np.flatnonzero(np.maximum(size[a], self.size[b]) > WIDE):
                before[k], behind[k] = _common_of(scanned[a[k]], self.words[b[k]])
            longer = np.maximum(size[a], self.size[b])
            one = (before + behind >= longer - 1) & ~((before == longer) & (size[a] == self.size[b]))
            keep[at : at + (1 << 16)] = one & ~((self.kinds[b] == 1) & (before >= self.size[b] // 2))
        who, what = who[keep], what[keep]
        order = np.lexsort((self.order[what], -self.times[what], who))
        who, what = who[order], what[order]
        own, first, n = np.unique(who, return_index=True, return_counts=True)
        best = what[first]
        columns = [pa.array([scanned[i] for i in own], pa.string()), pa.array(n, pa.int64()), pa.array(self.times[best], pa.int64()), pa.array([self.words[i] for i in best], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "form_n", "form"])


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The first WIDE signs of each word, filled up with zeros, and all sizes."""
    held = np.array([w.encode("latin-1")[:WIDE] for w in words] or [b""], f"S{WIDE}")
    return held.view(np.uint8).reshape(len(held), WIDE), np.array([len(w) for w in words], np.int64)


def _common(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of what the rows of two matrices share at the start and at the end."""
    least = np.minimum(a_size, b_size)
    unlike = a != b
    before = np.where(unlike.any(1), unlike.argmax(1), WIDE)
    steps = np.arange(WIDE)
    back = lambda m, n: np.take_along_axis(m, np.clip(n[:, None] - 1 - steps, 0, WIDE - 1), 1)
    unlike = back(a, a_size) != back(b, b_size)
    behind = np.where(unlike.any(1), unlike.argmax(1), WIDE)
    return np.minimum(before, least), np.minimum(behind, least)


def _common_of(a: str, b: str) -> tuple[int, int]:
    least = min(len(a), len(b))
    before = next((i for i in range(least) if a[i] != b[i]), least)
    return before, next((i for i in range(least) if a[-1 - i] != b[-1 - i]), least)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard and part, halves (kind 0 and 1) before the words to scan (kind 2), which may repeat."""
    at, shard, kinds, words, times, waiting, last = None, None, [], [], [], [], None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("shard", "part", "kind", "word", "n"))
        for here, part, kind, word, n in zip(*columns, strict=True):
            if (here, part) != at:
                if waiting:
                    yield shard.near(waiting)
                at, shard, kinds, words, times, waiting, last = (here, part), None, [], [], [], [], None
            if kind < 2:
                kinds.append(kind)
                words.append(word)
                times.append(n)
                continue
            if shard is None:
                shard = Shard(kinds, words, times)
            if word == last:
                continue
            last = word
            waiting.append(word)
            if len(waiting) >= STEP:
                yield shard.near(waiting)
                waiting = []
    if waiting:
        yield shard.near(waiting)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form_n and form of each of words (word, n; each word once) that has near words.

    form is the near word of largest n, the smallest in code-point order of those. Words have at
    least six signs of Latin-1.
    """
    size = F.length("word")
    halves = words.select("word", "n", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.expr("left(word, int(length(word) / 2))").alias("half")), F.struct(F.lit(1).alias("kind"), F.expr("right(word, length(word) - int(length(word) / 2))").alias("half")))).alias("h")).select("word", "n", "h.*")
    # the starts and ends of a word that a partner of m - 1, m or m + 1 signs can have as a half
    starts = F.array_distinct(F.array(F.floor((size - 1) / 2), F.floor((size + 1) / 2)).cast("array<int>"))
    ends = F.array_distinct(F.array(F.ceil((size - 1) / 2), F.ceil((size + 1) / 2)).cast("array<int>"))
    both = F.concat(F.transform(starts, lambda k: F.struct(F.lit(0).alias("kind"), F.expr("word").substr(F.lit(1), k).alias("half"))), F.transform(ends, lambda k: F.struct(F.lit(1).alias("kind"), F.expr("word").substr(size - k + 1, k).alias("half"))))
    asked = words.select("word", F.explode(both).alias("h")).select("word", "h.*")
    total = words.count()
    shards = max(1, -(-2 * total // SHARD))
    home = F.pmod(F.xxhash64("kind", "half"), F.lit(shards))
    hot = halves.groupBy("kind", "half").count().where(F.col("count") > SHARD).select("kind", "half", F.ceil(F.col("count") / SHARD).cast("int").alias("parts"))
    # at most one of SHARD halves is hot, and each is one row
    halves, asked = (d.join(hot, ["kind", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("shard", home) for d in (halves, asked))
    # a hot half has shards of its own, by the half; all others share theirs
    own = F.when(F.col("parts") > 1, F.xxhash64("kind", "half")).otherwise(F.lit(0))
    part = lambda p: F.when(F.col("parts") > 1, F.xxhash64(own, p)).otherwise(F.lit(0))
    left = halves.select("shard", part(F.pmod(F.xxhash64("word", F.lit(3)), F.col("parts").cast("long"))).alias("part"), "kind", "word", "n")
    right = asked.select("word", "shard", "parts", "kind", "half", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
    right = right.select("shard", part(F.col("p").cast("long")).alias("part"), F.lit(2).alias("kind"), "word", F.lit(None).cast("long").alias("n"))
    dealt = left.unionByName(right).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "word")
    found = dealt.mapInArrow(tidy(_scan), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word and root: the end of each chain of forms (word, form); most: the largest n of a word.

    A form has at least TIMES_MORE the occurrences of its word, so chains have a bounded length, and
    each join doubles what has been walked.
    """
    walked = forms.select("word", F.col("form").alias("root"))
    hops = max(1, math.ceil(math.log(max(most, 2), TIMES_MORE)))
    for _ in range(math.ceil(math.log2(hops))):
        walked = staged(walked, "spelling-roots")
        on = walked.select(F.col("word").alias("root"), F.col("root").alias("further"))
        walked = walked.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return walked


def variants(docs: DataFrame, every: int = 199, signs: int = LEAST_SIGNS, times: int = LEAST_TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of the words of docs (doc_id, text; other columns are not read).

    Words are the results of word_counts() of at least signs (six or more) code points and at
    least times occurrences. A word's form is its near word of largest n (ties: the smallest),
    if that is TIMES_MORE times its own; root is where forms lead. An empty table gives no rows.
    """
    words = staged(word_counts(docs, every, signs).where(F.col("n") >= times), "spelling-words")
    most = words.agg(F.max("n")).first()[0]
    fine = F.col("form_n") >= TIMES_MORE * F.col("n")
    found = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fine, F.col("form")).alias("form"), F.when(fine, F.col("form_n")).alias("form_n"))
    found = staged(found, "spelling-near")
    ends = roots(found.where("form IS NOT NULL"), most or 0)
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")
