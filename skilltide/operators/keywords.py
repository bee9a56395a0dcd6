"""Keywords in texts by Aho-Corasick automata, for dictionaries of any size.

Keywords come in blocks of at most BLOCK, in the order in which Spark hands them over; each block is
broadcast, and the texts stream past its automaton in Arrow batches. A dictionary of ten keywords is
one block, one of ten million a hundred, in the same plan: what the blocks find is put together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Keywords in a block; its automaton takes some 100 MB of a worker at most.
BLOCK = 100_000

#: The automaton that this worker used last, by the name of its block.
_held: dict[str, object] = {}


def blocks(words: DataFrame) -> Iterator[pa.Table]:
    """The rows of words in tables of at most BLOCK; one of them is with the driver at a time."""
    held: list[tuple] = []
    fields = words.columns
    table = lambda rows: pa.table({c: [r[i] for r in rows] for i, c in enumerate(fields)}, pa.schema([(c, pa.string()) for c in fields]))
    for row in words.toLocalIterator():
        held.append(tuple(row))
        if len(held) == BLOCK:
            yield table(held)
            held = []
    yield table(held)


def by_block(texts: DataFrame, words: DataFrame, build: Callable[[pa.Table], object], find: Callable[[object, pa.RecordBatch], pa.RecordBatch], schema: str) -> list[DataFrame]:
    """For each block of words (text columns), what find gives for batches of texts and the block as build makes it."""
    out = []
    for block in blocks(words):
        shared, name = texts.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _held:
                _held.clear()
                _held[name] = build(shared.value)
            for batch in batches:
                yield find(_held[name], batch)

        out.append(texts.mapInArrow(run, schema))
    return out


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Containment:
    """Rows of a block by keyword, and an automaton over the keywords."""

    def __init__(self, block: pa.Table) -> None:
        self.block = block
        rows: dict[str, list[int]] = {}
        for i, word in enumerate(block["keyword"].to_pylist()):
            rows.setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, own in rows.items():
            self.automaton.add_word(word, tuple(own))
        if rows:
            self.automaton.make_automaton()
        self.empty = not rows

    def find(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, entries = [], []
        if not self.empty:
            for i, text in enumerate(batch.column("text").to_pylist()):
                for own in {own for _, own in self.automaton.iter(text)} if text else ():
                    entries += own
                    texts += [i] * len(own)
        keys = batch.drop_columns(["text"]).take(pa.array(texts, pa.int64()))
        words = self.block.take(pa.array(entries, pa.int64())).combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in words.columns]
        return pa.RecordBatch.from_arrays([*keys.columns, *columns], names=[*keys.schema.names, *words.schema.names])


def contained(texts: DataFrame, words: DataFrame) -> DataFrame:
    """The other columns of texts (text) with all of words (keyword and other text columns), for each word that a text contains, once.

    Both are compared as they are spelt. Empty and null texts and keywords contain nothing. words has no column of texts.
    """
    words = words.where("keyword <> ''")
    kept = [f for f in texts.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*kept, *words.schema])
    return union(by_block(texts.select(*(f"`{f.name}`" for f in kept), "text"), words, Containment, lambda c, b: c.find(b), schema))
