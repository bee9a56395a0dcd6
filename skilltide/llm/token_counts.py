"""Token counts: pieces are counted once per distinct pre-token, joined to each document's
pre-token frequencies and summed, so that no document's ids are ever held.

A pre-token of the byte-level pattern splits into itself when it stands alone, so the library's
count for it alone is its share of any text. One pass over the documents makes the frequencies.
Pre-tokens are joined to their counts in two ways. Those that a sample of documents has most of,
FREQUENT at most and none longer than SHORT characters, are counted first, broadcast, and summed
where the frequencies are made. All others leave the task with their document's number and
frequency, are counted once each over all documents, joined by hash and summed by document. The
sample decides which way a pre-token goes, and no result depends on it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, staged, table, texts, tidy

#: Documents of the sample, pre-tokens that are broadcast, and the most characters that one of them has.
SAMPLE, FREQUENT, SHORT = 20_000, 200_000, 32
_held: dict[str, PieceCounter] = {}


class PieceCounter:
    """Pre-tokens of texts, and numbers of tokens by pre-token, for one tokenizer file with a byte-level pre-tokenizer."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        # special strings in a text are one token by the library's default, and cut it
        special = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(special)) if special else None

    @staticmethod
    def of(path: str) -> PieceCounter:
        return _held.get(path) or _held.setdefault(path, PieceCounter(path))

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Frequencies of pre-tokens, and the number of special strings."""
        if self.special is None or self.special.search(text) is None:
            return Counter(self.pieces(text)), 0
        parts = self.special.split(text)
        found = Counter()
        for part in parts:
            found.update(self.pieces(part))
        return found, len(parts) - 1

    def counts(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def counted(pieces: DataFrame, tokenizer_path: str) -> DataFrame:
    """pieces (piece) with n, the number of tokens of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "piece"):
                n = PieceCounter.of(tokenizer_path).counts(part.column("piece").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("piece"), pa.array(n, pa.int64())], names=["piece", "n"])

    return pieces.select("piece").mapInArrow(tidy(run), "piece string, n long")


def frequent(said: DataFrame, tokenizer_path: str) -> dict[str, int]:
    """The numbers of tokens of the most frequent short pre-tokens of a sample of said (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in texts(batch):
                total.update(PieceCounter.of(tokenizer_path).frequencies(text)[0])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["piece", "times"])

    some = said.sample(False, min(1.0, SAMPLE / max(1, said.count())), 17)
    most = some.mapInArrow(tidy(run), "piece string, times long").where(F.length("piece") <= SHORT).groupBy("piece").agg(F.sum("times").alias("times"))
    rows = counted(most.orderBy(F.desc("times"), "piece").limit(FREQUENT), tokenizer_path).toArrow()
    return dict(zip(rows["piece"].to_pylist(), rows["n"].to_pylist(), strict=True))


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more tokens than limit) in place of the text.

    A null or empty text has 0 bytes and 0 tokens. Columns of docs with the names of the results
    are replaced; all others pass, whatever their names. Repeated rows are counted each, and an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in {text, "n_bytes", "n_tokens", "over_limit"}]
    said = docs.select(F.struct(*kept or [F.lit(None).cast("int")]).alias("kept"), F.col(f"`{text}`").alias("text"))
    known = spark.sparkContext.broadcast(frequent(said.select("text"), tokenizer_path))
    rare_type = pa.struct([("piece", pa.string()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, get = PieceCounter.of(tokenizer_path), known.value.get
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                sums, rare, times, cuts = [], [], [], [0]
                for t in texts(part):
                    found, special = counter.frequencies(t)
                    n = [get(p, 0) for p in found]
                    sums.append(special + sum(map(mul, found.values(), n)))
                    if 0 in n:
                        for p, k in zip(found, n, strict=True):
                            if not k:
                                rare.append(p)
                                times.append(found[p])
                    cuts.append(len(rare))
                pairs = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int64())], fields=list(rare_type))
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                columns = [part.column("kept"), pa.array(range(at, at + len(sums)), pa.int64()), size, pa.array(sums, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pairs)]
                at += len(sums)
                yield pa.RecordBatch.from_arrays(columns, names=["kept", "row", "n_bytes", "sum", "rare"])

    schema = T.StructType([said.schema["kept"]]).add("row", "long").add("n_bytes", "long").add("sum", "long").add("rare", T.ArrayType(T.StructType().add("piece", "string").add("times", "long")))
    # stored, so that a row keeps its number
    rows = staged(said.mapInArrow(tidy(run), schema), "token-counts")
    pairs = rows.select("row", F.explode("rare").alias("r")).select("row", "r.piece", "r.times")
    rest = pairs.join(counted(pairs.select("piece").distinct(), tokenizer_path), "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("rest"))
    n_tokens = F.col("sum") + F.coalesce("rest", F.lit(0))
    out = rows.drop("rare").join(rest, "row", "left")
    return out.select(*(["kept.*"] if kept else []), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
