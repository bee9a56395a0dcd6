"""N-gram Jaccard join with adaptive multi-match prefixes.

Sets of equal content are one class. Classes of n and m shingles that link share at least
a = ceil(t / (1 + t) * (n + m)) of them, and at least ceil(t * n) whatever m is. With shingles in
one global order, rare ones first, the first n - a + k of one and m - a + k of the other then
share k or more. Each class posts as many as any partner may need. It picks its own k by estimated
cost, candidates against the postings that a longer prefix reads, and a pair has to share as many
shingles of the prefixes for its own sizes as the smaller k of both before it is verified.

Copies of one text with small changes make long postings. So verification comes in rounds. First
each class meets the first class of each of its postings, one candidate for each row. Then, only
in postings in which different components meet, all pairs of classes of different components
follow. A pair that is already in one component has its link, or a path of links, and nothing is
left out.

Classes that came out similar, if not similar enough, form families, and in a family of FAMILY
classes or more pairs do not meet by postings, of which they have most in common, but by what they
differ in from a centre, the shingles that most of a few members have; any centre gives right
results. With d(x) differences and c shared ones, two classes have d(x) + d(y) - 2c shingles that
are not in both. Pairs that link without a shared difference all link to the member that is
nearest to the centre for its size, so this member meets all. Other pairs have to share one or
more, the larger their own numbers the more, which prefixes of rare differences first make use of.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blobs, keyed, shared_dir, slices, staged, table, tidy
from .components import components
from .words import VISIBLE, mix, shingles, words

SHINGLE, THRESHOLD = 4, 85
#: Buckets of the frequency estimate, and the most shared shingles that a prefix may ask for.
SKETCH, MATCHES = 1 << 18, 8
#: Classes in a family that meet by differences, members that make its centre, and the similarity in per cent of a family.
FAMILY, CENTRE, SIMILAR = 64, 31, 60
#: Shingles sorted at a time for the estimate.
HELD = 2_000_000
#: Cost of verifying a candidate, in postings read.
VERIFY = 8


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending; fewer words than size are one shingle."""
    found = words(texts, VISIBLE)
    whole = shingles(found.hashes, size)
    out = []
    for a, b in zip(found.first[:-1], found.first[1:], strict=True):
        out.append(np.unique(whole[a : b - size + 1] if b - a >= size else shingles(found.hashes[a:b], b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def set_keys(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, own, n and a 128-bit key of each document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(blobs(part), size)
                k = [np.array([f(s).sum(dtype=np.uint64) for s in sets], np.uint64) for f in (lambda s: mix(s), lambda s: mix(s ^ np.uint64(0x5851F42D4C957F2D)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("own"), pa.array([len(s) for s in sets], pa.int64()), _signed(k[0]), _signed(k[1])], names=["doc_id", "own", "n", "k1", "k2"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, own {kind}, n long, k1 long, k2 long")


def frequency_sketch(docs: DataFrame, size: int) -> np.ndarray:
    """Estimated number of documents by bucket of shingles, from all documents.

    Shingles in one document only of the HELD that are counted together are left out of the
    sums, else the many rare ones would fill the buckets. The estimate sets an order; results never depend on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(SKETCH, np.int64), [np.zeros(0, np.uint64)]

        def count() -> None:
            both = np.sort(np.concatenate(held))
            cut = np.flatnonzero(np.concatenate([both[:1] == both[:1], both[1:] != both[:-1]]))
            n = np.diff(np.append(cut, len(both)))
            np.add.at(total, (both[cut[n > 1]] % np.uint64(SKETCH)).astype(np.int64), n[n > 1])

        for batch in batches:
            for part in slices(batch):
                held += shingle_sets(blobs(part), size)
                if sum(map(len, held)) > HELD:
                    count()
                    held = [np.zeros(0, np.uint64)]
        count()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def prefix(found: np.ndarray, sketch: np.ndarray, threshold: int) -> tuple[np.ndarray, int]:
    """The prefix of a set and the number k of shared shingles it stands for."""
    n = len(found)
    spare = n - -(-threshold * n // 100)
    often = sketch[(found % np.uint64(SKETCH)).astype(np.int64)]
    first = np.argsort(often, kind="stable")[: spare + MATCHES]  # ties go by the shingles' own order
    read = np.cumsum(often[first])
    ks = np.arange(1, min(MATCHES, n - spare) + 1)
    cost = read[spare + ks - 1] * (1 + VERIFY / ks)
    k = int(ks[np.argmin(cost)])
    return found[first[: spare + k]], k


def prefixes(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """doc_id, n, k and prefix (array<long>)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(blobs(part), size)
                made = [prefix(s, shared.value, threshold) if len(s) else (s, 1) for s in sets]
                cuts = np.concatenate([[0], np.cumsum([len(p) for p, _ in made])]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(cuts), _signed(np.concatenate([np.zeros(0, np.uint64), *(p for p, _ in made)])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k for _, k in made], pa.int32()), held], names=["doc_id", "n", "k", "prefix"])

    return docs.mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, k int, prefix array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """doc_id and held (binary: the sorted shingles) of the documents in wanted, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(blobs(part), size)], pa.binary())], names=["doc_id", "held"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, held binary").dropDuplicates(["doc_id"])
    return staged(sets, "sets", "uncompressed")


def _set(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.uint64)


def scored(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """a, b, common and total (sum of the sets' sizes) of pairs (a, b) of a similarity of least per cent or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, total = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                both = np.sort(np.concatenate([_set(x), _set(y)]))
                common.append(int((both[1:] == both[:-1]).sum()))
                total.append(len(both))
            good = [c > 0 and 100 * c >= least * (t - c) for c, t in zip(common, total, strict=True)]
            rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "common", "total"])
            yield rows.filter(pa.array(good, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("held").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("held").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(check), f"a {kind}, b {kind}, common long, total long")


def family_differences(near: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, root, n, d and differences (array<long>) of the members of large families of near pairs (a, b)."""
    members = components(near).withColumnsRenamed({"node": "rep", "component": "root"})
    large = members.groupBy("root").agg(F.count("*").alias("m")).where(F.col("m") >= FAMILY)
    # about twice the members needed, and the root, so that no more than that is ranked of a family
    place = F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) / (1 << 40)
    some = members.join(large, "root").where((place * F.col("m") <= 2 * CENTRE) | (F.col("rep") == F.col("root")))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(place, "rep"))
    few = some.withColumn("rank", rank).where(F.col("rank") <= CENTRE)
    members = members.join(large, "root", "left_semi")
    kind = near.schema["a"].dataType.simpleString()
    held = sets.withColumnRenamed("doc_id", "rep")

    def centre(rows: pa.Table) -> pa.Table:
        shingle, n = np.unique(np.concatenate([_set(x) for x in rows["held"]]), return_counts=True)
        return pa.table({"root": rows["root"].slice(0, 1), "centre": pa.array([shingle[2 * n > rows.num_rows].tobytes()], pa.binary())})

    centres = few.join(held, "rep").select("root", "held").groupBy("root").applyInArrow(centre, f"root {kind}, centre binary")

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, close = [], []
            for x, m in zip(batch.column("held"), batch.column("centre"), strict=True):
                x, m = _set(x), _set(m)
                more, less = np.setdiff1d(x, m, True), np.setdiff1d(m, x, True)
                out.append(np.concatenate([more, mix(less ^ np.uint64(0x5851F42D4C957F2D))]))
                close.append(100 * (len(x) - len(more)) >= SIMILAR * (len(m) + len(more)))
            cuts = np.cumsum([0] + [len(x) for x in out]).astype(np.int32)
            rows = [batch.column("rep"), batch.column("root"), pa.array([len(_set(x)) for x in batch.column("held")], pa.int64()), pa.array([len(x) for x in out], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), _signed(np.concatenate([np.zeros(0, np.uint64), *out])))]
            yield pa.RecordBatch.from_arrays(rows, names=["rep", "root", "n", "d", "differences"]).filter(pa.array(close, pa.bool_()))

    both = members.join(held, "rep").join(centres, "root").select("rep", "root", "held", "centre")
    return staged(both.mapInArrow(tidy(differences), f"rep {kind}, root {kind}, n long, d long, differences array<long>"), "differences")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text).

    Documents link if 100 * intersection >= threshold * union of their sets of distinct
    shingles of size words; component_id is the least doc_id that links reach. Empty sets (null,
    empty or blank texts) link with nothing. Rows with a null doc_id keep a null component. Rows
    that repeat a document have its component; one whose doc_id has another, lesser text links with
    nothing. Other columns are left out, and an empty table gives an empty one.
    """
    shared_dir(docs.sparkSession)
    docs = keyed(docs.select("doc_id", "text")).select(F.col("_key").alias("doc_id"), F.col("doc_id").alias("own"), "text")
    keys = staged(set_keys(docs, size), "set-keys")
    classes = keys.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = staged(classes, "classes")
    reps = classes.select(F.col("rep").alias("doc_id"))
    rows = prefixes(docs, size, threshold).join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = staged(rows.select(F.col("doc_id").alias("rep"), "n", "k", F.posexplode("prefix").alias("i", "token")), "postings")
    heads = rows.groupBy("token").agg(F.min(F.struct("rep", "n", "k", "i")).alias("h"), F.max("rep").alias("last"), F.count("*").alias("posts")).where("h.rep < last")
    shared = staged(rows.join(heads.select("token", "h", "posts"), "token"), "shared-postings")

    # of sizes that can link, and the token in the prefixes that a pair of these sizes needs
    least = f"({threshold} * (n + n2) + {99 + threshold}) div {100 + threshold} - least(k, k2)"
    fits = f"100 * least(n, n2) >= {threshold} * greatest(n, n2) AND i < n - ({least}) AND i2 < n2 - ({least})"
    met = shared.where("rep > h.rep").select(F.col("rep").alias("a"), "n", "k", "i", F.col("h.rep").alias("b"), F.col("h.n").alias("n2"), F.col("h.k").alias("k2"), F.col("h.i").alias("i2"), "posts")
    star = met.where(fits).groupBy("a", "b").agg(F.count("*").alias("m"), F.first(F.least("k", "k2")).alias("k")).where("m >= k").select("a", "b")
    # in long postings one shared shingle is enough to see who is of the family
    alike = f"100 * least(n, n2) >= {SIMILAR} * greatest(n, n2)"
    star = star.union(met.where(F.col("posts") >= FAMILY).where(alike).select("a", "b")).distinct()
    star = staged(star, "star")
    sets = sets_of(docs, star.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), size)
    near = staged(scored(star, sets, min(SIMILAR, threshold)), "near")
    links = near.where(f"100 * common >= {threshold} * (total - common)").select("a", "b")

    family = family_differences(near.select("a", "b"), sets)
    # what a class is too far from the centre to link by differences of its own; negative: how much it may lack
    over = family.select("rep", "root", (F.col("d") * (100 + threshold) - F.col("n") * (100 - threshold)).alias("e"))
    nearest = over.groupBy("root").agg(F.min(F.struct("e", "rep")).alias("m"))
    links = staged(links.unionByName(over.join(nearest, "root").where("rep <> m.rep AND e + m.e <= 0").select(F.col("rep").alias("a"), F.col("m.rep").alias("b"))), "links")
    own = components(links).withColumnsRenamed({"node": "rep", "component": "c"})

    def named(df: DataFrame) -> DataFrame:
        return df.join(own, "rep", "left").withColumn("c", F.coalesce("c", "rep"))

    # in families: pairs of different components that share so many differences as to link, found by prefixes of rare differences first
    # no partner asks for fewer shared differences than the nearest to the centre would
    fewest = over.join(nearest, "root").select("rep", F.greatest(F.lit(1), F.floor((F.col("e") + F.col("m.e") + 2 * (100 + threshold) - 1) / (2 * (100 + threshold)))).alias("fewest"))
    apart = named(family.select("rep", "root", "n", "d", F.explode("differences").alias("token")))
    often = apart.groupBy("root", "token").agg(F.count("*").alias("often"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("often", "token")) - 1
    apart = apart.join(often, ["root", "token"]).withColumn("i", place).where("c1 < c2").join(fewest, "rep").where("i <= d - fewest").select("root", "token", "rep", "n", "d", "i", "c")
    apart = staged(apart, "mixed-differences")
    other = apart.select("root", "token", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("i").alias("i2"), F.col("c").alias("c2"))
    shared_least = f"greatest(1, ({100 + threshold} * (d + d2) - {100 - threshold} * (n + n2) + {2 * (100 + threshold) - 1}) div {2 * (100 + threshold)})"
    pairs = apart.join(other, ["root", "token"]).where(f"rep < rep2 AND c <> c2 AND i <= d - {shared_least} AND i2 <= d2 - {shared_least}").select("rep", "rep2").distinct()
    side = family.select("rep", "n", "d", "differences")
    both = pairs.join(side, "rep").join(side.toDF("rep2", "n2", "d2", "differences2"), "rep2")
    found = both.where(f"{100 + threshold} * (d + d2 - 2 * size(array_intersect(differences, differences2))) <= {100 - threshold} * (n + n2)").select(F.col("rep").alias("a"), F.col("rep2").alias("b"))

    # by postings: pairs of different components that are not of one family; a root that is not in its family itself, for its distance to the centre, stands alone
    held = named(shared).join(family.select("rep", "root"), "rep", "left").withColumn("f", F.struct(F.col("root").isNull(), F.coalesce("root", "rep"))).select("token", "rep", "n", "k", "i", "c", "f")
    mixed = held.groupBy("token").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min("f").alias("f1"), F.max("f").alias("f2")).where("c1 < c2 AND f1 < f2").select("token")
    held = staged(held.join(mixed, "token", "left_semi"), "mixed-postings")
    other = held.select("token", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("k").alias("k2"), F.col("i").alias("i2"), F.col("c").alias("c2"), F.col("f").alias("f2"))
    met = held.join(other, "token").where("rep < rep2 AND c <> c2 AND f <> f2").where(fits)
    met = met.groupBy("rep", "rep2").agg(F.count("*").alias("m"), F.first(F.least("k", "k2")).alias("k")).where("m >= k")
    met = staged(met.select(F.col("rep").alias("a"), F.col("rep2").alias("b")), "candidates")
    more = scored(met, sets_of(docs, met.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), size), threshold).select("a", "b")
    whole = components(links.unionByName(found).unionByName(more))

    by_class = classes.join(whole, classes["rep"] == whole["node"], "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    out = keys.join(by_class, ["n", "k1", "k2"], "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select(F.col("own").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("own")).alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
