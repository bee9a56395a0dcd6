"""A corpus pipeline over documents: each stage takes all that the one before kept, its decisions take effect,
and all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltide.llm import byte_bpe, decontaminate, jaccard_join, language_id, suffix_dedup
from skilltide.llm.common import delete, fresh, scratch, table

#: The least score with which a document's language counts as known: no more than half of the probability on others.
LEAST = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, and puts the predicted one where lang is null.

    A document has none if the network gives no language LEAST or more, which is so for null texts
    and texts without a letter. Without any label nothing can be learned: then texts that are null
    or have no letter go, and lang stays. Repeated rows are judged each, and an empty table stays empty.
    """
    net = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = language_id.predict(docs, net).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST))
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more.

    Of rows that repeat a doc_id the least stays. Rows with a null doc_id, and null, empty and blank
    texts, are in no group and stay. An empty table stays empty.
    """
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        least = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
        docs = docs.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(least)
    groups = jaccard_join.near_duplicates(docs, size=5, threshold=80)
    copies = groups.where("doc_id <> component_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings of 100 bytes or more out of texts; drops documents of which nothing but white space is left.

    Of equal strings the one in the smallest doc_id, and there the first, stays. Rows that repeat a
    document lose the same, rows with a null doc_id and null texts stay as they are. An empty table stays empty.
    """
    cut = suffix_dedup.unrepeated(docs).where("n_removed = 0 OR kept_text RLIKE '[^ \\\\t\\\\r\\\\n]'")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumns({"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages.

    Repeated rows are judged each; null and empty texts hold none and stay; an empty benchmark drops nothing.
    """
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them; null texts have no tokens, repeated rows are encoded each."""
    return byte_bpe.digests(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]

#: A trained network, components of links and repeats over all documents are beyond plain SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage gives. Of stored copies only its output is left; what stages store for themselves goes when they end."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh(spark, name.replace(" ", "-").lower())
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
