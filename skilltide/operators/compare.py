"""Tables against each other: cell comparison with tolerance, match rates, set scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import number, ratio
from ..schemas import require


def _unique(df: DataFrame, keys: list[str], label: str, columns: list[str]) -> DataFrame:
    """One row for each key; a repeated key is an error. Grouping by the keys is the shuffle that the join needs anyway."""
    require(df, keys, label)
    once = F.when(F.count("*") > 1, F.raise_error(F.lit(f"{label} has rows with the same key")).cast("boolean"))
    return df.groupBy(*keys).agg(once.alias("_dup"), *(F.first(c).alias(c) for c in columns)).where("_dup IS NULL").drop("_dup")


def compare_tables(actual: DataFrame, expected: DataFrame, keys: list[str], columns: list[str], tolerances: dict[str, float] | None = None) -> DataFrame:
    """Rows that differ, with status and the first differing column; columns with a tolerance are numbers."""
    columns = [c for c in columns if c in actual.columns and c in expected.columns]
    a = _unique(actual, keys, "actual", columns).select(*keys, F.struct(F.lit(1), *columns).alias("_a"))
    b = _unique(expected, keys, "expected", columns).select(*keys, F.struct(F.lit(1), *columns).alias("_b"))
    both = a.join(b, keys, "full")
    tolerances = tolerances or {}

    def differs(c: str) -> Column:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        return F.abs(number(x.cast("string")) - number(y.cast("string"))) > tolerances[c] if c in tolerances else ~x.eqNullSafe(y)

    first = F.coalesce(*(F.when(differs(c), F.lit(c)) for c in columns), F.lit(None).cast("string")) if columns else F.lit(None).cast("string")
    status = F.when(F.col("_a").isNull(), "missing_actual").when(F.col("_b").isNull(), "extra_actual").when(F.col("column").isNotNull(), "value_mismatch")
    value = lambda side: F.when(F.col("status") == "value_mismatch", F.coalesce(*(F.when(F.col("column") == c, F.col(f"{side}.{c}").cast("string")) for c in columns)))
    out = both.withColumn("column", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), first)).withColumn("status", status).where("status IS NOT NULL")
    return out.select(*keys, "status", F.coalesce("column", F.lit("")).alias("column"), *((value("_a").alias("actual"), value("_b").alias("expected")) if columns else ()))


def match_statistics(actual: DataFrame, expected: DataFrame, keys: list[str], diff: DataFrame) -> DataFrame:
    """One row: total, matched and differing rows by status, and the match rate with six places."""
    total = actual.select(*keys).union(expected.select(*keys)).distinct().agg(F.count("*").alias("total_rows"))
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_rows")
    found = diff.agg(F.count("*").alias("n"), count("missing_actual"), count("extra_actual"), count("value_mismatch"))
    out = total.join(F.broadcast(found)).withColumn("matched_rows", F.greatest(F.col("total_rows") - F.col("n"), F.lit(0).cast("long"))).drop("n")
    return out.withColumn("match_rate", F.when(F.col("total_rows") == 0, 1.0).otherwise(ratio(F.col("matched_rows"), F.col("total_rows"))))


def passes(statistics: list[DataFrame], threshold: float = 0.9) -> DataFrame:
    """One row: whether all match rates are above the threshold; equal does not pass."""
    return reduce(DataFrame.unionByName, statistics).agg((F.min("match_rate") > threshold).alias("passed"), F.min("match_rate").alias("lowest_match_rate"))


def set_scores(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: precision, recall and F1 of found against gold as sets."""
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(found.select(*keys).distinct().withColumn("f", F.lit(1)), keys, "full")
    n = both.agg(F.count_if(F.expr("g = 1 AND f = 1")).alias("tp"), F.count_if(F.expr("g IS NULL")).alias("fp"), F.count_if(F.expr("f IS NULL")).alias("fn"))
    return n.select("tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one side only, with side."""
    return a.distinct().exceptAll(b.distinct()).withColumn("side", F.lit("left")).unionByName(b.distinct().exceptAll(a.distinct()).withColumn("side", F.lit("right")))


def is_subset(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "left_anti").agg((F.count("*") == 0).alias("is_subset"))
