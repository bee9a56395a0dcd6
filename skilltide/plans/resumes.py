"""Synthetic résumés for standard jobs, by seeded hashes instead of a random generator: any partitioning gives the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts in which skills are numbered, so that no task numbers all.
PARTS = 64


def drawn(*of: Column) -> Column:
    """A number above 0 and below 1, from the first 52 bits of the md5 of the joined texts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in of))), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def race(weight: Column, *of: Column) -> Column:
    """A waiting time, exponential with rate weight: the n shortest are a weighted draw of n without replacement."""
    return -F.ln(drawn(*of)) / weight


def synthetic_resumes(feed: DataFrame, per_job: int, seed: int = 42, coverage: float = 0.7, overlap: float = 0.2) -> DataFrame:
    """resume_id, standard_job, skills (array) and counts.

    A résumé holds a share (coverage) of its job's feed, drawn without replacement with weights that
    fall with the place in the feed, and, as a share (overlap) of that, skills of the other jobs, each
    as likely as another. feed: profile_feed(), a few rows for each job.
    """
    jobs = feed.select("standard_job").distinct()
    resumes = jobs.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(per_job - 1)))).withColumn("resume_id", F.concat("standard_job", F.lit("-"), F.lpad(F.col("number").cast("string"), 6, "0")))
    own = resumes.join(feed.select("standard_job", "skill", "place"), "standard_job")
    order = Window.partitionBy("resume_id").orderBy(race(1 / F.col("place"), F.lit(seed), F.col("resume_id"), F.col("skill")), "skill")
    size = F.count("*").over(Window.partitionBy("resume_id"))
    kept = own.withColumns({"n": F.row_number().over(order), "size": size}).where(F.col("n") <= F.ceil(F.col("size") * coverage))
    # skills of other jobs: a résumé draws places among all skills, as many as it needs; parts are numbered by themselves and then in turn
    part = F.floor(drawn(F.col("skill")) * PARTS).cast("int")
    listed = feed.select("skill").distinct().withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("skill")))
    sizes = listed.groupBy("part").agg(F.count("*").alias("size"))  # PARTS rows at most
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    placed = listed.join(F.broadcast(before), "part").select("skill", (F.col("before") + F.col("n") - 1).alias("at"))
    total = F.broadcast(sizes.agg(F.sum("size").alias("total")))  # one row
    need = kept.groupBy("resume_id", "standard_job").agg(F.ceil(F.count("*") * overlap).cast("int").alias("need")).where("need > 0")
    picks = need.join(total).select("resume_id", "standard_job", F.explode(F.sequence(F.lit(1), F.col("need"))).alias("i"), "total")
    picks = picks.withColumn("at", F.floor(drawn(F.lit(seed + 1), F.col("resume_id"), F.col("i")) * F.col("total")))
    other = picks.join(placed, "at").select("resume_id", "standard_job", "skill").join(feed.select("standard_job", "skill"), ["standard_job", "skill"], "left_anti")
    all_skills = kept.select("resume_id", "standard_job", "skill", F.lit(1).alias("own")).unionByName(other.distinct().withColumn("own", F.lit(0)))
    return all_skills.groupBy("resume_id", "standard_job").agg(F.array_sort(F.collect_list("skill")).alias("skills"), F.sum("own").alias("n_own"), F.sum(1 - F.col("own")).alias("n_other"))
