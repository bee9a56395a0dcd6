"""The star-schema test tables in the roles of the domain.

Orders are postings and order lines their skills. The dense mapping has market segments as jobs
and brands as skills; the sparse one nations as jobs, regions as categories and brands with types
as skills. Orders without lines are postings without skills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order lines and orders of a part of the events, about: what a task holds does not grow with the tables.
LINES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """job_id, month, standard_job and skills (array)."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    if sparse:
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        customer = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("standard_job"))
    else:
        customer = customer.select("c_custkey", F.col("c_mktsegment").alias("standard_job"))
    skill = F.concat_ws(" ", "p_brand", "p_type") if sparse else F.col("p_brand")
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey IS NOT NULL")
    part = table(spark, sf_dir, "part").select("p_partkey", skill.alias("skill"))
    wanted = -(-lineitem.select("l_orderkey").union(orders.select("o_orderkey")).count() // LINES)
    parts = max(spark.sparkContext.defaultParallelism, wanted)
    orders = orders.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        # the session's partitions would grow with the tables: both joins sort in parts of bounded size as well
        lineitem, part = lineitem.repartition(parts, "l_partkey"), part.repartition(parts, "p_partkey").hint("merge")
        orders, customer = orders.repartition(parts, "o_custkey"), customer.repartition(parts, "c_custkey").hint("merge")
    lines = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("key"), "skill", F.lit(None).alias("posting"))
    postings = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").cast("string").alias("key"), F.lit(None).alias("skill"), F.struct("month", "standard_job").alias("posting"))
    # lines and postings meet by order in parts of bounded size; an order has a few lines. The key is the
    # job_id as it leaves, so that Spark knows the parts by it: who tells job_ids apart does so inside them
    both = lines.unionByName(postings).repartition(parts, "key").groupBy("key").agg(F.collect_list("posting").alias("postings"), F.array_sort(F.collect_set("skill")).alias("skills"))
    return both.select(F.col("key").alias("job_id"), "skills", F.inline("postings")).select("job_id", "month", "standard_job", "skills")


def taxonomy(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """standard_job and standard_category."""
    if not sparse:
        return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("standard_job"), F.lit("ALL").alias("standard_category")).distinct()
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("standard_job"), F.col("r_name").alias("standard_category"))


def families(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """A pool's columns skill, family and type: normalized_skill, kg_display_skill, skill_type."""
    part = table(spark, sf_dir, "part")
    if sparse:
        return part.select(F.concat_ws(" ", "p_brand", "p_type").alias("normalized_skill"), F.col("p_type").alias("kg_display_skill"), F.when(F.col("p_type").startswith("ECONOMY"), "traditional").otherwise("modern").alias("skill_type")).distinct()
    return part.select(F.col("p_brand").alias("normalized_skill"), F.lit("BRAND").alias("kg_display_skill"), F.lit("modern").alias("skill_type")).distinct()


def universe(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """standard_job, skill, kg_display_skill and skill_stage of all jobs and skills."""
    skills = families(spark, sf_dir, sparse).select(F.col("normalized_skill").alias("skill"), "kg_display_skill", F.col("skill_type").alias("skill_stage"))
    return taxonomy(spark, sf_dir, sparse).select("standard_job").join(skills)  # two dictionaries, of which the universe is the product


def postings_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as postings with a title of words."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("job_id"), F.col("p_name").alias("job_title"), F.col("p_type").alias("job_responsibility"), F.col("p_brand").alias("job_requirement"))
