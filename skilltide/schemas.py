"""Schemas of the tables, and how rows are made to fit them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def text_like(schema: T.StructType) -> T.StructType:
    """The same columns as text."""
    return _text(*schema.fieldNames())


EVENTS = T.StructType([*_text("job_id", "month", "standard_job", "job_title", "job_responsibility", "job_requirement").fields, T.StructField("skills", T.ArrayType(T.StringType()))])
EVENTS_TEXT = _text("job_id", "month", "standard_job", "job_title", "job_responsibility", "job_requirement", "skills")
PROVENANCE = ("source", "source_name", "publish_time", "recruitment_year", "source_url", "government_agency", "government_department", "location", "cleaned_job_title", "route_status", "event_time_type", "source_time_granularity")
GOVERNMENT_EVENTS_TEXT = T.StructType([*EVENTS_TEXT.fields, *_text(*PROVENANCE).fields])
FREQUENCY = T.StructType(
    [
        *_text("month", "standard_job", "skill").fields,
        *(T.StructField(n, T.LongType() if n.endswith("count") else T.DoubleType()) for n in ("monthly_jd_count", "monthly_skill_count", "monthly_skill_frequency", "cumulative_jd_count", "cumulative_skill_count", "cumulative_skill_frequency")),
    ]
)
TAXONOMY = _text("standard_job_title", "standard_category", "match_keywords")
SKILL_UNIVERSE = _text("standard_job", "skill", "kg_display_skill", "skill_stage")
SKILL_DICTIONARY = _text("skill_keyword", "normalized_skill", "kg_display_skill")
OVERRIDES = _text("override_id", "standard_job", "skill", "action", "new_skill", "kg_display_skill", "note", "updated_at")
REVIEW_QUEUE = _text("review_id", "job_id", "status", "route_status", "payload", "created_at", "updated_at")


def empty(spark, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of schema in its order: missing ones are empty (text) or null, others are dropped."""
    have = set(df.columns)
    return df.select(*((F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit("" if isinstance(f.dataType, T.StringType) else None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def require(df: DataFrame, columns, label: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{label} lacks columns: {', '.join(missing)}")
    return df
