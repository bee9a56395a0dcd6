"""Text, list and month expressions; all are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(c: Column) -> Column:
    """Null to empty, runs of any white space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))


def split_list(c: Column) -> Column:
    """The distinct non-empty items of a list with semicolons, sorted."""
    items = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), clean_text)
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: x != "")))


def clean_items(c: Column) -> Column:
    """As split_list(), from an array."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), clean_text), lambda x: x != "")))


def join_list(c: Column) -> Column:
    return F.array_join(c, "; ")


def distinct_by_case(items: Column) -> Column:
    """The items in order, without those that differ from an earlier one in case only."""
    return F.aggregate(items, F.array().cast("array<string>"), lambda held, x: F.when(F.exists(held, lambda y: F.lower(y) == F.lower(x)) | (x == ""), held).otherwise(F.concat(held, F.array(x))))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(clean_text(c), F.lit("")) for c in columns), F.lit(""))


def month_number(month: Column) -> Column:
    """Months since year 0 of yyyy-MM, for distances."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int") - 1


def month_text(number: Column) -> Column:
    """The month of a month_number()."""
    return F.concat_ws("-", F.lpad((number / 12).cast("int").cast("string"), 4, "0"), F.lpad((number % 12 + 1).cast("int").cast("string"), 2, "0"))


def is_month(c: Column) -> Column:
    return c.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")


def whole_div(a: Column, b: Column) -> Column:
    """Integer division of counts; b is positive."""
    return ((a - a % b) / b).cast("long")


def ratio(part: Column, whole: Column, scale: int = 1_000_000) -> Column:
    """part / whole rounded half up to 1 / scale, in integers so that every engine gives the same; 0 if there is no whole."""
    n, d = part.cast("long"), whole.cast("long")
    return F.when(d > 0, whole_div(2 * n * F.lit(scale) + d, 2 * d) / F.lit(float(scale))).otherwise(F.lit(0.0))


def ratio_change(now: Column, before: Column) -> Column:
    return F.when(before == 0, F.when(now > 0, 1.0).otherwise(0.0)).otherwise((now - before) / before)


def number(c: Column) -> Column:
    """Text to double, 0 where it is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def whole_number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").cast("long"), F.lit(0).cast("long"))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def truncate(c: Column, length: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit(suffix))).otherwise(c)


def stable_id(*parts: Column, length: int = 20) -> Column:
    """The start of the sha256 hex digest of the parts, with | between."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def split_bucket(key: Column) -> Column:
    """train, dev or test, as 80:10:10 by md5."""
    # fixed values: the digits that are taken, and the shares
    bucket = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 10
    return F.when(bucket < 8, "train").when(bucket < 9, "dev").otherwise("test")


#: Administrative rank at the end of a title; a fixed value.
RANK_SUFFIX = r"(?:一|二|三|四|五|六|七|八|九|十)?级?(?:主任科员|行政执法员|主办|主管|警长|警员|科员|专业技术员)(?:及以下)?(?:（[^）]*）)?$"


def strip_rank_suffix(title: Column) -> Column:
    """A title without its administrative rank; the title itself if nothing is left."""
    title = clean_text(title)
    bare = F.trim(F.regexp_replace(F.regexp_replace(title, RANK_SUFFIX, ""), r"[\-—–]+$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), title)


def year_of(c: Column) -> Column:
    return F.regexp_extract(c, r"(20\d{2})", 1)


#: Titles with a technical marker lose their level, unless they have one of the others.
TECHNICAL = ("算法", "开发", "研发", "测试", "数据", "运维", "硬件", "芯片", "架构", "工程", "前端", "后端", "客户端", "服务端", "大模型", "AIGC", "Agent", "智能体", "AI Infra", "AI Ops")
NOT_ENGINEERS = ("产品经理", "项目经理", "运营", "设计师", "研究员", "科学家", "分析师")
LEVEL = "(?i)(高级|资深|初级|中级|专家级|首席)"
LEAD_AT_END = r"(?i)(实习生|专家|负责人|Leader|Tech\s*Lead|Technical\s*Lead)$"
LEAD_OF_FIELD = r"(?i)(算法|开发|研发|测试|数据|运维|硬件|芯片|架构|工程化)(负责人|Leader|Tech\s*Lead|Technical\s*Lead)"


def normalize_level(title: Column) -> Column:
    """A technical title without words of level, leads as engineers; other titles are only cleaned."""
    title = clean_text(title)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(title, LEVEL, ""), LEAD_AT_END, "工程师"), LEAD_OF_FIELD, "$1工程师")
    return F.when(contains_any(title, TECHNICAL) & ~contains_any(title, NOT_ENGINEERS), clean_text(plain)).otherwise(title)


def split_sentences(text: Column) -> Column:
    """The sentences of a text: cut at line ends and 。！？；;, without white space, colons, dashes, commas and list marks around them."""
    # fixed values: the signs that end sentences, and those that are taken off them
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), r"[\n。！？；;]+")
    kept = F.filter(parts, lambda x: clean_text(x) != "")
    return F.transform(kept, lambda x: F.regexp_replace(x, r"^[ \t:\-—，,、)]+|[ \t:\-—，,、)]+$", ""))


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.coalesce(*(F.when(low.contains(t.lower()), F.lit(True)) for t in terms), F.lit(False)) if terms else F.lit(False)


def contains_all_groups(text: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    out = F.lit(True)
    for terms in groups:
        out = out & contains_any(text, terms)
    return out
