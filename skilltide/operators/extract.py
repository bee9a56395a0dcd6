"""Skills in texts: sentence units, dictionary matches, mention rollup, normalisation and review flags."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions.text import clamp, clean_text, number, split_sentences
from ..sources.readers import read_cache
from .keywords import by_block, union
from .pool import first_alias

#: Text fields of a job in the order in which they are read; the title is one sentence. Fixed names.
FIELDS = ("job_title", "job_description", "requirements", "qualification", "responsibility")

#: What makes a broad phrase technical, and phrases that are broad.
ACTIONS = ("开发", "设计", "实现", "搭建", "构建", "训练", "推理", "部署", "调优", "优化", "治理", "测试", "运维", "分析", "建模", "编排", "集成", "研发", "工程化")
BROAD = ("业务|产品|项目|客户|用户|运营|营销|销售|财务|订单|支付|交易|客服", "愿景|职责|方向|经验|优先|熟悉|了解|意识|能力$|思维$")
#: Fixed values of the admission of new skills.
ANCHORS = ("模型", "算法", "框架", "引擎", "平台", "协议", "架构", "数据库", "中间件", "编译器", "操作系统", "芯片", "机器人", "仿真", "图谱", "向量", "检索", "推理", "训练", "部署", "容器", "编排", "调度", "流式", "视觉", "语音", "多模态", "安全")
REJECTED = ("请求合并", "资源压缩", "权限校验", "防注入", "接口安全性", "缓存设计", "懒加载", "模块化", "高兼容性", "视觉一致性", "用户体验流畅性")
REJECTED_PATTERNS = (r"^(高性能|高并发|高可用|高兼容|稳定性|可用性|可靠性|安全性|一致性)$", r"(经验|能力|意识|思维|热情|抗压|沟通|协作)$", r"(设计|封装|调试|联调|维护|迭代|落地|实现|保障)$", r"(优化策略|适配方案|缓存策略|调试工具)$")


def sentence_units(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """job_id, sentence_id (job::field::0001 and on), evidence_field, place and text of all sentences of a job's FIELDS.

    Absent fields are empty. limit keeps the first sentences of each job, for callers with a bounded prompt.
    """
    have = set(jobs.columns)
    said = lambda f: clean_text(F.col(f)) if f in have else F.lit("")
    parts = [F.when(said(f) == "", F.array().cast("array<string>")).otherwise(F.array(said(f)) if f == "job_title" else split_sentences(said(f))) for f in FIELDS]
    numbered = lambda f, c: F.transform(c, lambda x, i: F.struct(F.lit(f).alias("field"), (i + 1).cast("int").alias("n"), x.alias("text")))
    items = F.concat(*(numbered(f, c) for f, c in zip(FIELDS, parts, strict=True)))
    rows = jobs.select(clean_text(F.col("job_id")).alias("job_id"), F.posexplode(F.slice(items, 1, limit) if limit else items).alias("place", "s"))
    name = F.coalesce(F.nullif("job_id", F.lit("")), F.lit("job"))
    return rows.select("job_id", F.format_string("%s::%s::%04d", name, F.col("s.field"), F.col("s.n")).alias("sentence_id"), F.col("s.field").alias("evidence_field"), "place", F.col("s.text").alias("text"))


def _pattern(keyword: str) -> re.Pattern[str] | None:
    if re.fullmatch(r"[A-Za-z0-9_+#. /-]+", keyword):  # fixed value: the signs that must not stand beside such a keyword
        return re.compile(rf"(?<![A-Za-z0-9_+#.-]){re.escape(keyword)}(?![A-Za-z0-9_+#.-])", re.IGNORECASE)
    return re.compile(re.escape(keyword), re.IGNORECASE) if len(keyword) > 1 else None


class _Folded(dict):
    """By sign: the sign that stands for all that a pattern takes for it where case is ignored. Lengths stay as they are."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        self[c] = out = next((y for y in ("i" if x in "\u0130\u0131" else x.casefold(), x.lower()) if len(y) == 1), x)
        return out


_folded = _Folded()


def fold_case(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_folded)


class Matcher:
    """Patterns of a block of dictionary entries, and an automaton that tells where they can match."""

    def __init__(self, block: pa.Table) -> None:
        entries = zip(*(block[c].to_pylist() for c in ENTRY), strict=True)
        self.entries = [e for e in entries if _pattern(e[0]) is not None]
        self.patterns = [_pattern(e[0]) for e in self.entries]
        self.broad = {i for i, e in enumerate(self.entries) if any(re.search(p, e[0]) for p in BROAD)}
        by_word: dict[str, list[int]] = {}
        for i, e in enumerate(self.entries):
            by_word.setdefault(fold_case(e[0]), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, own in by_word.items():
            self.automaton.add_word(word, (len(word), own))
        if by_word:
            self.automaton.make_automaton()

    def places(self, text: str) -> list[tuple[int, int, int]]:
        """Start, end and entry of all matches; those of one entry do not overlap each other."""
        out, after = [], {}
        for last, (size, own) in self.automaton.iter(fold_case(text)) if text and self.entries else ():
            a = last + 1 - size
            for i in own:
                if a >= after.get(i, 0) and self.patterns[i].match(text, a):
                    after[i] = last + 1
                    out.append((a, last + 1, i))
        return out

    def technical(self, text: str, a: int, b: int, i: int) -> bool:
        """Whether a match counts: one of a broad phrase needs an action near it, or a technical sign."""
        return i not in self.broad or any(w in text[max(0, a - 18) : b + 18] for w in ACTIONS) or re.search(r"[A-Za-z0-9+#.]", text[a:b]) is not None

    def mentions(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """text and its matches, of texts that have any."""
        texts, rows = [], []
        for text in batch.column("text").to_pylist():
            if own := [(a, b, i) for a, b, i in self.places(text) if self.technical(text, a, b, i)]:
                texts.append(text)
                rows.append([{"span_start": a, "span_end": b, "name": self.entries[i][0].lower(), **dict(zip(ENTRY, self.entries[i], strict=True))} for a, b, i in own])
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(rows, _MATCHES)], names=["text", "found"])

    def hits(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """text and hit: the keywords that match anywhere in it, each once."""
        rows = [(text, self.entries[i][0]) for text in batch.column("text").to_pylist() for i in sorted({i for _, _, i in self.places(text)})]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ([], []))], names=["text", "hit"])


ENTRY = ("skill_keyword", "normalized_skill", "kg_display_skill")
_MATCH = "struct<span_start:int,span_end:int,name:string,skill_keyword:string,normalized_skill:string,kg_display_skill:string>"
_MATCHES = pa.list_(pa.struct([("span_start", pa.int32()), ("span_end", pa.int32()), *((c, pa.string()) for c in ("name", *ENTRY))]))


def _entries(dictionary: DataFrame) -> DataFrame:
    return first_alias(dictionary).select(*(clean_text(F.col(c)).alias(c) for c in ENTRY))


def _texts(rows: DataFrame) -> DataFrame:
    return rows.where("text <> ''").select("text").distinct()


def greedy(found: Column) -> Column:
    """Of matches those that stay: longer keywords come first, of equal length the larger, then the earlier place; none overlaps one before."""
    size = lambda x: F.length(x["skill_keyword"])
    before = lambda x, y: (size(x) > size(y)) | ((size(x) == size(y)) & ((x["name"] > y["name"]) | ((x["name"] == y["name"]) & (x["span_start"] < y["span_start"]))))
    in_turn = F.array_sort(found, lambda x, y: F.when(before(x, y), -1).when(before(y, x), 1).otherwise(0))
    overlap = lambda x, y: (x["span_start"] < y["span_end"]) & (y["span_start"] < x["span_end"])
    return F.aggregate(in_turn, F.array().cast(f"array<{_MATCH}>"), lambda kept, x: F.when(F.exists(kept, lambda y: overlap(x, y)), kept).otherwise(F.array_append(kept, x)))


def dictionary_mentions(units: DataFrame, dictionary: DataFrame) -> DataFrame:
    """units (text and others) with a row for each dictionary match of their text.

    Longer keywords come first, of equal length the larger one, and a match never overlaps an
    earlier one. Of a keyword the dictionary's first entry counts. Each distinct text is searched once.
    """
    parts = by_block(_texts(units), _entries(dictionary), Matcher, Matcher.mentions, f"text string, found array<{_MATCH}>")
    # a text has matches from several blocks only where there are several
    whole = parts[0] if len(parts) == 1 else union(parts).groupBy("text").agg(F.flatten(F.collect_list("found")).alias("found"))
    rows = whole.select("text", F.explode(greedy(F.col("found"))).alias("m"))
    span = F.substring("text", F.col("m.span_start") + 1, F.col("m.span_end") - F.col("m.span_start"))
    named = {"span_start": "span_start", "span_end": "span_end", "skill_keyword": "skill_keyword", "normalized_skill": "normalized_skill_candidate", "kg_display_skill": "kg_display_skill_candidate"}
    found = rows.select("text", span.alias("span_text"), *(F.col(f"m.{c}").alias(name) for c, name in named.items()))
    fixed = {"skill_type": F.lit("required"), "confidence": F.lit(1.0), "reason": F.lit("dictionary_literal_match"), "match_method": F.lit("dictionary_literal"), "dictionary_skill_keyword": F.col("skill_keyword")}
    return units.join(found, "text").withColumns(fixed)


def dictionary_hints(mentions: DataFrame, limit: int = 160) -> DataFrame:
    """job_id, skill_keyword and family of the first mention of each keyword of a job, limit of them, for prompts; mentions have place and span_start."""
    order = lambda *by: Window.partitionBy(*by).orderBy("place", F.desc(F.length("skill_keyword")), F.desc(F.lower("skill_keyword")), "span_start")
    firsts = mentions.withColumn("_n", F.row_number().over(order("job_id", F.lower("skill_keyword")))).where("_n = 1")
    return firsts.withColumn("place", F.row_number().over(order("job_id"))).where(F.col("place") <= limit).select("job_id", "place", "skill_keyword", F.col("kg_display_skill_candidate").alias("kg_display_skill"))


def validate_mentions(mentions: DataFrame, units: DataFrame) -> DataFrame:
    """mentions (job_id, sentence_id, span_text and what else a finder gives) with their sentence, or with the error that keeps them out.

    A span lies where it first occurs in its sentence. Types other than preferred are required, a
    missing confidence is 0.80, and all are brought into 0 to 1.
    """
    have = set(mentions.columns)
    own = lambda c, default="": F.coalesce(F.nullif(clean_text(F.col(c)), F.lit("")), F.lit(default)) if c in have else F.lit(default)
    said = units.select(F.col("job_id").alias("_job"), F.col("sentence_id").alias("_id"), F.col("text").alias("evidence_sentence"), "evidence_field")
    span = own("span_text")
    taken = mentions.drop("evidence_sentence", "evidence_field", "text", "place")
    rows = taken.join(said, (F.col("job_id") == F.col("_job")) & (own("sentence_id") == F.col("_id")), "left")
    start = F.instr(F.col("evidence_sentence"), span) - 1
    error = F.when(F.col("_id").isNull(), F.concat(F.lit("unknown sentence_id: "), own("sentence_id"))).when(span == "", "empty span_text").when(F.coalesce(start, F.lit(-1)) < 0, F.concat(F.lit("span not found: "), span))
    confidence = clamp(F.coalesce(F.nullif(number(F.col("confidence").cast("string")), F.lit(0.0)), F.lit(0.8))) if "confidence" in have else F.lit(0.8)
    return rows.select(
        "job_id", own("sentence_id").alias("sentence_id"), own("skill_keyword").alias("_word"), span.alias("span_text"), start.cast("int").alias("span_start"), (start + F.length(span)).cast("int").alias("span_end"),
        *(own(c).alias(c) for c in ("dictionary_skill_keyword", "normalized_skill_candidate", "kg_display_skill_candidate")),
        F.when(own("skill_type") == "preferred", "preferred").otherwise("required").alias("skill_type"),
        F.coalesce("evidence_sentence", F.lit("")).alias("evidence_sentence"), F.coalesce("evidence_field", F.lit("")).alias("evidence_field"), confidence.alias("confidence"), own("match_method", "llm_api_extraction").alias("match_method"), error.alias("error"),
    ).withColumn("skill_keyword", F.coalesce(F.nullif("_word", F.lit("")), "span_text")).drop("_word")


def merge_mentions(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both without repeats of keys; those of the first win."""
    both = first.withColumn("_at", F.lit(0)).unionByName(second.withColumn("_at", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*(F.lower(F.col(k).cast("string")) for k in keys)).orderBy("_at", *keys)
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_at")


def mention_rollup(mentions: DataFrame) -> DataFrame:
    """One row for each job and keyword, case aside: required before preferred, highest confidence, distinct evidence.

    mentions: validate_mentions() without errors; place, if there, is their order, else the
    sentence and the span are. Evidence is deduplicated first, so that lists hold as many items as
    there are distinct ones, in the order of their first mention; dictionary columns are those of
    the first mention that has any.
    """
    at = F.struct(*(c for c in ("place", "evidence_sentence", "span_start", "span_text") if c in mentions.columns))
    rows = mentions.where("job_id <> '' AND skill_keyword <> ''").withColumns({"skill_key": F.lower("skill_keyword"), "_at": at})
    linked = ["dictionary_skill_keyword", "normalized_skill_candidate", "kg_display_skill_candidate"]
    entry = F.struct(*linked)
    once = rows.groupBy("job_id", "skill_key", "evidence_sentence", "evidence_field", "span_text", "span_start", "span_end").agg(
        F.min("_at").alias("_at"), F.min_by("skill_keyword", F.struct("_at", "skill_keyword")).alias("skill_keyword"), F.min_by("match_method", F.struct("_at", "match_method")).alias("match_method"), F.max("confidence").alias("confidence"),
        F.max((F.col("skill_type") != "preferred").cast("int")).alias("required"), F.min_by(entry, F.struct(F.col("dictionary_skill_keyword") == "", F.col("_at"), entry)).alias("_entry"),
    )
    firsts = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(c).alias("x")))), lambda y: y["x"])).alias(f"{c}s")
    out = once.groupBy("job_id", "skill_key").agg(
        F.min_by("skill_keyword", F.struct("_at", "skill_keyword")).alias("skill_keyword"),
        F.min_by("_entry", F.struct(F.col("_entry.dictionary_skill_keyword") == "", F.col("_at"), F.col("_entry"))).alias("_entry"),
        F.when(F.max("required") == 1, "required").otherwise("preferred").alias("skill_type"),
        F.count("*").alias("mention_count"),
        F.max("confidence").alias("max_confidence"),
        F.countDistinct("evidence_sentence").alias("evidence_count"),
        firsts("evidence_sentence"), firsts("evidence_field"), firsts("span_text"), firsts("match_method"),
    )
    return out.select("*", *(F.col(f"_entry.{c}").alias(c) for c in linked)).drop("_entry")


def alias_link(mentions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """mentions with dictionary_skill_keyword, normalized_skill_candidate and kg_display_skill_candidate of the entry they stand for.

    That is the entry of the keyword, else of the span, else the only one whose pattern is in the
    span; empty if there is none or more than one.
    """
    words = _entries(dictionary).select(F.lower("skill_keyword").alias("_k"), F.struct(*ENTRY).alias("_w"))
    by = lambda c: words.select(F.col("_k").alias(f"_{c}"), F.col("_w").alias(f"w_{c}"))
    span = clean_text(F.col("span_text"))
    out = mentions.withColumns({"_keyword": F.lower(clean_text(F.col("skill_keyword"))), "_span": F.lower(span), "_text": span})
    out = out.join(by("keyword"), "_keyword", "left").join(by("span"), "_span", "left")
    open_spans = out.where("w_keyword IS NULL AND w_span IS NULL").select(F.col("_text").alias("text"))
    hits = union(by_block(_texts(open_spans), _entries(dictionary), Matcher, Matcher.hits, "text string, hit string"))
    only = hits.groupBy(F.col("text").alias("_text")).agg(F.count("*").alias("_n"), F.min(F.lower("hit")).alias("_hit")).where("_n = 1").drop("_n")
    out = out.join(only, "_text", "left").join(by("hit"), "_hit", "left")
    entry = F.coalesce("w_keyword", "w_span", "w_hit")
    named = {"dictionary_skill_keyword": "skill_keyword", "normalized_skill_candidate": "normalized_skill", "kg_display_skill_candidate": "kg_display_skill"}
    return out.withColumns({c: F.coalesce(entry[e], F.lit("")) for c, e in named.items()}).drop("_keyword", "_span", "_text", "_hit", "w_keyword", "w_span", "w_hit")


def dictionary_summary(dictionary: DataFrame, categories: int = 28, examples: int = 14) -> DataFrame:
    """kg_display_skill, keyword_count and example_skill_keywords (text) of the categories with most keywords, case aside; ties by name."""
    word, family = clean_text(F.col("skill_keyword")), clean_text(F.col("kg_display_skill"))
    order = F.col("row_order") if "row_order" in dictionary.columns else word
    rows = dictionary.where(word != "").select(F.coalesce(F.nullif(family, F.lit("")), F.lit("uncategorized")).alias("kg_display_skill"), word.alias("w"), order.alias("o"))
    once = rows.groupBy("kg_display_skill", F.lower("w").alias("k")).agg(F.min(F.struct("o", "w")).alias("f"))
    place = F.row_number().over(Window.partitionBy("kg_display_skill").orderBy("f"))
    listed = once.withColumn("n", place).groupBy("kg_display_skill").agg(F.count("*").alias("keyword_count"), F.array_sort(F.collect_list(F.when(F.col("n") <= examples, F.struct("n", "f.w")))).alias("e"))
    top = listed.orderBy(F.desc("keyword_count"), "kg_display_skill").limit(categories)
    return top.select("kg_display_skill", "keyword_count", F.array_join(F.transform("e", lambda x: x["w"]), "; ").alias("example_skill_keywords"))


def commonest_category(labelled: DataFrame) -> DataFrame:
    """normalized_skill, category (the most frequent, ties by name) and gold_count of labelled mentions."""
    family = F.coalesce(F.nullif(clean_text(F.col("category")), F.lit("")), F.lit("未分类"))
    counted = labelled.groupBy("normalized_skill", family.alias("category")).agg(F.count("*").alias("n"))
    return counted.groupBy("normalized_skill").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("category"), F.sum("n").alias("gold_count"))


def normalize_skills(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows (normalized_skill_candidate, dictionary_skill_keyword, skill_keyword, span_text) with normalized skill, family, method, confidence and status.

    A candidate that is a known skill wins; then, field by field, a keyword of the dictionary and
    a known skill. The dictionary is joined four times by equality, whatever its size.
    """
    entries = _entries(dictionary)
    known = entries.where("normalized_skill <> ''").groupBy(F.lower("normalized_skill").alias("k")).agg(F.min("normalized_skill").alias("s"), F.min("kg_display_skill").alias("d"))
    aliases = entries.where("normalized_skill <> ''").select(F.lower("skill_keyword").alias("k"), F.col("normalized_skill").alias("s"), F.col("kg_display_skill").alias("d"))
    both = aliases.select("k", F.struct("s", "d").alias("alias")).join(known.select("k", F.struct("s", "d").alias("known")), "k", "full")
    out, fields = rows, ("normalized_skill_candidate", "dictionary_skill_keyword", "skill_keyword", "span_text")
    for f in fields:
        out = out.join(both.select(F.col("k").alias(f"_{f}"), F.col("alias").alias(f"a_{f}"), F.col("known").alias(f"k_{f}")), F.lower(clean_text(F.col(f))) == F.col(f"_{f}"), "left").drop(f"_{f}")
    steps = [(F.col("k_normalized_skill_candidate"), "extractor_candidate", 1.0)]
    for f in fields[1:]:
        steps += [(F.col(f"a_{f}"), f"{f}_dictionary_exact", 1.0), (F.col(f"k_{f}"), f"{f}_already_normalized", 0.98)]
    pick, method, confidence = F.lit(None).cast("struct<s:string,d:string>"), F.lit("unresolved_local"), F.lit(0.0)
    for value, name, sure in reversed(steps):
        pick, method, confidence = F.coalesce(value, pick), F.when(value.isNotNull(), name).otherwise(method), F.when(value.isNotNull(), sure).otherwise(confidence)
    out = out.withColumns({"_p": pick, "normalization_method": method, "normalization_confidence": confidence})
    out = out.withColumns({"normalized_skill": F.coalesce("_p.s", F.lit("")), "kg_display_skill": F.coalesce("_p.d", F.lit("")), "normalization_status": F.when(F.col("_p").isNull(), "unresolved").otherwise("normalized")})
    return out.drop("_p", *(f"{p}_{f}" for f in fields for p in "ak"))


def normalize_with(rows: DataFrame, dictionary: DataFrame, fallback=None) -> DataFrame:
    """normalize_skills(); rows that stay unresolved get what fallback gives for their keywords.

    fallback takes distinct skill_keyword and gives skill_keyword, normalized_skill,
    kg_display_skill, normalization_status, normalization_method and normalization_confidence.
    """
    out = normalize_skills(rows, dictionary)
    if fallback is None:
        return out
    names = ["normalized_skill", "kg_display_skill", "normalization_status", "normalization_method", "normalization_confidence"]
    asked = out.where("normalization_status = 'unresolved'").select("skill_keyword").distinct()
    told = fallback(asked).select(F.col("skill_keyword").alias("_k"), F.struct(*names).alias("_t"))
    both = out.join(told, (F.col("skill_keyword") == F.col("_k")) & (F.col("normalization_status") == "unresolved"), "left")
    return both.withColumns({c: F.coalesce(F.col("_t")[c], F.col(c)) for c in names}).drop("_k", "_t")


#: What a fallback tells of a keyword.
ANSWER = "normalized_skill string, kg_display_skill string, normalization_status string, normalization_method string, normalization_confidence double"


def batched_fallback(ask: Callable[[list[str]], list[dict]], cache: str, size: int = 80, calls: int = 4, context: str = "") -> Callable[[DataFrame], DataFrame]:
    """A fallback for normalize_with() that asks for size keywords at a time and remembers what it was told.

    ask takes keywords and gives dictionaries with skill_keyword and the columns of ANSWER; keywords
    that it leaves out stay unresolved and are asked again. cache: an append-only folder of JSON
    lines; only keywords that it does not hold for this context (the dictionary's digest, say) are
    asked, calls tasks at a time. Answers are appended when all of them are there, so that a task that runs
    twice, or a job that fails, leaves each of them once or not at all. The case of keywords counts.
    """
    kind = T.StructType.fromDDL(f"context string, skill_keyword string, {ANSWER}, asked_with int")

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []

        def told(group: list[str]) -> pa.RecordBatch:
            rows = [{"context": context, **{f.name: r.get(f.name) for f in kind if f.name != "context"}, "asked_with": len(group)} for r in ask(group) if r.get("skill_keyword") in group]
            return pa.RecordBatch.from_pylist(rows, to_arrow_schema(kind))

        for batch in batches:
            waiting += batch.column("skill_keyword").to_pylist()
            while len(waiting) >= size:
                yield told(waiting[:size])
                del waiting[:size]
        if waiting:
            yield told(waiting)

    def fallback(asked: DataFrame) -> DataFrame:
        spark = asked.sparkSession
        known = lambda: read_cache(spark, cache, kind, ["context", "skill_keyword"], "normalization_confidence").where(F.col("context") == context)
        new = asked.where("skill_keyword IS NOT NULL").select("skill_keyword").distinct().join(known().select("skill_keyword"), "skill_keyword", "left_anti")
        if not new.isEmpty():
            new.repartition(calls).mapInArrow(answers, kind).write.mode("append").json(cache)
        return known().join(asked.select("skill_keyword").distinct(), "skill_keyword", "left_semi")

    return fallback


def job_skills(jobs: DataFrame, dictionary: DataFrame, extractor=None, fallback=None) -> DataFrame:
    """Skills of jobs from their texts: dictionary matches and what extractor finds, validated, linked, rolled up and normalised.

    extractor takes sentence_units() and gives mentions (job_id, sentence_id, span_text, skill_keyword
    and more); of equal mentions the dictionary's counts. fallback: see normalize_with().
    """
    units = sentence_units(jobs)
    found = dictionary_mentions(units, dictionary)
    if extractor is not None:
        found = merge_mentions(found, extractor(units), ["job_id", "sentence_id", "span_text", "skill_keyword"])
    valid = validate_mentions(found, units).where("error IS NULL").drop("error")
    spans = F.array_join("span_texts", "; ").alias("span_text")
    rolled = mention_rollup(alias_link(valid, dictionary))
    return normalize_with(rolled.select("*", spans), dictionary, fallback)


def admit_new_skills(proposed: DataFrame, families: DataFrame) -> DataFrame:
    """proposed (skill, kg_display_skill) with admitted and the reason; families: kg_display_skill."""
    have = families.select(clean_text(F.col("kg_display_skill")).alias("_f")).distinct()
    rows = proposed.join(have, clean_text(F.col("kg_display_skill")) == F.col("_f"), "left")
    s, f = clean_text(F.col("skill")), clean_text(F.col("kg_display_skill"))
    broad = F.lit(False)
    for p in REJECTED_PATTERNS:
        broad = broad | s.rlike(p)
    anchor = F.lit(False)
    for a in ANCHORS:
        anchor = anchor | s.contains(a)
    reason = (
        F.when(s == "", "empty skill").when(f == "", "no family").when(F.col("_f").isNull(), "unknown family").when(s.isin(*REJECTED), "rejected phrase").when(broad, "broad phrase")
        .when(s.rlike("[A-Za-z][A-Za-z0-9+.#/-]*"), "technology name").when(anchor, "technical anchor").otherwise("no technical anchor")
    )
    return rows.withColumn("reason", reason).withColumn("admitted", F.col("reason").isin("technology name", "technical anchor")).drop("_f")


def review_flags(skills: DataFrame, pool: DataFrame, low: float = 0.80) -> DataFrame:
    """skills with is_low_confidence, is_new_skill_candidate and needs_review against a pool (normalized_skill)."""
    have = pool.select(F.lower("normalized_skill").alias("_k")).distinct().withColumn("_known", F.lit(True))
    out = skills.join(have, F.lower("normalized_skill") == F.col("_k"), "left")
    weak = F.coalesce(F.col("normalization_status").isin("unresolved", "uncertain"), F.lit(False)) | F.coalesce(F.col("confidence") < low, F.lit(False))
    out = out.withColumns({"is_low_confidence": weak, "is_new_skill_candidate": F.col("_known").isNull()}).drop("_k", "_known")
    return out.withColumn("needs_review", F.col("is_low_confidence") | F.col("is_new_skill_candidate"))


def confirmed_skills(reviewed: DataFrame) -> DataFrame:
    """Reviewed skills that are not declared invalid. One without a name or family, and a review_id of which none is left, is an error."""
    left = F.coalesce(F.col("decision"), F.lit("")) != "invalid"
    bare = left & ((clean_text(F.col("normalized_skill")) == "") | (clean_text(F.col("kg_display_skill")) == ""))
    valid = F.count_if(left).over(Window.partitionBy("review_id"))  # a review has a few skills
    error = F.when(bare, F.raise_error(F.lit("a confirmed skill lacks its name or family")).cast("boolean")).when(valid == 0, F.raise_error(F.lit("at least one valid skill is required")).cast("boolean"))
    return reviewed.withColumn("_e", error).where(F.col("_e").isNull() & left).drop("_e")
