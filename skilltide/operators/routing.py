"""From postings to standard jobs: keyword seeds, similarity candidates, the decision ladder and guards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import rules as R
from ..functions.text import clamp, clean_text, contains_all_groups, contains_any
from ..sources.shared import stored
from .keywords import contained, union

#: Candidates in a block that is broadcast.
SMALL = 20_000
#: Titles of a part, and different ones of a part in which they meet jobs, about: what a task holds does not grow with the tables.
TITLES, TEXTS = 500_000, 5_000

#: Families that a title can announce (name, terms, categories that cover it).
NEW_FAMILY_RULES = (
    ("new_family_robotics", ("机器人", "具身", "具身智能", "Robotaxi", "Robotics", "无人机", "传感器工程师"), ("机器人",)),
    ("new_family_autonomous_driving", ("自动驾驶", "无人车", "车云协同", "域控制器", "数据闭环", "汽车法规"), ("自动驾驶",)),
    ("new_family_multimedia_graphics_audio_video", ("音视频", "图形渲染", "图形显示", "图像传感器", "图像评测", "技术美术", "UE5", "游戏引擎", "Camera", "相机色彩", "图像调校", "视频编解码", "GPU渲染", "PCG技术美术", "虚拟人交互"), ("多媒体",)),
)
#: Jobs that a title can announce (name, groups of terms of which each has to occur, excluded terms, jobs that cover it).
POTENTIAL_JOB_RULES = (
    ("gap_llm_test_quality", (("AI", "Agent", "智能体", "大模型", "模型", "LLM", "AIGC", "MaaS", "Agent Harness", "RL Data", "AI基建"), ("测试", "评测", "质量", "QA", "Harness", "RL Data", "基建")), (), ("大模型测试工程师",)),
    ("gap_multimodal_algorithm", (("多模态", "跨模态", "Omni", "多模", "VLM"), ("算法", "研究", "模型", "理解", "生成", "推荐", "交互", "内容安全", "策略", "推理")), (), ("多模态算法工程师",)),
    ("gap_aigc_algorithm", (("AIGC", "生成式AI", "生成式影像", "生成式视频", "数字人"), ("算法", "生成", "影像", "视频", "数字人", "技术专家")), ("应用开发", "应用研发", "产品"), ("AIGC算法工程师",)),
    ("gap_search_algorithm", (("搜索", "展示召回"), ("算法", "排序", "召回", "架构", "引擎", "AI搜索", "搜索产品")), (), ("搜索算法工程师",)),
    ("gap_data_mining", (("数据挖掘",),), (), ("数据挖掘算法工程师",)),
    ("gap_data_governance", (("数据治理", "数据质量", "数据采集", "数据标注", "标注", "地图测绘"),), (), ("数据治理工程师",)),
    ("gap_go_development", (("Go", "Golang", "GO开发", "Go开发"), ("开发", "研发", "工程师", "后端", "服务端")), (), ("Go开发工程师",)),
    ("gap_python_development", (("Python",), ("开发", "研发", "工程师", "后端", "服务端")), (), ("Python开发工程师",)),
    ("gap_devops", (("DevOps", "SRE", "运维开发", "云原生运维", "平台运维", "工程效能", "研发效能", "构建优化"),), (), ("DevOps工程师",)),
    ("gap_chip_verification", (("芯片", "IC", "SoC", "SOC", "IP", "CPU", "DPU", "DFT", "原型验证", "存储系统验证"), ("验证", "DFT")), (), ("芯片验证工程师",)),
    ("gap_thermal_design", (("热设计", "散热", "热仿真", "热管理", "仿真工程师"),), (), ("热设计工程师",)),
    (
        "gap_llm_application",
        (
            ("大模型应用", "LLM应用", "RAG", "知识库问答", "Prompt工程", "提示词工程", "AI科学计算", "AI Coding", "存储优化", "UGC", "引擎工程师", "不动产技术"),
            ("开发", "研发", "工程", "后端", "应用", "科学计算", "Coding", "存储优化", "引擎", "技术负责人"),
        ),
        ("Agent", "智能体", "Agentic"),
        ("大模型应用工程师",),
    ),
    (
        "gap_misc_platform_and_experience",
        (("安全策略", "安全与隐私保护工程师", "用户体验", "供应链交付", "基础设施平台", "内存系统验证", "数据生产", "SNIC软件应用", "增程器设计验证", "视频大模型编导", "Agent工程师", "大模型Agent框架", "视觉创作Agent技术专家"),),
        (),
        (),
    ),
)


def keyword_matches(postings: DataFrame, keywords: DataFrame, fields: dict[str, int]) -> DataFrame:
    """job_id, standard_job, field and keyword of each keyword that a field contains, case aside; see keywords.contained()."""
    names = list(fields)
    texts = postings.select("job_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lower(clean_text(F.col(c))) for c in names)))).alias("field", "text"))
    words = keywords.select("standard_job", F.lower(clean_text(F.col("keyword"))).alias("keyword")).distinct()
    return contained(texts, words).select("job_id", "standard_job", "field", "keyword")


def seed_scores(postings: DataFrame, keywords: DataFrame, priorities: DataFrame, rules: R.SeedRules = R.SeedRules()) -> DataFrame:
    """job_id, standard_job, score and priority: weights of fields times their matched keywords."""
    fields = {"job_title": rules.title_weight, "job_responsibility": rules.responsibility_weight, "job_requirement": rules.requirement_weight}
    weight = F.coalesce(*(F.when(F.col("field") == f, w) for f, w in fields.items()))
    found = keyword_matches(postings, keywords, fields).groupBy("job_id", "standard_job").agg(F.sum(weight).alias("score"))
    return found.join(priorities, "standard_job", "left").withColumn("priority", F.coalesce("priority", F.lit(0)))


def seed_assignment(postings: DataFrame, keywords: DataFrame, priorities: DataFrame, rules: R.SeedRules = R.SeedRules()) -> DataFrame:
    """One row for each posting: the best job, the margin to the second, status and reason.

    Postings without a match take part with score 0 and no job; a named job beats the general
    one of priority 0 at equal scores, names settle the rest.
    """
    order = Window.partitionBy("job_id").orderBy(F.desc("score"), F.desc("priority"), "standard_job")
    ranked = seed_scores(postings, keywords, priorities, rules).withColumns({"n": F.row_number().over(order), "second": F.lead("score", 1, 0).over(order)})
    best = postings.select("job_id").join(ranked.where("n = 1").drop("n"), "job_id", "left").na.fill(0, ["score", "second", "priority"]).na.fill("", ["standard_job"])
    margin = F.col("score") - F.col("second")
    reason = (
        F.when(F.col("score") <= 0, "no seed-keyword evidence")
        .when((F.col("priority") > 0) & (F.col("score") <= 1), "specialty assignment relies on weak evidence only")
        .when((margin == 0) & (F.col("second") > 0), "top seed-rule candidates are tied")
        .when((margin <= rules.close_margin) & (F.col("second") > 0), "top seed-rule candidates are close")
        .otherwise("seed taxonomy keyword rule")
    )
    out = best.withColumns({"assignment_margin": margin, "assignment_reason": reason}).withColumnsRenamed({"standard_job": "assigned_standard_job", "score": "assignment_score"})
    status = F.when(F.col("assignment_reason") == "seed taxonomy keyword rule", "assigned").otherwise("needs_review")
    return out.withColumn("assignment_status", status).drop("second", "priority")


def assignment_review(postings: DataFrame, assignments: DataFrame) -> DataFrame:
    """Postings that need review, joined one to one; sort by margin, score, job and id to work them off."""
    one = assignments.groupBy("job_id").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("assignments repeat a job_id")).cast("boolean")).alias("_dup"), *(F.first(c).alias(c) for c in assignments.columns if c != "job_id"))
    return postings.join(one.where("_dup IS NULL").drop("_dup").where("assignment_status = 'needs_review'"), "job_id")


def _vectors(column: pa.Array | list, size: int) -> np.ndarray:
    """Rows of size numbers and length 1; zeros for a vector that is null, of another size, without length, or with nulls or infinite components."""
    out = np.zeros((len(column), size))
    if isinstance(column, pa.Array) and len(column.flatten()) == len(column) * size and not column.null_count and not column.flatten().null_count and (np.diff(column.offsets.to_numpy()) == size).all():
        out = column.flatten().to_numpy().reshape(out.shape).copy()
    elif held := [(i, v) for i, v in enumerate(column if isinstance(column, list) else column.to_pylist()) if v is not None and len(v) == size and None not in v]:
        out[[i for i, _ in held]] = np.array([v for _, v in held], float)
    out[~np.isfinite(out).all(1)] = 0
    length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def _largest(scores: np.ndarray, k: int, slack: float) -> np.ndarray:
    """By row: whether a score is one of the k largest, equal to the k-th, or within slack of it."""
    n = scores.shape[1]
    return np.ones(scores.shape, bool) if n <= k else scores >= np.partition(scores, n - k, axis=1)[:, n - k, None] - slack


def cosine_candidates(queries: DataFrame, candidates: DataFrame, k: int, per_category: int = 0, slack: float | None = None) -> DataFrame:
    """job_id, name, category, score and rank of candidates by cosine: each query's k best, and the per_category best of each category.

    queries: job_id, v; candidates: name, category, v. A taxonomy is broadcast in blocks of SMALL
    rows; each is scored against batches of queries as a matrix product, and only what can be among
    the best leaves the batch. Ties go by name. With slack, candidates that come within slack of
    the last of the best stay too, for those who round scores or break ties in another way; rank
    counts rows that are there. Vectors of no length, null, broken or of another size score 0.
    """
    size = candidates.agg(F.max(F.size("v"))).first()[0]
    parts, held = [], []
    kind = queries.schema["job_id"].dataType.simpleString()
    asked = queries.select("job_id", F.col("v").cast("array<double>").alias("v"))

    def scored() -> None:
        rows = sorted(held, key=lambda r: (r["category"] is not None, r["category"] or "", r["name"]))
        held.clear()
        cuts = [i for i in range(len(rows) + 1) if i in (0, len(rows)) or rows[i]["category"] != rows[i - 1]["category"]]
        shared = queries.sparkSession.sparkContext.broadcast(([r["name"] for r in rows], [r["category"] for r in rows], _vectors([r["v"] for r in rows], max(0, size or 0)), cuts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, categories, matrix, cuts = shared.value
            names, categories, wide = pa.array(names, pa.string()), pa.array(categories, pa.string()), slack or 0.0
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    scores = _vectors(part.column("v"), matrix.shape[1]) @ matrix.T
                    keep = _largest(scores, k, wide)
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        if per_category:
                            keep[:, a:b] |= _largest(scores[:, a:b], per_category, wide)
                    i, j = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([part.column("job_id").take(pa.array(i)), names.take(pa.array(j)), categories.take(pa.array(j)), pa.array(scores[i, j])], names=["job_id", "name", "category", "score"])

        parts.append(asked.mapInArrow(run, f"job_id {kind}, name string, category string, score double"))

    for row in candidates.select("name", "category", F.col("v").cast("array<double>").alias("v")).toLocalIterator():
        held.append(row)
        if len(held) == SMALL:
            scored()
    if held or not parts:
        scored()
    by = lambda *keys: Window.partitionBy("job_id", *keys).orderBy(F.desc("score"), "name")
    found = union(parts).withColumn("rank", F.row_number().over(by()))
    if per_category:
        found = found.withColumn("_c", F.row_number().over(by("category")))
    if slack is None:
        return found.where((F.col("rank") <= k) | (F.col("_c") <= per_category)).drop("_c") if per_category else found.where(F.col("rank") <= k)
    least = lambda place, n, *keys: F.col("score") >= F.min(F.when(F.col(place) <= n, F.col("score"))).over(Window.partitionBy("job_id", *keys)) - slack
    fine = least("rank", k) | least("_c", per_category, "category") if per_category else least("rank", k)
    return found.withColumn("_keep", fine).where("_keep").drop("_keep", "_c")


def ladder_candidates(queries: DataFrame, candidates: DataFrame, rules: R.RouteRules = R.RouteRules(), top: int = 3, slack: float = 0.0) -> DataFrame:
    """The candidates that route(), category_scores() and route_review() can need: the top best of all and of each category, or more if rules ask for more."""
    most = max(top, rules.judged_max_rank, 2)
    return cosine_candidates(queries, candidates, most, most, slack)


def gram_scores(titles: DataFrame, jobs: DataFrame, size: int = 2) -> DataFrame:
    """job_id, name, category and score of the jobs whose names share a run of size signs with a title, case aside.

    titles: job_id, title; jobs: name, category. The score is the cosine of the counts of runs; a
    text shorter than size is one run. It stands in where no vectors are at hand, and whatever
    gives the same columns can take its place. Pairs that share nothing have no row.
    """
    a = _grams(titles, ["job_id"], "title", size).withColumnsRenamed({"n": "n1", "square": "s1"})
    b = _grams(jobs, ["name", "category"], "name", size).withColumnsRenamed({"n": "n2", "square": "s2"})
    met = a.join(b, "gram").groupBy("job_id", "name", "category", "s1", "s2").agg(F.sum(F.col("n1") * F.col("n2")).alias("dot"))
    return met.select("job_id", "name", "category", (F.col("dot") / F.sqrt((F.col("s1") * F.col("s2")).cast("double"))).alias("score"))


def _grams(df: DataFrame, keys: list[str], column: str, size: int) -> DataFrame:
    """keys, gram, n (how often a text has it) and square (the sum of n * n) of texts that are not empty."""
    text = F.lower(clean_text(F.col(column)))
    return _counted(df.where(text != "").select(*keys, F.explode(_runs(text, size)).alias("gram")), keys)


def _runs(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda i: F.substr(text, i, F.lit(size)))


def _counted(grams: DataFrame, keys: list[str]) -> DataFrame:
    rows = grams.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    return rows.withColumn("square", F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(*keys)))


def gram_topk(titles: DataFrame, jobs: DataFrame, k: int, floor: float = 0.3, size: int = 2) -> DataFrame:
    """job_id, name, category, score and rank of the k jobs nearest to each title, of those that score floor or more as gram_scores() does.

    The runs of a title that any job has are put in order, those of the fewest jobs first. A job whose
    first common run is the i-th shares nothing before it, so its cosine is at most the length of what
    is left from there on over the title's; runs from which that is under floor are not joined, and
    these are the ones that most jobs have. What the join finds is scored exactly. Titles that are
    the same, case aside, are ranked once, and only the jobs that they keep are joined to their ids.
    """
    deal = lambda df, most, key: df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most)), key)
    text = F.lower(clean_text(F.col("title")))
    told = deal(titles.where(F.col("job_id").isNotNull()), TITLES, "job_id").select("job_id", text.alias("text")).where("text <> ''")
    # a job_id has one title as a rule; the runs of more are counted together
    said = stored(told.groupBy("job_id").agg(F.array_sort(F.collect_list("text")).alias("texts")), "titles")
    texts = deal(stored(said.select("texts").distinct(), "texts"), TEXTS, "texts")
    a = _counted(texts.select("texts", F.explode(F.flatten(F.transform("texts", lambda x: _runs(x, size)))).alias("gram")), ["texts"])
    b = _grams(jobs, ["name", "category"], "name", size)
    df = b.groupBy("gram").agg(F.count("*").alias("df"))
    left = Window.partitionBy("texts").orderBy(F.desc("df"), F.desc("gram")).rowsBetween(Window.unboundedPreceding, 0)
    bound = F.sqrt(F.sum(F.col("n") * F.col("n")).over(left) / F.col("square"))
    prefix = a.join(df, "gram").withColumn("bound", bound).where(F.col("bound") >= floor - 1e-9)
    met = prefix.select("texts", "gram").join(b.select("gram", "name", "category"), "gram").select("texts", "name", "category").distinct()
    # a title and a name have a few runs
    counts = lambda rows, keys, name: rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("gram", "n"))).alias(name), F.max("square").alias(f"{name}_square"))
    both = met.join(counts(a, ["texts"], "x"), "texts").join(counts(b, ["name", "category"], "y").withColumnRenamed("category", "_c").withColumnRenamed("name", "_n"), (F.col("name") == F.col("_n")) & F.col("category").eqNullSafe(F.col("_c")))
    dot = F.aggregate(F.map_entries("x"), F.lit(0).cast("long"), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(F.col("y"), e["key"]), F.lit(0).cast("long")))
    scored = both.select("texts", "name", "category", (dot / F.sqrt((F.col("x_square") * F.col("y_square")).cast("double"))).alias("score")).where(F.col("score") >= floor - 1e-9)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("texts").orderBy(F.desc("score"), "name", "category"))).where(F.col("rank") <= k)
    return said.join(ranked, "texts").select("job_id", "name", "category", "score", "rank")


def category_scores(candidates: DataFrame, top: int = 3) -> DataFrame:
    """job_id, category, score and the names of its top candidates; a category scores as its best job."""
    return candidates.groupBy("job_id", "category").agg(F.max("score").alias("score"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "name"))), 1, top), lambda x: x["name"]), "; ").alias("top_jobs"))


def route(candidates: DataFrame, decisions: DataFrame | None = None, rules: R.RouteRules = R.RouteRules()) -> DataFrame:
    """One row for each posting: route_status, standard_job, score, margin and reason, by the ladder of thresholds.

    candidates: job_id, name, category, score of all jobs of the taxonomy that come into question.
    decisions: job_id, decision_status, decision_job, decision_confidence of whoever judges the
    middle zone; without one, middle cases stay potential new jobs.
    """
    by_score = Window.partitionBy("job_id").orderBy(F.desc("score"), "name")
    top = F.max("score").over(Window.partitionBy("job_id", "category"))
    rows = candidates.withColumns({"rank": F.row_number().over(by_score), "category_score": top})
    best_category = F.max("score").over(Window.partitionBy("job_id"))
    rows = rows.withColumn("best_category", best_category)
    dense = F.dense_rank().over(Window.partitionBy("job_id").orderBy(F.desc("category_score"), "category"))
    rows = rows.withColumn("category_rank", dense)
    near = rows.where((F.col("category_score") >= rules.category_floor) & (F.col("best_category") - F.col("category_score") <= rules.category_gap) & (F.col("category_rank") <= rules.max_categories))
    chosen = near.withColumns({"n": F.row_number().over(by_score), "second": F.lead("score").over(by_score)}).where("n = 1")
    chosen = chosen.select("job_id", F.col("name").alias("top_job"), F.col("score").alias("top_score"), F.coalesce(F.col("score") - F.col("second"), F.lit(1.0)).alias("margin"))
    out = candidates.select("job_id").distinct().join(chosen, "job_id", "left")
    if decisions is None:
        out = out.withColumns({"decision_status": F.lit(None).cast("string"), "decision_job": F.lit(None).cast("string"), "decision_confidence": F.lit(None).cast("double"), "picked_rank": F.lit(None).cast("int"), "picked_score": F.lit(None).cast("double")})
    else:
        picked = rows.select("job_id", F.col("name").alias("decision_job"), F.col("rank").alias("picked_rank"), F.col("score").alias("picked_score"))
        out = out.join(decisions, "job_id", "left").join(picked, ["job_id", "decision_job"], "left")
    c = F.col
    direct = (c("top_score") >= rules.direct_score) & (c("margin") >= rules.direct_margin)
    accepted = (c("decision_status") == "existing_job") & (c("picked_rank") <= rules.judged_max_rank) & (c("picked_score") >= rules.judged_score) & (c("decision_confidence") >= rules.judged_confidence)
    taken = c("decision_status").isin("potential_new_job", "new_family") & (c("top_score") >= rules.direct_score)
    steps = [
        (c("top_job").isNull(), "new_family", F.lit(None), "category below floor"),
        (c("top_score") < rules.job_floor, "potential_new_job", F.lit(None), "job below floor"),
        (direct, "existing_job", c("top_job"), "direct"),
        (accepted, "existing_job", c("decision_job"), "judged"),
        (taken, "existing_job", c("top_job"), "judge uncertain, top candidate taken"),
        (c("decision_status").isNull(), "potential_new_job", F.lit(None), "middle zone without a judge"),
    ]
    status, job, reason = c("decision_status"), F.lit(None).cast("string"), F.lit("judged not accepted")
    for holds, name, pick, said in reversed(steps):
        status, job, reason = F.when(holds, name).otherwise(status), F.when(holds, pick.cast("string")).otherwise(job), F.when(holds, said).otherwise(reason)
    return out.select("job_id", status.alias("route_status"), F.coalesce(job, F.lit("")).alias("standard_job"), "top_job", "top_score", "margin", reason.alias("route_reason"))


def gap_guard(titles: DataFrame, known_jobs: tuple[str, ...], known_categories: tuple[str, ...], families=NEW_FAMILY_RULES, potential=POTENTIAL_JOB_RULES) -> DataFrame:
    """titles (job_id, title) with guard_status and guard_rule of the first rule that a title meets, null if none.

    families: (name, terms, covering categories); potential: (name, groups of terms of which each
    has to occur, excluded terms, covering jobs). Rules whose cover is known are left out.
    """
    jobs, categories = {x.lower() for x in known_jobs}, {x.lower() for x in known_categories}
    cases = [(contains_any(F.col("title"), terms), "new_family", name) for name, terms, cover in families if not any(x.lower() in categories for x in cover)]
    cases += [(contains_all_groups(F.col("title"), groups) & ~contains_any(F.col("title"), excluded), "potential_new_job", name) for name, groups, excluded, cover in potential if not any(x.lower() in jobs for x in cover)]
    status, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for holds, name, said in reversed(cases):
        status, rule = F.when(holds, name).otherwise(status), F.when(holds, said).otherwise(rule)
    return titles.withColumns({"guard_status": status, "guard_rule": rule})


def category_texts(taxonomy: DataFrame) -> DataFrame:
    """standard_category and profile: the category, then the titles and keywords of its jobs in order.

    taxonomy: standard_job, standard_category, match_keywords, and row_order or else by title; a category has as many jobs as the taxonomy gives it.
    """
    order = F.col("row_order") if "row_order" in taxonomy.columns else F.col("standard_job")
    said = F.filter(F.array("standard_job", F.coalesce("match_keywords", F.lit(""))), lambda x: x != "")
    listed = taxonomy.groupBy("standard_category").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), said.alias("x")))).alias("l"))
    return listed.select("standard_category", F.concat_ws(" ", "standard_category", F.flatten(F.transform("l", lambda x: x["x"]))).alias("profile"))


def route_review(postings: DataFrame, scores: DataFrame, keywords: DataFrame, top: int = 5, floor: float = 0.45) -> DataFrame:
    """One row for each posting with its best jobs and categories, the keyword evidence of the best, and who has to decide.

    postings: job_id, cleaned_job_title, routing_text and others, which are kept; scores: job_id,
    name, category and score of all jobs of the taxonomy for the cleaned title; keywords:
    standard_job and keyword. Jobs rank by score, then by their keywords in the routing text, then
    by name. A title that was not cleaned is an error.
    """
    if top < 2:
        raise ValueError("top has to be 2 or more")
    bare = F.when(clean_text(F.col("cleaned_job_title")) == "", F.raise_error(F.lit("titles have to be cleaned before they are routed")).cast("boolean"))
    postings = postings.withColumn("_bare", bare).where("_bare IS NULL").drop("_bare")
    hits = keyword_matches(postings, keywords, {"routing_text": 1}).groupBy("job_id", F.col("standard_job").alias("name")).agg(F.array_sort(F.collect_set("keyword")).alias("evidence"))
    rows = scores.select("job_id", "name", "category", clamp(F.col("score")).alias("score")).join(hits, ["job_id", "name"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    place = (F.desc("score"), F.desc(F.size("evidence")), F.asc("name"))
    rows = rows.withColumns({"n": F.row_number().over(Window.partitionBy("job_id").orderBy(*place)), "in_category": F.row_number().over(Window.partitionBy("job_id", "category").orderBy(*place))})
    rows = rows.withColumn("c", F.when(F.col("in_category") == 1, F.sum((F.col("in_category") == 1).cast("int")).over(Window.partitionBy("job_id").orderBy("n"))))
    job = F.struct("n", F.struct(F.col("name").alias("standard_job"), "category", "score", F.col("evidence").alias("keyword_evidence")).alias("x"))
    category = F.struct("c", F.struct(F.col("category").alias("standard_category"), "score", F.col("name").alias("top_standard_job")).alias("x"))
    listed = lambda c: F.transform(F.array_sort(c), lambda y: y["x"])
    best = rows.where((F.col("n") <= top) | (F.col("c") <= top)).groupBy("job_id").agg(
        listed(F.collect_list(F.when(F.col("n") <= top, job))).alias("_jobs"), listed(F.collect_list(F.when(F.col("c") <= top, category))).alias("_categories")
    )
    one, two = F.col("_jobs")[0], F.try_element_at(F.col("_jobs"), F.lit(2))
    margin = F.coalesce(one["score"] - two["score"], F.lit(1.0))
    judged = F.when(F.size(one["keyword_evidence"]) == 0, "semantic candidate has no exact government dictionary keyword evidence").when(margin < 0.05, "top1/top2 semantic margin is below 0.05").otherwise("government routes require LLM adjudication before formal event assignment")
    low = one["score"] < floor
    return postings.join(best, "job_id").withColumns(
        {
            "top_categories_json": F.to_json("_categories"),
            "top_jobs_json": F.to_json("_jobs"),
            "top1_standard_category": one["category"],
            "top1_standard_job": one["standard_job"],
            "top1_score": F.round(one["score"], 6),
            "top2_standard_job": F.coalesce(two["standard_job"], F.lit("")),
            "top2_score": F.coalesce(F.round(two["score"], 6), F.lit(0.0)),
            "top1_margin": F.round(margin, 6),
            "top1_keyword_evidence": F.array_join(one["keyword_evidence"], "; "),
            "route_status": F.when(low, "needs_human_review").otherwise("needs_llm_adjudication"),
            "route_reason": F.when(low, f"top1 text2vec score below candidate floor {floor:.2f}").otherwise(judged),
            "selected_standard_category": F.lit(""),
            "selected_standard_job": F.lit(""),
        }
    ).drop("_jobs", "_categories")


def validated_decisions(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """A judge's decisions (job_id, decision_status, decision_job, decision_confidence) in the form that route() takes.

    An unknown status is potential_new_job, an existing job that is not among the candidates of
    its posting too; confidences are brought into 0 to 1, and of several decisions the surest counts.
    """
    known = candidates.select("job_id", F.col("name").alias("decision_job"), F.lit(True).alias("_known"))
    sure = clamp(F.coalesce(F.col("decision_confidence").cast("string").try_cast("double"), F.lit(0.0)))
    rows = decisions.withColumn("decision_confidence", sure).join(known, ["job_id", "decision_job"], "left")
    status = F.when(F.col("decision_status").isin("potential_new_job", "new_family"), F.col("decision_status")).when((F.col("decision_status") == "existing_job") & F.col("_known"), "existing_job").otherwise("potential_new_job")
    order = Window.partitionBy("job_id").orderBy(F.desc("decision_confidence"), "decision_job")
    rows = rows.withColumns({"decision_status": status, "_n": F.row_number().over(order)}).where("_n = 1")
    return rows.select("job_id", "decision_status", F.when(F.col("decision_status") == "existing_job", F.col("decision_job")).otherwise("").alias("decision_job"), "decision_confidence")
