"""Audits of notes: typed relations, declared coverage of sources, note rules, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import markdown as M
from marginalia.operators import rules
from marginalia.sources.notes import prop

#: The domains of relation rows and of note properties.
CATEGORIES = ("故事与剧本", "导演与视听语言", "摄影美术与现场制作", "声音与后期", "创作实践与项目复盘", "行业观察与灵感素材")
RELATIONS = ("前置", "转译", "实现", "制约", "验证", "反馈", "冲突", "互补", "对照")
BASES = ("来源明示", "现有笔记明示", "多源综合", "Codex综合", "项目验证")
SAME, CROSS = "同类知识连接", "跨域连接"
REQUIRED = ("类型", "分类", "状态", "材料类型", "信息来源", "完整程度", "整理日期")
TOPIC_V2 = ("解决问题", "适用阶段", "知识状态", "成熟度", "上位主题", "相关主题", "最后复核")
STATES = {
    "知识状态": ("待提炼", "已提炼", "已验证", "已应用", "待修订"), "成熟度": ("种子", "生长", "稳定"), "沉淀状态": ("未沉淀", "部分沉淀", "已沉淀"),
    "理解状态": ("待理解", "理解中", "已理解"), "证据状态": ("单一来源", "多源互证", "实践验证", "存在争议"), "掌握状态": ("未检验", "能复述", "能辨析", "能迁移"),
}
MASTERY = {"未检验": 0, "能复述": 1, "能辨析": 2, "能迁移": 3}
NEEDS_REASON, NEEDS_NOTE = ("合并", "待补", "待核"), ("保留", "合并")


ROWS = "array<struct<target:string,category:string,relation:string,reason:string,basis:string,line:int,section:string>>"


def relation_rows(body: str) -> Column:
    return F.udf(lambda b: M.relations(b or "")[0], ROWS, useArrow=True)(body)


def relations(topics: DataFrame) -> DataFrame:
    """(source, own_category, target, category, relation, reason, basis, section, line) from notes' relation tables."""
    out = topics.select(F.col("title").alias("source"), prop("分类").alias("own_category"), F.explode(relation_rows("body")).alias("r"))
    return out.select("source", "own_category", "r.*")


def audit_relations(edges: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with ``valid``, errors (source, target, line, code)); ``categories`` is (title, category) of all topics.

    An edge is valid if its own row is right and the target has a row back in the same section.
    """
    known = categories.select(F.col("title").alias("target"), F.col("category").alias("real"))
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "section", F.lit(True).alias("back")).distinct()
    e = edges.join(known, "target", "left").join(back, ["source", "target", "section"], "left")
    section = F.when(F.col("own_category") == F.col("real"), SAME).otherwise(CROSS)
    codes = {
        "unknown_target": F.col("real").isNull(), "relation": ~F.col("relation").isin(*RELATIONS), "basis": ~F.col("basis").isin(*BASES),
        "reason": F.trim("reason") == "", "category": F.col("real").isNotNull() & (F.col("category") != F.col("real")),
        "section": F.col("real").isNotNull() & (F.col("section") != section), "not_reciprocal": F.col("back").isNull(),
    }
    wrong = F.lit(False)
    for c in codes.values():
        wrong = wrong | F.coalesce(c, F.lit(False))
    e = e.withColumn("valid", ~wrong)
    row = e.withColumn("_key", F.struct("source", "target", "line"))
    errors = rules.violations(row, "_key", codes).select("_key.*", "code")
    return e.select(*edges.columns, "valid"), errors


def edge_counts(edges: DataFrame) -> DataFrame:
    """Distinct undirected valid edges inside a category and across, and the topics that they connect."""
    pair = F.struct(F.least("source", "target"), F.greatest("source", "target"))
    good = edges.filter("valid").withColumn("pair", pair)
    ends = good.select(F.explode(F.array("source", "target")).alias("t"))
    counts = good.agg(F.countDistinct(F.when(F.col("section") == SAME, F.col("pair"))).alias("same"), F.countDistinct(F.when(F.col("section") == CROSS, F.col("pair"))).alias("cross"))
    return counts.crossJoin(ends.agg(F.countDistinct("t").alias("connected")))  # one row each


def is_version(*versions: str) -> Column:
    return F.coalesce(prop("知识库版本").isin(*versions), F.lit(False))


def note_rules() -> dict[str, Column]:
    """Rules of a note (columns of ``sources.notes.notes``) as code and violating condition."""
    empty = lambda p: F.coalesce(F.size(F.col("props")[p]), F.lit(0)) < 1
    heads = F.transform("blocks", lambda b: b["heading"])
    out = {f"missing:{p}": empty(p) for p in REQUIRED}
    out["title"] = F.regexp_count("body", F.lit(r"(?m)^#[ \t]+\S")) != 1
    out["duplicate_heading"] = F.size(F.regexp_extract_all("body", F.lit(r"(?m)^##[ \t]+(.+?)[ \t]*$"), F.lit(1))) != F.size(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?m)^##[ \t]+(.+?)[ \t]*$"), F.lit(1))))
    out["naked_url"] = F.col("body").rlike(r"(?m)(^|[^(<\"'])https?://\S+")
    topic = (prop("类型") == "主题笔记") & is_version("2", "2.0", "2.1")
    out |= {f"topic_missing:{p}": topic & empty(p) & (p not in ("上位主题", "相关主题")) for p in TOPIC_V2}
    out["topic_sections"] = topic & (F.size(F.array_except(F.array(F.lit("核心命题"), F.lit("适用边界")), heads)) > 0)
    out |= {f"state:{p}": prop(p).isNotNull() & ~prop(p).isin(*values) for p, values in STATES.items()}
    out["category"] = topic & ~prop("分类").isin(*CATEGORIES)
    out["mastery_date"] = (prop("掌握状态").isNotNull() & (prop("掌握状态") != "未检验")) & F.try_to_date(prop("最近检验"), "yyyy-MM-dd").isNull()
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


#: What an episode note must have, its heading, and those of a lesson note.
EPISODE, TIMELINE, LESSON, LAYERED, THREADS = ("课程", "分集", "主题", "BV", "P"), "时间线笔记", "课", "课程分层", "分集脉络"
#: Headings of topic notes by version, and the record that a checked topic must have.
TOPIC_HEADINGS, V2_HEADINGS, V21_HEADING, CHECKED = ("学习材料", "内容导览"), ("核心命题", "适用边界", "知识单元", "项目应用与验证"), "外部补充与分歧", "内化检验记录"


def _has_heading(name: str, level: int = 2) -> Column:
    return F.col("body").rlike(rf"(?m)^#{{{level}}}[ \t]+\Q{name}\E[ \t]*$")


def episode_rules() -> dict[str, Column]:
    """Rules of episode notes, those of a whole lesson included: their pages ascend, repeat none, begin with P, and each
    is linked."""
    mine = prop("类型") == "分集笔记"
    lesson = mine & (prop("聚合单位") == LESSON)
    have = F.map_contains_key("props", "包含P")
    pages = F.transform(F.regexp_extract_all(F.array_join(F.coalesce(F.col("props")["包含P"], F.array().cast("array<string>")), ","), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
    some = lesson & have & (F.size(pages) > 0)
    linked = F.transform(F.regexp_extract_all("body", F.lit(r"[?&]p=(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    out = {f"episode_missing:{p}": mine & ~F.map_contains_key("props", p) for p in EPISODE}
    out["episode_page"] = mine & (F.trim(F.coalesce(prop("P"), F.lit(""))) == "")
    out["episode_video"] = mine & ~F.col("body").rlike(r"(?m)^视频[:：]\s*\[[^\]]+\]\(https?://[^)]+\)")
    out["episode_timeline"] = mine & ~_has_heading(TIMELINE)
    out["lesson_layers"] = lesson & ~F.coalesce(prop("笔记架构") == LAYERED, F.lit(False))
    out["lesson_missing:包含P"] = lesson & ~have
    out["lesson_no_pages"] = lesson & have & (F.size(pages) == 0)
    out["lesson_order"] = some & (pages != F.array_sort(pages))
    out["lesson_repeated"] = some & (F.size(pages) != F.size(F.array_distinct(pages)))
    out["lesson_first"] = some & ~F.coalesce(F.regexp_extract(F.coalesce(prop("P"), F.lit("")), r"\d+", 0).try_cast("int") == pages[0], F.lit(False))
    out["lesson_threads"] = some & ~_has_heading(THREADS)
    out["lesson_links"] = some & (F.size(F.array_except(pages, linked)) > 0)
    return out


def topic_rules() -> dict[str, Column]:
    """Further rules of topic notes: headings by version, and states of mastery that go with dates and records."""
    mine = prop("类型") == "主题笔记"
    newer = mine & is_version("2", "2.0", "2.1")
    level, date = F.map_contains_key("props", "掌握状态"), F.map_contains_key("props", "最近检验")
    checked = mine & level & date & ((F.coalesce(prop("掌握状态"), F.lit("")) != "未检验") | (F.coalesce(prop("最近检验"), F.lit("")) != ""))
    out = {f"topic_heading:{h}": mine & ~_has_heading(h) for h in TOPIC_HEADINGS}
    out |= {f"topic_heading:{h}": newer & ~_has_heading(h) for h in V2_HEADINGS}
    out[f"topic_heading:{V21_HEADING}"] = mine & is_version("2.1") & ~_has_heading(V21_HEADING)
    out["mastery_pair"] = newer & (level != date)
    out["mastery_record"] = newer & checked & ~_has_heading(CHECKED, 3)
    return out


def validate(notes: DataFrame, strict: bool = False) -> DataFrame:
    """(path, code) of every rule that a note violates; ``strict`` adds those of episode and topic notes' headings."""
    more = {k: F.coalesce(v, F.lit(False)) for k, v in (episode_rules() | topic_rules()).items()} if strict else {}
    return rules.violations(notes, "path", note_rules() | more)


def review_target(topics: DataFrame, focus: str = "", category: str = "") -> DataFrame:
    """The topic to review next: out of focus last, least mastered, longest not reviewed, by path."""
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MASTERY.items() for x in kv]), prop("掌握状态")), F.lit(0))
    open_ = topics.filter(level < 3)
    if category:
        open_ = open_.filter(prop("分类") == category)
    date = F.coalesce(F.try_to_date(prop("最近检验"), "yyyy-MM-dd"), F.lit("0001-01-01").cast("date"))
    order = [(F.coalesce(prop("分类"), F.lit("")) != focus).asc(), level.asc(), date.asc(), F.lower("path").asc()]
    return rules.least(open_, order, ["path", "title"])


def coverage_items(records: DataFrame) -> DataFrame:
    """(source_id, id, status, reason, source_from, source_to, note_lines, error) of registered items of review records."""
    item = records.select("source_id", "coverage.scope", F.explode("coverage.items").alias("i"))
    lines = F.col("i.source.lines")
    inside = F.exists("scope", lambda s: (s[0] <= lines[0]) & (s[1] >= lines[1]))
    error = (
        F.when(lines.isNull() | (F.size(lines) != 2), "locator").when(lines[0] > lines[1], "locator").when(~inside, "scope")
        .when(~F.col("i.status").isin("保留", *NEEDS_REASON), "status").when(F.col("i.status").isin(*NEEDS_REASON) & (F.trim(F.coalesce("i.reason", F.lit(""))) == ""), "reason")
        .when(F.col("i.status").isin(*NEEDS_NOTE) & F.col("i.note.lines").isNull(), "locator")
    )
    return item.select("source_id", "i.id", "i.status", "i.reason", lines[0].alias("source_from"), lines[1].alias("source_to"), F.col("i.note.lines").alias("note_lines"), error.alias("error"))


def coverage_verdict(records: DataFrame, texts: DataFrame) -> DataFrame:
    """(source_id, status, unregistered) of records against (source_id, text): invalid, open or closed.

    Lines in scope that are not blank must be registered; waiting items keep a record open; any error makes it invalid.
    """
    items = coverage_items(records)
    scope = records.select("source_id", F.explode("coverage.scope").alias("s")).select("source_id", F.explode(F.sequence(F.col("s")[0], F.col("s")[1])).alias("line")).distinct()
    lines = texts.select("source_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).filter(F.trim("t") != "").select("source_id", (F.col("p") + 1).alias("line"))
    good = items.filter(F.col("error").isNull())
    known = good.select("source_id", F.explode(F.sequence("source_from", "source_to")).alias("line")).distinct()
    left = scope.join(lines, ["source_id", "line"]).join(known, ["source_id", "line"], "left_anti").groupBy("source_id").agg(F.count("*").alias("n"))
    state = items.groupBy("source_id").agg(F.bool_or(F.col("error").isNotNull()).alias("bad"), F.bool_or(F.col("status").isin("待补", "待核")).alias("waiting"))
    out = records.select("source_id").join(state, "source_id", "left").join(left, "source_id", "left")
    verdict = F.when(F.coalesce("bad", F.lit(False)), "invalid").when(F.coalesce("waiting", F.lit(False)) | (F.col("n") > 0), "open").otherwise("closed")
    return out.select("source_id", verdict.alias("status"), F.coalesce("n", F.lit(0)).alias("unregistered"))


def receipt_errors(known: DataFrame, receipt: DataFrame, facets: DataFrame) -> DataFrame:
    """(id, code) of a receipt's (facet_id, evidence_id, hash) rows against known (evidence_id, hash) and facets (facet_id)."""
    k = known.select("evidence_id", F.col("hash").alias("real"))
    r = receipt.join(k, "evidence_id", "left")
    rows = rules.violations(r, "evidence_id", {"unknown_evidence": F.col("real").isNull(), "stale_evidence": F.col("real").isNotNull() & (F.col("real") != F.col("hash"))})
    n = receipt.select("facet_id").distinct().withColumn("r", F.lit(True)).join(facets.groupBy("facet_id").agg(F.count("*").alias("n")), "facet_id", "full")
    more = rules.violations(n, "facet_id", {"unknown_facet": F.col("n").isNull(), "missing_facet": F.col("r").isNull(), "repeated_facet": F.col("n") > 1})
    return rows.select(F.col("evidence_id").alias("id"), "code").distinct().unionByName(more.select(F.col("facet_id").alias("id"), "code"))
