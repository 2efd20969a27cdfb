"""What is shown of notes: gaps, cards of evidence, questions to ask, best matches of a prompt, views, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import markdown as M
from marginalia.functions.similarity import similarity_to
from marginalia.functions.text import folded_key
from marginalia.sources.notes import prop

#: The section and the labels of explicit gaps, and what stands for a property that a note lacks.
SKELETON, GAP_LABELS, UNKNOWN = "知识骨架", ("空白", "待补", "缺失", "未覆盖", "待补充"), "未标注"
#: Questions by mastery; the first names the problem (or title), the others the title.
ASK_NEW = "不看笔记，你会怎样用自己的话说清“%s”背后的核心因果关系？"
ASK_LIMITS = "关于“%s”，什么情况下这条方法会失效，或者最容易被误用成什么？"
ASK_TRANSFER = "换到一个你没用过的新故事或新场景，你会怎样应用“%s”，第一步看什么，为什么？"
#: The length of an excerpt, and how many similar prompts are shown from what similarity on.
EXCERPT, SIMILAR, SHOWN = 1800, 0.82, 5
#: The form of a module's name and the lengths of its name and description.
MODULE_NAME, NAME_LENGTH, DESCRIPTION_LENGTH = r"^[a-z0-9]+(-[a-z0-9]+)*$", 64, 1024


def _table_rows(body: str, heading: str) -> list[dict]:
    return [{"cells": M.cells(x), "line": x.strip()} for b in M.sections(body) if b.heading == heading for x in b.text.split("\n") if x.strip().startswith("|")]


def gaps(maps: DataFrame, focus: str) -> DataFrame:
    """(category, question, path, basis): the rows of maps' skeleton tables that say they are gaps, ``focus`` first."""
    rows = F.udf(lambda b: _table_rows(b or "", SKELETON), "array<struct<cells:array<string>,line:string>>", useArrow=True)("body")
    found = maps.select("path", F.coalesce(prop("分类"), F.lit("")).alias("category"), F.explode(rows).alias("r"))
    found = found.filter((F.size("r.cells") >= 4) & F.element_at("r.cells", -1).isin(*GAP_LABELS))
    out = found.select("category", F.col("r.cells")[1].alias("question"), "path", F.col("r.line").alias("basis"))
    return out.orderBy(F.col("category") != focus, "path", "question")


def evidence(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """``blocks`` (id, path, heading, text, ...) with what a reader must know of their notes; long texts are left to be read."""
    known = lambda *names: F.coalesce(*[prop(n) for n in names], F.lit(UNKNOWN))
    about = notes.select(
        F.col("path").alias("_path"), "title", "doc_hash", known("材料类型").alias("source_type"), known("沉淀状态").alias("source_status"),
        known("作者或讲者", "信息来源").alias("author_or_institution"), prop("整理日期").alias("note_date"), prop("发布日期").alias("published_date"),
        known("完整程度").alias("completeness"), known("证据状态").alias("evidence_status"),
    )
    length = F.length("text")
    out = blocks.drop("title", "doc_hash").join(about, F.col("path") == F.col("_path")).drop("_path")
    out = out.withColumn("characters", length).withColumn("read_required", length > EXCERPT)
    return out.withColumn("excerpt", F.when(length <= EXCERPT, F.col("text")).otherwise("")).drop("text")


def question(mastery: Column, problem: Column, title: Column) -> Column:
    """What to ask about a topic of a mastery; an unknown mastery is an advanced one."""
    subject = F.coalesce(F.nullif(problem, F.lit("")), title)
    return F.when(mastery == "未检验", F.format_string(ASK_NEW, subject)).when(mastery == "能复述", F.format_string(ASK_LIMITS, title)).otherwise(F.format_string(ASK_TRANSFER, title))


def best_matches(entries: DataFrame, candidate: str, threshold: float = SIMILAR, shown: int = SHOWN) -> DataFrame:
    """(category, title, similarity, exact) of prompt entries most like ``candidate``: all equal ones, and the ``shown``
    best of the others from ``threshold`` on; an entry counts by the best of its organized, original and fenced texts.

    Texts whose lengths alone rule out the threshold are not compared; nothing is like an empty candidate.
    """
    from marginalia.functions.terms import key

    wanted = key(candidate)
    texts = F.array_distinct(F.concat(F.array("organized", "original"), "fenced"))
    rows = entries.select("category", "title", F.monotonically_increasing_id().alias("_entry"), F.explode(texts).alias("text"))
    rows = rows.withColumn("k", folded_key(F.col("text"))).filter(F.length("k") > 0)
    n = F.length("k")
    rows = rows.filter(F.lit(bool(wanted)) & (2 * F.least(n, F.lit(len(wanted))) >= threshold * (n + len(wanted))))
    rows = rows.withColumn("ratio", similarity_to(wanted, F.col("k"), threshold)).filter(F.col("ratio").isNotNull())
    best = rows.groupBy("_entry", "category", "title").agg(F.max("ratio").alias("best"))
    best = best.select("_entry", "category", "title", F.round("best", 4).alias("similarity"), (F.col("best") == 1.0).alias("exact"))
    other = best.filter(~F.col("exact")).orderBy(F.col("similarity").desc(), "_entry").limit(shown)
    return best.filter("exact").unionByName(other).drop("_entry")


def lesson_units(notes: DataFrame, course: str) -> DataFrame:
    """A course's lesson notes by their first page: the view that aggregates episodes by lesson."""
    mine = (prop("类型") == "分集笔记") & (prop("课程") == course) & (prop("聚合单位") == "课")
    names = ("P", "包含P", "分集", "主题", "状态", "信息来源", "完整程度")
    return notes.filter(mine).select("path", *[F.array_join(F.col("props")[n], ", ").alias(n) for n in names]).orderBy(F.col("P").try_cast("int"), "path")


def topics_of(notes: DataFrame, category: str) -> DataFrame:
    """The topic notes of a category by file name, with their folder and states."""
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    names = ("解决问题", "适用阶段", "知识状态", "成熟度")
    rows = notes.filter((prop("类型") == "主题笔记") & (prop("分类") == category))
    return rows.select(F.element_at(parts, -1).alias("name"), folder.alias("folder"), *[F.array_join(F.col("props")[n], ", ").alias(n) for n in names]).orderBy("name", "folder")


def module_errors(notes: DataFrame) -> DataFrame:
    """(path, code) of module descriptions whose name is not their folder's or ill-formed, or whose description is missing,
    too long or holds angle brackets; one error a file, in that order."""
    name, about = F.coalesce(prop("name"), F.lit("")), F.coalesce(prop("description"), F.lit(""))
    folder = F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit(""))
    code = F.when(F.size(F.map_keys("props")) == 0, "header").when(name != folder, "name_differs").when(~name.rlike(MODULE_NAME) | (F.length(name) > NAME_LENGTH), "name")
    code = code.when((about == "") | (F.length(about) > DESCRIPTION_LENGTH) | about.rlike("[<>]"), "description")
    return notes.select("path", code.alias("code")).filter(F.col("code").isNotNull())


def manifest_totals(files: DataFrame) -> DataFrame:
    """(file_count, total_bytes, markdown_count) of a manifest (path, size, sha256): one row, zeros without files."""
    return files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count_if(F.lower("path").endswith(".md")).alias("markdown_count"))


def write_manifest(files: DataFrame, path: str) -> None:
    """A manifest as JSON lines, in order of paths; one that is there already is never overwritten."""
    files.select("path", "size", "sha256").repartitionByRange("path").sortWithinPartitions("path").write.mode("errorifexists").json(path)


def known_head(refs: DataFrame, branch: str, verified: list[str], tag_prefix: str) -> DataFrame:
    """(head, known) of the branch among ``refs`` (ref, sha): a head is known if a local state names it or a tag verifies it."""
    head = refs.filter(F.col("ref") == f"refs/heads/{branch}").select(F.col("sha").alias("head"))
    tagged = refs.filter(F.startswith("ref", F.lit(f"refs/tags/{tag_prefix}"))).select(F.col("sha").alias("head")).distinct().withColumn("_t", F.lit(True))
    return head.join(tagged, "head", "left").select("head", (F.col("head").isin(*verified) | F.coalesce("_t", F.lit(False))).alias("known"))


def rendered(rows: DataFrame, key: str) -> DataFrame:
    """(key, json): each row as canonical JSON, its fields in alphabetical order and nulls written out."""
    return rows.select(key, F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("json"))


def report(rows: DataFrame, title: str, columns: dict[str, str]) -> DataFrame:
    """(line_no, line): a Markdown report of ``rows`` in their order, one table row each, below a title and a header.

    ``columns`` maps columns to their heads. Bars and line breaks in values are written so that they don't divide.
    """
    clean = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(clean, columns)), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(columns.values()) + " |", "|" + "---|" * len(columns)]
    first = rows.sparkSession.createDataFrame(list(enumerate(head)), "line_no bigint, line string")
    return first.unionByName(rows.select((F.monotonically_increasing_id() + len(head)).alias("line_no"), line.alias("line")))


def clip(value: Column) -> Column:
    """``start,end`` in seconds as (start, end); null unless both are finite, not negative and in order."""
    parts = F.split(value, ",")
    start, end = (F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in (0, 1))
    good = (F.size(parts) == 2) & start.isNotNull() & end.isNotNull() & (start >= 0) & (start < end) & (end < float("inf"))
    return F.when(good, F.struct(start.alias("start"), end.alias("end")))


def clips(duration: Column, chunk: int) -> Column:
    """The (start, end) stretches of ``chunk`` seconds that make up a duration, the last one shorter; none without one."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.floor(duration) / chunk).cast("int") - 1, F.lit(0)))
    each = F.transform(starts, lambda i: F.struct((i * chunk).cast("double").alias("start"), F.least((i + 1) * chunk, duration).cast("double").alias("end")))
    return F.when(duration >= 1, each).otherwise(F.array().cast("array<struct<start:double,end:double>>"))


def frame_times(start: Column, end: Column) -> Column:
    """Three times to look at in [start, end): its start, its middle, and a second before its end; null if it is none."""
    good = (start >= 0) & (start < end) & ~F.isnan(start) & ~F.isnan(end) & (end < float("inf"))
    return F.when(good, F.array_sort(F.array_distinct(F.array(start, (start + end) / 2, F.greatest(start, end - 1)))))
