"""Ranked retrieval over parsed notes, with a verdict when nothing answers.

Rows stream past literal terms once for the statistics and once for the scores; only the ranking's few rows move.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions import terms as T
from marginalia.functions.roles import Reading, owns, reading, reviews
from marginalia.functions.text import folded_key, folded_lexical, text_key
from marginalia.operators import ranking
from marginalia.plans.storage import materialize
from marginalia.sources.notes import blocks, prop

#: Weights of a topic's fields, of a chunk's parts, and the bonuses of stage and role.
TITLE, PROBLEM, SUMMARY, CHUNK, ROUTE = 38, 34, 16, 28, 44
HEADING, CONTENT = 0.65, 0.35
STAGE_BONUS, ROLE_BONUS, BONUS_FROM, STAGE_ROUTE = 7, 4, 10, 0.08
#: States of notes that are not answers any more.
RETIRED = ("撤回", "已撤回", "停用", "已失效")
MAX_RESULTS = 3


def topics(notes: DataFrame, kind: str = "主题笔记") -> DataFrame:
    """(path, title, category, problem, stages, summary, boundary, retired, chunks) of topic notes, and their folded texts.

    A written table: what reads topics several times, for statistics and scores, parses no note again.
    """
    part = lambda h: F.coalesce(F.col("parts")[h], F.lit(""))
    values = lambda name: F.coalesce(F.col("props")[name], F.array().cast("array<string>"))
    aliases = F.when(F.size(values("aliases")) > 0, values("aliases")).otherwise(values("检索别名"))
    out = notes.filter(prop("类型") == kind).select(
        "path", "title", F.coalesce(prop("分类"), F.lit("未标注")).alias("category"), F.coalesce(prop("解决问题"), F.lit("")).alias("problem"),
        values("适用阶段").alias("stages"), F.concat_ws(" ", part("核心命题"), part("一分钟核心摘要"), part("我的默认做法")).alias("summary"),
        part("适用边界").alias("boundary"), F.coalesce(prop("状态").isin(*RETIRED), F.lit(False)).alias("retired"), "chunks",
        F.concat_ws(" ", "title", aliases).alias("named"),
    )
    tail = F.element_at(F.split("title", "｜"), -1)
    out = out.select(
        "*", folded_lexical(F.col("named")).alias("lexical_title"), folded_lexical(F.col("problem")).alias("lexical_problem"),
        folded_lexical(F.col("summary")).alias("lexical_summary"), folded_lexical(tail).alias("lexical_owner"),
    ).drop("named")
    return materialize(out, "topics")


@dataclass
class Question:
    """A question, what it is about (``roles``), and the terms of that."""

    text: str
    stage: str = ""
    role_categories: tuple[str, ...] = ()
    rules: list[dict] = field(default_factory=list)
    roles: Reading = field(init=False)
    terms: list[str] = field(init=False)
    lookup: bool = field(init=False)

    def __post_init__(self) -> None:
        self.roles = reading(self.text)
        self.terms = T.query_terms(T.expanded(self.roles.target, self.rules))
        self.lookup = T.is_lookup(self.roles.target)

    def owned(self, owner: Column, lexical_owner: Column, lexical_body: Column, body: Column) -> Column:
        """Whether a passage may answer: it owns one of the target's objects, or reviews decisions where that is asked."""
        mine = owns(self.roles.target_foci, lexical_owner, lexical_body)
        return mine | reviews(self.roles.target, owner, body) if "release" in self.roles.target_foci else mine


def specific(hits: Column, question: Question) -> Column:
    """Those of the terms hit that no other one contains and that aren't general words."""
    dull = F.array(*[F.lit(t) for t in question.terms if T.is_generic(t)]).cast("array<string>")
    return F.filter(hits, lambda t: ~F.exists(hits, lambda o: (o != t) & F.contains(o, t)) & ~F.array_contains(dull, t))


def known(question: Question, weights: dict[str, float]) -> int:
    """How many specific terms of a question the library knows."""
    return len(T.specific([t for t in question.terms if weights.get(t, 0) > 0]))


def admissible(hits: Column, question: Question, weights: dict[str, float]) -> Column:
    """Two specific terms hit; or one of a lookup; or one of four characters where no two are known at all."""
    whole = specific(hits, question)
    one = F.exists(whole, lambda t: F.length(t) >= 4) if known(question, weights) < 2 else F.lit(False)
    return (F.size(whole) >= 2) | one | ((F.size(whole) >= 1) if question.lookup else F.lit(False))


def supports(heading: Column, body: Column, title: Column, native: Column, question: Question, weights: dict[str, float]) -> Column:
    """Whether a passage answers by the terms hit in its heading, its body and its note's title.

    Its body is admissible; or has a specific term and is admissible with the title, or with the heading where no two
    terms are known; or it owns the question's object (``native``) and has a specific term of four characters. Where the
    question has objects, a passage that owns none by its heads needs such a term, or three specific ones.
    """
    own = specific(body, question)
    some, long = F.size(own) > 0, F.exists(own, lambda t: F.length(t) >= 4)
    ok = admissible(body, question, weights) | (some & admissible(F.array_union(body, title), question, weights))
    if known(question, weights) < 2:
        ok = ok | (some & admissible(F.array_union(heading, body), question, weights))
    if question.roles.target_foci:
        ok = (ok | (native & long)) & (native | long | (F.size(own) >= 3))
    return ok


def term_weights(texts: DataFrame, question: Question) -> dict[str, float]:
    """IDF weights of the question's terms over (text); as many rows reach the driver as the question has terms."""
    if not question.terms:
        return {}
    got = ranking.idf(texts, "text", question.terms, frozenset(t for t in question.terms if t in T.GENERIC_TERMS))
    return {r.term: r.weight for r in got.collect()}


def routed(routes: DataFrame, question: Question, weights: dict[str, float]) -> DataFrame:
    """(target, route, by): for each title that routes lead to, the one that covers the question best and its coverage;
    the question's stage adds STAGE_ROUTE, and the first of equal routes counts."""
    text = folded_lexical(F.concat_ws(" ", "category", "name", "stage", "enter", "order", "stop"))
    rows = routes.withColumn("_text", text).withColumn("_stage", folded_key(F.col("stage")))
    stage = T.key(question.stage)
    same = F.when((F.col("_stage") == stage) & (F.col("_stage") != ""), STAGE_ROUTE).otherwise(0.0) if stage else F.lit(0.0)
    rows = rows.withColumn("by", ranking.covered(F.col("_text"), weights) + same).withColumn("target", F.explode("targets"))
    return rows.groupBy("target").agg(F.max("by").alias("by"), F.min_by("name", F.struct(-F.col("by"), "path", "position")).alias("route"))


def retrieve(found: DataFrame, question: Question, limit: int = 1, routes: DataFrame | None = None) -> DataFrame:
    """The best topics: (path, title, score, semantic, hits, block_id, rank, kept, ambiguous, route, gap).

    ``found`` is from ``topics``, ``routes`` from ``library.routes``. Only passages that own the question's objects
    count. A topic's semantic score counts only if its hits are admissible and it owns the objects or has a passage that
    does; routes, stage and role can raise a match and never make one. ``block_id`` is the best passage, ``gap`` is true
    where no kept topic has a passage that ``supports`` an answer; without any topic there is one row with ``gap``
    alone.
    """
    spark = found.sparkSession
    live = found.filter(~F.col("retired"))
    chunk = live.select("path", "lexical_title", F.explode("chunks").alias("b")).select("path", "lexical_title", "b.*")
    texts = live.select(F.concat_ws(" ", "lexical_title", "lexical_problem", "lexical_summary").alias("text"))
    texts = texts.unionByName(chunk.select(F.concat_ws(" ", "lexical_heading", "lexical_text").alias("text")))
    if routes is not None:
        texts = texts.unionByName(routes.select(folded_lexical(F.concat_ws(" ", "category", "name", "stage", "enter", "order", "stop")).alias("text")))
    weights = term_weights(texts, question)
    nothing = spark.range(1).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("title"), F.lit(True).alias("gap"))
    if not weights or not any(weights.values()):
        return nothing

    hits = lambda c: ranking.matched(F.col(c), question.terms)
    chunk = chunk.filter(question.owned(F.col("owner"), F.col("lexical_owner"), F.col("lexical_text"), F.col("text")))
    native = owns(question.roles.target_foci, F.col("lexical_owner"), F.lit(""))
    if "release" in question.roles.target_foci:
        native = native | reviews(question.roles.target, F.col("owner"), F.col("text"))
    parts = chunk.select("path", "id", "heading", native.alias("native"), hits("lexical_heading").alias("h"), hits("lexical_text").alias("t"), hits("lexical_title").alias("n"))
    parts = parts.withColumn("s", HEADING * ranking.coverage(F.col("h"), weights) + CONTENT * ranking.coverage(F.col("t"), weights))
    parts = parts.withColumn("own", supports(F.col("h"), F.col("t"), F.col("n"), F.col("native"), question, weights))
    best = parts.groupBy("path").agg(
        F.max("s").alias("chunk"), F.min_by("id", F.struct(~F.col("own"), -F.col("s"), "heading", "id")).alias("block_id"), F.bool_or("own").alias("body"),
        F.array_distinct(F.flatten(F.collect_list("t"))).alias("ct"),
    )
    owner = owns(question.roles.target_foci, F.col("lexical_owner"), F.lit(""))
    out = live.select("path", "title", "category", "stages", owner.alias("owner"), hits("lexical_title").alias("a"), hits("lexical_problem").alias("p"), hits("lexical_summary").alias("u"))
    out = out.join(best, "path", "left")
    if routes is None:
        out = out.withColumn("by", F.lit(None).cast("double")).withColumn("route", F.lit(None).cast("string"))
    else:
        out = out.join(routed(routes, question, weights).withColumnRenamed("target", "title"), "title", "left")
    cover = lambda c: ranking.coverage(F.col(c), weights)
    semantic = TITLE * cover("a") + PROBLEM * cover("p") + SUMMARY * cover("u") + CHUNK * F.coalesce("chunk", F.lit(0.0)) + ROUTE * F.coalesce("by", F.lit(0.0))
    every = F.array_distinct(F.concat("a", "p", "u", F.coalesce("ct", F.array().cast("array<string>"))))
    out = out.withColumn("hits", every)
    sound = (F.col("owner") | F.col("chunk").isNotNull()) & admissible(F.col("hits"), question, weights)
    out = out.withColumn("semantic", F.when(sound, semantic).otherwise(0.0))
    stage = T.key(question.stage)
    fits = F.exists("stages", lambda s: F.contains(text_key(s), F.lit(stage)) | F.contains(F.lit(stage), text_key(s))) if stage else F.lit(False)
    role = F.coalesce(F.col("category").isin(*question.role_categories), F.lit(False)) if question.role_categories else F.lit(False)
    bonus = F.when(fits, STAGE_BONUS).otherwise(0) + F.when(role, ROLE_BONUS).otherwise(0)
    out = out.withColumn("score", F.col("semantic") + F.when(F.col("semantic") >= BONUS_FROM, bonus).otherwise(0))
    out = ranking.ranked(out.filter(F.col("semantic") >= ranking.LEAST_SCORE), "score", ["title", "path"], min(max(limit, 1), MAX_RESULTS))
    gap = ~F.coalesce(F.bool_or(F.col("kept") & F.coalesce("body", F.lit(False))).over(W.partitionBy()), F.lit(False))
    route = F.when(F.col("by") >= STAGE_ROUTE, F.col("route")).alias("route")
    out = out.select("path", "title", "score", "semantic", "hits", "block_id", "rank", "kept", "ambiguous", route, gap.alias("gap"))
    return out.unionByName(nothing.join(out.limit(1).select(F.lit(1).alias("_x")), F.lit(True), "left_anti"), allowMissingColumns=True)


def retrieve_scoped(found: DataFrame, question: Question, scope: Column, limit: int = 1) -> DataFrame:
    """``retrieve`` within ``scope``; only if that is a gap, once more over everything."""
    first = retrieve(found.filter(scope), question, limit)
    return retrieve(found, question, limit) if first.filter("gap").count() else first


def search(notes: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Notes whose path or text has ``needle`` in any case, by path."""
    low = F.lit(needle.lower())
    hit = F.contains(F.lower("path"), low) | F.contains(F.lower("body"), low)
    return notes.filter(hit).orderBy("path").limit(limit).select("path", "title")


def links(notes: DataFrame) -> DataFrame:
    """(path, target) of the links in notes' blocks."""
    return blocks(notes).filter(~F.col("routing_only")).select("path", F.explode("links").alias("target")).distinct()


def page(text: Column, offset: int, size: int) -> Column:
    """A page of a text: (shown, line, characters, truncated, next_offset)."""
    shown = F.substring(text, offset + 1, size)
    end = F.least(F.length(text), F.lit(offset + size))
    return F.struct(
        shown.alias("shown"), F.size(F.split(F.substring(text, 1, offset), "\n")).alias("line"), F.length(text).alias("characters"),
        (F.length(text) > offset + size).alias("truncated"), F.when(F.length(text) > offset + size, end).alias("next_offset"),
    )
