"""Review packs for several facets, and follow-ups between two states of a library.

A pack ranks blocks for each facet, picks primaries with their supporting sources and boundaries, and alternatives, and
keeps texts within a budget of characters; what is cut keeps its locator. A follow-up compares a library with its checkpoint: what changed, what depends on it,
which links break or go one way, and which notes are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions.text import folded_lexical, link_key
from marginalia.operators import diff, graph, ranking
from marginalia.plans import budget
from marginalia.plans.retrieve import RETIRED, Question, admissible, term_weights
from marginalia.plans.skew import small
from marginalia.plans.storage import materialize
from marginalia.sources.notes import blocks, prop

#: Blocks that score less go, the share of the best that a second primary needs, facets and budget.
LEAST_BLOCK, SECOND, FACETS, BUDGET = 0.025, 0.70, 8, 9000
#: Kinds of blocks by words in their headings, and what each kind multiplies a score by.
KINDS = (("navigation", "相关知识|入口|导览", 0.25), ("boundary", "边界|反例|不适用|误区|风险", 0.45), ("case", "案例", 0.65), ("overview", "概览|总览|结构", 0.65))
#: The heading of a note's general boundaries, the field that names sources, types of notes that are sources.
GENERAL, SOURCES, SOURCE_NOTES = "适用边界", "来源材料", ("材料总览", "分集笔记", "来源笔记", "来源地图")
#: Characters that the locator of an excerpt left out takes: a mode, an id and a snapshot.
CONTINUATION = 160
#: Fields that declare what a note depends on.
DEPENDS_ON = ("来源材料", "派生自", "调用知识")


def kind_of(heading: Column) -> Column:
    out = F.lit("method")
    for kind, words, _ in reversed(KINDS):
        out = F.when(heading.rlike(words), kind).otherwise(out)
    return out


def passages(notes: DataFrame) -> DataFrame:
    """(id, path, heading, text, line_start, body, above, owner, lexical_owner) of the blocks that may answer, folded once for
    all questions and written."""
    live = notes.filter(~F.coalesce(prop("状态").isin(*RETIRED), F.lit(False)))
    rows = blocks(live).filter(~F.col("routing_only"))
    body = folded_lexical(F.regexp_replace(F.concat_ws(" ", "heading", "text"), r"\[\[[^\]]*\]\]", " "))
    owner = F.concat_ws(" ", F.element_at(F.split("title", "｜"), -1), "heading")
    above = folded_lexical(F.concat_ws(" ", "title", F.array_join("parents", " ")))
    rows = rows.select("id", "path", "heading", "text", "line_start", body.alias("body"), above.alias("above"), owner.alias("owner"), folded_lexical(owner).alias("lexical_owner"))
    return materialize(rows, "passages")


def candidates(rows: DataFrame, question: Question) -> DataFrame:
    """(id, path, heading, text, line_start, kind, score, own) of ``passages`` that score LEAST_BLOCK before their kind is
    weighed."""
    rows = rows.filter(question.owned(F.col("owner"), F.col("lexical_owner"), F.col("body"), F.col("text"))).drop("owner", "lexical_owner")
    weights = term_weights(rows.select(F.col("body").alias("text")), question)
    if not any(weights.values()):
        return rows.limit(0).select("id", "path", "heading", "text", "line_start", F.lit("").alias("kind"), F.lit(0.0).alias("score"), F.lit(False).alias("own"))
    # the terms hit leave a generator, so that the filter below reads them and doesn't look for them again at each mention
    met = F.struct(ranking.matched(F.col("body"), question.terms).alias("hits"), ranking.matched(F.col("above"), question.terms).alias("far"))
    rows = rows.select("*", F.explode(F.array(met)).alias("met")).select("*", "met.*").drop("met")
    score = ranking.block_score(ranking.coverage(F.col("hits"), weights), ranking.coverage(F.array_except("far", "hits"), weights), F.length("text"))
    rows = rows.withColumn("base", score).withColumn("own", admissible(F.col("hits"), question, weights)).filter((F.col("base") >= LEAST_BLOCK) & F.col("own"))
    factor = F.lit(1.0)
    for kind, _, by in KINDS:
        factor = F.when(F.col("kind") == kind, by).otherwise(factor)
    rows = rows.withColumn("kind", kind_of(F.col("heading"))).withColumn("score", F.col("base") * factor)
    return rows.select("id", "path", "heading", "text", "line_start", "kind", "score", "own")


def pack(notes: DataFrame, questions: list[str], most: int = BUDGET, limit: int = 12) -> DataFrame:
    """(facet, role, rank, id, of, path, heading, kind, score, excerpt, read_required); a facet without rows is a gap.

    The first block that answers is primary, a second one too if it scores SECOND of it, and the next two are
    alternatives, among the ``limit`` best. For each primary (``of``) there is at most one supporting block, the best
    among the notes that its own note names as sources, never of that note itself; and of its note's boundaries the first
    general one and the best specific one, or the two best specific ones where there is no general one. A specific one
    must answer, the general one needn't have a word of the question.

    Alternatives are locators. The other excerpts are left out, the longest first, until the pack fits ``most``
    characters of JSON (``plans.budget``); what is left out keeps its locator.
    """
    if not 0 < len(questions) <= FACETS:
        raise ValueError(f"1 to {FACETS} questions")
    read = passages(notes)
    rows = None
    for i, q in enumerate(questions):
        found = candidates(read, Question(q)).withColumn("facet", F.lit(i))
        rows = found if rows is None else rows.unionByName(found)
    rows = materialize(rows, "candidates")
    best = [F.col("score").desc(), "path", "line_start"]
    out = rows.filter("kind != 'boundary'").withColumn("rank", F.row_number().over(W.partitionBy("facet").orderBy(*best))).filter(F.col("rank") <= min(limit, 4))
    out = out.withColumn("top", F.max("score").over(W.partitionBy("facet")))
    role = F.when((F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("score") >= SECOND * F.col("top"))), "primary").otherwise("alternative")
    chosen = ["facet", "role", "rank", "id", "of", "path", "heading", "kind", "score", "text"]
    out = out.withColumn("role", role).withColumn("of", F.when(role == "primary", F.col("id")))
    out = materialize(out.select(*chosen), "chosen")  # four rows a facet at most
    mine = F.broadcast(out.filter("role = 'primary'").select(F.col("facet").alias("_facet"), "of", F.col("path").alias("_path")))
    out = out.unionByName(_supporting(notes, rows, mine).select(*chosen)).unionByName(_boundaries(notes, rows, mine).select(*chosen))
    return _fitted(materialize(out, "pack"), most)


def _supporting(notes: DataFrame, rows: DataFrame, mine: DataFrame) -> DataFrame:
    """For each primary the best candidate of its facet in the notes that its note names as sources: two hops, topic to
    link and link to source."""
    sources = dependencies(notes, mine.select(F.col("_path").alias("path"))).filter(F.col("field") == SOURCES).select("dependent", "dependency")
    near = materialize(sources.join(mine, F.col("dependent") == F.col("_path")).filter("dependency != dependent").select("_facet", "of", "dependency").distinct(), "sources")
    out = rows.join(small(near), (F.col("facet") == F.col("_facet")) & (F.col("path") == F.col("dependency")))
    first = W.partitionBy("facet", "of").orderBy(F.col("score").desc(), "path", "line_start")
    return out.withColumn("rank", F.row_number().over(first)).filter("rank = 1").withColumn("role", F.lit("support"))


def _boundaries(notes: DataFrame, rows: DataFrame, mine: DataFrame) -> DataFrame:
    """For each primary its note's first general boundary and best specific one, or two specific ones."""
    own = blocks(notes).filter(~F.col("routing_only") & (F.col("heading") == GENERAL)).join(mine, F.col("path") == F.col("_path"))
    own = own.groupBy(F.col("_facet").alias("facet"), "of").agg(F.min_by(F.struct("id", "path", "heading", "text"), "line_start").alias("b"))
    own = own.select("facet", "of", "b.*").withColumn("rank", F.lit(1)).withColumn("kind", F.lit("boundary")).withColumn("score", F.lit(None).cast("double"))
    own = materialize(own, "general")
    some = rows.filter((F.col("kind") == "boundary") & (F.col("heading") != GENERAL)).join(mine, (F.col("facet") == F.col("_facet")) & (F.col("path") == F.col("_path")))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("facet", "of").orderBy(F.col("score").desc(), "line_start"))).filter("rank <= 2")
    has = F.broadcast(own.select(F.col("facet").alias("_f"), F.col("of").alias("_of")))  # a row a primary at most
    some = some.join(has, (F.col("facet") == F.col("_f")) & (F.col("of") == F.col("_of")), "left").filter(F.col("_of").isNull() | (F.col("rank") == 1))
    some = some.withColumn("rank", F.col("rank") + F.when(F.col("_of").isNull(), 0).otherwise(1))
    columns = ["facet", "rank", "id", "of", "path", "heading", "kind", "score", "text"]
    return own.select(*columns).unionByName(some.select(*columns)).withColumn("role", F.lit("boundary"))


def _fitted(out: DataFrame, most: int) -> DataFrame:
    """The rows of a pack with excerpts as far as ``most`` characters of JSON go; a few rows for each facet."""
    turn = F.when(F.col("role") == "primary", 0).when(F.col("role") == "support", 1).when(F.col("role") == "boundary", 2).otherwise(3)
    out = out.withColumn("place", F.row_number().over(W.orderBy(turn, "facet", "of", "rank", "id"))).withColumn("pack", F.lit(0))
    fields = ["facet", "role", "rank", "id", "of", "path", "heading", "kind", "score"]
    full = F.length(F.to_json(F.struct(*fields, F.col("text").alias("excerpt"))))
    short = F.length(F.to_json(F.struct(*fields, F.lit("").alias("excerpt"), F.lit(True).alias("read_required")))) + CONTINUATION
    shown = F.col("role") != "alternative"
    out = out.withColumn("size", F.when(shown, full).otherwise(short).cast("long")).withColumn("gain", (full - short).cast("long"))
    out = materialize(out.withColumn("len", F.when(shown, F.length("text")).otherwise(0).cast("long")), "sized")
    over = materialize(budget.excess(out.groupBy("pack").agg(F.sum("size").alias("size")), ["pack"], "size", most), "over")
    out = budget.deferred(out, over, ["pack"], "place", "len", "gain").withColumn("read_required", F.col("deferred") | (F.col("role") == "alternative"))
    return out.select(*fields, F.when(~F.col("read_required"), F.col("text")).alias("excerpt"), "read_required").orderBy("place")


def pack_counts(notes: DataFrame, packed: DataFrame, questions: list[str]) -> DataFrame:
    """(facet, status, primaries, supporting, boundaries, alternatives, source_gap) of each question of a pack: gap or
    needs_review, and whether neither a supporting block nor a primary is of a source."""
    spark = packed.sparkSession
    every = spark.createDataFrame([(i,) for i in range(len(questions))], "facet int")
    kinds = notes.select(F.col("path").alias("_path"), prop("类型").isin(*SOURCE_NOTES).alias("source"))
    got = packed.join(kinds, F.col("path") == F.col("_path"), "left")
    n = lambda role: F.count_if(F.col("role") == role)
    sound = F.bool_or((F.col("role") == "support") | ((F.col("role") == "primary") & F.coalesce("source", F.lit(False))))
    got = got.groupBy(F.col("facet").alias("_facet")).agg(n("primary").alias("primaries"), n("support").alias("supporting"), n("boundary").alias("boundaries"), n("alternative").alias("alternatives"), sound.alias("sound"))
    out = every.join(got, F.col("facet") == F.col("_facet"), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("primaries", "supporting", "boundaries", "alternatives")]
    status = F.when(F.coalesce("primaries", F.lit(0)) > 0, "needs_review").otherwise("gap")
    return out.select("facet", status.alias("status"), *zero, (~F.coalesce("sound", F.lit(False))).alias("source_gap"))


def dependencies(notes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(dependent, dependency, field) of declared links that name another note by path or by a title of its own; of the notes
    ``of`` (path) alone, if given."""
    stem = F.element_at(F.split("key", "/"), -1)
    rows = None
    own = notes if of is None else notes.join(of, "path", "left_semi")
    for f in DEPENDS_ON:
        part = own.select("path", F.explode(F.coalesce(F.col("props")[f], F.array().cast("array<string>"))).alias("v")).withColumn("field", F.lit(f))
        rows = part if rows is None else rows.unionByName(part)
    found = rows.select("path", "field", link_key(F.regexp_extract("v", r"\[\[([^\]|]+)", 1)).alias("key")).filter(F.col("key").isNotNull())
    found = found.select(F.struct("path", "field").alias("link_id"), F.col("key").alias("full"), F.lit(None).cast("string").alias("partial"), stem.alias("stem"))
    targets = notes.select(F.col("path").alias("target_id"), link_key(F.col("path")).alias("key"))
    targets = targets.select("target_id", F.col("key").alias("full"), F.lit(None).cast("string").alias("partial"), stem.alias("stem"))
    hit = graph.resolve_links(found, targets).filter(F.col("target_id").isNotNull())
    return hit.select(F.col("link_id.path").alias("dependent"), F.col("target_id").alias("dependency"), F.col("link_id.field").alias("field")).distinct()


def effects(notes: DataFrame, before: DataFrame, edges: DataFrame | None = None, pending: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, impact) of ``followup``, from the paths, hashes and properties of notes alone."""
    changes = diff.snapshot_diff(before, notes, "path", "doc_hash")
    retired = notes.filter(F.coalesce(prop("状态").isin(*RETIRED), F.lit(False))).select(F.col("path").alias("node"))
    seeds = changes.filter(F.col("kind").isin("modified", "removed")).select(F.col("path").alias("node")).unionByName(retired)
    now = dependencies(notes).select("dependent", "dependency")
    now = now if edges is None else now.unionByName(edges.select("dependent", "dependency"))
    impact = graph.impact(seeds, now).filter("depth > 0").join(notes.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    impact = impact.select("trigger", "target", "depth", "chain")
    if pending is not None:
        impact = impact.unionByName(pending.select(*impact.columns).join(impact, ["trigger", "target"], "left_anti"))
    return changes, impact


def followup(notes: DataFrame, before: DataFrame, edges: DataFrame | None = None, pending: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, impact, issues) of notes against a checkpoint: (path, doc_hash) of its notes, the ``edges`` that
    ``dependencies`` gave then, and the ``pending`` rows of impact that were not settled.

    Impact starts at notes that were modified, removed or retired, over the dependencies declared now or then, and
    names notes that are there; pending rows are carried over. Without ``edges`` nothing is known to have depended
    on a removed note. Issues are broken links, notes of equal text, and titles that repeat.
    """
    changes, impact = effects(notes, before, edges, pending)
    target = link_key(F.col("target"))
    links = blocks(notes).select("path", F.explode("links").alias("target")).select("path", "target", F.element_at(F.split(target, "/"), -1).alias("stem"))
    stems = notes.select(F.element_at(F.split(link_key(F.col("path")), "/"), -1).alias("stem")).distinct()
    broken = links.filter(F.col("stem").isNotNull()).join(stems, "stem", "left_anti").select(F.lit("broken_link").alias("kind"), "path", F.col("target").alias("value")).distinct()
    same = notes.groupBy(F.sha2("body", 256).alias("value")).agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n > 1")
    titles = notes.groupBy(F.col("title").alias("value")).agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n > 1")
    issues = broken.unionByName(same.select(F.lit("exact_duplicate").alias("kind"), "path", "value"))
    return changes, impact, issues.unionByName(titles.select(F.lit("duplicate_title").alias("kind"), "path", "value"))
