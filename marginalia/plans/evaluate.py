"""Retrieval for a table of questions at once, and its evaluation against expected answers.

One plan serves all questions, where ``retrieve`` is a plan for each. Notes are turned into an inverted table of their
fields: windows of the folded texts' distinct words, as long as the questions' terms, joined with these by equality. From
it come the terms' document frequencies, for each question its candidate topics, those with terms enough to be
admissible, and what each field of them hits, so that no text is read again or moved. Candidates are counted where a
topic's rows stand together. Those that hit the same in all fields score the same, so that only the first of them by
title go on (``_first``). They are scored by ``retrieve``'s rules, with the question's terms and weights as columns; the
best of each question are cut before they are shuffled.

Grams of the questions and their profiles are broadcast while they are small (both measured), else shuffled, where
Spark splits the partitions of a frequent gram. Rows grow with matches, never with questions times notes, and what is
counted of them is neither written nor, but for the first of their kind, shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions import roles
from marginalia.functions import terms as T
from marginalia.functions.text import folded_key, folded_lexical, lexical_text, text_key
from marginalia.operators import ranking
from marginalia.plans import retrieve as R
from marginalia.plans.skew import small
from marginalia.plans.storage import materialize

#: The longest windows that the inverted table has; longer terms are verified in the text.
LONGEST = 20
#: Rows of a narrow lookup (a term, a question, a path) that may be broadcast; its bytes have the bound of all others.
NARROW_ROWS = 1_000_000
#: Terms of a question that a mask has places for, and rows of matches that one task counts.
MASK, COUNTED = 63, 2_000_000
#: The thresholds of an evaluation.
TOP1, HIT3, GAP, CHARS = 0.90, 0.95, 0.95, 4000

_PROFILE = "mode string, target string, lookup boolean, terms array<string>, generic array<string>, foci array<string>, review boolean, review_kinds array<int>"


def profiles(questions: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """``questions`` (question, text, and maybe stage, categories) with what each is about and its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                q = R.Question(text or "", rules=rules or [])
                asked = q.roles.target
                rows.append({
                    "mode": q.roles.mode, "target": asked, "lookup": q.lookup, "terms": q.terms, "generic": [t for t in q.terms if T.is_generic(t)], "foci": list(q.roles.target_foci),
                    "review": "release" in q.roles.target_foci and any(w in asked for w in roles.REVIEW), "review_kinds": [i for i, k in enumerate(roles.REVIEW_KINDS) if any(w in asked for w in k)],
                })
            strings = pa.list_(pa.string())
            kinds = {"mode": pa.string(), "target": pa.string(), "lookup": pa.bool_(), "terms": strings, "generic": strings, "foci": strings, "review": pa.bool_(), "review_kinds": pa.list_(pa.int32())}
            made = [pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns)] + made, names=[*batch.schema.names, *kinds])

    stage = F.col("stage") if "stage" in questions.columns else F.lit(None).cast("string")
    categories = F.col("categories") if "categories" in questions.columns else F.lit(None).cast("array<string>")
    slim = questions.select("question", "text", F.coalesce(stage, F.lit("")).alias("stage"), F.coalesce(categories, F.array().cast("array<string>")).alias("categories"))
    kind = dict(slim.dtypes)["question"]
    return slim.mapInArrow(run, f"question {kind}, text string, stage string, categories array<string>, {_PROFILE}")


def matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, term) for every one of ``terms`` (term; distinct, of two characters or more) that a text of ``texts``
    (row, text; lexical) contains.

    Windows have the lengths of the terms, up to LONGEST, so that equality is the verdict where the text is read. Where no
    term has white space they are of a text's words, each looked at once, those that are shorter than all terms never.
    Only what begins like a longer term is verified in the text.
    """
    book = terms.select("term", F.substring("term", 1, LONGEST).alias("gram"))
    book = materialize(book, "grams")
    lengths = book.groupBy(F.length("gram").alias("n")).agg(F.bool_or(F.rlike("term", F.lit(r"\s"))).alias("wide")).collect()  # LONGEST rows at most
    if not lengths:
        return texts.select("row", F.lit("").alias("term")).limit(0)
    widths = sorted(r.n for r in lengths)
    rows = texts
    if any(r.wide for r in lengths):
        parts = [F.regexp_extract_all("text", F.lit(f"(?=(.{{{n}}}))"), F.lit(1)) for n in widths]
    else:
        words = F.filter(F.array_distinct(F.split("text", " ")), lambda w: F.length(w) >= widths[0])
        rows = texts.select("row", F.explode(F.array(words)).alias("words"))  # they leave a generator, so that they are made once
        parts = [F.regexp_extract_all(F.array_join(F.filter("words", lambda w: F.length(w) >= n), " "), F.lit(rf"(?=(\S{{{n}}}))"), F.lit(1)) for n in widths]
    grams = rows.select("row", F.explode(F.array_distinct(F.concat(*parts))).alias("gram"))
    found = grams.join(small(book, NARROW_ROWS), "gram").select("row", "term")
    if not any(r.n == LONGEST for r in lengths):
        return found
    sure, open_ = found.filter(F.length("term") <= LONGEST), found.filter(F.length("term") > LONGEST)
    # the long ones of a row stand together, so that its text is read once for all of them
    open_ = open_.groupBy("row").agg(F.collect_set("term").alias("terms")).join(texts, "row")
    return sure.unionByName(open_.select("row", F.explode(F.filter("terms", lambda t: F.contains(F.col("text"), t))).alias("term")))


def weights(found: DataFrame, texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, weight) by ``ranking.idf``'s rule, from the matches of all texts."""
    n = texts.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    out = terms.join(found.groupBy("term").agg(F.count("*").alias("df")), "term", "left").crossJoin(F.broadcast(n))  # n is one row
    length = 1 + 0.35 * F.least(F.greatest(F.length("term") - 2, F.lit(0)), F.lit(2))
    weight = (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 0.35) * F.when(F.col("general"), 0.25).otherwise(1.0) * length
    return out.select("term", F.when(F.coalesce("df", F.lit(0)) == 0, 0.0).otherwise(weight).alias("weight"))


def _hits(found: str) -> Column:
    """The question's terms, in their order, that are among those found in a field."""
    return F.filter("terms", lambda t: F.coalesce(F.array_contains(F.col(found), t), F.lit(False)))


def _coverage(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0.0), lambda a, t: a + F.coalesce(F.col("weight")[t], F.lit(0.0))) / F.col("whole")


def _specific(hits: Column) -> Column:
    return F.filter(hits, lambda t: ~F.exists(hits, lambda o: (o != t) & F.contains(o, t)) & ~F.array_contains("generic", t))


def _admissible(hits: Column) -> Column:
    own = _specific(hits)
    one = (F.col("known") < 2) & F.exists(own, lambda t: F.length(t) >= 4)
    return (F.size(own) >= 2) | one | ((F.size(own) >= 1) & F.col("lookup"))


def _held(owner: Column, body: Column) -> Column:
    """The objects that a passage owns, by ``roles.owns``'s rule for each."""
    held = [F.when(F.coalesce(roles.owns((o,), owner, body), F.lit(False)), F.lit(o)) for o in roles.OWNED]
    return F.filter(F.array(*held), lambda o: o.isNotNull())


def _owned(held: str) -> Column:
    """``roles.owns`` for the objects of the question's own row."""
    return (F.size("foci") == 0) | F.coalesce(F.arrays_overlap("foci", held), F.lit(False))


def _reviewed(owner: Column, body: Column) -> Column:
    """The kinds of words by which a passage may review decisions (``roles.reviews``), null if it isn't about those."""
    some = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    foreign = F.lit(False)
    for o in set(roles.NAMES) - {"release"}:
        seen = F.regexp_replace(owner, roles.REACH, "") if o == "color" else owner
        foreign = foreign | some(lexical_text(seen), roles.NAMED[o])
    kinds = F.filter(F.array(*[F.when(some(body, k), F.lit(i)) for i, k in enumerate(roles.REVIEW_KINDS)]), lambda i: i.isNotNull())
    return F.when(some(owner, roles.REVIEWER) & ~foreign, kinds)


def _routed(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes as texts (row, text), and those rows with what is needed to weigh them later."""
    text = folded_lexical(F.concat_ws(" ", "category", "name", "stage", "enter", "order", "stop"))
    rows = routes.select("path", "position", "name", "targets", folded_key(F.col("stage")).alias("_stage"), text.alias("text"))
    rows = materialize(rows.withColumn("row", F.concat(F.lit("r"), F.monotonically_increasing_id())), "routes")
    return rows.select("row", "text"), rows


def retrieve_many(found: DataFrame, questions: DataFrame, limit: int = 3, routes: DataFrame | None = None, rules: list[dict] | None = None) -> DataFrame:
    """(question, rank, path, title, score, semantic, hits, block_id, kept, ambiguous, route, gap): what ``retrieve`` gives
    for each of ``questions`` (question, text, and maybe stage and categories; one row a question).

    ``found`` is from ``retrieve.topics``, ``routes`` from ``library.routes``. A question without any topic has one
    row with ``gap`` alone. A null text asks nothing and is a gap.
    """
    asked = materialize(profiles(questions, rules), "asked")
    terms = asked.select(F.explode("terms").alias("term"), "generic").select("term", F.array_contains("generic", F.col("term")).alias("general"))
    terms = materialize(terms.groupBy("term").agg(F.bool_or("general").alias("general")), "terms")
    live = found.filter(~F.col("retired"))
    body = live.select("path", "title", F.posexplode("chunks").alias("k", "b"))
    field = lambda name, text: F.struct(F.lit(name).alias("field"), F.col(text).alias("text"))
    head = live.select("path", "title", F.lit(-1).alias("k"), F.explode(F.array(field("a", "lexical_title"), field("p", "lexical_problem"), field("u", "lexical_summary"))).alias("f"))
    parts = head.unionByName(body.select("path", "title", "k", F.explode(F.array(field("h", "b.lexical_heading"), field("t", "b.lexical_text"))).alias("f")))
    texts = parts.select(F.struct("path", "title", "k", "f.field").alias("row"), "f.text")
    every = live.select("path").unionByName(body.select("path"))
    if routes is not None:
        route_texts, route_rows = _routed(routes)
        texts = texts.unionByName(route_texts.select(F.struct(F.col("row").alias("path"), F.lit(None).cast("string").alias("title"), F.lit(-2).alias("k"), F.lit("r").alias("field")).alias("row"), "text"))
        every = every.unionByName(route_texts.select("row"), allowMissingColumns=True)
    hit = materialize(matches(texts, terms.select("term")).select("row.*", "term"), "matches")
    weighed = materialize(weights(hit.select("path", "k", "term").distinct(), every, terms), "weights")

    # profiles with their weights: as wide as a question has terms
    w = asked.select("question", F.explode("terms").alias("term")).join(small(weighed, NARROW_ROWS), "term")
    w = w.groupBy("question").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weight"), F.sum("weight").alias("_sum"))
    asked = asked.join(w, "question").filter("_sum > 0").withColumn("whole", F.col("_sum")).drop("_sum")
    living = F.filter("terms", lambda t: F.col("weight")[t] > 0)
    asked = materialize(asked.withColumn("known", F.size(_specific(living))), "asked")

    limit = min(max(limit, 1), R.MAX_RESULTS)
    pairs = materialize(_first(hit.filter("field != 'r'"), asked, limit, routes is not None), "candidates")
    near = small(pairs, NARROW_ROWS)
    met = near.join(hit.filter("field != 'r'").drop("title"), "path").join(small(materialize(asked.select("question", F.explode("terms").alias("term")), "asked_terms"), NARROW_ROWS), ["question", "term"])
    met = met.groupBy("question", "path", "k").agg(*[F.collect_set(F.when(F.col("field") == f, F.col("term"))).alias(f"_{f}") for f in "apuht"])
    met = materialize(met, "met")
    asked = small(asked)

    owner = F.struct(_held(F.col("lexical_owner"), F.lit("")).alias("natural"))
    heads = near.join(live.select("path", "title", "category", "stages", "lexical_owner").withColumn("o", owner).drop("lexical_owner"), "path")
    rows = heads.join(met.filter("k = -1").select("question", "path", "_a", "_p", "_u"), ["question", "path"], "left").join(asked, "question")

    # texts are only asked what they own where a question names an object
    flags = {"natural": _held(F.col("b.lexical_owner"), F.lit("")), "held": _held(F.col("b.lexical_owner"), F.col("b.lexical_text")), "reviewed": _reviewed(F.col("b.owner"), F.col("b.text"))}
    if asked.filter(F.size("foci") > 0).isEmpty():
        flags = {"natural": F.lit(None).cast("array<string>"), "held": F.lit(None).cast("array<string>"), "reviewed": F.lit(None).cast("array<int>")}
    about = body.select("path", "k", "b.id", "b.heading", *[c.alias(name) for name, c in flags.items()])
    chunk = near.join(about, "path").join(met.filter("k >= 0").select("question", "path", "k", "_h", "_t"), ["question", "path", "k"], "left")
    chunk = chunk.join(met.filter("k = -1").select("question", "path", "_a"), ["question", "path"], "left").join(asked, "question")
    reviews = F.col("review") & F.coalesce(F.size(F.array_intersect("review_kinds", "reviewed")) >= 2, F.lit(False))
    chunk = chunk.filter(_owned("held") | reviews).withColumn("native", _owned("natural") | reviews)
    chunk = chunk.withColumn("h", _hits("_h")).withColumn("t", _hits("_t")).withColumn("n", _hits("_a"))
    own = _specific(F.col("t"))
    some, long = F.size(own) > 0, F.exists(own, lambda t: F.length(t) >= 4)
    ok = _admissible(F.col("t")) | (some & _admissible(F.array_union("t", "n"))) | ((F.col("known") < 2) & some & _admissible(F.array_union("h", "t")))
    ok = F.when(F.size("foci") > 0, (ok | (F.col("native") & long)) & (F.col("native") | long | (F.size(own) >= 3))).otherwise(ok)
    part = R.HEADING * _coverage(F.col("h")) + R.CONTENT * _coverage(F.col("t"))
    chunk = chunk.select("question", "path", "id", "heading", "t", part.alias("s"), ok.alias("own"))
    best = chunk.groupBy("question", "path").agg(
        F.max("s").alias("chunk"), F.min_by("id", F.struct(~F.col("own"), -F.col("s"), "heading", "id")).alias("block_id"), F.bool_or("own").alias("body"),
        F.array_distinct(F.flatten(F.collect_list("t"))).alias("ct"),
    )

    out = rows.withColumn("a", _hits("_a")).withColumn("p", _hits("_p")).withColumn("u", _hits("_u"))
    out = out.join(best, ["question", "path"], "left")
    if routes is None:
        out = out.withColumn("by", F.lit(None).cast("double")).withColumn("route", F.lit(None).cast("string"))
    else:
        out = out.join(_by_route(hit, route_rows, asked), ["question", "title"], "left")
    semantic = R.TITLE * _coverage(F.col("a")) + R.PROBLEM * _coverage(F.col("p")) + R.SUMMARY * _coverage(F.col("u")) + R.CHUNK * F.coalesce("chunk", F.lit(0.0)) + R.ROUTE * F.coalesce("by", F.lit(0.0))
    out = out.withColumn("hits", F.array_distinct(F.concat("a", "p", "u", F.coalesce("ct", F.array().cast("array<string>")))))
    sound = (_owned("o.natural") | F.col("chunk").isNotNull()) & _admissible(F.col("hits"))
    out = out.withColumn("semantic", F.when(sound, semantic).otherwise(0.0)).filter(F.col("semantic") >= ranking.LEAST_SCORE)
    stage = F.regexp_replace(F.lower("stage"), T.NOT_KEY.pattern, "")
    fits = (stage != "") & F.exists("stages", lambda s: F.contains(text_key(s), stage) | F.contains(stage, text_key(s)))
    bonus = F.when(F.coalesce(fits, F.lit(False)), R.STAGE_BONUS).otherwise(0) + F.when(F.array_contains("categories", F.col("category")), R.ROLE_BONUS).otherwise(0)
    out = out.withColumn("score", F.col("semantic") + F.when(F.col("semantic") >= R.BONUS_FROM, bonus).otherwise(0))
    return _ranked(out, questions, limit)


def _first(hit: DataFrame, asked: DataFrame, limit: int, routed: bool) -> DataFrame:
    """(question, path) of the topics that can be among the ``limit`` best of a question.

    They hit two terms that aren't general, or one where one may do. Of a question without objects, stage and categories
    the terms that the fields hit decide the score: they are masks, one place a term, and of the topics that are alike in
    all masks the first by title and path are the best. All topics are kept where more decides: routes, hits in several
    passages, a question with more terms than a mask has places.
    """
    free = (F.size("foci") == 0) & (F.col("stage") == "") & (F.size("categories") == 0) & (F.size("terms") <= MASK) & F.lit(not routed)
    slots = asked.select("question", "generic", ((F.col("known") < 2) | F.col("lookup")).alias("one"), free.alias("free"), F.posexplode("terms").alias("slot", "term"))
    own = F.when(~F.array_contains("generic", F.col("term")), F.col("slot")).alias("own")
    slots = materialize(slots.select("question", "term", "one", "free", own, F.expr("shiftleft(1L, slot)").alias("bit")), "slots")
    # as many rows as a task can count, whatever the most frequent terms and the questions that share them
    rows = hit.groupBy("term").agg(F.count("*").alias("n")).join(slots.groupBy("term").agg(F.count("*").alias("q")), "term").agg(F.sum(F.col("n") * F.col("q")).alias("rows")).first().rows
    tasks = (rows or 0) // COUNTED + 1
    hit = hit.repartition(tasks, "path") if tasks > int(hit.sparkSession.conf.get("spark.sql.shuffle.partitions")) else hit.repartition("path")
    masks = [F.coalesce(F.bit_or(F.when(F.col("field") == f, F.col("bit"))), F.lit(0)).alias(f"_{f}") for f in "apuht"]
    passage = F.when(F.col("k") >= 0, F.col("k"))
    near = hit.join(small(slots, NARROW_ROWS), "term").groupBy("path", "title", "question", "one", "free")
    near = near.agg(F.min("own").alias("lo"), F.max("own").alias("hi"), (F.min(passage) < F.max(passage)).alias("several"), *masks)
    near = near.filter("lo is not null and (one or lo < hi)")
    alike = F.when(~F.col("free") | F.coalesce("several", F.lit(False)), F.col("path")).alias("apart")
    near = near.select("question", "path", "title", *[f"_{f}" for f in "apuht"], alike)
    place = F.row_number().over(W.partitionBy("question", *[f"_{f}" for f in "apuht"], "apart").orderBy("title", "path"))
    return near.withColumn("place", place).filter(F.col("place") <= limit).select("question", "path")


def _by_route(hit: DataFrame, routes: DataFrame, asked: DataFrame) -> DataFrame:
    """(question, title, by, route): for each title the route that covers a question best."""
    terms = asked.select("question", F.explode("terms").alias("term"), "weight", "whole", "stage")
    seen = hit.filter("field = 'r'").select(F.col("path").alias("row"), "term").join(terms, "term")
    seen = seen.groupBy("row", "question").agg((F.sum(F.col("weight")[F.col("term")]) / F.first("whole")).alias("by"), F.first("stage").alias("stage"))
    seen = seen.join(routes, "row")
    stage = F.regexp_replace(F.lower("stage"), T.NOT_KEY.pattern, "")
    seen = seen.withColumn("by", F.col("by") + F.when((stage != "") & (F.col("_stage") == stage), R.STAGE_ROUTE).otherwise(0.0))
    seen = seen.select("question", F.explode("targets").alias("title"), "by", "name", "path", "position")
    return seen.groupBy("question", "title").agg(F.max("by").alias("by"), F.min_by("name", F.struct(-F.col("by"), "path", "position")).alias("route"))


def _ranked(out: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """The best rows of each question with rank, floors and the gap verdict; ranks are cut before the shuffle."""
    first = W.partitionBy("question").orderBy(F.col("score").desc(), "title", "path")
    whole = W.partitionBy("question")
    route = F.when(F.col("by") >= R.STAGE_ROUTE, F.col("route")).alias("route")
    out = out.select("question", "path", "title", "score", "semantic", "hits", "block_id", "body", route).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)
    out = out.withColumn("top", F.max("score").over(whole)).withColumn("second", F.max(F.when(F.col("rank") == 2, F.col("score"))).over(whole))
    out = out.withColumn("kept", F.col("score") >= F.greatest(F.lit(ranking.LEAST_SCORE), ranking.RELATIVE_FLOOR * F.col("top")))
    out = out.withColumn("ambiguous", F.coalesce(F.col("second") >= ranking.AMBIGUOUS * F.col("top"), F.lit(False)))
    out = out.withColumn("gap", ~F.bool_or(F.col("kept") & F.coalesce("body", F.lit(False))).over(whole)).drop("top", "second", "body")
    out = questions.select("question").join(out, "question", "left").withColumn("gap", F.coalesce("gap", F.lit(True)))
    return out.select("question", "rank", "path", "title", "score", "semantic", "hits", "block_id", "kept", "ambiguous", "route", "gap")


def verdicts(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """(question, titles, gap, expect_gap, top1_ok, hit3_ok, gap_ok, forbidden_ok, passed) of answers from
    ``retrieve_many`` for ``cases`` (question, expected_top1, expected_any, forbidden, expect_gap).

    Null lists are empty, but ``expected_any`` is ``expected_top1`` where it is null. A case that expects a gap is right
    on titles whatever they are.
    """
    none = F.array().cast("array<string>")
    ranked = F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "title")))
    told = answers.groupBy("question").agg(F.bool_and("gap").alias("gap"), F.transform(F.array_sort(ranked), lambda x: x["title"]).alias("titles"))
    out = cases.join(told, "question", "left")
    out = out.withColumn("titles", F.coalesce("titles", none)).withColumn("gap", F.coalesce("gap", F.lit(True))).withColumn("expect_gap", F.coalesce("expect_gap", F.lit(False)))
    first = F.coalesce("expected_top1", none)
    top1 = F.col("expect_gap") | F.coalesce(F.array_contains(first, F.try_element_at("titles", F.lit(1))), F.lit(False))
    hit3 = F.col("expect_gap") | F.arrays_overlap(F.coalesce("expected_any", first), F.col("titles"))
    free = ~F.arrays_overlap(F.coalesce("forbidden", none), F.col("titles"))
    out = out.select("question", "titles", "gap", "expect_gap", top1.alias("top1_ok"), F.coalesce(hit3, F.lit(False)).alias("hit3_ok"), (F.col("gap") == F.col("expect_gap")).alias("gap_ok"), F.coalesce(free, F.lit(True)).alias("forbidden_ok"))
    return out.withColumn("passed", F.col("top1_ok") & F.col("hit3_ok") & F.col("gap_ok") & F.col("forbidden_ok"))


def summary(judged: DataFrame) -> DataFrame:
    """One row: cases, supported, negatives, the three rates (1 without cases of their kind), failures and the verdict."""
    def rate(right: str, of: Column) -> Column:
        return F.coalesce(F.count_if(F.col(right) & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(1.0))

    asks, denies = ~F.col("expect_gap"), F.col("expect_gap")
    out = judged.agg(
        F.count("*").alias("cases"), F.count_if(asks).alias("supported"), F.count_if(denies).alias("negatives"), rate("top1_ok", asks).alias("top1"), rate("hit3_ok", asks).alias("hit3"),
        rate("gap_ok", denies).alias("gap"), F.count_if(~F.col("passed")).alias("failures"),
    )
    return out.withColumn("accepted", (F.col("top1") >= TOP1) & (F.col("hit3") >= HIT3) & (F.col("gap") >= GAP) & (F.col("failures") == 0))
