"""Bounds of what Python workers hold, and columns that are made once."""

import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions.terms import lexical
from marginalia.queries import QUERIES
from marginalia.sources.notes import parse_note


def test_texts_are_folded_in_pieces_and_only_beyond_ascii(spark):
    """F9"""
    assert list(X.pieces(pa.array(["a" * 900, "b" * 900, None, "c" * 5000, ""]), 2000)) == [(0, 3), (3, 4), (4, 5)]
    assert list(X.pieces(pa.array([], pa.string()))) == [(0, 0)]
    texts = ["Straße ﬁn", "PLAIN a-B", "", None, "一鿿䷿ꀀ Ⅷ 𝔄b𐐀", "ǅ İ"] * 40
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", X.folded(F.col("t")).alias("f"), X.folded_lexical(F.col("t")).alias("l")).collect()
    assert [(r.f, r.l) for r in got] == [(t if t is None else unicodedata.normalize("NFKC", t).casefold(), t if t is None else lexical(t)) for t in texts]


@pytest.mark.parametrize("name, most", [("notes_topics_of", 1), ("notes_audit", 1)])
def test_notes_are_parsed_once(spark, name, most):
    """a filter on a field of the note doesn't parse it a second time."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= most


def test_a_parser_makes_the_fields_that_are_asked_for(spark):
    """F4, F6"""
    rows = spark.createDataFrame([("a.md", "h", "---\n类型: x\n---\n# T\n## 知识单元\nbody"), ("b.md", "h", None)], "path string, h string, t string")
    whole = rows.select(parse_note("path", "h", "t").alias("n")).collect()
    part = rows.select(parse_note("path", "h", "t", ("props", "title")).alias("n"))
    assert part.schema["n"].dataType.names == ["props", "title"]
    assert [r.n and (r.n.props, r.n.title) for r in part.collect()] == [r.n and (r.n.props, r.n.title) for r in whole] == [({"类型": ["x"]}, "T"), None]


def test_terms_are_found_where_texts_are_read(spark):
    """no rows of texts that merely begin like a term are shuffled."""
    from marginalia.plans.evaluate import matches

    texts = spark.createDataFrame([("r", "thernderinan then other"), ("s", "thern derinan")], "row string, text string")
    got = matches(texts, spark.createDataFrame([("thernderinan",), ("nderin",), ("zz",)], "term string"))
    assert sorted(map(tuple, got.collect())) == [("r", "nderin"), ("r", "thernderinan")]
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_both_ways_of_a_pair_are_one_group(spark):
    """F12"""
    from marginalia.operators.graph import reciprocal

    rows = [(1, 2), (2, 1), (2, 1), (3, 3), (4, 5), (7, 6), (None, 1), (1, None), (None, 1)]
    got = reciprocal(spark.createDataFrame(rows, "a long, b long"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 2, True), (2, 1, True), (3, 3, True), (4, 5, False), (7, 6, False), (None, 1, False), (1, None, False)]))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_the_pipeline_drops_what_fingerprints_link(spark):
    """every component of op9's method keeps one document at most."""
    import corpus_pipeline
    from marginalia.llm import simhash_variants

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    roots = {r.doc_id: r.component_id for r in simhash_variants.components(docs).collect()}
    kept = [roots[r.doc_id] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) and len(kept) > 0


def _topics(spark, texts):
    from marginalia.plans import retrieve as R

    rows = [(f"n{i:03}.md", "h", f"---\n类型: 主题笔记\n---\n# t{i:03}\n## 知识单元\n{x}\n") for i, x in enumerate(texts)]
    return R.topics(spark.createDataFrame(rows, "path string, h string, t string").withColumn("n", parse_note("path", "h", "t", ("props", "title", "parts", "chunks"))).select("path", "n.*"))


def test_of_topics_that_hit_the_same_the_first_are_candidates(spark, monkeypatch):
    """candidates don't grow with questions times topics, and the answers are what each question gets alone."""
    from marginalia.plans import evaluate as E
    from marginalia.plans import retrieve as R

    found = _topics(spark, ["stupidly licensing"] * 40 + ["licensing thoughtful"] * 40 + ["stupidly licensing thoughtful", "thoughtful"] + ["### a\nstupidly\n### b\nthoughtful"] * 2)
    asked = {1: "stupidly licensing thoughtful", 2: "licensing thoughtful", 3: "thoughtful"}
    made, write = {}, E.materialize
    monkeypatch.setattr(E, "materialize", lambda df, name: made.__setitem__(name, write(df, name)) or made[name])
    got = E.retrieve_many(found, spark.createDataFrame(list(asked.items()), "question int, text string"), 3).collect()
    assert made["candidates"].count() <= 3 * 9  # 168 without the cut
    for q, text in asked.items():
        alone = {(r.rank, r.title, r.kept, r.block_id, round(r.score, 9)) for r in R.retrieve(found, R.Question(text), 3).collect()}
        assert {(r.rank, r.title, r.kept, r.block_id, round(r.score, 9)) for r in got if r.question == q} == alone


def test_cases_are_judged_by_the_documents_that_answers_name(spark):
    """what holds all words of a question is looked for among its answers, not among all documents."""
    from marginalia import queries as Q

    sf = "/root/testdata/sf0.001"
    cases = spark.createDataFrame([(0, ["license"], False), (1, None, True), (2, ["qqqqqqq"], False)], "question long, ws array<string>, expect_gap boolean")
    holds = [str(r.doc_id) for r in Q.table(spark, sf, "documents").filter(F.contains(F.lower("text"), F.lit("license"))).collect()]
    answers = spark.createDataFrame([(0, holds[0]), (0, "nothing"), (1, holds[0]), (2, holds[0])], "question long, title string")
    got = {r.question: r.expected_top1 for r in Q._judged(spark, sf, cases, answers).collect()}
    assert len(holds) > 1 and got == {0: [holds[0]], 1: None, 2: None}
