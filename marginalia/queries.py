"""The queries of the library's own operators over the driver's tables, and their DuckDB counterparts.

The tables stand in for a note library: documents are notes (lines their blocks), pages notes with links, the
TPC-H-like tables an entity graph and manifests, conversations transcripts and events a change feed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions import text as X
from marginalia.functions.similarity import similarity_to
from marginalia.operators import audit, cards, containment, diff, graph, integrity, intervals, ranking, rules
from marginalia.plans import budget, evaluate, lookups, retrieve, review
from marginalia.plans.deltas import NoteIndex
from marginalia.plans.skew import small
from marginalia.plans.storage import materialize, work_dir
from marginalia.session import table
from marginalia.sources import notes
from marginalia.streaming.changes import ChangeFeed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The question of the ranking queries, as terms in their order, and the weights of the block queries.
TERMS = ["stupid", "license", "token", "thought", "ing", "auf"]
WEIGHTS = {"stupid": 2.0, "license": 3.0, "token": 1.5, "thought": 1.0, "ing": 0.25, "auf": 0.5}
CUT = "1995-01-01"


def _list(terms: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _coverage_sql(text: str) -> str:
    hit = " + ".join(f"(CASE WHEN contains({text}, '{t}') THEN {w} ELSE 0.0 END)::DOUBLE" for t, w in WEIGHTS.items())
    return f"((0.0::DOUBLE + {hit}) / {sum(WEIGHTS.values())}::DOUBLE)"


# --- scans and parsers -------------------------------------------------------------------------------------------


@query("SELECT doc_id, string_split(text, chr(10))[1] AS title, len(string_split(text, chr(10)))::BIGINT AS n_lines, length(text)::BIGINT AS n_chars FROM documents")
def inventory(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    lines = F.split("text", "\n")
    return d.select("doc_id", lines[0].alias("title"), F.size(lines).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))


@query(
    """SELECT doc_id, line_no, line AS block FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no FROM documents)
    WHERE trim(line) <> ''"""
)
def block_explode(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "block"))
    return d.filter(F.trim("block") != "").select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "block")


@query(
    """SELECT page_id, pos, href FROM (SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1)::BIGINT AS pos
    FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))"""
)
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    p = table(spark, sf, "pages").select("page_id", F.posexplode(hrefs).alias("p", "href"))
    return p.select("page_id", (F.col("p") + 1).cast("long").alias("pos"), "href")


@query(
    """SELECT page_id, title, heading, len(regexp_extract_all(html, '<p>'))::BIGINT AS n_paragraphs FROM (SELECT page_id, html,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages)"""
)
def page_headings(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("n_paragraphs"),
    )


@query(
    r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '[?&]page=(\d+)', 1) AS page_no,
    CASE WHEN regexp_matches(url, '^[A-Za-z]:') THEN 'drive' END AS odd FROM pages"""
)
def url_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select(
        "page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"[?&]page=(\d+)", 1).alias("page_no"),
        F.when(F.col("url").rlike("^[A-Za-z]:"), "drive").alias("odd"),
    )


@query(
    """SELECT page_id, n, CASE WHEN n = '' THEN 'record' WHEN starts_with(n, '<h') THEN 'concept' WHEN contains(n, 'token') THEN 'method'
    WHEN length(n) < 80 THEN 'navigation' ELSE 'knowledge' END AS role
    FROM (SELECT page_id, lower(unnest(regexp_extract_all(html, '<(?:h1|p)>[^<]*'))) AS n FROM pages)"""
)
def role_hint(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(?:h1|p)>[^<]*"), F.lit(0))).alias("n"))
    p = p.withColumn("n", F.lower("n"))
    role = F.when(F.col("n") == "", "record").when(F.col("n").startswith("<h"), "concept").when(F.col("n").contains("token"), "method")
    return p.select("page_id", "n", role.when(F.length("n") < 80, "navigation").otherwise("knowledge").alias("role"))


# --- ranking -------------------------------------------------------------------------------------------------------


@query(
    f"""WITH b AS (SELECT lower(text) AS t FROM documents), n AS (SELECT greatest(count(*), 1) AS n FROM b),
    d AS (SELECT term, (SELECT count(*) FROM b WHERE contains(b.t, term)) AS df FROM (SELECT unnest({_list(TERMS)}) AS term))
    SELECT term, df::BIGINT AS df, round(CASE WHEN df = 0 THEN 0.0 ELSE (ln((n + 1) / (df + 1)) + 0.35) * (CASE WHEN term = 'ing' THEN 0.25 ELSE 1.0 END)
    * (1 + 0.35 * least(greatest(length(term) - 2, 0), 2)) END::DOUBLE, 6) AS weight FROM d, n"""
)
def term_idf(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.lower("text").alias("t"))
    return ranking.idf(d, "t", TERMS, frozenset({"ing"})).select("term", "df", F.round("weight", 6).alias("weight"))


@query(f"SELECT doc_id, round({_coverage_sql('lower(text)')}, 6) AS coverage, array_to_string(list_filter({_list(TERMS)}, lambda t: contains(lower(text), t)), ',') AS hits FROM documents")
def term_coverage(spark: SparkSession, sf: str) -> DataFrame:
    hits = ranking.matched(F.lower("text"), TERMS)
    d = table(spark, sf, "documents").select("doc_id", hits.alias("h"))
    return d.select("doc_id", F.round(ranking.coverage(F.col("h"), WEIGHTS), 6).alias("coverage"), F.array_join("h", ",").alias("hits"))


_SCORED = f"""s AS (SELECT doc_id, round(38 * {_coverage_sql('lower(string_split(text, chr(10))[1])')} + 28 * {_coverage_sql('lower(text)')}, 6) AS score FROM documents)"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t"))
    title = ranking.coverage(ranking.matched(F.split("t", "\n")[0], TERMS), WEIGHTS)
    return d.select("doc_id", F.round(38 * title + 28 * ranking.coverage(ranking.matched(F.col("t"), TERMS), WEIGHTS), 6).alias("score"))


@query(
    f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, max(score) OVER () AS top FROM s),
    k AS (SELECT * FROM r WHERE rank <= 3), z AS (SELECT max(CASE WHEN rank = 2 THEN score END) AS second FROM k)
    SELECT doc_id, score, rank::INT AS rank, top, score >= greatest(4.5, 0.62 * top) AS kept, coalesce(second >= 0.88 * top, false) AS ambiguous FROM k, z"""
)
def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.ranked(_scored(spark, sf), "score", ["doc_id"], 3)


_QUESTIONS = {"q1": ["stupid", "moron"], "q2": ["zzzzzz", "qqqqqq"], "q3": ["license", "apache"]}


@query(
    "WITH q AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{q}', {_list(t)})" for q, t in _QUESTIONS.items())
    + """) v(question, terms)), s AS (SELECT question, doc_id, len(list_filter(terms, lambda t: contains(lower(text), t))) * 10.0 / len(terms) AS score FROM documents, q),
    b AS (SELECT question, max(score) AS best, count(*) FILTER (WHERE score >= 4.5) AS n FROM s GROUP BY 1)
    SELECT question, best::DOUBLE AS best, n::BIGINT AS n_matches, n = 0 AS gap FROM b"""
)
def retrieval_gap(spark: SparkSession, sf: str) -> DataFrame:
    t = F.lower("text")
    scores = [F.struct(F.lit(q).alias("question"), (F.size(ranking.matched(t, ts)) * 10.0 / len(ts)).alias("score")) for q, ts in _QUESTIONS.items()]
    d = table(spark, sf, "documents").select(F.explode(F.array(*scores)).alias("s")).select("s.*")
    got = d.groupBy("question").agg(F.max("score").alias("best"), F.count_if(F.col("score") >= 4.5).alias("n_matches"))
    return got.withColumn("gap", F.col("n_matches") == 0)


@query(
    """WITH f AS (SELECT * FROM (VALUES ('a', 'stupid'), ('b', 'license'), ('c', 'token')) v(facet, term)),
    s AS (SELECT facet, doc_id, (length(lower(text)) - length(replace(lower(text), term, '')))::DOUBLE / length(term) AS score FROM documents, f),
    r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY score DESC, doc_id) AS rn, max(score) OVER (PARTITION BY facet) AS top FROM s WHERE score > 0)
    SELECT facet, doc_id, score, CASE WHEN rn = 1 OR (rn = 2 AND score >= 0.7 * top) THEN 'primary' ELSE 'alternative' END AS role FROM r WHERE rn <= 4"""
)
def facet_review(spark: SparkSession, sf: str) -> DataFrame:
    t = F.lower("text")
    one = [F.struct(F.lit(f).alias("facet"), ((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))).cast("double") / len(w)).alias("score")) for f, w in (("a", "stupid"), ("b", "license"), ("c", "token"))]
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.array(*one)).alias("s")).select("doc_id", "s.*").filter("score > 0")
    w = W.partitionBy("facet").orderBy(F.col("score").desc(), "doc_id")
    d = d.withColumn("rn", F.row_number().over(w)).filter("rn <= 4").withColumn("top", F.max("score").over(W.partitionBy("facet")))
    primary = (F.col("rn") == 1) | ((F.col("rn") == 2) & (F.col("score") >= 0.7 * F.col("top")))
    return d.select("facet", "doc_id", "score", F.when(primary, "primary").otherwise("alternative").alias("role"))


@query(
    f"""WITH b AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no,
    lower(string_split(text, chr(10))[1]) AS head FROM documents)
    SELECT doc_id, line_no, round(({_coverage_sql('t')} + 0.2 * {_coverage_sql('head')}) / (1 + 0.08 * ln(1 + length(t) / 500.0::DOUBLE)), 6) AS score
    FROM b WHERE ({_coverage_sql('t')} + 0.2 * {_coverage_sql('head')}) / (1 + 0.08 * ln(1 + length(t) / 500.0::DOUBLE)) >= 0.025"""
)
def block_score(spark: SparkSession, sf: str) -> DataFrame:
    """Heads are scored once a document; a line's score leaves a generator, so the filter reads it and makes no second one."""
    lines = F.split(F.lower("text"), "\n")
    d = table(spark, sf, "documents").select("doc_id", ranking.covered(lines[0], WEIGHTS).alias("head"), F.posexplode(lines).alias("p", "t"))
    score = ranking.block_score(ranking.covered(F.col("t"), WEIGHTS), F.col("head"), F.length("t"))
    d = d.select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.explode(F.array(score)).alias("score"))
    return d.filter("score >= 0.025").withColumn("score", F.round("score", 6))


# --- the note engine: documents written as notes, read by the note parser --------------------------------------------


def _notes(spark: SparkSession, sf: str, fields: tuple[str, ...], extra: str = "''", keep: str = "true", below: str = "''") -> DataFrame:
    """Documents as topic notes: their source is the category, their text the one section of methods.

    ``fields`` are those that the parser makes. ``extra`` is a SQL expression for further lines of the header, each with its
    line break, ``below`` for sections behind.
    """
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").filter(keep)
    head = F.concat(F.lit("---\n类型: 主题笔记\n分类: "), F.coalesce("source", F.lit("")), F.lit("\n"), F.expr(extra), F.lit("---\n# "))
    note = F.concat(head, F.col("doc_id").cast("string"), F.lit("\n## 知识单元\n"), F.coalesce("text", F.lit("")), F.lit("\n"), F.expr(below))
    d = d.select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), note.alias("note")).withColumn("doc_hash", F.sha2("note", 256))
    return d.withColumn("n", notes.parse_note("path", "doc_hash", "note", fields)).select("path", "doc_hash", "n.*")


_TOPIC = ("props", "title", "parts", "chunks")
_ASKED = ["moron", "stupid", "idiot", "scum"]


@query(
    f"""WITH d AS (SELECT doc_id::VARCHAR AS title, lower(replace(coalesce(text, ''), 'ß', 'ss')) AS t FROM documents),
    c AS (SELECT * FROM d WHERE regexp_matches(t, '[^\\s]')), k AS (SELECT (SELECT count(*) FROM d) + (SELECT count(*) FROM c) AS n),
    f AS (SELECT term, (SELECT count(*) FROM c WHERE contains(c.t, term)) AS df FROM (SELECT unnest({_list(_ASKED)}) AS term)),
    w AS (SELECT term, CASE WHEN df = 0 THEN 0.0 ELSE (ln((n + 1) / (df + 1)) + 0.35) * 1.7 END::DOUBLE AS w FROM f, k),
    h AS (SELECT title, sum(w) / (SELECT sum(w) FROM w) AS cover, count(*) AS n, string_agg(term, ',' ORDER BY length(term) DESC, term) AS hits FROM c JOIN w ON contains(c.t, term) GROUP BY 1),
    s AS (SELECT title, hits, 28 * (0.35 * cover) AS score FROM h WHERE n >= 2), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, title) AS rank FROM s WHERE score >= 4.5),
    k3 AS (SELECT * FROM r WHERE rank <= 3), z AS (SELECT max(score) AS top, max(CASE WHEN rank = 2 THEN score END) AS second FROM k3)
    SELECT 'notes/' || title || '.md' AS path, round(score, 6) AS score, hits, rank::INT AS rank, score >= greatest(4.5, 0.62 * top) AS kept, coalesce(second >= 0.88 * top, false) AS ambiguous, false AS gap FROM k3, z
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, true WHERE NOT EXISTS (SELECT 1 FROM k3)"""
)
def notes_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The best notes for a question, by the whole of retrieval: roles, terms, passages, floors and the gap verdict."""
    got = retrieve.retrieve(retrieve.topics(_notes(spark, sf, _TOPIC)), retrieve.Question(" ".join(_ASKED)), 3)
    for c, kind in (("score", "double"), ("hits", "array<string>"), ("rank", "int"), ("kept", "boolean"), ("ambiguous", "boolean")):
        got = got if c in got.columns else got.withColumn(c, F.lit(None).cast(kind))
    return got.select("path", F.round("score", 6).alias("score"), F.array_join("hits", ",").alias("hits"), "rank", "kept", "ambiguous", "gap")


#: Words of three objects that questions name; what has one would ask for passages that own it.
_NAMED = "sdh|vfx|alpha|foley"
_CASES_SQL = f"""d AS (SELECT doc_id, doc_id::VARCHAR AS title, text, lower(replace(coalesce(text, ''), 'ß', 'ss')) AS t FROM documents),
    k AS (SELECT doc_id, title, text, list_slice(list_sort(list_transform(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{7,12}}'), lambda x: NOT regexp_matches(x, '{_NAMED}'))),
    lambda x: lpad((99 - length(x))::VARCHAR, 2, '0') || x)), 1, 3) AS ws FROM d WHERE doc_id % 50 = 0),
    a AS (SELECT doc_id, text, list_transform(ws, lambda x: substr(x, 3)) AS ws FROM k WHERE len(ws) >= 2),
    q AS (SELECT doc_id * 2 AS question, ws AS terms, false AS expect_gap FROM a UNION ALL SELECT doc_id * 2 + 1, list_transform(ws, lambda x: 'zq' || reverse(x) || 'qz'), true FROM a)"""
_VERDICTS_SQL = f"""{_CASES_SQL}, c AS (SELECT * FROM d WHERE regexp_matches(t, '[^\\s]')), n AS (SELECT (SELECT count(*) FROM d) + (SELECT count(*) FROM c) AS n),
    u AS (SELECT question, unnest(terms) AS term FROM q), f AS (SELECT term, (SELECT count(*) FROM c WHERE contains(c.t, term)) AS df FROM (SELECT DISTINCT term FROM u)),
    w AS (SELECT term, CASE WHEN df = 0 THEN 0.0 ELSE (ln((n + 1) / (df + 1)) + 0.35) * 1.7 END::DOUBLE AS w FROM f, n),
    qw AS (SELECT question, sum(w) AS whole, list(term) FILTER (w > 0) AS living FROM u JOIN w USING (term) GROUP BY 1 HAVING sum(w) > 0),
    kn AS (SELECT question, whole, len(list_filter(living, lambda x: len(list_filter(living, lambda y: y <> x AND contains(y, x))) = 0)) AS known FROM qw),
    h AS (SELECT question, title, sum(w) AS got, list(term) AS hits FROM u JOIN w USING (term) JOIN c ON contains(c.t, term) GROUP BY 1, 2),
    s AS (SELECT h.question, title, 28 * (0.35 * (got / whole)) AS score FROM h JOIN kn USING (question)
    WHERE len(list_filter(hits, lambda x: len(list_filter(hits, lambda y: y <> x AND contains(y, x))) = 0)) >= CASE WHEN known < 2 THEN 1 ELSE 2 END),
    r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(score, 9) DESC, title) AS rank FROM s WHERE score >= 4.5),
    g AS (SELECT question, list(title ORDER BY rank) AS titles FROM r WHERE rank <= 3 GROUP BY 1),
    e AS (SELECT q.question, expect_gap, list(d.title) FILTER (d.title IS NOT NULL) AS expected FROM q LEFT JOIN d ON NOT expect_gap AND len(list_filter(terms, lambda x: NOT contains(d.t, x))) = 0 GROUP BY 1, 2),
    v AS (SELECT e.question, coalesce(titles, []) AS titles, titles IS NULL AS gap, expect_gap, expect_gap OR coalesce(list_contains(expected, titles[1]), false) AS top1_ok,
    expect_gap OR coalesce(len(list_intersect(expected, titles)) > 0, false) AS hit3_ok, (titles IS NULL) = expect_gap AS gap_ok FROM e LEFT JOIN g USING (question))"""


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """A question of each fiftieth document's longest words, and one of words that none has."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{7,12})"))), lambda x: ~x.rlike(_NAMED))
    longest = F.transform(F.slice(F.array_sort(F.transform(words, lambda x: F.concat(F.lpad((99 - F.length(x)).cast("string"), 2, "0"), x))), 1, 3), lambda x: F.substring(x, 3, 99))
    a = materialize(d.filter("doc_id % 50 = 0").select("doc_id", longest.alias("ws")), "asked").filter(F.size("ws") >= 2)
    asks = a.select((F.col("doc_id") * 2).alias("question"), F.array_join("ws", " ").alias("text"), "ws", F.lit(False).alias("expect_gap"))
    odd = F.array_join(F.transform("ws", lambda x: F.concat(F.lit("zq"), F.reverse(x), F.lit("qz"))), " ")
    denies = a.select((F.col("doc_id") * 2 + 1).alias("question"), odd.alias("text"), F.lit(None).cast("array<string>").alias("ws"), F.lit(True).alias("expect_gap"))
    return materialize(asks.unionByName(denies), "cases")


def _judged(spark: SparkSession, sf: str, cases: DataFrame, answers: DataFrame) -> DataFrame:
    """``cases`` with what answers them: the documents that have all of a question's words. They are only compared with
    the titles that ``answers`` has, so it is these documents that are read again, where they are."""
    told = answers.join(cases.select("question", "ws"), "question").filter("title is not null and ws is not null").select("question", "title", "ws")
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("title"), "text").join(small(materialize(told, "told"), evaluate.NARROW_ROWS), "title")
    text = F.lower(F.replace("text", F.lit("ß"), F.lit("ss")))
    held = d.filter(F.forall("ws", lambda w: F.contains(text, w))).groupBy("question").agg(F.collect_list("title").alias("expected_top1"))
    none = F.lit(None).cast("array<string>")
    return cases.select("question", "expect_gap").join(held, "question", "left").withColumn("expected_any", none).withColumn("forbidden", none)


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    cases = _cases(spark, sf)
    answers = materialize(evaluate.retrieve_many(retrieve.topics(_notes(spark, sf, _TOPIC)), cases, 3), "answers")
    return evaluate.verdicts(answers, _judged(spark, sf, cases, answers))


@query(f"WITH {_VERDICTS_SQL} SELECT question, array_to_string(titles, ',') AS titles, gap, expect_gap, top1_ok, hit3_ok, gap_ok, top1_ok AND hit3_ok AND gap_ok AS passed FROM v")
def notes_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval for many questions in one plan, against what each should find."""
    return _verdicts(spark, sf).withColumn("titles", F.array_join("titles", ",")).drop("forbidden_ok")


@query(
    f"""WITH {_VERDICTS_SQL}, m AS (SELECT count(*)::BIGINT AS cases, count(*) FILTER (NOT expect_gap)::BIGINT AS supported, count(*) FILTER (expect_gap)::BIGINT AS negatives,
    count(*) FILTER (NOT expect_gap AND top1_ok) AS t, count(*) FILTER (NOT expect_gap AND hit3_ok) AS h, count(*) FILTER (expect_gap AND gap_ok) AS g,
    count(*) FILTER (NOT (top1_ok AND hit3_ok AND gap_ok))::BIGINT AS failures FROM v),
    x AS (SELECT *, CASE WHEN supported = 0 THEN 1.0 ELSE t::DOUBLE / supported END AS top1, CASE WHEN supported = 0 THEN 1.0 ELSE h::DOUBLE / supported END AS hit3, CASE WHEN negatives = 0 THEN 1.0 ELSE g::DOUBLE / negatives END AS gap FROM m)
    SELECT cases, supported, negatives, round(top1, 6) AS top1, round(hit3, 6) AS hit3, round(gap, 6) AS gap, failures, top1 >= 0.9 AND hit3 >= 0.95 AND gap >= 0.95 AND failures = 0 AS accepted FROM x"""
)
def notes_evaluation_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The rates of that evaluation against their thresholds."""
    return evaluate.summary(_verdicts(spark, sf)).withColumns({c: F.round(c, 6) for c in ("top1", "hit3", "gap")})


_HEADER = """concat(case when doc_id % 2 = 0 then '知识库版本: 2.1\\n' else '' end, case when quality = 0 then '证据状态: 传闻\\n' when quality = 1 then '证据状态: 单一来源\\n' else '' end,
case when doc_id % 3 = 0 then '掌握状态: 能复述\\n' else '' end, case when doc_id % 4 = 0 then '最近检验: 2026-01-01\\n' else '' end)"""
_NEWER = "doc_id % 2 = 0"
_AUDIT = {
    **{f"missing:{p}": "true" for p in ("状态", "材料类型", "信息来源", "完整程度", "整理日期")},
    "missing:分类": "source IS NULL OR source = ''", "naked_url": "regexp_matches(text, 'https?://')",
    **{f"topic_missing:{p}": _NEWER for p in ("解决问题", "适用阶段", "知识状态", "成熟度", "最后复核")},
    "topic_sections": _NEWER, "state:证据状态": "quality = 0", "category": f"{_NEWER} AND source IS NOT NULL AND source <> ''",
    "mastery_date": "doc_id % 3 = 0 AND doc_id % 4 <> 0", "mastery_pair": f"{_NEWER} AND (doc_id % 3 = 0) <> (doc_id % 4 = 0)",
    "mastery_record": f"{_NEWER} AND doc_id % 3 = 0 AND doc_id % 4 = 0",
    **{f"topic_heading:{h}": "true" for h in ("学习材料", "内容导览")}, **{f"topic_heading:{h}": _NEWER for h in ("核心命题", "适用边界", "项目应用与验证", "外部补充与分歧")},
}


@query("WITH j AS (SELECT d.*, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) " + " UNION ALL ".join(f"SELECT 'notes/' || doc_id || '.md' AS path, '{c}' AS code FROM j WHERE {w}" for c, w in _AUDIT.items()))
def notes_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The rules that notes violate, with those of their type."""
    return audit.validate(_notes(spark, sf, ("props", "body", "blocks"), _HEADER), strict=True)


_NOW, _THEN = "doc_id % 11 <> 0", "doc_id % 13 <> 0"
_PARENT = """case when doc_id >= 7 then concat('来源材料:\\n  - "[[', cast(doc_id div 7 as string), ']]"\\n') else '' end"""


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, 'notes/' || doc_id || '.md' AS path, 'notes/' || (doc_id // 7) || '.md' AS parent FROM documents),
    n AS (SELECT * FROM d WHERE {_NOW}), b AS (SELECT * FROM d WHERE {_THEN}),
    e AS (SELECT path, parent FROM n WHERE doc_id >= 7 AND parent IN (SELECT path FROM n) UNION SELECT path, parent FROM b WHERE doc_id >= 7 AND parent IN (SELECT path FROM b)),
    s AS (SELECT path FROM b WHERE path NOT IN (SELECT path FROM n) OR doc_id % 5 = 0),
    w AS (SELECT path AS "trigger", path AS target, 0 AS depth, path AS chain FROM s UNION ALL SELECT w."trigger", e.path, depth + 1, chain || '>' || e.path FROM w JOIN e ON e.parent = w.target)
    SELECT "trigger", target, depth, chain FROM w WHERE depth > 0 AND target IN (SELECT path FROM n)"""
)
def notes_followup(spark: SparkSession, sf: str) -> DataFrame:
    """What changed, removed and retired notes have an effect on, over what is and was declared to depend on them."""
    was = f"concat({_PARENT}, case when doc_id % 5 = 0 then '状态: 旧\\n' else '' end)"
    now, then = (materialize(_notes(spark, sf, ("props",), x, keep), "notes") for x, keep in ((_PARENT, _NOW), (was, _THEN)))
    impact = review.effects(now, then.select("path", "doc_hash"), review.dependencies(then))[1]
    return impact.withColumn("chain", F.array_join("chain", ">"))


_FACETS = [["moron", "stupid", "idiot", "scum"], ["tion", "ing", "auf"], ["zzzzzz", "qqqqqq"]]
_LIMITS = """concat(case when doc_id % 2 = 1 then '## 适用边界\\nLimits of this one.\\n' else '' end, case when doc_id % 3 > 0 then '## 风险\\nA stupid moron is a risk.\\n' else '' end)"""


@query(
    f"""WITH q AS (SELECT * FROM (VALUES {", ".join(f"({i}, {_list(t)})" for i, t in enumerate(_FACETS))}) v(facet, terms)), t AS (SELECT facet, unnest(terms) AS term FROM q),
    d AS (SELECT DISTINCT doc_id, 'notes/' || doc_id || '.md' AS path, regexp_replace(regexp_replace(coalesce(text, ''), '^(\\s*\\n)+', ''), '(\\n\\s*)+$', '') AS text FROM documents),
    b AS (SELECT doc_id, path, 1 AS k, '知识单元' AS heading, 'method' AS kind, text FROM d WHERE regexp_matches(text, '[^\\s]')
    UNION ALL SELECT doc_id, path, 2, '适用边界', 'boundary', 'Limits of this one.' FROM d WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, path, 3, '风险', 'boundary', 'A stupid moron is a risk.' FROM d WHERE doc_id % 3 > 0),
    l AS (SELECT *, lower(replace(text, 'ß', 'ss')) AS t FROM b), n AS (SELECT count(*) AS n FROM b),
    f AS (SELECT facet, term, (SELECT count(*) FROM l WHERE contains(l.t, term)) AS df FROM t), w AS (SELECT facet, term, CASE WHEN df = 0 THEN 0.0 ELSE (ln((n + 1) / (df + 1)) + 0.35) * (1 + 0.35 * least(greatest(length(term) - 2, 0), 2)) END::DOUBLE AS w FROM f, n),
    z AS (SELECT facet, sum(w) AS whole FROM w GROUP BY 1),
    s AS (SELECT w.facet, doc_id, path, k, heading, kind, text, sum(w.w) / any_value(whole) / (1 + 0.08 * ln(1 + length(text) / 500.0)) AS base, count(*) AS hits FROM l JOIN w ON contains(l.t, w.term) JOIN z ON z.facet = w.facet GROUP BY 1, 2, 3, 4, 5, 6, 7),
    c AS (SELECT *, CASE WHEN kind = 'boundary' THEN base * 0.45 ELSE base END AS score FROM s WHERE hits >= 2 AND base >= 0.025),
    r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY score DESC, path) AS rank, max(score) OVER (PARTITION BY facet) AS top FROM c WHERE kind <> 'boundary'),
    m AS (SELECT *, CASE WHEN rank = 1 OR (rank = 2 AND score >= 0.7 * top) THEN 'primary' ELSE 'alternative' END AS role FROM r WHERE rank <= 4), p AS (SELECT facet, doc_id, path FROM m WHERE role = 'primary'),
    u AS (SELECT c.*, p.path AS of, row_number() OVER (PARTITION BY c.facet, p.path ORDER BY score DESC, c.path, k) AS rank FROM p JOIN c ON c.facet = p.facet AND p.doc_id >= 7 AND c.doc_id = p.doc_id // 7),
    g AS (SELECT p.facet, p.path AS of, b.* FROM p JOIN b ON b.doc_id = p.doc_id AND k = 2), x AS (SELECT c.*, p.path AS of, p.doc_id % 2 = 1 AS general FROM p JOIN c ON c.facet = p.facet AND c.doc_id = p.doc_id AND c.k = 3)
    SELECT facet, role, rank::INT AS rank, CASE WHEN role = 'primary' THEN path END AS of, path, heading, kind, round(score, 6) AS score, length(text)::INT AS chars FROM m
    UNION ALL SELECT facet, 'support', 1, of, path, heading, kind, round(score, 6), length(text) FROM u WHERE rank = 1
    UNION ALL SELECT facet, 'boundary', 1, of, path, heading, kind, NULL, length(text) FROM g UNION ALL SELECT facet, 'boundary', CASE WHEN general THEN 2 ELSE 1 END, of, path, heading, kind, round(score, 6), length(text) FROM x"""
)
def notes_review(spark: SparkSession, sf: str) -> DataFrame:
    """A review pack for three questions: primaries, their supporting sources and boundaries, and alternatives."""
    found = materialize(_notes(spark, sf, ("props", "title", "blocks"), _PARENT, below=_LIMITS), "notes")
    got = materialize(review.pack(found, [" ".join(t) for t in _FACETS], most=1 << 40), "pack")
    whole = blocks_of(found).join(F.broadcast(got.select("id").distinct()), "id", "left_semi")  # a pack has a few rows a facet
    of = got.filter("role = 'primary'").select(F.col("of").alias("_of"), F.col("path").alias("of_path")).distinct()
    got = got.join(of, F.col("of") == F.col("_of"), "left").join(whole, "id", "left")
    return got.select("facet", "role", "rank", F.col("of_path").alias("of"), "path", "heading", "kind", F.round("score", 6).alias("score"), "chars")


def blocks_of(found: DataFrame) -> DataFrame:
    """(id, chars) of the blocks of notes."""
    return notes.blocks(found).select("id", F.length("text").alias("chars"))


def _unrepeated(rows: DataFrame, key: str) -> DataFrame:
    """Distinct ``rows``: those of keys that repeat alone are put together, no other text is moved."""
    again = rows.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("n")).filter("n > 1").select("_again")
    again = small(materialize(again, "again"))
    same = F.col(key).eqNullSafe(F.col("_again"))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").distinct())


# --- paths, effects, integrity and budgets, by the library's operators -------------------------------------------------

_PAGE_PATH = "regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '') || '.md'"


@query(
    f"""WITH c AS (SELECT page_id, {_PAGE_PATH} AS path, page_id % 5 <> 0 AS indexed, html FROM pages),
    s AS (SELECT *, string_split(path, '/')[-1] AS name, string_split(path, '/')[-2] AS folder, substr(path, 1, length(path) - 3) AS bare FROM c),
    l AS (SELECT page_id * 2 AS link_id, CASE page_id % 9 WHEN 3 THEN 'index.md' ELSE path END AS origin, CASE page_id % 9 WHEN 0 THEN bare WHEN 1 THEN './' || name WHEN 2 THEN '../' || folder || '/' || name WHEN 3 THEN name WHEN 4 THEN '../../../../' || name
    WHEN 5 THEN '/' || path WHEN 6 THEN '#top' WHEN 7 THEN upper(bare) || '.MD#x' ELSE 'no\\such\\' || name END AS raw FROM s
    UNION ALL SELECT page_id * 2 + 1, path, regexp_extract(html, 'href=["'']([^"'']*)', 1) FROM s),
    t AS (SELECT link_id, origin, trim(replace(string_split(raw, '#')[1], '\\', '/')) AS raw FROM l),
    p AS (SELECT *, CASE WHEN lower(raw) LIKE '%.md' THEN raw ELSE raw || '.md' END AS path, raw LIKE '/%' OR regexp_matches(raw, '^[a-zA-Z]:') AS away FROM t),
    w AS (SELECT link_id, 1 AS way, path AS x FROM p WHERE raw <> '' AND NOT away UNION ALL SELECT link_id, 2, regexp_replace(origin, '[^/]*$', '') || path FROM p WHERE raw <> '' AND NOT away),
    o AS (SELECT link_id, way, list_reduce([[]::VARCHAR[]] || list_transform(list_filter(string_split(x, '/'), lambda i: i <> '' AND i <> '.'), lambda i: [i]),
    lambda a, e: CASE WHEN a = ['!'] THEN a WHEN e[1] <> '..' THEN a || e WHEN len(a) = 0 THEN ['!'] ELSE list_slice(a, 1, len(a) - 1) END) AS parts FROM w),
    h AS (SELECT o.link_id, way, arg_min(c.path, (NOT indexed, c.path)) AS target, min(NOT indexed) AS out, 1 AS n FROM o JOIN c ON lower(c.path) = lower(array_to_string(parts, '/')) WHERE parts <> ['!'] GROUP BY 1, 2
    UNION ALL SELECT p.link_id, 3, arg_min(s.path, (NOT indexed, s.path)), min(NOT indexed), count(*) FROM p JOIN s ON lower(s.name) = lower(p.path) WHERE p.raw <> '' AND NOT away AND NOT contains(p.path, '/') GROUP BY 1),
    b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY way) = 1),
    r AS (SELECT p.link_id, target, CASE WHEN raw = '' THEN 'empty' WHEN away THEN 'outside' WHEN b.link_id IS NULL THEN 'missing' WHEN way = 3 AND n > 1 THEN 'ambiguous' WHEN out THEN 'exists' ELSE ['root', 'relative', 'name'][way] END AS reason
    FROM p LEFT JOIN b ON p.link_id = b.link_id)
    SELECT link_id, CASE WHEN reason IN ('root', 'relative', 'name') THEN target END AS target, reason FROM r"""
)
def path_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages, written in many ways and as they stand in the html, among the pages' own paths."""
    c = table(spark, sf, "pages").select("page_id", F.expr(_PAGE_PATH).alias("path"), "html")
    parts, k = F.split("path", "/"), F.col("page_id") % 9
    name, folder, bare = F.element_at(parts, -1), F.element_at(parts, -2), F.expr("substring(path, 1, length(path) - 3)")
    ways = [bare, F.concat(F.lit("./"), name), F.concat(F.lit("../"), folder, F.lit("/"), name), name, F.concat(F.lit("../../../../"), name), F.concat(F.lit("/"), "path"), F.lit("#top"), F.concat(F.upper(bare), F.lit(".MD#x"))]
    raw = F.concat(F.lit("no\\such\\"), name)
    for i, way in enumerate(ways):
        raw = F.when(k == i, way).otherwise(raw)
    links = c.select((F.col("page_id") * 2).alias("link_id"), raw.alias("raw"), F.when(k == 3, "index.md").otherwise(F.col("path")).alias("origin"))
    links = links.unionByName(c.select((F.col("page_id") * 2 + 1).alias("link_id"), F.regexp_extract("html", "href=[\"']([^\"']*)", 1).alias("raw"), F.col("path").alias("origin")))
    return graph.resolve_paths(links, c.select("path", (F.col("page_id") % 5 != 0).alias("indexed")))


@query(
    f"""WITH c AS (SELECT page_id, {_PAGE_PATH} AS path FROM pages), s AS (SELECT *, string_split(path, '/')[-1] AS name, string_split(path, '/')[1] AS host FROM c),
    l AS (SELECT path AS origin, name AS raw FROM s UNION SELECT path, host || '/nowhere' FROM s WHERE page_id % 4 = 0 UNION SELECT path, 'x' || name FROM s WHERE page_id % 3 = 0),
    u AS (SELECT name, count(*) AS n, min(path) AS path FROM s GROUP BY 1), t AS (SELECT s.path AS origin, x.path AS target FROM s JOIN s x ON x.page_id = s.page_id // 2),
    e AS (SELECT DISTINCT origin, target FROM t WHERE origin <> target), lost AS (SELECT origin AS path, count(*) AS n FROM l WHERE raw <> string_split(origin, '/')[-1] GROUP BY 1)
    SELECT c.path, (SELECT count(*) FROM e WHERE e.origin = c.path)::BIGINT AS links, (SELECT count(*) FROM e WHERE e.target = c.path)::BIGINT AS backlinks, coalesce(lost.n, 0)::BIGINT AS unresolved,
    NOT EXISTS (SELECT 1 FROM e WHERE e.target = c.path) AS orphan, NOT EXISTS (SELECT 1 FROM e WHERE e.origin = c.path) AS dead_end FROM (SELECT DISTINCT path FROM c) c LEFT JOIN lost ON lost.path = c.path"""
)
def note_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Links, backlinks, orphans, dead ends and unresolved links of pages that link to themselves, to others and nowhere."""
    c = table(spark, sf, "pages").select("page_id", F.expr(_PAGE_PATH).alias("path"))
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    to = c.select(F.col("page_id").alias("_id"), F.col("path").alias("_to"))
    rows = c.join(to, F.col("page_id").cast("long") == F.col("_id") * 2).select("path", "_to").unionByName(c.join(to, F.col("page_id").cast("long") == F.col("_id") * 2 + 1).select("path", "_to"))
    links = c.select(F.col("path").alias("origin"), name.alias("raw")).unionByName(c.filter("page_id % 4 = 0").select(F.col("path").alias("origin"), F.concat(parts[0], F.lit("/nowhere")).alias("raw")))
    links = links.unionByName(c.filter("page_id % 3 = 0").select(F.col("path").alias("origin"), F.concat(F.lit("x"), name).alias("raw"))).unionByName(rows.select(F.col("path").alias("origin"), F.col("_to").alias("raw")))
    links = materialize(links.select(F.struct("origin", "raw").alias("link_id"), "raw", "origin").distinct().withColumn("link_id", F.to_json("link_id")), "links")
    got = graph.resolve_paths(links, c.select("path", F.lit(True).alias("indexed"))).join(links.select("link_id", "origin"), "link_id")
    return lookups.note_graph(c, got)


@query(
    """WITH d AS (SELECT DISTINCT 'notes/' || doc_id AS path, lower(text) AS t FROM documents WHERE doc_id % 11 <> 0 AND text IS NOT NULL)
    SELECT path, len(list_distinct(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))))::INT AS n_grams, contains(t, 'the ') AS found FROM d"""
)
def index_by_changes(spark: SparkSession, sf: str) -> DataFrame:
    """An inverted table of an older state of the documents, brought to the present one by what differs, and a search in it."""
    d = _unrepeated(table(spark, sf, "documents").filter("text is not null").select("doc_id", F.concat(F.lit("notes/"), "doc_id").alias("path"), "text"), "doc_id")
    now = d.filter("doc_id % 11 != 0").withColumn("doc_hash", F.sha2("text", 256))
    then = d.filter("doc_id % 13 != 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))).withColumn("doc_hash", F.sha2("text", 256))
    index = NoteIndex(spark, f"{work_dir(spark)}/index-{uuid.uuid4().hex}")
    index.update(then, F.col("text"))
    index.update(now, F.col("text"))
    hits = lookups.find(index, now, "the ").select(F.col("path").alias("_path"))
    got = index.table.read().select("path", F.size("grams").alias("n_grams")).join(hits, F.col("path") == F.col("_path"), "left")
    return got.select("path", "n_grams", F.col("_path").isNotNull().alias("found"))


@query(
    """WITH e AS (SELECT user_id::VARCHAR AS key, event_id AS seq, CASE WHEN value < 5 THEN NULL ELSE event_type END AS hash FROM events WHERE user_id IS NOT NULL)
    SELECT key, max(seq) AS seq, arg_max(struct_pack(hash), seq).hash AS hash, true AS pending, arg_max(struct_pack(hash), seq).hash AS pending_hash FROM e GROUP BY 1"""
)
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes of their users, in three batches out of order, the second of which comes twice; and what waits for review."""
    e = table(spark, sf, "events").filter("user_id is not null")
    e = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("value") < 5, None).otherwise(F.col("event_type")).alias("hash"))
    feed = ChangeFeed(spark, f"{work_dir(spark)}/feed-{uuid.uuid4().hex}")
    for batch, third in ((0, 1), (1, 0), (1, 0), (2, 2)):
        feed(e.filter(F.col("seq") % 3 == third), batch)
    waits = feed.pending().select(F.col("key").alias("_key"), F.col("hash").alias("pending_hash"))
    got = feed.state(2).join(waits, F.col("key") == F.col("_key"), "left")
    return got.select("key", "seq", "hash", F.col("_key").isNotNull().alias("pending"), "pending_hash")


@query(
    """WITH RECURSIVE n AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 13 <> 0),
    now AS (SELECT doc_id AS dependent, doc_id // 7 AS dependency, true AS current FROM n WHERE doc_id >= 7 UNION SELECT doc_id, doc_id // 3, true FROM n WHERE doc_id % 17 = 0 AND doc_id > 0),
    then_ AS (SELECT doc_id AS dependent, doc_id // 7 AS dependency FROM b WHERE doc_id >= 7),
    e AS (SELECT dependent, dependency, bool_or(current) AS current FROM (SELECT * FROM now UNION ALL SELECT *, false FROM then_) GROUP BY 1, 2),
    fresh AS (SELECT dependent, dependency FROM now EXCEPT SELECT * FROM then_),
    s AS (SELECT doc_id AS node, 'dependency_added' AS reason FROM n WHERE doc_id NOT IN (SELECT doc_id FROM b)
    UNION ALL SELECT doc_id, 'dependency_changed_or_unavailable' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM n) OR doc_id % 5 = 0),
    w AS (SELECT node AS "trigger", NULL::BIGINT AS start, node AS target, 0 AS depth, [node] AS chain, reason FROM s
    UNION ALL SELECT dependency, dependent, dependent, 1, [dependency, dependent], 'declared_dependency_added' FROM fresh),
    walk AS (SELECT * FROM w UNION ALL SELECT k."trigger", k.start, e.dependent, k.depth + 1, k.chain || [e.dependent], k.reason FROM walk k JOIN e ON e.dependency = k.target
    WHERE (k.start IS NULL OR e.current) AND e.dependent <> k."trigger"),
    r AS (SELECT "trigger", target, arg_min(struct_pack(reason, depth, chain), (start IS NOT NULL, coalesce(start, 0), depth, chain)) AS x FROM walk WHERE depth > 0 AND target IN (SELECT doc_id FROM n) GROUP BY 1, 2)
    SELECT "trigger", target, ['topic', 'application', 'source'][target % 3 + 1] AS kind, x.reason AS reason, x.depth AS depth, array_to_string(x.chain, '>') AS chain FROM r"""
)
def change_impact(spark: SparkSession, sf: str) -> DataFrame:
    """What added, removed and modified documents and newly declared dependencies have an effect on."""
    d = table(spark, sf, "documents").select("doc_id").distinct()
    now, then = materialize(d.filter("doc_id % 11 <> 0"), "now"), materialize(d.filter("doc_id % 13 <> 0"), "then")
    edges = lambda rows, keep, by: rows.filter(keep).select(F.col("doc_id").alias("dependent"), F.expr(f"doc_id div {by}").alias("dependency"), F.lit(f"by{by}").alias("field"))
    kind = F.element_at(F.array(F.lit("topic"), F.lit("application"), F.lit("source")), (F.col("doc_id") % 3 + 1).cast("int"))
    added = now.join(then, "doc_id", "left_anti").select(F.col("doc_id").alias("node"), F.lit("dependency_added").alias("reason"))
    gone = then.join(now, "doc_id", "left_anti").unionByName(now.join(then, "doc_id", "left_semi").filter("doc_id % 5 = 0"))
    seeds = added.unionByName(gone.select(F.col("doc_id").alias("node"), F.lit("dependency_changed_or_unavailable").alias("reason")))
    current = edges(now, "doc_id >= 7", 7).unionByName(edges(now, "doc_id % 17 = 0 and doc_id > 0", 3))
    got = graph.change_impact(now.select(F.col("doc_id").alias("node"), kind.alias("kind")), seeds, current, edges(then, "doc_id >= 7", 7))
    return got.withColumn("chain", F.array_join("chain", ">"))


_LINE = "split(text, '\n')"


@query(
    """WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l, text || chr(10) || CASE WHEN doc_id % 10 = 3 THEN '' ELSE '<!-- source-evidence: s' || doc_id || ' -->' END AS note FROM documents WHERE text IS NOT NULL),
    v AS (SELECT doc_id, 's' || doc_id AS source_id, l, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'matches' END AS note,
    CASE WHEN doc_id % 4 = 0 OR strlen(l[1]) = 0 THEN 'none' WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 9 = 0 THEN 'changed' ELSE 'matches' END AS prefix,
    doc_id % 13 <> 0 AND contains(note, '<!-- source-evidence: s' || doc_id || ' -->') AS marker,
    CASE WHEN doc_id % 8 = 0 THEN 'history_only' WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'matches' END AS raw_source FROM d),
    i AS (SELECT doc_id, 1 AS f, 2 AS t, left(l[1], 20) AS quote FROM v UNION ALL SELECT doc_id, 2, 3, CASE WHEN doc_id % 3 = 0 THEN left(l[1], 15) || '~' ELSE left(l[2], 15) END FROM v),
    c AS (SELECT v.doc_id, count(*) AS n FROM v JOIN i USING (doc_id) WHERE raw_source = 'matches' AND (t > len(l) OR (quote IS NOT NULL AND NOT contains(array_to_string(list_slice(l, f, t), chr(10)), quote))) GROUP BY 1)
    SELECT source_id, false AS repeated, note, prefix, marker, raw_source, coalesce(n, 0)::BIGINT AS bad_items FROM v LEFT JOIN c USING (doc_id)"""
)
def source_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Records over documents as their own sources: stale notes and prefixes, missing and changed texts, wrong quotes."""
    d = _unrepeated(table(spark, sf, "documents").filter("text is not null").select("doc_id", "text"), "doc_id").withColumn("source_id", F.concat(F.lit("s"), "doc_id")).withColumn("path", F.concat(F.lit("notes/"), "doc_id"))
    note = F.concat("text", F.lit("\n"), F.when(F.col("doc_id") % 10 == 3, "").otherwise(F.concat(F.lit("<!-- source-evidence: "), "source_id", F.lit(" -->"))))
    line = F.split("text", "\n")
    d = d.withColumn("note", note).withColumn("first", line[0]).withColumn("second", F.try_element_at(line, F.lit(2)))
    prefix = F.when((F.col("doc_id") % 4 != 0) & (F.octet_length("first") > 0), F.octet_length("first"))
    records = d.select(
        "source_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")), 256).alias("text_sha256"), (F.col("doc_id") % 8 != 0).alias("local"), F.col("path").alias("note_path"),
        F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("note", F.lit("x"))).otherwise(F.col("note")), 256).alias("note_sha256"), prefix.alias("prefix_bytes"),
        F.sha2(F.when(F.col("doc_id") % 9 == 0, "zz").otherwise(F.col("first")), 256).alias("prefix_sha256"),
    )
    quote = F.when(F.col("doc_id") % 3 == 0, F.concat(F.left("first", F.lit(15)), F.lit("~"))).otherwise(F.left("second", F.lit(15)))
    item = lambda i, a, b, q: d.select("source_id", F.lit(i).alias("id"), F.lit(a).alias("from"), F.lit(b).alias("to"), q.alias("quote"))
    items = item("a", 1, 2, F.left("first", F.lit(20))).unionByName(item("b", 2, 3, quote))
    notes_ = d.filter("doc_id % 13 <> 0").select("path", F.col("note").cast("binary").alias("content"))
    return integrity.audited(records, items, notes_, d.filter("doc_id % 11 <> 0").select("source_id", F.col("text").cast("binary").alias("content")))


_PACKS_SQL = """i AS (SELECT source, doc_id, coalesce(length(text), 0) AS len, coalesce(length(text), 0) - 120 AS gain FROM documents), k AS (SELECT source, d.doc_id, 40 + length(d.doc_id::VARCHAR) AS size FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    p AS (SELECT source, (SELECT coalesce(sum(len + 60), 0) FROM i WHERE i.source IS NOT DISTINCT FROM d.source) + (SELECT coalesce(sum(size), 0) FROM k WHERE k.source IS NOT DISTINCT FROM d.source) AS size FROM (SELECT DISTINCT source FROM documents) d),
    o AS (SELECT source, size, greatest(size - (0.6 * size)::BIGINT, 0) AS over FROM p),
    lk AS (SELECT k.*, over, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < over AS dropped FROM k JOIN o ON k.source IS NOT DISTINCT FROM o.source),
    o2 AS (SELECT o.source, o.size, over, greatest(over - coalesce((SELECT sum(lk.size) FROM lk WHERE dropped AND lk.source IS NOT DISTINCT FROM o.source), 0), 0) AS need FROM o),
    x AS (SELECT i.*, need, coalesce(sum(gain) OVER (PARTITION BY i.source ORDER BY len DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < need AND gain > 0 AND len > 0 AS deferred FROM i JOIN o2 ON i.source IS NOT DISTINCT FROM o2.source)"""


def _packs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, F.Column]:
    d = table(spark, sf, "documents").select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("len"))
    items = materialize(d.withColumn("gain", F.col("len") - 120), "items")
    links = table(spark, sf, "labels").join(items, "doc_id").select("source", "doc_id", (40 + F.length(F.col("doc_id").cast("string"))).cast("long").alias("size"))
    links = materialize(links, "links")
    sizes = items.select("source", (F.col("len") + 60).alias("size")).unionByName(links.select("source", "size"))
    packs = materialize(sizes.groupBy("source").agg(F.sum("size").alias("size")), "packs")
    most = F.round(F.col("size") * 0.6).cast("long")
    over = materialize(budget.excess(packs, ["source"], "size", most), "over")
    links = materialize(budget.popped(links, over, ["source"], "doc_id", "size"), "links")
    left = materialize(budget.left_over(over, links, ["source"], "size"), "over")
    return packs, links, budget.deferred(items, left, ["source"], "doc_id", "len", "gain"), most


@query(f"WITH {_PACKS_SQL} SELECT source, doc_id, len, deferred FROM x")
def budget_items(spark: SparkSession, sf: str) -> DataFrame:
    """Of each source's documents as a pack, which go so that three fifths of it stay, the longest first."""
    return _packs(spark, sf)[2].select("source", "doc_id", "len", "deferred")


@query(
    f"""WITH {_PACKS_SQL} SELECT source, (SELECT count(*) FROM lk WHERE NOT dropped AND lk.source IS NOT DISTINCT FROM o2.source)::BIGINT AS returned,
    (SELECT count(*) FROM lk WHERE dropped AND lk.source IS NOT DISTINCT FROM o2.source)::BIGINT AS omitted, (SELECT count(*) FROM x WHERE deferred AND x.source IS NOT DISTINCT FROM o2.source)::BIGINT AS deferred,
    (size - coalesce((SELECT sum(lk.size) FROM lk WHERE dropped AND lk.source IS NOT DISTINCT FROM o2.source), 0) - coalesce((SELECT sum(gain) FROM x WHERE deferred AND x.source IS NOT DISTINCT FROM o2.source), 0))::BIGINT AS size,
    (size - coalesce((SELECT sum(lk.size) FROM lk WHERE dropped AND lk.source IS NOT DISTINCT FROM o2.source), 0) - coalesce((SELECT sum(gain) FROM x WHERE deferred AND x.source IS NOT DISTINCT FROM o2.source), 0)) > (0.6 * size)::BIGINT AS exceeded FROM o2"""
)
def budget_packs(spark: SparkSession, sf: str) -> DataFrame:
    """What was left out of each of those packs, and whether it fits."""
    packs, links, items, most = _packs(spark, sf)
    return budget.report(packs, links, materialize(items, "deferred"), ["source"], "size", "size", "gain", most)


# --- text functions, totals and views, by the library's operators ------------------------------------------------------


@query(
    r"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS head, strlen(text) AS n, left(text, 200) AS h FROM documents),
    c AS (SELECT *, 200 - least(CASE WHEN instr(reverse(h), '。') > 0 THEN instr(reverse(h), '。') ELSE 201 END, CASE WHEN instr(reverse(h), '；') > 0 THEN instr(reverse(h), '；') ELSE 201 END,
    CASE WHEN instr(reverse(h), chr(10)) > 0 THEN instr(reverse(h), chr(10)) ELSE 201 END) + 1 AS last FROM d)
    SELECT doc_id, sha256(regexp_replace(lower(text), '[^0-9a-z一-鿿]+', '', 'g')) AS key, sha256(regexp_replace(lower(replace(text, 'ß', 'ss')), '[^0-9a-z一-鿿]+', '', 'g')) AS prompt_key,
    CASE WHEN length(text) <= 200 THEN text WHEN last > 130 THEN rtrim(left(h, last)) ELSE rtrim(h) || '…' END AS clipped,
    CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1f MiB', floor(n / 1048576.0 * 10 + 0.5) / 10) END AS size,
    coalesce(nullif(rtrim(left(trim(regexp_replace(regexp_replace(head, '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g')), 80)), ''), 'untitled') AS name,
    coalesce(TRY_CAST('2020-02-' || lpad((doc_id % 40)::VARCHAR, 2, '0') AS DATE), DATE '0001-01-01')::VARCHAR AS day,
    CASE WHEN doc_id % 7 <= doc_id % 11 THEN array_to_string(list_concat(range(doc_id % 7, doc_id % 11 + 1), [3]), ' ') END AS pages,
    '{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}' AS json FROM c JOIN (SELECT DISTINCT doc_id, lang, source FROM documents) USING (doc_id)"""
)
def text_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Keys, clipped texts, sizes, file names, dates, ranges and canonical JSON of documents."""
    d = table(spark, sf, "documents")
    text = F.col("text")
    day = X.date_or_least(F.concat(F.lit("2020-02-"), F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0")))
    ranges = X.page_ranges(F.concat((F.col("doc_id") % 7).cast("string"), F.lit("-"), (F.col("doc_id") % 11).cast("string"), F.lit(", 3")))
    json = cards.rendered(d.select("doc_id", "lang", "source"), "doc_id").withColumnRenamed("doc_id", "_id")
    rows = d.select(
        "doc_id", F.sha2(X.text_key(text), 256).alias("key"), F.sha2(X.folded_key(text), 256).alias("prompt_key"), X.clip(text, 200).alias("clipped"), X.byte_size(F.octet_length(text)).alias("size"),
        X.safe_name(F.split(text, "\n")[0]).alias("name"), day.cast("string").alias("day"), F.array_join(ranges.cast("array<string>"), " ").alias("pages"),
    )
    return rows.join(json, F.col("doc_id") == F.col("_id")).drop("_id")


@query("SELECT count(*)::BIGINT AS file_count, coalesce(sum(strlen(text)), 0)::BIGINT AS total_bytes, count(*) FILTER (doc_id % 3 = 0)::BIGINT AS markdown_count FROM documents")
def manifest_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as the files of a manifest, a third of them Markdown."""
    name = F.concat(F.lit("x/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".MD").otherwise(".txt"))
    return cards.manifest_totals(table(spark, sf, "documents").select(name.alias("path"), F.octet_length("text").cast("long").alias("size")))


@query("SELECT doc_id || '.md' AS name, 'notes' AS folder, 'problem ' || doc_id AS problem, CASE WHEN doc_id % 2 = 0 THEN 'one, two' END AS stages FROM documents WHERE source = 'src1'")
def notes_topics_of(spark: SparkSession, sf: str) -> DataFrame:
    """The topic notes of a category, with their folder and fields."""
    header = "concat('解决问题: problem ', cast(doc_id as string), '\\n', case when doc_id % 2 = 0 then '适用阶段:\\n  - one\\n  - two\\n' else '' end)"
    got = cards.topics_of(_notes(spark, sf, ("props",), header), "src1")
    return got.select("name", "folder", F.col("解决问题").alias("problem"), F.col("适用阶段").alias("stages"))


# --- duplicates and containment ------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS key, count(*)::BIGINT AS n, min(doc_id) AS first_member, max(doc_id) AS last_member FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return rules.groups_above_one(table(spark, sf, "documents"), F.sha2("text", 256), "doc_id")


@query("SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS key, count(*)::BIGINT AS n, min(page_id) AS first_member, max(page_id) AS last_member FROM pages GROUP BY 1 HAVING count(*) > 1")
def same_origin(spark: SparkSession, sf: str) -> DataFrame:
    return rules.groups_above_one(table(spark, sf, "pages"), F.regexp_extract("url", "^https?://([^/?#]+)", 1), "page_id")


@query("SELECT lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))) AS key, count(*)::BIGINT AS n, min(page_id) AS first_member, max(page_id) AS last_member FROM pages GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    return rules.groups_above_one(table(spark, sf, "pages"), F.lower(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))), "page_id")


@query()
def similar_top5(spark: SparkSession, sf: str) -> DataFrame:
    """The five documents most similar to a candidate (the document of the smallest id), at 0.82 or more."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    first = d.orderBy("doc_id").limit(1).collect()
    candidate = X_key(first[0].text) if first else ""
    n, own = F.length("key"), len(candidate)
    d = d.select("doc_id", X.text_key(F.col("text")).alias("key")).filter(2 * F.least(n, F.lit(own)) >= 0.82 * (n + own))
    got = d.select("doc_id", similarity_to(candidate, F.col("key"), 0.82).alias("ratio")).filter(F.col("ratio").isNotNull())
    return got.orderBy(F.col("ratio").desc(), "doc_id").limit(5).withColumn("ratio", F.round("ratio", 4))


def X_key(value: str) -> str:
    """``functions.text.text_key`` of one string on the driver."""
    import re

    return re.sub(X.TOKEN, "", value.lower())


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def passage_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a passage; see ``containment.contained``."""
    b = table(spark, sf, "benchmark").select("item_id", "text")
    return containment.contained(table(spark, sf, "documents").select("doc_id", "text"), b, "text").select("doc_id", "item_id")


# --- intervals and coverage ----------------------------------------------------------------------------------------

_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line_no FROM documents),
m AS (SELECT * FROM l WHERE trim(line) <> '')"""


@query(
    f"""WITH {_LINES}, u AS (SELECT doc_id, line_no FROM m WHERE length(line) % 5 <> 0),
    g AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM u)
    SELECT doc_id, min(line_no)::BIGINT AS first, max(line_no)::BIGINT AS last FROM g GROUP BY doc_id, g"""
)
def unregistered_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of lines that no registration covers; registered are the lines of a length divisible by 5."""
    m = block_explode(spark, sf)
    registered = m.filter(F.length("block") % 5 == 0).select("doc_id", "line_no")
    return intervals.islands(m.select("doc_id", "line_no").join(registered, ["doc_id", "line_no"], "left_anti"), ["doc_id"], "line_no")


@query(
    f"""WITH {_LINES}, r AS (SELECT doc_id, line_no, length(line) % 7 = 0 AS waiting FROM m WHERE length(line) % 3 <> 0)
    SELECT m.doc_id, count(*)::BIGINT AS meaningful, count(r.line_no)::BIGINT AS covered, 0::BIGINT AS outside, coalesce(sum(waiting::INT), 0)::BIGINT AS waiting,
    CASE WHEN coalesce(sum(waiting::INT), 0) > 0 OR count(r.line_no) < count(*) THEN 'open' ELSE 'closed' END AS status
    FROM m LEFT JOIN r ON m.doc_id = r.doc_id AND m.line_no = r.line_no GROUP BY 1"""
)
def coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    m = block_explode(spark, sf).withColumnRenamed("line_no", "line")
    n = F.length("block")
    r = m.filter(n % 3 != 0).select("doc_id", "line", F.when(n % 7 == 0, "waiting").otherwise("kept").alias("status"))
    return intervals.coverage(m, r, "doc_id")


@query(
    """WITH c AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 10.0::DOUBLE AS start,
    length(text) / 10.0::DOUBLE AS len FROM conversations)
    SELECT conv_id, turn, round(start, 6) AS start, round(start + len, 6) AS stop FROM c WHERE start < 60.0 AND start + len > 10.0"""
)
def interval_overlap_clip(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    c = intervals.running_before(c, ["conv_id"], "turn", "n", "before")
    c = c.select("conv_id", "turn", (F.col("before") / 10.0).alias("start"), (F.col("n") / 10.0).alias("len"))
    c = c.filter(intervals.overlaps(F.col("start"), F.col("start") + F.col("len"), F.lit(10.0), F.lit(60.0)))
    return c.select("conv_id", "turn", F.round("start", 6).alias("start"), F.round(F.col("start") + F.col("len"), 6).alias("stop"))


@query("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM conversations")
def running_offsets(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return intervals.running_before(c, ["conv_id"], "turn", "n", "before").select("conv_id", "turn", F.col("before").cast("long").alias("offset"))


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM events),
    g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM e)
    SELECT user_id, count(*)::BIGINT AS n, round(max(gap), 3) AS max_gap, coalesce(bool_and(gap > 0 AND gap <= 3600), true) AS regular FROM g GROUP BY 1"""
)
def timestamp_gaps(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return intervals.gap_check(e, ["user_id"], "t", 3600).withColumn("max_gap", F.round("max_gap", 3))


@query(
    """SELECT conv_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS length_clock
    FROM (SELECT conv_id, sum(length(text))::BIGINT AS s FROM conversations GROUP BY 1)"""
)
def transcript_clock(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("s"))
    return c.select("conv_id", X.clock(F.col("s")).alias("length_clock"))


# --- differences and merges ----------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders")
    old = o.filter(F.col("o_orderkey") % 7 != 0).select("o_orderkey", F.col("o_orderstatus").alias("state"))
    change = F.when(F.col("o_orderdate") >= CUT, F.concat("o_orderstatus", F.lit("*"))).otherwise(F.col("o_orderstatus"))
    return old, o.filter(F.col("o_orderkey") % 11 != 0).select("o_orderkey", change.alias("state"))


_SNAP = f"""o AS (SELECT o_orderkey, o_orderstatus AS old_state FROM orders WHERE o_orderkey % 7 <> 0),
n AS (SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '{CUT}' THEN o_orderstatus || '*' ELSE o_orderstatus END AS new_state FROM orders WHERE o_orderkey % 11 <> 0)"""


@query(
    f"""WITH {_SNAP} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed'
    WHEN old_state = new_state THEN 'unchanged' ELSE 'modified' END AS kind, old_state, new_state FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey"""
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    return diff.snapshot_diff(*_snapshots(spark, sf), "o_orderkey", "state")


_MOVED = """o AS (SELECT c_custkey AS k, md5(c_name) AS h FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT -1, md5('x')),
n AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS k, md5(c_name) AS h FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT -2, md5('x') UNION ALL SELECT -3, md5('x'))"""


@query(
    f"""WITH {_MOVED}, g AS (SELECT h, count(*) AS c, min(k) AS k FROM o WHERE k NOT IN (SELECT k FROM n) GROUP BY 1),
    a AS (SELECT h, count(*) AS c, min(k) AS k FROM n WHERE k NOT IN (SELECT k FROM o) GROUP BY 1)
    SELECT g.h AS state, g.k AS old_key, a.k AS new_key, CASE WHEN g.c = 1 AND a.c = 1 THEN 'renamed' ELSE 'ambiguous' END AS kind FROM g JOIN a ON g.h = a.h"""
)
def rename_candidates(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter(F.col("c_custkey") % 3 != 0).select(F.col("c_custkey").alias("k"), F.md5("c_name").alias("h"))
    x = spark.range(1).select(F.md5(F.lit("x")).alias("h"))
    old = c.unionByName(x.select(F.lit(-1).cast("long").alias("k"), "h"))
    new = c.select(F.when(F.col("k") % 5 == 0, F.col("k") + 1_000_000_000).otherwise(F.col("k")).alias("k"), "h")
    new = new.unionByName(x.select(F.explode(F.array(F.lit(-2).cast("long"), F.lit(-3).cast("long"))).alias("k"), "h"))
    return diff.renames(diff.snapshot_diff(old, new, "k", "h"), "k")


@query(
    """WITH e AS (SELECT p_name || '/' || p_partkey AS path, p_size AS size, sha256(p_brand) AS h FROM part WHERE p_partkey % 10 <> 0),
    a AS (SELECT p_name || '/' || p_partkey AS path, CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS size, sha256(p_brand) AS h FROM part WHERE p_partkey % 9 <> 0),
    j AS (SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.h IS NULL THEN 'missing' WHEN e.h IS NULL THEN 'extra' WHEN e.size <> a.size OR e.h <> a.h THEN 'changed' END AS status
    FROM e FULL JOIN a ON e.path = a.path) SELECT * FROM j WHERE status IS NOT NULL"""
)
def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit("/"), "p_partkey").alias("path"), F.col("p_size").alias("size"), F.sha2("p_brand", 256).alias("sha256"))
    a = p.filter("p_partkey % 9 != 0").withColumn("size", F.when(F.col("p_partkey") % 13 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return diff.manifest_diff(p.filter("p_partkey % 10 != 0"), a)


@query(
    """WITH r AS (SELECT source, sha256(doc_id::VARCHAR || '/' || text) AS d FROM documents),
    i AS (SELECT source, substr(d, 1, 3) AS b, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY d)) AS h FROM r GROUP BY 1, 2)
    SELECT source, sum(n)::BIGINT AS n_rows, sha256(string_agg(b || ':' || h, chr(10) ORDER BY b || ':' || h)) AS fingerprint FROM i GROUP BY 1"""
)
def corpus_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("/"), "text"), 256).alias("d"))
    return diff.fingerprint(d, ["source"], "d")


@query(
    """WITH c AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 4 <> 0),
    u AS (SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE c_acctbal + 1 END AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)
    SELECT coalesce(c.c_custkey, u.c_custkey) AS c_custkey, c_name, CASE WHEN u.c_custkey IS NOT NULL THEN u.c_mktsegment ELSE c.c_mktsegment END AS c_mktsegment,
    CASE WHEN u.c_custkey IS NOT NULL THEN u.c_acctbal ELSE c.c_acctbal END AS c_acctbal,
    CASE WHEN u.c_custkey IS NULL THEN 'keep' WHEN c.c_custkey IS NULL THEN 'insert' WHEN c.c_mktsegment = u.c_mktsegment AND c.c_acctbal = u.c_acctbal THEN 'same' ELSE 'update' END AS action
    FROM c FULL JOIN u ON c.c_custkey = u.c_custkey"""
)
def keyed_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    bal = F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).otherwise(F.col("c_acctbal") + 1)
    u = c.filter("c_custkey % 3 = 0").select("c_custkey", F.upper("c_mktsegment").alias("c_mktsegment"), bal.alias("c_acctbal"))
    return diff.keyed_merge(c.filter("c_custkey % 4 != 0"), u, "c_custkey", ["c_mktsegment", "c_acctbal"])


@query("SELECT c_custkey, 'AFK-' || upper(substr(sha256(c_name || chr(0) || c_mktsegment), 1, 12)) AS key FROM customer")
def stable_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", X.stable_key("AFK-", F.col("c_name"), F.col("c_mktsegment")).alias("key"))


# --- graphs --------------------------------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT p_partkey AS id, lower(p_name || '/' || p_brand || '/' || p_type) AS f, lower(p_name || '/' || p_brand) AS p, lower(p_name) AS s FROM part),
    l AS (SELECT p_partkey AS link_id, CASE p_partkey % 4 WHEN 0 THEN lower(p_name || '/' || p_brand || '/' || p_type) END AS f,
    CASE p_partkey % 4 WHEN 1 THEN lower(p_name || '/' || p_brand) END AS p, CASE p_partkey % 4 WHEN 2 THEN lower(p_name) WHEN 3 THEN lower(p_name) || '?' END AS s FROM part),
    f AS (SELECT f, min(id) AS id, count(*) AS n FROM t GROUP BY 1), p AS (SELECT p, min(id) AS id, count(*) AS n FROM t GROUP BY 1), s AS (SELECT s, min(id) AS id, count(*) AS n FROM t GROUP BY 1),
    j AS (SELECT link_id, coalesce(CASE WHEN f.n = 1 THEN f.id END, CASE WHEN p.n = 1 THEN p.id END, CASE WHEN s.n = 1 THEN s.id END) AS target_id,
    greatest(coalesce(f.n, 0), coalesce(p.n, 0), coalesce(s.n, 0)) AS n FROM l LEFT JOIN f ON l.f = f.f LEFT JOIN p ON l.p = p.p LEFT JOIN s ON l.s = s.s)
    SELECT link_id, target_id, CASE WHEN target_id IS NOT NULL THEN 'hit' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS reason FROM j"""
)
def link_resolution(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    full, part, stem = (F.lower(F.concat_ws("/", *c)) for c in (["p_name", "p_brand", "p_type"], ["p_name", "p_brand"], ["p_name"]))
    targets = p.select(F.col("p_partkey").alias("target_id"), full.alias("full"), part.alias("partial"), stem.alias("stem"))
    way = F.col("p_partkey") % 4
    links = p.select(
        F.col("p_partkey").alias("link_id"), F.when(way == 0, full).alias("full"), F.when(way == 1, part).alias("partial"),
        F.when(way == 2, stem).when(way == 3, F.concat(stem, F.lit("?"))).alias("stem"),
    )
    return graph.resolve_links(links, targets)


_PAIRS = "e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_suppkey <> l_partkey)"


@query(f"WITH {_PAIRS} SELECT e.a, e.b, r.a IS NOT NULL AS mutual FROM e LEFT JOIN e r ON r.a = e.b AND r.b = e.a")
def reciprocal_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and parts as nodes of one graph, by their numbers."""
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return graph.reciprocal(e.filter("a != b"))


@query(
    """WITH d AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag <> 'A'), c AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_linenumber > 1)
    SELECT coalesce(d.a, c.a) AS a, coalesce(d.b, c.b) AS b, CASE WHEN d.a IS NULL THEN 'declaration' ELSE 'citation' END AS missing
    FROM d FULL JOIN c ON d.a = c.a AND d.b = c.b WHERE d.a IS NULL OR c.a IS NULL"""
)
def one_way_links(spark: SparkSession, sf: str) -> DataFrame:
    item = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), "l_returnflag", "l_linenumber")
    return graph.one_way(item.filter("l_returnflag != 'A'"), item.filter("l_linenumber > 1"))


@query(
    """SELECT 'order_without_lines' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 2)
    UNION ALL SELECT 'customer_without_orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def traceability_gaps(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    item = table(spark, sf, "lineitem").filter("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey"))
    one = o.join(item, "o_orderkey", "left_anti").select(F.lit("order_without_lines").alias("kind"), F.col("o_orderkey").alias("id"))
    two = c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.lit("customer_without_orders").alias("kind"), F.col("c_custkey").alias("id"))
    return one.unionByName(two)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def islands(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


_EDGES = """edges AS (SELECT DISTINCT 'n' || n_nationkey AS dependent, 'r' || n_regionkey AS dependency FROM nation
UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""


@query(
    f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT 'r1' AS trigger, 'r1' AS target, 0 AS depth, 'r1' AS chain
    UNION ALL SELECT trigger, dependent, depth + 1, chain || '>' || dependent FROM walk JOIN edges ON dependency = target WHERE depth < 8)
    SELECT trigger, target, min(depth)::INT AS depth, arg_min(chain, (depth, chain)) AS chain FROM walk GROUP BY 1, 2"""
)
def impact_propagation(spark: SparkSession, sf: str) -> DataFrame:
    def side(name: str, a: str, ka: str, b: str, kb: str) -> DataFrame:
        return table(spark, sf, name).select(F.concat(F.lit(a), ka).alias("dependent"), F.concat(F.lit(b), kb).alias("dependency"))

    edges = side("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(side("customer", "c", "c_custkey", "n", "c_nationkey"))
    edges = edges.unionByName(side("supplier", "s", "s_suppkey", "n", "s_nationkey"))
    got = graph.impact(spark.range(1).select(F.lit("r1").alias("node")), edges)
    return got.withColumn("chain", F.array_join("chain", ">"))


@query(
    """WITH RECURSIVE g AS (SELECT p_partkey AS a, p_partkey // 5 AS b FROM part WHERE p_partkey >= 5 UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey % 97 = 0),
    walk AS (SELECT a, b FROM g UNION SELECT walk.a, g.b FROM walk JOIN g ON walk.b = g.a) SELECT a, b FROM walk"""
)
def dependency_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that are made of each other, by their numbers: pairs grow with the parts times the depth."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("a"))
    return graph.closure(p.filter("a >= 5").selectExpr("a", "a div 5 as b").unionByName(p.filter("a % 97 = 0").selectExpr("a", "a div 2 as b")))


@query(
    """WITH RECURSIVE g AS (SELECT p_partkey AS a, p_partkey // 10 * 10 + (p_partkey * 7 + 3) % 10 AS b FROM part WHERE p_partkey % 10 NOT IN (7, 9) UNION SELECT p_partkey, p_partkey // 10 FROM part WHERE p_partkey % 10 = 6),
    walk AS (SELECT a, b FROM g UNION SELECT walk.a, g.b FROM walk JOIN g ON walk.b = g.a) SELECT DISTINCT a AS node FROM walk WHERE a = b"""
)
def cycle_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in rings of their ten, and ways from one ten to another that close none."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("a"))
    ring = p.filter("a % 10 not in (7, 9)").selectExpr("a", "a div 10 * 10 + (a * 7 + 3) % 10 as b")
    return graph.cycle_nodes(ring.unionByName(p.filter("a % 10 = 6").selectExpr("a", "a div 10 as b")))


@query(
    """WITH p AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'), k AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    SELECT o_orderkey, o_custkey FROM p WHERE o_custkey NOT IN (SELECT c_custkey FROM k)
    UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"""
)
def pending_acknowledgement(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    known = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    carried = o.filter("o_orderstatus = 'P'").join(known, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")
    return carried.unionByName(o.filter("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey"))


# --- dashboards, selections, pages -----------------------------------------------------------------------------------


@query(
    """SELECT source, count(*)::BIGINT AS n, count(*) FILTER (WHERE lang = 'en')::BIGINT AS n_en, count(quality)::BIGINT AS labelled,
    count(*) FILTER (WHERE quality = 0)::BIGINT AS weak, count(*) FILTER (WHERE toxic = 1)::BIGINT AS conflicts FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"""
)
def status_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count("quality").alias("labelled"),
        F.count_if(F.col("quality") == 0).alias("weak"), F.count_if(F.col("toxic") == 1).alias("conflicts"),
    )


@query(
    """WITH j AS (SELECT d.doc_id, quality, toxic, text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT 'understanding' AS queue, doc_id FROM j WHERE quality = 0 UNION ALL SELECT 'conflict', doc_id FROM j WHERE toxic = 1
    UNION ALL SELECT 'deposit', doc_id FROM j WHERE quality IS NULL UNION ALL SELECT 'unanswered', doc_id FROM j WHERE contains(text, '?')"""
)
def queue_lists(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.contains("text", F.lit("?")).alias("asks")).join(table(spark, sf, "labels"), "doc_id", "left")
    queues = {"understanding": F.col("quality") == 0, "conflict": F.col("toxic") == 1, "deposit": F.col("quality").isNull(), "unanswered": F.col("asks")}
    return rules.violations(d, "doc_id", queues).select(F.col("code").alias("queue"), "doc_id")


@query(
    r"""SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE length(text) < 50)::BIGINT AS short, count(*) FILTER (WHERE contains(text, 'icense'))::BIGINT AS licensed,
    count(*) FILTER (WHERE regexp_matches(text, '[^(]https?://'))::BIGINT AS naked_links, count(DISTINCT source)::BIGINT AS sources FROM documents"""
)
def audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(
        F.count("*").alias("n"), F.count_if(F.length("text") < 50).alias("short"), F.count_if(F.contains("text", F.lit("icense"))).alias("licensed"),
        F.count_if(F.col("text").rlike("[^(]https?://")).alias("naked_links"), F.countDistinct("source").alias("sources"),
    )


@query(
    r"""WITH i AS (SELECT 'short' AS kind FROM documents WHERE length(text) < 50 UNION ALL SELECT 'secret' FROM documents WHERE regexp_matches(text, 'token\s*=\s*"')
    UNION ALL SELECT 'no_label' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT kind, count(*)::BIGINT AS n FROM i GROUP BY 1"""
)
def issue_histogram(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    seen = d.join(table(spark, sf, "labels").select("doc_id").distinct().withColumn("l", F.lit(True)), "doc_id", "left")
    codes = {"short": F.length("text") < 50, "secret": F.col("text").rlike(r'token\s*=\s*"'), "no_label": F.col("l").isNull()}
    return rules.violations(seen, "doc_id", codes).groupBy(F.col("code").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*)::BIGINT AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ROLLUP (lang, source)")
def storage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query(
    """WITH e AS (SELECT quality, CASE WHEN contains(text, '|') OR contains(text, '!!') OR contains(text, '$$') THEN 0 ELSE 1 END AS guess, length(text) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
    SELECT count(*)::BIGINT AS n, round(avg((guess = quality)::INT), 6) AS top1, round(avg(CASE WHEN quality = 0 THEN (guess = 0)::INT END), 6) AS gap_accuracy,
    round(avg(n), 6) AS avg_chars, max(n)::BIGINT AS max_chars, avg((guess = quality)::INT) >= 0.9 AS passed FROM e"""
)
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    guess = F.when(t.contains("|") | t.contains("!!") | t.contains("$$"), 0).otherwise(1)
    e = table(spark, sf, "documents").select("doc_id", guess.alias("guess"), F.length("text").alias("n")).join(table(spark, sf, "labels"), "doc_id")
    hit = (F.col("guess") == F.col("quality")).cast("int")
    return e.agg(
        F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("top1"), F.round(F.avg(F.when(F.col("quality") == 0, hit)), 6).alias("gap_accuracy"),
        F.round(F.avg("n"), 6).alias("avg_chars"), F.max("n").cast("long").alias("max_chars"), (F.avg(hit) >= 0.9).alias("passed"),
    )


@query(
    """SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal < 9000
    ORDER BY c_mktsegment <> 'BUILDING', CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END, c_acctbal, lower(c_name), c_custkey LIMIT 1"""
)
def review_target(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_acctbal < 9000")
    tier = F.when(F.col("c_acctbal") < 0, 0).when(F.col("c_acctbal") < 5000, 1).otherwise(2)
    order = [(F.col("c_mktsegment") != "BUILDING").asc(), tier.asc(), F.col("c_acctbal").asc(), F.lower("c_name").asc(), F.col("c_custkey").asc()]
    return rules.least(c, order, ["c_custkey", "c_name", "c_mktsegment"])


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'blocker' WHEN o_totalprice < 1000 THEN 'invalid_source' WHEN o_orderpriority = '1-URGENT' THEN 'selected_question'
    WHEN o_orderdate >= DATE '1998-01-01' THEN 'current_task' WHEN o_orderstatus = 'O' THEN 'focus_topic' ELSE 'none' END AS action FROM orders"""
)
def priority_cascade(spark: SparkSession, sf: str) -> DataFrame:
    action = (
        F.when(F.col("o_orderstatus") == "P", "blocker").when(F.col("o_totalprice") < 1000, "invalid_source")
        .when(F.col("o_orderpriority") == "1-URGENT", "selected_question").when(F.col("o_orderdate") >= "1998-01-01", "current_task")
        .when(F.col("o_orderstatus") == "O", "focus_topic").otherwise("none")
    )
    return table(spark, sf, "orders").select("o_orderkey", action.alias("action"))


@query(
    """WITH s AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS c FROM documents)
    SELECT source, doc_id, rn::INT AS rank, (c - 2)::BIGINT AS deferred FROM s WHERE rn <= 2"""
)
def paged_followup(spark: SparkSession, sf: str) -> DataFrame:
    """Two a source: ranks are cut to two before the shuffle, counts are combined before theirs."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.length("text").alias("n"))
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.col("n").desc(), "doc_id"))
    best = d.withColumn("rank", rank).filter("rank <= 2").select("source", "doc_id", "rank")
    counts = d.groupBy(F.col("source").alias("s")).agg((F.count("*") - 2).alias("deferred"))
    return best.join(counts, F.col("source").eqNullSafe(F.col("s"))).select("source", "doc_id", "rank", "deferred")


@query(
    """WITH s AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM conversations)
    SELECT conv_id, turn, n::INT AS n, c::BIGINT AS used FROM s WHERE c <= 400"""
)
def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    c = intervals.running_before(c, ["conv_id"], "turn", "n", "before")
    return c.select("conv_id", "turn", "n", (F.col("before") + F.col("n")).alias("used")).filter("used <= 400")


@query(
    """SELECT doc_id, substr(text, 101, 200) AS page, len(string_split(substr(text, 1, 100), chr(10)))::INT AS first_line, length(text) > 300 AS truncated,
    sha256(text) AS document_hash FROM documents"""
)
def paged_read(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.substring("text", 101, 200).alias("page"), F.size(F.split(F.substring("text", 1, 100), "\n")).alias("first_line"),
        (F.length("text") > 300).alias("truncated"), F.sha2("text", 256).alias("document_hash"),
    )


# --- rules, scans, views ---------------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey AS id, 'price' AS code FROM orders WHERE o_totalprice < 2000 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT o_orderkey, 'priority' FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice > 300000 UNION ALL SELECT c_custkey, 'balance' FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT doc_id, 'text' FROM documents WHERE length(text) < 20"""
)
def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id")
    codes = {
        "price": F.col("o_totalprice") < 2000, "status": ~F.col("o_orderstatus").isin("O", "F"),
        "priority": (F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") > 300000),
    }
    c = rules.violations(table(spark, sf, "customer").withColumnRenamed("c_custkey", "id"), "id", {"balance": F.col("c_acctbal") < 0})
    d = rules.violations(table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), "id", {"text": F.length("text") < 20})
    return rules.violations(o, "id", codes).unionByName(c).unionByName(d)


@query(
    """WITH e AS (SELECT event_id, list_filter(['a', 'k', 'page', 'ref'], lambda k: json_extract_string(props, '$.' || k) IS NULL) AS m FROM events)
    SELECT event_id, array_to_string(m, ',') AS missing, len(m) = 0 AS compatible FROM e"""
)
def required_fields(spark: SparkSession, sf: str) -> DataFrame:
    need = ["a", "k", "page", "ref"]
    missing = F.filter(F.array(*[F.when(F.get_json_object("props", f"$.{k}").isNull(), F.lit(k)) for k in need]), lambda x: x.isNotNull())
    e = table(spark, sf, "events").select("event_id", missing.alias("m"))
    return e.select("event_id", F.array_join("m", ",").alias("missing"), (F.size("m") == 0).alias("compatible"))


_SECRETS = {
    "token": r'(?:token|secret|password|api_key)\s*[:=]\s*"[^"]{8,}"',
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "drive_path": r"[A-Za-z]:\\[A-Za-z]",
}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS code FROM documents WHERE regexp_matches(text, '{p}')" for k, p in _SECRETS.items()))
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return rules.violations(table(spark, sf, "documents"), "doc_id", {k: F.col("text").rlike(p) for k, p in _SECRETS.items()})


@query(
    r"""SELECT page_id, CASE WHEN starts_with(u, '/') THEN 'absolute' WHEN regexp_matches(u, '^[A-Za-z]:') THEN 'drive' WHEN list_contains(string_split(u, '/'), '..') THEN 'parent'
    WHEN contains(u, ':') THEN 'colon' WHEN len(list_filter(string_split(u, '/'), lambda p: regexp_matches(p, '^\.[A-Za-z]'))) > 0 THEN 'hidden'
    WHEN regexp_matches(lower(u), '\.(key|pem|pfx|env)$') THEN 'denied_suffix' END AS reason
    FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '/' || url WHEN 2 THEN 'a/../b' WHEN 3 THEN 'c:/' || page_id ELSE 'notes/.git/x' || page_id END AS u FROM pages)"""
)
def path_safety(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    u = F.when(i % 5 == 0, F.col("url")).when(i % 5 == 1, F.concat(F.lit("/"), "url")).when(i % 5 == 2, "a/../b").when(i % 5 == 3, F.concat(F.lit("c:/"), i)).otherwise(F.concat(F.lit("notes/.git/x"), i))
    return table(spark, sf, "pages").select("page_id", X.exclusion_reason(u).alias("reason"))


_PREFIXES = r"""p AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^https?://([^?#]+)', 1), '/$', '') AS path FROM pages),
q AS (SELECT path FROM p UNION SELECT regexp_extract(path, '^[^/]+', 0) FROM p WHERE length(path) % 4 = 0)"""


@query(f"WITH {_PREFIXES} SELECT path FROM q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.path <> q.path AND starts_with(q.path, o.path || '/'))")
def prefix_dominance(spark: SparkSession, sf: str) -> DataFrame:
    """Paths without an ancestor among them: each path's own ancestors are made, then one anti join."""
    p = table(spark, sf, "pages").select(F.regexp_replace(F.regexp_extract("url", "^https?://([^?#]+)", 1), "/$", "").alias("path")).distinct()
    q = p.unionByName(p.filter(F.length("path") % 4 == 0).select(F.regexp_extract("path", "^[^/]+", 0).alias("path"))).distinct()
    return _undominated(q)


def _undominated(q: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    above = q.filter(F.size(parts) > 1).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("up"))
    covered = above.join(q.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    return q.join(covered, "path", "left_anti")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber::BIGINT AS line FROM lineitem), e AS (SELECT o_orderkey AS l_orderkey, unnest(generate_series(1, 4))::BIGINT AS line FROM orders)
    SELECT 'missing' AS kind, * FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT 'extra', * FROM (SELECT * FROM a EXCEPT SELECT * FROM e)
    UNION ALL SELECT 'duplicate', l_orderkey, line FROM a GROUP BY ALL HAVING count(*) > 1"""
)
def expected_vs_actual(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("line")).agg(F.count("*").alias("n"))
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("line"), F.lit(True).alias("e"))
    both = a.join(e, ["l_orderkey", "line"], "full")
    kinds = {"missing": F.col("n").isNull(), "extra": F.col("e").isNull(), "duplicate": F.col("n") > 1}
    found = F.filter(F.array(*[F.when(w, F.lit(k)) for k, w in kinds.items()]), lambda x: x.isNotNull())
    return both.select(F.explode(found).alias("kind"), "l_orderkey", "line")


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src0' ORDER BY doc_id")
def view_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("lang = 'en' and source = 'src0'").select("doc_id", "source", "n_chars").orderBy("doc_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_orderstatus IS NULL OR o_orderstatus <> 'F') ORDER BY o_orderdate DESC, o_orderkey")
def view_undeposited(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus").isNull() | (F.col("o_orderstatus") != "F")))
    return o.orderBy(F.col("o_orderdate").desc(), "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def view_latest(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(10)
    return o.select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    """WITH t AS (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY 1)
    SELECT o_custkey, array_to_string(kinds, ',') AS kinds FROM t WHERE len(kinds) > 1 AND list_contains(kinds, '1-URGENT')"""
)
def view_involved(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("kinds"))
    return t.filter((F.size("kinds") > 1) & F.array_contains("kinds", "1-URGENT")).select("o_custkey", F.array_join("kinds", ",").alias("kinds"))


@query(
    """SELECT conv_id, turn, regexp_extract(text, '([^.?!]*[,][^.?!]*[.?!])', 1) AS task FROM conversations WHERE role = 'user' AND contains(text, ',') ORDER BY conv_id, turn"""
)
def view_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """The first sentence with a comma of each turn that has one (no turn of the tables asks a question)."""
    c = table(spark, sf, "conversations").filter((F.col("role") == "user") & F.contains("text", F.lit(",")))
    return c.select("conv_id", "turn", F.regexp_extract("text", "([^.?!]*[,][^.?!]*[.?!])", 1).alias("task")).orderBy("conv_id", "turn")


@query(
    """SELECT lang, (arg_min(doc_id, (length(text), doc_id)))::BIGINT AS smallest, (arg_max(doc_id, (length(text), -doc_id)))::BIGINT AS largest FROM documents GROUP BY 1"""
)
def preference_argmin(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("lang", "doc_id", F.length("text").alias("n"))
    return d.groupBy("lang").agg(F.min_by("doc_id", F.struct("n", "doc_id")).alias("smallest"), F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("largest"))


# --- extensions: not among the reference's operators ---------------------------------------------------------------


@query(
    """SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*)::BIGINT AS n FROM events GROUP BY 1, 2"""
)
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"))
