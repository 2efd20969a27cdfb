"""Line deduplication by a suffix array over line ids (DataFrame operations only).

Every text is a sequence of line ids. Prefix doubling sorts the suffixes: at level k a position has the rank of the
2**k lines that begin there, and level k + 1 ranks the pairs of ranks (at the position, 2**k further on). A rank is a
row's place in a range-partitioned sort, so no step sees all rows. A block that occurs once is resolved and leaves;
what stays are the intervals of the suffix array whose longest common prefix is 2**k lines or more.

A run of lines is a repeat if it has ``min_words`` words and occurs earlier, in the order of (doc_id, line). Any such
run is covered by repeated *minimal* runs, those that reach ``min_words`` at their last line, or, read backwards, at
their first, and these have ``min_words`` lines at most; so the doubling ends after log2(min_words) levels. Two
minimal runs of m lines are equal if they share the interval at their first and at their last 2**k lines (2**k <= m <
2**(k+1)), and a digest of all their lines by another hash, so that no deletion rests on a single 64-bit id. Minimal
runs that continue each other in both places make the maximal repeated runs (``maximal_runs``). Of equal runs the first
stays whole; the lines of all others are deleted, and with a line the blank lines right behind it.

Hot lines are counted before they are shuffled and looked up by broadcast (see ``attach``).

Defined cases: null stays null and blank texts stay as they are; rows with the same doc_id and the same text are one
document, edited alike; a null doc_id comes first; lines are compared without the white space around them; a text of
which nothing is left is empty; further columns, whatever their names, pass through ``deduplicated`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.llm.common import ROW, read, tucked, untucked
from marginalia.plans.skew import attach, small
from marginalia.plans.storage import discard, materialize

MIN_WORDS = 50
DOC = ["k1", "k2"]
SPACES = " \t\n\r\x0b\x0c"


def pieces(text: Column) -> Column:
    """The lines of a text, each with the blank lines behind it; joined by line feeds they are the text again."""
    return F.split(text, r"\n(?=[ \t\x0B\f\r]*+[^\s])")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("k1", F.xxhash64("doc_id")).withColumn("k2", F.xxhash64("text"))


def line_table(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, i, h, g, wc): the non-blank lines by two hashes; once for rows with the same doc_id and text."""
    rows = _keyed(docs.select("doc_id", "text")).select(*DOC, "doc_id", F.posexplode(pieces(F.col("text"))).alias("i", "line"))
    line = F.btrim("line", F.lit(SPACES))
    rows = rows.select(*DOC, "doc_id", "i", F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"), F.regexp_count("line", F.lit(r"[^\s]+")).alias("wc"))
    return materialize(rows.filter(F.col("wc") > 0), "lines")


def _ranks(keys: DataFrame, order: list[str]) -> DataFrame:
    """``keys`` with ``rank``, ascending in the sort by ``order``: a place in a range partition, then in its sort."""
    return materialize(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _named(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` whose ``key`` occurs twice or more, with the key's rank as ``r``."""
    keys = rows.groupBy(key).agg(*[F.min(c).alias(c) for c in order if c != key], F.count("*").alias("n")).filter(F.col("n") > 1)
    out = attach(rows, _ranks(keys, order).select(key, "n", F.col("rank").alias("r")), key, ["r"], "n", F.struct("k2", "i"))
    return out.filter(F.col("r").isNotNull())


def _minimal_runs(level: DataFrame, min_words: int) -> DataFrame:
    """(doc, s, m, check): runs of repeated lines that reach ``min_words`` at their last line or, backwards, their
    first; ``check`` is a digest of the run's lines."""
    island = level.withColumn("g_", F.col("i") - F.row_number().over(W.partitionBy(*DOC).orderBy("i")))
    order = W.partitionBy(*DOC, "g_").orderBy("i")

    def length(lines: Column) -> Column:
        start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("m"))
        end = F.aggregate(lines, start, lambda a, x: F.when(a["w"] >= min_words, a).otherwise(F.struct((a["w"] + x["wc"]).alias("w"), (a["m"] + 1).alias("m"))))
        return F.when(end["w"] >= min_words, end["m"])

    def check(lines: Column) -> Column:
        return F.xxhash64(F.transform(lines, lambda x: x["g"]))

    line = F.struct("wc", "g")
    runs = island.withColumn("ahead", F.collect_list(line).over(order.rowsBetween(0, min_words - 1)))
    runs = runs.withColumn("behind", F.reverse(F.collect_list(line).over(order.rowsBetween(-(min_words - 1), 0))))
    runs = runs.withColumn("f", length(F.col("ahead"))).withColumn("b", length(F.col("behind")))
    fore = F.struct(F.col("i").alias("s"), F.col("f").alias("m"), check(F.slice("ahead", 1, F.col("f"))).alias("check"))
    back = F.struct((F.col("i") - F.col("b") + 1).alias("s"), F.col("b").alias("m"), check(F.reverse(F.slice("behind", 1, F.col("b")))).alias("check"))
    both = F.array(F.when(F.col("f").isNotNull(), fore), F.when(F.col("b").isNotNull(), back))
    runs = runs.select(*DOC, "doc_id", F.explode(F.filter(F.array_distinct(both), lambda x: x.isNotNull())).alias("x"))
    return runs.select(*DOC, "doc_id", "x.s", "x.m", "x.check").distinct()


def _at(runs: DataFrame, level: DataFrame, place: Column, name: str) -> DataFrame:
    ranks = level.select(*[F.col(c).alias(f"_{c}") for c in DOC], F.col("i").alias("_i"), F.col("r").alias(name))
    return runs.join(ranks, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (place == F.col("_i"))).drop("_k1", "_k2", "_i")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, s, m, first) for every minimal run that occurs earlier: m lines from line s on, and where they are first."""
    lines = line_table(docs)
    level = materialize(_named(lines, "h", ["h"]).drop("h"), "level")
    discard(lines)
    runs = materialize(_minimal_runs(level, min_words), "runs")
    level = level.drop("g")
    named: list[DataFrame] = [_at(runs.filter("m = 1"), level, F.col("s"), "a").withColumn("b", F.col("a"))]
    k, longest = 0, runs.agg(F.max("m")).first()[0] or 0
    while longest >= 2:
        step = 1 << k
        if k:
            mine = runs.filter((F.col("m") >= step) & (F.col("m") < 2 * step))
            named.append(_at(_at(mine, level, F.col("s"), "a"), level, F.col("s") + F.col("m") - step, "b"))
        if longest < 2 * step:
            break
        # Only positions inside runs that are longer still matter.
        ends = runs.filter(F.col("m") >= 2 * step).select(*DOC, F.explode(F.sequence("s", F.col("s") + F.col("m") - 1)).alias("i")).distinct()
        inside = level.join(ends, [*DOC, "i"])
        further = F.first("r").over(W.partitionBy(*DOC).orderBy("i").rangeBetween(step, step))
        pairs = inside.withColumn("r2", further).filter(F.col("r2").isNotNull()).withColumnRenamed("r", "r1")
        pairs = materialize(pairs.withColumn("h", F.xxhash64("r1", "r2")), "pairs")
        level = materialize(_named(pairs, "h", ["r1", "r2"]).select(*DOC, "doc_id", "i", "wc", "r"), "level")
        discard(pairs)
        k += 1
    found = named[0]
    for more in named[1:]:
        found = found.unionByName(more)
    found = materialize(found.withColumn("key", F.xxhash64("m", "a", "b")).withColumn("at", F.struct("doc_id", "k2", "s")), "named")
    first = found.groupBy("key", "check").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter(F.col("n") > 1)
    # Of one key there is one check, but for runs that share a key by chance.
    first = first.groupBy("key").agg(F.collect_list(F.struct("check", "first")).alias("firsts"), F.sum("n").alias("n"))
    later = attach(found, materialize(first, "first"), "key", ["firsts"], "n", F.col("at"))
    later = later.withColumn("first", F.get(F.filter("firsts", lambda x: x["check"] == F.col("check")), F.lit(0))["first"])
    return later.filter(F.col("at") > F.col("first")).select(*DOC, "doc_id", "s", "m", "first")


def _joined(runs: DataFrame, line: list[str]) -> DataFrame:
    """``runs`` (s, e) of each ``line`` made one where they overlap or meet."""
    order = W.partitionBy(*line).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0))
    runs = runs.withColumn("part", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*line, "part").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("part")


def maximal_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, s, e, first_doc_id, first_k2, by): the maximal runs, lines s to e, that repeat lines of an earlier place.

    They are minimal runs that overlap or meet, at one distance ``by`` from where they are first: line s is the same as
    line s - by of the document ``first_doc_id`` whose text has the hash ``first_k2``.
    """
    runs = repeated_runs(docs, min_words).withColumn("e", F.col("s") + F.col("m") - 1)
    first = {"first_doc_id": F.col("first.doc_id"), "first_k2": F.col("first.k2"), "by": F.col("s") - F.col("first.s")}
    return _joined(runs.withColumns(first), [*DOC, *first])


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, spans): for each text that loses lines, the places (first, last) of what goes, apart and in order."""
    spans = _joined(maximal_runs(docs, min_words), DOC).select(*DOC, F.struct(F.col("s").alias("first"), F.col("e").alias("last")).alias("span"))
    return materialize(spans.groupBy(*DOC).agg(F.sort_array(F.collect_list("span")).alias("spans")), "deletions")


def _edited(docs: DataFrame, min_words: int) -> DataFrame:
    """``tucked`` rows with doc_id, text, _spans (what goes) and _new (what is left of the text)."""
    gone = deletions(docs, min_words).select(F.col("k1").alias("_d1"), F.col("k2").alias("_d2"), F.col("spans").alias("_spans"))
    rows = tucked(docs, doc_id=F.col("doc_id"), text=F.col("text"), _k1=F.xxhash64("doc_id"), _k2=F.xxhash64("text"))
    rows = rows.join(small(gone), (F.col("_k1") == F.col("_d1")) & (F.col("_k2") == F.col("_d2")), "left")
    kept = F.filter(pieces(F.col("text")), lambda x, i: ~F.exists("_spans", lambda d: (i >= d["first"]) & (i <= d["last"])))
    return rows.withColumn("_new", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated runs cut out of ``text``; ``n_chars`` follows, if there is one."""
    out = _edited(docs, min_words)
    changed = {"text": F.col("_new")}
    if kind := dict(docs.dtypes).get("n_chars"):
        was = F.col(ROW).getField("n_chars")
        changed["n_chars"] = F.when(F.col("_spans").isNull(), was).otherwise(F.length("_new").cast(kind))
    return untucked(out, **changed)


def query(spark: SparkSession, sf_dir: str, min_words: int = MIN_WORDS) -> DataFrame:
    """op8: what is left of every document, as a digest, and how many lines (with the blank ones behind) went."""
    out = _edited(read(spark, sf_dir, "documents").select("doc_id", "text"), min_words)
    gone = F.aggregate(F.coalesce("_spans", F.array()), F.lit(0), lambda a, x: a + x["last"] - x["first"] + 1)
    return out.select(
        "doc_id", gone.cast("long").alias("lines_removed"), F.length("_new").cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce("_new", F.lit("")), 256).alias("text_sha256"),
    )


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
b AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS wc FROM l),
o AS (SELECT *, sum(CASE WHEN wc > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS i FROM b),
n AS (SELECT doc_id, i, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k, wc, sum(wc) OVER (PARTITION BY doc_id ORDER BY ln) AS c FROM o WHERE wc > 0),
f AS (SELECT a.doc_id, a.i AS s, min(z.i) AS e FROM n a JOIN n z ON a.doc_id = z.doc_id AND z.i BETWEEN a.i AND a.i + 49 AND z.c - a.c + a.wc >= 50 GROUP BY 1, 2),
g AS (SELECT z.doc_id, max(a.i) AS s, z.i AS e FROM n z JOIN n a ON a.doc_id = z.doc_id AND a.i BETWEEN z.i - 49 AND z.i AND z.c - a.c + a.wc >= 50 GROUP BY 1, 3),
w AS (SELECT doc_id, s, e FROM f UNION SELECT doc_id, s, e FROM g),
t AS (SELECT w.doc_id, s, e, string_agg(k, chr(10) ORDER BY i) AS run FROM w JOIN n ON n.doc_id = w.doc_id AND n.i BETWEEN s AND e GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS rn FROM t),
x AS (SELECT DISTINCT r.doc_id, n.i FROM r JOIN n ON n.doc_id = r.doc_id AND n.i BETWEEN s AND e WHERE rn > 1),
k AS (SELECT o.doc_id, string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE x.i IS NULL) AS text, count(DISTINCT x.i) AS gone
      FROM o LEFT JOIN x ON o.doc_id = x.doc_id AND o.i = x.i GROUP BY 1)
SELECT doc_id, coalesce(gone, 0)::BIGINT AS lines_removed, CASE WHEN d.text IS NOT NULL THEN length(coalesce(k.text, '')) END::BIGINT AS n_chars_left, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""
