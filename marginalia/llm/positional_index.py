"""Benchmark decontamination by a distributed positional inverted index (DataFrame operations only).

``build_index`` tokenizes every training text once and stores the postings (row, position, term) of the terms that the
tests use, with one head posting for each text that carries its words' number. A search takes windows of test words.
The terms' frequencies over the whole corpus come from the index; each window is looked up by its rarest term, and
the list is intersected, offset by offset, with the list of its second rarest: what is left are diagonals (text, item,
shift). On a diagonal the item's words are matched with the postings, and runs of matched words as long as a window
are exact phrase matches. A window with a term that the corpus lacks is dropped at once.

Nothing pairs texts with texts: rows grow with the postings of rare terms and with true matches. Test tables are
broadcast only up to a counted number of rows; beyond it the same joins shuffle, dealt out by text.

Defined cases: null and blank texts have no words; an item shorter than a window is one window; items without words
match nothing; repeated rows are texts of their own; equal items match each on their own; an item id that repeats
joins its rows' windows under that id; an empty benchmark hits nothing. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.llm.common import read
from marginalia.plans.skew import small
from marginalia.plans.storage import materialize

WINDOW = 13
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, in order; null gives none."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    parts = F.split(F.concat(F.lit(" "), low), NOT_WORD)
    parts = F.slice(parts, 2, F.size(parts))  # before the first separator stands nothing
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, copy, ipos, n, word) for every word of every item; copy tells rows with one id apart."""
    rows = items.select("item_id", F.xxhash64("text").alias("copy"), words(F.col("text")).alias("w")).distinct()
    return rows.select("item_id", "copy", F.size("w").alias("n"), F.posexplode("w").alias("ipos", "word"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings table: (row, doc_id, n_words, pos, tid), pos from 1; the head posting of a text has pos 0, tid -1.

    ``terms`` is (word, tid) without repeats. Terms are found by a 64-bit hash of the word and then compared whole.
    """
    known = terms.select(F.col("word").alias("_w"), "tid", F.xxhash64("word").alias("_h"))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    rows = rows.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "word"))
    rows = rows.withColumn("_k", F.xxhash64("word"))
    known = known.unionByName(known.sparkSession.range(1).select(F.lit("").alias("_w"), F.lit(-1).alias("tid"), F.xxhash64(F.lit("")).alias("_h")))
    out = rows.join(small(materialize(known, "terms")), (F.col("_k") == F.col("_h")) & (F.col("word") == F.col("_w")))
    return materialize(out.select("row", "doc_id", "n_words", "pos", "tid"), "postings")


def windows(tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, o, n, terms) for every window of the items (item, ipos, n, tid); o is its first word's place."""
    length = F.least(F.col("n"), F.lit(window))
    order = W.partitionBy("item").orderBy("ipos").rowsBetween(0, window - 1)
    out = tests.withColumn("terms", F.collect_list(F.struct("freq", "tid", "ipos")).over(order))
    return out.filter(F.size("terms") == length).select("item", F.col("ipos").alias("o"), "n", "terms")


def phrase_matches(index: DataFrame, tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, item, start, end): maximal runs of words of an item, as long as a window at least, in a text.

    ``tests`` is (item, ipos, n, tid), materialized; tid is null for a word that the index has no term for.
    """
    postings = index.filter(F.col("tid") >= 0).select("row", "pos", "tid")
    freq = materialize(postings.groupBy("tid").agg(F.count("*").alias("freq")), "frequencies")
    tests = tests.join(small(freq), "tid", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    tests = materialize(tests, "tests")
    found = windows(tests, window).filter(~F.exists("terms", lambda t: t["freq"] == 0))
    ranked = F.array_sort("terms")
    second = F.try_element_at(F.filter(ranked, lambda t: t["tid"] != F.element_at(ranked, 1)["tid"]), F.lit(1))
    found = found.select("item", F.element_at(ranked, 1).alias("a"), F.coalesce(second, F.element_at(ranked, -1)).alias("b"))
    found = found.select(
        "item", F.col("a.tid").alias("ta"), F.col("a.ipos").alias("pa"), F.col("b.tid").alias("tb"), (F.col("b.ipos") - F.col("a.ipos")).alias("gap")
    )
    anchors = materialize(found.distinct(), "anchors")

    rare = postings.join(small(materialize(anchors.select("ta", "tb", "gap").distinct(), "rarest")), F.col("tid") == F.col("ta"))
    rare = rare.select("row", "pos", "ta", "tb", "gap", (F.col("pos") + F.col("gap")).alias("pos_b"))
    next_terms = small(materialize(anchors.select(F.col("tb").alias("tid")).distinct(), "second"))
    other = postings.join(next_terms, "tid").select(F.col("row").alias("_r"), F.col("pos").alias("_p"), F.col("tid").alias("_t"))
    both = rare.join(other, (F.col("row") == F.col("_r")) & (F.col("pos_b") == F.col("_p")) & (F.col("tb") == F.col("_t")))
    lines = both.select("row", "pos", "ta", "tb", "gap").join(small(anchors), ["ta", "tb", "gap"])
    lines = materialize(lines.select("row", "item", (F.col("pos") - F.col("pa")).alias("shift")).distinct(), "diagonals")

    rows = small(materialize(lines.select("row").distinct(), "hit_rows"))
    within = postings.join(rows, "row")
    wanted = lines.join(small(tests.select("item", "ipos", "n", "tid")), "item")
    wanted = wanted.select("row", "item", "shift", "ipos", "n", (F.col("ipos") + F.col("shift")).alias("pos"), "tid")
    hits = wanted.join(within, ["row", "pos", "tid"])
    island = F.col("ipos") - F.row_number().over(W.partitionBy("row", "item", "shift").orderBy("ipos"))
    runs = hits.withColumn("g", island).groupBy("row", "item", "shift", "g", "n").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    runs = runs.filter(F.col("end") - F.col("start") + 1 >= F.least(F.col("n"), F.lit(window)))
    return materialize(runs.select("row", "item", "start", "end"), "runs")


def proximity_matches(index: DataFrame, tids: list[int], span: int) -> DataFrame:
    """(row, start): places from which the next ``span`` words of a text hold all of the terms ``tids``, in any order."""
    near = index.filter(F.col("tid").isin(tids)).select("row", "pos", "tid")
    ahead = W.partitionBy("row").orderBy("pos").rangeBetween(0, span - 1)
    near = near.withColumn("held", F.collect_set("tid").over(ahead))
    return near.filter(F.size("held") == len(set(tids))).select("row", F.col("pos").alias("start"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, n_words, n_hit, n_items, item_ids) for every row of ``docs``; item_ids sorted as strings."""
    tests = materialize(item_words(items), "items")
    terms = tests.select("word").distinct()
    # Numbers of terms only have to be distinct and fixed: the table is written before it is used.
    terms = materialize(terms.select("word", F.monotonically_increasing_id().alias("tid")), "vocabulary")
    terms = terms.withColumn("tid", F.col("tid").cast("long"))
    index = build_index(docs, terms)
    keyed = tests.join(small(terms), "word").select(F.struct("item_id", "copy").alias("item"), "ipos", "n", "tid")
    runs = phrase_matches(index, materialize(keyed, "keyed"), window)

    sooner = W.partitionBy("row").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.max("end").over(sooner), F.lit(-1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start") - 1, seen))
    ids = F.array_sort(F.collect_set(F.col("item.item_id").cast("string")))
    hits = runs.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"), ids.alias("item_ids"))
    heads = index.filter(F.col("tid") == -1).select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    out = heads.join(hits, "row", "left")
    return out.select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` less the contaminated rows; columns and other rows as they are. Rows of equal id and text go alike."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    bad = decontaminate(keyed, items, window).filter(contaminated())
    bad = materialize(bad.select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.h").alias("_h")).distinct(), "contaminated")
    return docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the benchmark passages in every document."""
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[o:o + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS o FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, p, dg.n FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
