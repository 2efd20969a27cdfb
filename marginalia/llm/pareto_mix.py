"""Mixing sources to target weights by Pareto order sampling.

A source's target share follows its weight; a target stops at ``cap`` times the source's size, and the excess is
shared anew by weight until no target is above (water filling). Within a source longer documents are likelier: a
document of n words is expected ``level`` times the number of n's binary digits times, ``cap`` at most, with the level
at which a source's expected words are its target. The whole copies in that are certain; the fraction p, which differs
from one length class to the next, is the probability that the document enters the sample. Documents are ranked by
q = (u / (1 - u)) / (p / (1 - p)), random odds over inclusion odds, and the smallest are taken until the words that the
source still lacks are there, to the nearest document; so the sample's size is fixed, and with it how near the target
comes. u is a uniform number hashed from doc_id, text, the number among rows equal in id, source and text, and seed.

The order within a source is never gathered in one task: words are counted in ``BUCKETS`` buckets of q for each
source, the sums of the buckets are added up, and only the documents of the bucket in which the target falls are
ordered, in pieces of the next finer buckets.

Defined cases: a null text has size 0, and is the same as an empty one; a null source is the last source; sources
without words have target 0 and take nothing; rows of equal id (or none), source and text are numbered, so each has a u
of its own; an empty table gives an empty result; further columns pass through ``mix`` untouched, but columns named ``size``
and ``copies`` are replaced by the operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.llm.common import ROW, read, tucked, untucked
from marginalia.plans.skew import small
from marginalia.plans.storage import materialize

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Buckets of the uniform number, at the first and at the second level.
BUCKETS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def class_of(size: Column) -> Column:
    """The number of binary digits of a size: the class of a length, and how much more likely such documents are."""
    return F.length(F.bin(size)).cast("long")


def uniform(seed: int = 42) -> Column:
    """A number in (0, 1) from doc_id, _digest and _copy: 52 bits of a SHA-256."""
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("_digest"), F.col("_copy").cast("string"), F.lit(str(seed)))
    return (F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


#: What tells rows apart that are to be sampled each on its own, but for their number among equals.
NAME = ("doc_id", "source", "_digest")


def numbered(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` (materialized, with their number ``_row``) with ``_copy``: 0, 1, … among rows equal in all of NAME.

    ``repeated`` are the names of what occurs more than once. Rows are counted for each table partition (the upper bits
    of ``_row``), so rows of one name are numbered within theirs and never gathered.
    """
    same = lambda right: [F.col(c).eqNullSafe(F.col(f"{right}{c}")) for c in NAME]
    keys = small(materialize(repeated.select(*[F.col(c).alias(f"k_{c}") for c in NAME]), "repeated"))
    found = rows.select("_row", *NAME).join(keys, same("k_")).select("_row", *NAME, F.shiftrightunsigned("_row", 33).alias("_part"))
    found = materialize(found, "repeats")
    parts = found.groupBy(*NAME, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*NAME).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"p_{c}") for c in NAME], F.col("_part").alias("_q"), before.alias("_before"))
    place = F.row_number().over(W.partitionBy(*NAME, "_part").orderBy("_row")) - 1
    number = found.withColumn("_place", place).join(small(materialize(parts, "parts")), [*same("p_"), F.col("_part") == F.col("_q")])
    number = number.select(F.col("_row").alias("_r"), (F.col("_before") + F.col("_place")).alias("_c"))
    return rows.join(number, F.col("_row") == F.col("_r"), "left").withColumn("_copy", F.coalesce("_c", F.lit(0)).cast("long")).drop("_r", "_c")


def targets(sizes: DataFrame, share: float = 1.0, cap: float = 3.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source, so one task suffices.

    With sources in the order of cap * size / weight, those up to some place stand at their caps, and the others share
    what is left by weight; the place is the last at which the cap is no more than the share. Beyond it ``level``, which
takes the caps of all sources before as given, only falls, so the first source's that is not full is the largest.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    got = sizes.withColumn("w", w.cast("double")).withColumn("most", F.col("source_size") * F.lit(cap))
    whole = W.partitionBy()
    up = W.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    below = up.rowsBetween(W.unboundedPreceding, -1)
    got = got.withColumn("left", F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("most").over(below), F.lit(0.0)))
    got = got.withColumn("rest", F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing)))
    got = got.withColumn("level", F.col("left") / F.col("rest")).withColumn("full", F.col("most") <= F.col("w") * F.col("level"))
    got = got.withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * F.col("water"))
    return got.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _prefix(sums: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """``sums`` with ``before``: the words of the buckets of the same ``keys`` below; BUCKETS rows a key at most."""
    order = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))


def levels(classes: DataFrame, cap: float = 3.0) -> DataFrame:
    """``classes`` (source, target, class, words) with ``times``: how often a document of a class is expected.

    Classes from the longest down stand at ``cap`` as long as the level of those that are left would carry them to it;
    the first that is not full has the level of all that follow, as in ``targets``. A source has some 40 classes.
    """
    down = W.partitionBy("source").orderBy(F.col("class").desc())
    above = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("class") * F.col("words")).over(down.rowsBetween(0, W.unboundedFollowing))
    got = classes.withColumn("level", (F.col("target") - F.lit(cap) * above) / F.nullif(rest, F.lit(0)))
    got = got.withColumn("full", F.coalesce(F.col("class") * F.col("level") >= F.lit(cap), F.lit(False)))
    got = got.withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(W.partitionBy("source")))
    times = F.when(F.col("full"), F.lit(cap)).otherwise(F.coalesce(F.col("class") * F.col("water"), F.lit(0.0)))
    return got.select("source", "target", "class", "words", F.least(times, F.lit(cap)).alias("times"))


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with _size and _u) joined with the plan of their source and class: rank _q and its buckets at two levels."""
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (class_of(F.col("_size")) == F.col("_class")), "left")
    odds = F.col("_u") / (1 - F.col("_u")) / (F.col("_p") / (1 - F.col("_p")))
    out = out.withColumn("_q", F.when(F.col("_p") > 0, odds))
    fine = F.col("_q") / (1 + F.col("_q")) * F.lit(float(BUCKETS))  # monotonic in q
    out = out.withColumn("_b1", F.floor(fine).cast("int"))
    return out.withColumn("_b2", F.floor((fine - F.floor(fine)) * F.lit(float(BUCKETS))).cast("int"))


def _crossing(sums: DataFrame) -> DataFrame:
    """Of the buckets of each source, the one in which the words reach what the source lacks."""
    return sums.filter((F.col("before") <= F.col("_lack")) & (F.col("before") + F.col("words") > F.col("_lack")))


def planned(rows: DataFrame, share: float = 1.0, cap: float = 3.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row for each source and class, from rows (doc_id, source, _size, _u): whole copies and where samples end.

    ``rows`` is read four times; give a materialized table.
    """
    classes = rows.groupBy("source", class_of(F.col("_size")).alias("class")).agg(F.sum("_size").alias("words"))
    classes = materialize(classes, "classes")
    sources = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), share, cap, weights)
    sources = materialize(sources.withColumnRenamed("source", "_s"), "sources")
    plan = classes.join(small(sources), F.col("source").eqNullSafe(F.col("_s")))
    plan = levels(plan.select("source", "target", "class", "words"), cap).withColumn("_whole", F.floor("times")).withColumn("_p", F.col("times") - F.floor("times"))
    lack = F.col("target") - F.sum(F.col("_whole") * F.col("words")).over(W.partitionBy("source"))
    plan = plan.select(F.col("source").alias("_of"), F.col("class").alias("_class"), "_whole", "_p", lack.alias("_lack"))
    plan = plan.join(small(sources), F.col("_of").eqNullSafe(F.col("_s"))).drop("_of")
    plan = materialize(plan, "plan")

    live = _ranked(rows, small(plan)).filter(F.col("_q").isNotNull())
    one = live.groupBy("_s", "_lack", "_b1").agg(F.sum("_size").alias("words"))
    one = _crossing(_prefix(one, ["_s"], "_b1"))
    one = materialize(one.select(F.col("_s").alias("_t"), F.col("_b1").alias("_c1"), F.col("before").alias("_f1")), "first")
    inner = live.join(small(one), F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_b1") == F.col("_c1")))
    two = inner.groupBy("_s", "_lack", "_f1", "_b2").agg(F.sum("_size").alias("words"))
    two = _crossing(_prefix(two, ["_s"], "_b2").withColumn("before", F.col("before") + F.col("_f1")))
    two = materialize(two.select(F.col("_s").alias("_v"), F.col("_b2").alias("_c2"), F.col("before").alias("_f2")), "second")
    last = inner.join(small(two), F.col("_s").eqNullSafe(F.col("_v")) & (F.col("_b2") == F.col("_c2")))
    up = W.partitionBy("_s").orderBy("_q", "doc_id", "_size").rowsBetween(W.unboundedPreceding, -1)
    last = last.withColumn("before", F.col("_f2") + F.coalesce(F.sum("_size").over(up), F.lit(0)))
    last = last.filter(F.col("before") + F.col("_size") / 2 <= F.col("_lack"))
    ends = last.groupBy(F.col("_s").alias("_e")).agg(F.max(_place()).alias("_end"))

    out = plan.join(small(one), F.col("_s").eqNullSafe(F.col("_t")), "left")
    out = out.join(small(two), F.col("_s").eqNullSafe(F.col("_v")), "left")
    out = out.join(ends, F.col("_s").eqNullSafe(F.col("_e")), "left")
    return materialize(out.select("_s", "_class", "source_size", "target", "_whole", "_p", "_c1", "_c2", "_end"), "plan")


def _place() -> Column:
    return F.struct(F.col("_q").alias("q"), F.col("doc_id").alias("id"), F.col("_size").alias("size"))


def applied(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with doc_id, source, _size, _u) with source_size, target and copies; nothing is shuffled."""
    out = _ranked(rows, small(plan))
    within = F.when(F.col("_c1").isNull() | (F.col("_b1") < F.col("_c1")), True).when(F.col("_b1") > F.col("_c1"), False)
    within = within.when(F.col("_c2").isNull() | (F.col("_b2") < F.col("_c2")), True).when(F.col("_b2") > F.col("_c2"), False)
    within = within.otherwise(F.coalesce(_place() <= F.col("_end"), F.lit(False)))
    sampled = F.when(F.col("_q").isNotNull() & within, 1).otherwise(0)
    return out.withColumn("copies", (F.col("_whole") + sampled).cast("long"))


def prepared(rows: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, source, _size, _digest, and ROW) with _u, and the same without ROW as a table of its own.

    Only if rows repeat in id, source and text are they written with a number, to be told apart.
    """
    slim = materialize(rows.drop(ROW), "sizes")
    repeated = materialize(slim.groupBy(*NAME).agg(F.count("*").alias("_n")).filter("_n > 1"), "repeated")
    if repeated.isEmpty():
        u = lambda d: d.withColumn("_copy", F.lit(0)).withColumn("_u", uniform(seed)).drop("_copy", "_digest")
        return u(rows), u(slim)
    kept = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    kept = numbered(kept, repeated).withColumn("_u", uniform(seed)).drop("_row", "_copy", "_digest")
    return kept, materialize(kept.drop(ROW), "sizes")


def mix(docs: DataFrame, share: float = 1.0, cap: float = 3.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """``docs`` with ``size`` (words) and ``copies`` (how often the mix takes the document, 0 included)."""
    text = F.col("text")
    rows = tucked(docs, doc_id=F.col("doc_id"), source=F.col("source"), _size=size_of(text), _digest=digest_of(text))
    rows, slim = prepared(rows, seed)
    return untucked(applied(rows, planned(slim, share, cap, weights)), size=F.col("_size"), copies=F.col("copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what the mix takes of every document."""
    docs, text = read(spark, sf_dir, "documents"), F.col("text")
    slim = prepared(docs.select("doc_id", "source", size_of(text).alias("_size"), digest_of(text).alias("_digest")))[1]
    out = applied(slim, planned(slim))
    taken = (F.col("copies") * F.col("_size")).alias("taken")
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", taken, "source", "copies")


ORACLE_SQL = r"""
WITH x AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size, sha256(coalesce(text, '')) AS digest FROM documents),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, digest) - 1 AS copy FROM x),
d AS (
  SELECT doc_id, source, size, length(bin(size)) AS class,
         (CAST('0x' || substr(sha256(coalesce(doc_id::VARCHAR, 'null') || '/' || digest || '/' || copy || '/42'), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM y),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 3.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE
                - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS lef,
             sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
v AS (SELECT *, lef / rest AS level, most <= w * (lef / rest) AS full_ FROM l),
t AS (SELECT source, source_size, coalesce(CASE WHEN full_ THEN most ELSE w * (max(CASE WHEN NOT full_ THEN level END) OVER ()) END, 0.0) AS target FROM v),
k AS (SELECT d.source, class, sum(size)::BIGINT AS words FROM d GROUP BY 1, 2),
m AS (SELECT k.*, t.target, t.source_size,
             (t.target - 3.0::DOUBLE * (coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
             / nullif((sum(class * words) OVER (PARTITION BY k.source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE, 0) AS level
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, coalesce(class * level >= 3.0::DOUBLE, false) AS full_ FROM m),
p AS (SELECT *, least(CASE WHEN full_ THEN 3.0::DOUBLE ELSE coalesce(class * (max(CASE WHEN NOT full_ THEN level END) OVER (PARTITION BY source)), 0.0) END, 3.0::DOUBLE) AS times FROM n),
q AS (SELECT *, floor(times) AS whole, times - floor(times) AS p, target - (sum(floor(times) * words) OVER (PARTITION BY source)) AS lack FROM p),
r AS (SELECT d.*, q.source_size, q.target, q.whole, q.lack,
             CASE WHEN q.p > 0 THEN u / (1 - u) / (q.p / (1 - q.p)) END AS rank
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.class = q.class),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
z AS (SELECT *, (whole + CASE WHEN rank IS NOT NULL AND before + size / 2.0 <= lack THEN 1 ELSE 0 END)::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM z
"""
