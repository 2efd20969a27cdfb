"""Lexical ranking: document frequency, coverage, scores, floors and the gap verdict.

Terms match as substrings. A query's terms are few and known to the driver, so they are an array literal that every
row is tested against where it is read: the theta join needs neither a join nor a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The floors of the ranking.
LEAST_SCORE, RELATIVE_FLOOR, AMBIGUOUS = 4.5, 0.62, 0.88


def matched(text: Column, terms: list[str]) -> Column:
    """The terms that ``text`` contains, in the order of ``terms``."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def idf(rows: DataFrame, text: str, terms: list[str], generic: frozenset[str] = frozenset()) -> DataFrame:
    """(term, df, weight) for every term: 0 without documents, else damped by generality and raised by length."""
    counts = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), *[F.count_if(F.contains(F.col(text), F.lit(t))).alias(f"t{i}") for i, t in enumerate(terms)])
    cells = [F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df"), F.lit(t in generic).alias("g")) for i, t in enumerate(terms)]
    out = counts.select("n", F.explode(F.array(*cells)).alias("c")).select("n", "c.*")
    length = 1 + 0.35 * F.least(F.greatest(F.length("term") - 2, F.lit(0)), F.lit(2))
    weight = (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 0.35) * F.when(F.col("g"), 0.25).otherwise(1.0) * length
    return out.select("term", "df", F.when(F.col("df") == 0, 0.0).otherwise(weight).alias("weight"))


def coverage(hits: Column, weights: dict[str, float]) -> Column:
    """The weight of the terms hit over the weight of all; 0 / 0 counts as 0 / 1."""
    whole = sum(weights.values()) or 1.0
    got = F.lit(0.0)
    for t, w in weights.items():
        got = got + F.when(F.array_contains(hits, t), F.lit(w)).otherwise(F.lit(0.0))
    return got / F.lit(whole)


def covered(text: Column, weights: dict[str, float]) -> Column:
    """``coverage`` of the terms that ``text`` contains, each looked for once."""
    return sum((F.when(F.contains(text, F.lit(t)), F.lit(w)).otherwise(F.lit(0.0)) for t, w in weights.items()), F.lit(0.0)) / F.lit(sum(weights.values()) or 1.0)


def block_score(direct: Column, routing: Column, length: Column) -> Column:
    """Coverage of a block: its own terms, a fifth of those of its headings, damped by length."""
    return (direct + 0.2 * routing) / (1 + 0.08 * F.log(1 + length / 500.0))


def ranked(rows: DataFrame, score: str, ties: list[str], limit: int) -> DataFrame:
    """The ``limit`` best rows with rank, top, margin and flags: at least LEAST_SCORE and RELATIVE_FLOOR of the best."""
    best = rows.orderBy(F.col(score).desc(), *ties).limit(limit)
    one = W.orderBy(F.col(score).desc(), *ties)
    out = best.withColumn("rank", F.row_number().over(one)).withColumn("top", F.max(score).over(W.partitionBy()))
    out = out.withColumn("second", F.max(F.when(F.col("rank") == 2, F.col(score))).over(W.partitionBy()))
    floor = F.greatest(F.lit(LEAST_SCORE), RELATIVE_FLOOR * F.col("top"))
    out = out.withColumn("kept", F.col(score) >= floor).withColumn("ambiguous", F.coalesce(F.col("second") >= AMBIGUOUS * F.col("top"), F.lit(False)))
    return out.drop("second")
