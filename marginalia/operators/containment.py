"""Which texts hold which passages, letter by letter.

A passage is looked up by an anchor that every text that holds it must have: a run of whole words from its inside
(its first and last word may be parts of the text's words), or, where it has no inside, its first characters. Texts
give the hashes of their runs of words, an equality join finds candidates, and ``contains`` decides. Nothing pairs
texts with passages that share no anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.plans.skew import small
from marginalia.plans.storage import materialize

#: Words of an anchor, if the passage's inside has so many, and characters of one for a passage without an inside.
WORDS, LETTERS = 3, 4


def _runs(words: Column, width: int) -> Column:
    """The distinct hashes of the runs of ``width`` words. ``words`` is made once, as the variable of a lambda."""

    def hashed(w: Column) -> Column:
        starts = F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - (width - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(width), *[F.element_at(w, i + k) for k in range(width)]))

    return F.array_distinct(F.flatten(F.transform(F.array(words), hashed)))


def _letters(text: Column, width: int) -> Column:
    """The distinct hashes of the stretches of ``width`` characters."""
    starts = F.when(F.length(text) >= width, F.sequence(F.lit(1), F.length(text) - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.lit(-width), F.substr(text, i, F.lit(width)))))


def anchored(passages: DataFrame, column: str) -> DataFrame:
    """``passages`` with ``_kind`` (words of the anchor, or minus its characters) and ``_anchor``; empty ones go.

    Of the runs inside, the one of the most characters is the anchor, the first of them if there are several.
    """
    words = F.split(column, " ", -1)
    inside = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    out = passages.filter(F.length(column) > 0).withColumn("_in", inside)
    out = out.withColumn("_kind", F.when(F.size("_in") > 0, F.least(F.size("_in"), F.lit(WORDS))).otherwise(-F.least(F.length(column), F.lit(LETTERS))))

    def longest(width: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("_in") - (width - 1))
        runs = F.transform(starts, lambda i: F.struct(-F.length(F.array_join(F.slice("_in", i, width), " ")), i.alias("i"), F.xxhash64(F.lit(width), *[F.element_at("_in", i + k) for k in range(width)]).alias("h")))
        return F.array_min(runs)["h"]

    anchor = F.lit(None).cast("bigint")
    for width in range(1, WORDS + 1):
        anchor = F.when(F.col("_kind") == width, longest(width)).otherwise(anchor)
    for width in range(1, LETTERS + 1):
        anchor = F.when(F.col("_kind") == -width, F.xxhash64(F.lit(-width), F.substring(column, 1, width))).otherwise(anchor)
    return out.withColumn("_anchor", anchor).drop("_in")


def contained(texts: DataFrame, passages: DataFrame, column: str) -> DataFrame:
    """``texts`` joined with the ``passages`` that their ``column`` contains; a passage's ``column`` is not returned.

    Null texts hold nothing, empty and null passages are in none; repeated rows of either side match each on their own.
    Only hashes are exploded and joined; a text meets a passage's letters where an anchor has brought them together.
    """
    found = anchored(passages.withColumnRenamed(column, "_passage"), "_passage").withColumn("_pid", F.monotonically_increasing_id())
    found = materialize(found, "anchors")
    kinds = sorted(r[0] for r in found.select("_kind").distinct().collect())  # seven at most
    words = F.split(column, " ", -1)
    made = [_runs(words, k) if k > 0 else _letters(F.col(column), -k) for k in kinds]
    keys = texts.select(F.xxhash64(column).alias("_text"), F.explode(F.concat(F.array().cast("array<bigint>"), *made)).alias("_key"))
    near = keys.join(small(found.select("_pid", "_anchor")), F.col("_key") == F.col("_anchor")).select("_text", "_pid").distinct()
    near = small(materialize(near, "near"))
    hit = texts.withColumn("_own", F.xxhash64(column)).join(near, F.col("_own") == F.col("_text")).join(small(found.drop("_kind", "_anchor")), "_pid")
    return hit.filter(F.contains(column, F.col("_passage"))).drop("_own", "_text", "_pid", "_passage")
