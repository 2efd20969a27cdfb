"""Checks of courses in pages, and choices among media."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.rules import violations


def page_partition(episodes: DataFrame, expected: DataFrame) -> DataFrame:
    """(course, code, page) of episodes (course, path, first, pages) against (course, page).

    An episode's pages ascend without repeats and begin with its first; a page belongs to one episode exactly.
    """
    own = episodes.withColumn("_sorted", F.array_sort(F.array_distinct("pages")))
    codes = {"order": F.col("pages") != F.col("_sorted"), "first": F.element_at("pages", 1) != F.col("first")}
    local = violations(own.withColumn("_k", F.struct("course", "first")), "_k", codes).select("_k.course", "code", F.col("_k.first").alias("page"))
    used = episodes.select("course", F.explode("pages").alias("page")).groupBy("course", "page").agg(F.count("*").alias("n"))
    both = used.join(expected.select("course", "page", F.lit(True).alias("_x")), ["course", "page"], "full")
    codes = {"missing": F.col("n").isNull(), "extra": F.col("_x").isNull(), "repeated": F.col("n") > 1}
    return local.unionByName(violations(both.withColumn("_k", F.struct("course", "page")), "_k", codes).select("_k.course", "code", "_k.page"))


def smallest_muxed(formats: DataFrame, key: str) -> DataFrame:
    """The smallest format with picture and sound and a known size, for each key."""
    good = formats.filter((F.col("vcodec") != "none") & (F.col("acodec") != "none") & (F.col("filesize") > 0))
    return good.groupBy(key).agg(F.min_by("format_id", F.struct("filesize", "format_id")).alias("format_id"))


def best_stream(streams: DataFrame, key: str, height: int = 720) -> DataFrame:
    """The AVC stream of the largest height up to ``height``, then width, then the least bandwidth, for each key."""
    good = streams.filter(F.col("codecs").startswith("avc") & (F.col("height") <= height))
    return good.groupBy(key).agg(F.max_by("id", F.struct("height", "width", -F.col("bandwidth"), "id")).alias("id"))


def preferred(rows: DataFrame, key: str, column: str, order: list[str]) -> DataFrame:
    """The value that comes first in ``order`` for each key; others come after, by text."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    rank = F.when(at > 0, at).otherwise(len(order) + 1)
    return rows.groupBy(key).agg(F.min_by(column, F.struct(rank, column)).alias(column))


def frame_timeline(frames: DataFrame, key: str, time: str, duration: float, rate: float) -> DataFrame:
    """(key, ok, max_gap): frames start and end within the tolerance, and no step is too long or not ahead."""
    from pyspark.sql.window import Window as W

    limit = min(1.0, max(0.1, 3.0 / rate))
    gap = F.col(time) - F.lag(time).over(W.partitionBy(key).orderBy(time))
    rows = frames.withColumn("_g", gap)
    ends = (F.min(time) <= limit) & (F.max(time) >= duration - limit)
    steps = F.coalesce(F.bool_and((F.col("_g") > 0) & (F.col("_g") <= limit)), F.lit(True))
    return rows.groupBy(key).agg((ends & steps).alias("ok"), F.max("_g").alias("max_gap"))


def selection_closure_errors(modules: DataFrame, chosen: DataFrame) -> DataFrame:
    """(name, missing) of requirements (modules: name, requires) that a selection (name) lacks; unknown names miss ''."""
    known = modules.select("name", "requires")
    sel = chosen.select("name").distinct()
    unknown = sel.join(known, "name", "left_anti").select("name", F.lit("").alias("missing"))
    needs = sel.join(known, "name").select("name", F.explode("requires").alias("missing"))
    return unknown.unionByName(needs.join(sel.withColumnRenamed("name", "missing"), "missing", "left_anti").select("name", "missing"))
