"""Packs cut to a budget of characters: links go first, then the longest excerpts, until a pack fits.

What a pack defers is a water level: all excerpts longer than some length, and of that length the first ones in order.
The level of each pack is read off the histogram of its excerpts' lengths; only the excerpts of that one length are put
in order. So a pack may have any number of excerpts, and none is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.operators.intervals import running_before
from marginalia.plans.storage import materialize


def _same(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]


def _of(rows: DataFrame, keys: list[str], *columns: Column | str) -> DataFrame:
    return rows.select(*[F.col(k).alias(f"_{k}") for k in keys], *columns)


def excess(packs: DataFrame, keys: list[str], size: str, budget: int | Column) -> DataFrame:
    """``packs`` (keys, size) with how far each is above its budget, zero if it fits."""
    return packs.select(*keys, F.greatest(F.col(size) - budget, F.lit(0)).cast("long").alias("excess"))


def popped(links: DataFrame, over: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """``links`` with ``dropped``: those at the end of ``order`` (a number) as long as what is left is too large.

    ``over`` is from ``excess``. A pack with many links is summed by blocks.
    """
    rows = materialize(links.withColumn("_back", -F.col(order)), "links")
    rows = running_before(rows, keys, "_back", size, "_after")
    out = rows.join(_of(over, keys, "excess"), _same(keys), "left")
    return out.withColumn("dropped", F.col("_after") < F.coalesce("excess", F.lit(0))).select(*links.columns, "dropped")


def left_over(over: DataFrame, links: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``over`` less what the ``dropped`` links took."""
    gone = links.filter("dropped").groupBy(*keys).agg(F.sum(size).alias("_gone"))
    out = over.join(_of(gone, keys, "_gone"), _same(keys), "left")
    return out.select(*keys, F.greatest(F.col("excess") - F.coalesce("_gone", F.lit(0)), F.lit(0)).cast("long").alias("excess"))


def levels(items: DataFrame, over: DataFrame, keys: list[str], length: str, gain: str) -> DataFrame:
    """(keys, level, need): excerpts longer than ``level`` are deferred, those as long until ``need`` characters are won.

    The level is the first, from the longest on, by whose end enough is won or at which an excerpt would win nothing:
    deferring stops there. Packs that fit have no row, nor have packs that can't be cut that far and lose nothing by it:
    all their excerpts are above level -1.
    """
    steps = items.filter(F.col(length) > 0).groupBy(*keys, length).agg(F.sum(gain).alias("won"), F.min(gain).alias("least"))
    steps = steps.join(_of(over.filter("excess > 0"), keys, "excess"), _same(keys))
    before = W.partitionBy(*keys).orderBy(F.col(length).desc()).rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("_before", F.coalesce(F.sum("won").over(before), F.lit(0)))
    ends = (F.col("_before") + F.col("won") >= F.col("excess")) | (F.col("least") <= 0)
    best = steps.groupBy(*keys).agg(F.max(F.when(ends, F.struct(F.col(length).alias("level"), (F.col("excess") - F.col("_before")).alias("need")))).alias("_s"))
    return best.select(*keys, F.coalesce(F.col("_s.level"), F.lit(-1)).cast("long").alias("level"), F.coalesce(F.col("_s.need"), F.lit(0)).cast("long").alias("need"))


def deferred(items: DataFrame, over: DataFrame, keys: list[str], order: str, length: str, gain: str) -> DataFrame:
    """``items`` with ``deferred``: whether an excerpt is left out, so that its pack fits.

    The longest goes first, of equally long ones the first by ``order`` (a number, unique in a pack); it stops as soon as
    the pack fits, or at an excerpt whose ``gain`` isn't positive, as a locator would take as much. Items without
    a text (``length`` 0 or null) have nothing to defer.
    """
    level = materialize(levels(items, over, keys, length, gain), "levels")
    rows = materialize(items.join(_of(level, keys, "level", "need"), _same(keys), "left").drop(*[f"_{k}" for k in keys]), "items")
    edge = rows.filter(F.col(length) == F.col("level"))
    # a gain that is none counts as all that is needed: nothing behind it is deferred
    edge = edge.withColumn("_g", F.when(F.col(gain) <= 0, F.col("need")).otherwise(F.col(gain)))
    edge = running_before(materialize(edge, "edge"), keys, order, "_g", "_won")
    edge = edge.select(*items.columns, ((F.col("_won") < F.col("need")) & (F.col(gain) > 0)).alias("deferred"))
    rest = rows.filter((F.col(length) != F.col("level")) | F.col("level").isNull() | F.col(length).isNull())
    return rest.select(*items.columns, F.coalesce((F.col(length) > 0) & (F.col(length) > F.col("level")), F.lit(False)).alias("deferred")).unionByName(edge)


def report(packs: DataFrame, links: DataFrame, items: DataFrame, keys: list[str], size: str, link_size: str, gain: str, budget: int | Column) -> DataFrame:
    """(keys, returned, omitted, deferred, size, exceeded): what was done to each pack, and whether it is still too large."""
    of_links = links.groupBy(*keys).agg(F.count_if(~F.col("dropped")).alias("returned"), F.count_if("dropped").alias("omitted"), F.sum(F.when(F.col("dropped"), F.col(link_size)).otherwise(0)).alias("_l"))
    of_items = items.groupBy(*keys).agg(F.count_if("deferred").alias("deferred"), F.sum(F.when(F.col("deferred"), F.col(gain)).otherwise(0)).alias("_i"))
    out = packs.join(_of(of_links, keys, "returned", "omitted", "_l"), _same(keys), "left").drop(*[f"_{k}" for k in keys])
    out = out.join(_of(of_items, keys, "deferred", "_i"), _same(keys), "left")
    now = F.col(size) - F.coalesce("_l", F.lit(0)) - F.coalesce("_i", F.lit(0))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("returned", "omitted", "deferred")]
    return out.select(*keys, *counts, now.cast("long").alias("size"), (now > budget).alias("exceeded"))
