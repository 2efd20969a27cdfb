"""Intervals, islands, running sums and coverage of line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.plans.skew import small
from marginalia.plans.storage import materialize


def islands(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, first, last): runs of consecutive integers."""
    g = F.col(number) - F.row_number().over(W.partitionBy(*keys).orderBy(number))
    out = rows.select(*keys, number).distinct().withColumn("_g", g)
    return out.groupBy(*keys, "_g").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_g")


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Half-open intervals that share a point."""
    return (start < high) & (end > low)


#: Rows of a key from which on it is cut into blocks, and blocks that it is cut into.
HOT_ROWS, BLOCKS = 4_000_000, 1024


def blocked(rows: DataFrame, keys: list[str], order: str, hot: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """(``rows`` with ``_block``, whether any key is cut). A block is 0, but for keys of more than ``hot`` rows, whose rows are cut by ``order`` (a number or a
    time) into blocks of about as many rows each, ascending; equal values share a block."""
    counts = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot), "hot_keys")
    if counts.isEmpty():
        return rows.withColumn("_block", F.lit(0)), False
    names = {k: f"_k_{k}" for k in keys}
    hot_keys = small(counts.select(*[F.col(k).alias(n) for k, n in names.items()]))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    steps = F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)])
    cuts = rows.join(hot_keys, same).groupBy(*names.values()).agg(F.array_distinct(F.percentile_approx(order, steps, 10_000)).alias("_cuts"))
    out = rows.join(small(materialize(cuts, "cuts")), same, "left")
    block = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(order))))
    return out.withColumn("_block", block).drop("_cuts", *names.values()), True


def running_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str, hot: int = HOT_ROWS) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same keys before; a hot key is summed by blocks."""
    cut, some = blocked(rows, keys, order, hot)
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = cut.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    if not some:
        return out.select(*rows.columns, F.col("_in").alias(name))
    sums = cut.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    over = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.sum("_sum").over(over)).filter(F.col("_base").isNotNull())
    sums = sums.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_block").alias("_of"), "_base")
    same = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    out = out.join(sums, [*same, F.col("_block") == F.col("_of")], "left")
    return out.withColumn(name, F.coalesce("_base", F.lit(0)) + F.col("_in")).select(*rows.columns, name)


def coverage(lines: DataFrame, registered: DataFrame, key: str) -> DataFrame:
    """(key, meaningful, covered, status) of (key, line) rows: closed if all lines are registered, else open.

    ``registered`` is (key, line, status); lines outside ``lines`` make the result invalid, waiting ones open.
    """
    known = registered.groupBy(key, "line").agg(F.bool_or(F.col("status").isin("waiting")).alias("waiting"))
    both = lines.select(key, "line", F.lit(True).alias("_m")).join(known, [key, "line"], "full")
    got = both.groupBy(key).agg(
        F.count_if(F.col("_m")).alias("meaningful"),
        F.count_if(F.col("_m") & F.col("waiting").isNotNull()).alias("covered"),
        F.count_if(F.col("_m").isNull()).alias("outside"),
        F.count_if(F.col("waiting")).alias("waiting"),
    )
    status = F.when(F.col("outside") > 0, "invalid").when((F.col("waiting") > 0) | (F.col("covered") < F.col("meaningful")), "open").otherwise("closed")
    return got.withColumn("status", status)


def gap_check(rows: DataFrame, keys: list[str], time: str, limit: float, hot: int = HOT_ROWS) -> DataFrame:
    """(keys, n, max_gap, regular): whether every step between neighbours is in (0, ``limit``] seconds.

    Steps are taken inside the blocks of a hot key, and once more between the last of one block and the first of the next.
    """
    cut = blocked(rows.select(*keys, time), keys, time, hot)[0]
    step = F.col(time) - F.lag(time).over(W.partitionBy(*keys, "_block").orderBy(time))
    inner = cut.withColumn("_g", step).groupBy(*keys, "_block").agg(
        F.count("*").alias("_n"), F.max("_g").alias("_max"), F.coalesce(F.bool_and((F.col("_g") > 0) & (F.col("_g") <= limit)), F.lit(True)).alias("_ok"),
        F.min(time).alias("_first"), F.max(time).alias("_last"),
    )
    between = F.col("_first") - F.lag("_last").over(W.partitionBy(*keys).orderBy("_block"))
    inner = inner.withColumn("_b", between)
    sound = F.col("_ok") & F.coalesce((F.col("_b") > 0) & (F.col("_b") <= limit), F.lit(True))
    return inner.groupBy(*keys).agg(F.sum("_n").alias("n"), F.max(F.greatest("_max", "_b")).alias("max_gap"), F.bool_and(sound).alias("regular"))
