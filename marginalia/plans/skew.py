"""Lookups that stay even when one key holds a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that are looked up by broadcast; any other key holds at most 1/HOT_KEYS of the rows.
HOT_KEYS = 1024
#: Rows and bytes of a lookup table that may be broadcast whole (both are measured).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def attach(rows: DataFrame, lookup: DataFrame, key: str, values: list[str], count: str, spread: Column) -> DataFrame:
    """Left join ``rows`` with ``lookup`` (one row for each non-null ``key``) without gathering a hot key.

    ``count`` is the lookup's column of how many rows of ``rows`` (about) have the key. The HOT_KEYS largest keys are
    joined by broadcast, which that number bounds; their rows then take a hash of ``spread`` in place of the key, so
    that the shuffled join of all others deals them out evenly. Rows with a null key get null values.
    """
    hot = lookup.filter(F.col(count) > 32).orderBy(F.col(count).desc(), F.col(key)).limit(HOT_KEYS)
    hot = hot.select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv"))
    cold = lookup.select(F.col(key).alias("_ck"), F.lit(0).alias("_cf"), F.struct(*values).alias("_cv"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    away = F.col("_hk").isNotNull() | F.col(key).isNull()
    kind = dict(rows.dtypes)[key]
    out = out.withColumn("_jk", F.when(away, F.xxhash64(spread).cast(kind)).otherwise(F.col(key)))
    out = out.withColumn("_jf", F.when(away, 1).otherwise(0))
    out = out.join(cold, (F.col("_jk") == F.col("_ck")) & (F.col("_jf") == F.col("_cf")), "left")
    got = F.coalesce("_hv", "_cv")
    return out.select(*rows.columns, *[got[v].alias(v) for v in values])


def _bytes(kind: T.DataType, value: Column) -> Column:
    """About how many bytes a value takes: texts and lists by what they hold, all else eight."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.ArrayType):
        fixed = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))
        inner = F.size(value) * 8 if fixed else F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _bytes(kind.elementType, x))
        return F.coalesce(inner.cast("long"), F.lit(0).cast("long")) + 8
    if isinstance(kind, T.StructType):
        return sum((_bytes(f.dataType, value[f.name]) for f in kind.fields), F.lit(8).cast("long"))
    return F.lit(8).cast("long")


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already materialized) with a broadcast hint if it has at most ``rows`` rows in ``most`` bytes, else as
    it is, so that the join shuffles. Both are measured on ``rows`` + 1 rows at most."""
    size = sum((_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(0).cast("long"))
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if got.n <= rows and got.size <= most else df
