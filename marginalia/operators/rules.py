"""Declarative rules: a table of (code, condition) over rows, and what violates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code) for every rule whose condition holds; one pass, nothing is shuffled."""
    broken = F.filter(F.array(*[F.when(when, F.lit(code)) for code, when in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(key), F.explode(broken).alias("code"))


def least(rows: DataFrame, order: list[Column], columns: list[str]) -> DataFrame:
    """The one row that comes first in ``order``."""
    return rows.orderBy(*order).limit(1).select(*columns)


def groups_above_one(rows: DataFrame, key: Column, member: str, name: str = "key") -> DataFrame:
    """(key, n, members): keys that more than one row has, with their members in order."""
    keyed = rows.select(key.alias(name), F.col(member).alias("_m"))
    many = keyed.groupBy(name).agg(F.count("*").alias("n"), F.min("_m").alias("first_member"), F.max("_m").alias("last_member"))
    return many.filter(F.col("n") > 1)
