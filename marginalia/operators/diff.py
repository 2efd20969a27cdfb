"""Snapshot differences, renames, manifests and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, state: str) -> DataFrame:
    """(key, kind, old_state, new_state): added, removed, modified or unchanged, by one full outer join."""
    o = old.select(F.col(key).alias("k"), F.col(state).alias("old_state"), F.lit(True).alias("_o"))
    n = new.select(F.col(key).alias("k"), F.col(state).alias("new_state"), F.lit(True).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed")
    kind = kind.when(F.col("old_state").eqNullSafe(F.col("new_state")), "unchanged").otherwise("modified")
    return o.join(n, "k", "full").select(F.col("k").alias(key), kind.alias("kind"), "old_state", "new_state")


def renames(diff: DataFrame, key: str) -> DataFrame:
    """(state, old_key, new_key, kind): a removed and an added key of equal state; ambiguous unless unique on both sides."""
    gone = diff.filter("kind = 'removed'").groupBy(F.col("old_state").alias("state")).agg(F.count("*").alias("n_old"), F.min(key).alias("old_key"))
    came = diff.filter("kind = 'added'").groupBy(F.col("new_state").alias("state")).agg(F.count("*").alias("n_new"), F.min(key).alias("new_key"))
    kind = F.when((F.col("n_old") == 1) & (F.col("n_new") == 1), "renamed").otherwise("ambiguous")
    return gone.join(came, "state").select("state", "old_key", "new_key", kind.alias("kind"))


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, status) of files (path, size, sha256) that are missing, extra or changed in size or digest."""
    e = expected.select("path", F.col("size").alias("es"), F.col("sha256").alias("eh"))
    a = actual.select("path", F.col("size").alias("s"), F.col("sha256").alias("h"))
    status = F.when(F.col("h").isNull(), "missing").when(F.col("eh").isNull(), "extra")
    status = status.when((F.col("es") != F.col("s")) | (F.col("eh") != F.col("h")), "changed")
    return e.join(a, "path", "full").select("path", status.alias("status")).filter(F.col("status").isNotNull())


def keyed_merge(current: DataFrame, update: DataFrame, key: str, managed: list[str]) -> DataFrame:
    """Upsert: the ``managed`` columns of ``update`` win, all other columns of ``current`` stay; with the action."""
    u = update.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in managed])
    out = current.withColumn("_c", F.lit(True)).join(u, F.col(key) == F.col("_k"), "full")
    same = F.lit(True)
    for c in managed:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    action = F.when(F.col("_k").isNull(), "keep").when(F.col("_c").isNull(), "insert").when(same, "same").otherwise("update")
    cols = {c: F.when(F.col("_k").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in managed} | {key: F.coalesce(key, "_k")}
    return out.select(*[cols.get(c, F.col(c)).alias(c) for c in current.columns], action.alias("action"))


def fingerprint(rows: DataFrame, group: list[str], digest: str, leaf: int = 1 << 20) -> DataFrame:
    """One order-free digest for each group: a tree of SHA-256 over its sorted row digests.

    Rows are folded by the first hexadecimal digits of their digests, three for up to ``leaf`` rows in the largest group
    and three more for each further factor of 4096, level by level; no task gathers more than some thousand strings.
    """
    most = rows.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    depth = 3
    while most > leaf:
        most, depth = most >> 12, depth + 3
    inner = rows.groupBy(*group, F.substring(digest, 1, depth).alias("_b")).agg(F.array_sort(F.collect_list(digest)).alias("_d"), F.count("*").alias("_n"))
    inner = inner.select(*group, "_b", "_n", F.sha2(F.array_join("_d", "\n"), 256).alias("_h"))
    child = F.array_sort(F.collect_list(F.concat("_b", F.lit(":"), "_h"))).alias("_d")
    for level in range(depth - 3, 0, -3):
        inner = inner.groupBy(*group, F.substring("_b", 1, level).alias("_c")).agg(child, F.sum("_n").alias("_n"))
        inner = inner.select(*group, F.col("_c").alias("_b"), "_n", F.sha2(F.array_join("_d", "\n"), 256).alias("_h"))
    outer = inner.groupBy(*group).agg(child, F.sum("_n").alias("n_rows"))
    return outer.select(*group, "n_rows", F.sha2(F.array_join("_d", "\n"), 256).alias("fingerprint"))
