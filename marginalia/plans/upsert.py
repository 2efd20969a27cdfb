"""Previewed writes of note tables: a plan with digests, applied only if nothing has changed since.

A library is a table (path, text) in versions below one root; the largest number in ``pointers`` names the live one and its
folder. A plan lists the rows that change with the digests before and after; its id covers all of it. Applying writes
the next version whole, in a folder of its own, and then its pointer, which only one writer can create: readers see the
old or the new library, and of two writers one fails. What a crashed or beaten write has left is no one's.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.diff import fingerprint
from marginalia.plans.storage import create_once, listed, read_text


def with_block(text: str, key: str, block: str):
    """A column: ``text`` with the marked block of ``key`` replaced by ``block``, or appended; null if marks are broken."""
    begin, end = F.concat(F.lit("<!-- managed:"), F.col(key), F.lit(":begin -->")), F.concat(F.lit("<!-- managed:"), F.col(key), F.lit(":end -->"))
    whole = F.coalesce(F.col(text), F.lit(""))
    n_begin = (F.length(whole) - F.length(F.replace(whole, begin, F.lit("")))) / F.length(begin)
    n_end = (F.length(whole) - F.length(F.replace(whole, end, F.lit("")))) / F.length(end)
    at, to = F.position(begin, whole), F.position(end, whole)
    managed = F.concat(begin, F.lit("\n"), F.col(block), F.lit("\n"), end)
    replaced = F.concat(F.substr(whole, F.lit(1), at - 1), managed, F.substr(whole, to + F.length(end)))
    appended = F.when(whole == "", F.concat(managed, F.lit("\n"))).otherwise(F.concat(F.rtrim(whole), F.lit("\n\n"), managed, F.lit("\n")))
    return F.when((n_begin == 0) & (n_end == 0), appended).when((n_begin == 1) & (n_end == 1) & (at < to), replaced)


def build(library: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, before, after, before_hash, after_hash) of changes (path, key, block) to a library (path, text)."""
    both = changes.join(library.withColumnRenamed("text", "before"), "path", "left")
    out = both.withColumn("after", with_block("before", "key", "block"))
    return out.select("path", "before", "after", F.sha2("before", 256).alias("before_hash"), F.sha2("after", 256).alias("after_hash"))


def plan_id(plan: DataFrame) -> str:
    rows = plan.withColumn("_all", F.lit(0)).withColumn("_d", F.sha2(F.concat_ws("\0", "path", F.coalesce("before_hash", F.lit("")), F.coalesce("after_hash", F.lit(""))), 256))
    got = fingerprint(rows, ["_all"], "_d").first()
    return got.fingerprint if got else ""


class Library:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> int:
        """The live version, or -1."""
        return max((int(n.removesuffix(".json")) for n in listed(self.spark, f"{self.root}/pointers") if n.endswith(".json")), default=-1)

    def read(self) -> DataFrame:
        folder = json.loads(read_text(self.spark, f"{self.root}/pointers/{self.version()}.json"))["folder"]
        return self.spark.read.schema("path string, text string").parquet(f"{self.root}/{folder}")

    def create(self, rows: DataFrame) -> None:
        """The first version; raises ValueError if the library is there already."""
        if self.version() >= 0:
            raise ValueError("the library exists")
        self._write(rows, 0)

    def _write(self, rows: DataFrame, version: int) -> None:
        folder = f"v={version}-{uuid.uuid4().hex}"
        rows.select("path", "text").write.parquet(f"{self.root}/{folder}")
        if not create_once(self.spark, f"{self.root}/pointers/{version}.json", json.dumps({"v": version, "folder": folder})):
            raise ValueError("the library has changed")

    def apply(self, plan: DataFrame, expected: str) -> int:
        """The new version; raises ValueError, and writes nothing, if the plan or the library is another by now."""
        if plan_id(plan) != expected:
            raise ValueError("the plan has changed")
        if not plan.filter(F.col("after").isNull()).isEmpty():
            raise ValueError("broken marks")
        version, now = self.version(), self.read()
        p = plan.select(F.col("path").alias("_p"), "after", "before_hash")
        stale = p.join(now, F.col("_p") == F.col("path"), "left").filter(~F.sha2("text", 256).eqNullSafe(F.col("before_hash")))
        if not stale.isEmpty():
            raise ValueError("the library has changed")
        merged = now.join(p, F.col("_p") == F.col("path"), "full")
        self._write(merged.select(F.coalesce("_p", "path").alias("path"), F.coalesce("after", "text").alias("text")), version + 1)
        return version + 1
