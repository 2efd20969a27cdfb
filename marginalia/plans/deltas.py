"""Keyed tables that are written by changes: what a write takes is in proportion to what it changes.

A table is a log below one root. An entry, ``log/<number>.json``, names the segments that are live from then on: a *base*,
dealt into bucket folders by key, and *deltas* with the rows that later writes changed or removed. A reader takes the base
less the deltas' keys, and of each of these the newest row. As soon as the deltas hold a quarter of the base's rows a write
merges them into a new base.

Each entry has a digest of every bucket, a sum of the hashes of its rows, which a write adjusts by the rows that go and
come; the table's signature is the hash of these, so that it is known without a scan and is that of a table built at once.

An entry is created only if its number isn't taken: of two writers that start from the same entry one gets a
``Conflict`` and has changed nothing. A write that names its batch is left out if the log has that batch already.
Segments without an entry, from writers that crashed or lost, are no one's.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.plans.skew import small
from marginalia.plans.storage import create_once, listed, materialize, read_text

#: Share of the base's rows that the deltas may hold before they are merged.
MERGE = 0.25


class Conflict(ValueError):
    """Another writer was first."""


class DeltaTable:
    """A table of unique keys below ``root``; ``schema`` is DDL, ``key`` one of its columns, null keys are not kept."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = 64) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema)
        self.columns = self.schema.names

    # --- the log

    def number(self) -> int:
        """The number of the last entry, or -1."""
        return max((int(n.removesuffix(".json")) for n in listed(self.spark, f"{self.root}/log") if n.endswith(".json")), default=-1)

    def entry(self, number: int | None = None) -> dict:
        number = self.number() if number is None else number
        if number < 0:
            return {"base": None, "deltas": [], "batch": -1, "digests": [0] * self.buckets, "base_rows": 0, "delta_rows": 0}
        return json.loads(read_text(self.spark, f"{self.root}/log/{number}.json"))

    def signature(self, number: int | None = None) -> str:
        """A digest of the rows, whatever writes they came by."""
        return hashlib.sha256(json.dumps(self.entry(number)["digests"]).encode()).hexdigest()

    # --- rows

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _hash(self) -> Column:
        return F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.columns]), {"ignoreNullFields": "false"})).cast("decimal(38,0)")

    def _segment(self, name: str) -> DataFrame:
        extra = "_bucket int" if name.startswith("base") else "_gone boolean, _bucket int"
        return self.spark.read.schema(T.StructType(self.schema.fields + T.StructType.fromDDL(extra).fields)).parquet(f"{self.root}/segments/{name}")

    def _rows(self, entry: dict, within: list[int] | None = None) -> DataFrame:
        """The rows with ``_bucket``, of the buckets ``within`` alone if given; their folders are all that is read."""
        cut = F.lit(True) if within is None else F.col("_bucket").isin(within)
        base = self._segment(entry["base"]).filter(cut) if entry["base"] else self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())]))
        if not entry["deltas"]:
            return base
        if len(entry["deltas"]) == 1:  # its keys are unique: nothing is to be gathered
            one = self._segment(entry["deltas"][0]).filter(cut)
            kept = base.join(small(one.select(F.col(self.key).alias("_key"))), F.col(self.key) == F.col("_key"), "left_anti")
            return kept.unionByName(one.filter("not _gone").drop("_gone"))
        deltas = None
        for i, name in enumerate(entry["deltas"]):
            one = self._segment(name).filter(cut).withColumn("_at", F.lit(i))
            deltas = one if deltas is None else deltas.unionByName(one)
        whole = F.struct(*[F.col(f"`{c}`") for c in self.columns], "_bucket", "_gone")
        newest = materialize(deltas.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(whole, "_at").alias("_r")), "newest")
        kept = base.join(small(newest.select("_key")), F.col(self.key) == F.col("_key"), "left_anti")
        return kept.unionByName(newest.filter("not _r._gone").select("_r.*").drop("_gone"))

    def read(self, number: int | None = None) -> DataFrame:
        """The table, as of an entry of the log if its number is given."""
        return self._rows(self.entry(number)).select(*[F.col(f"`{c}`") for c in self.columns])

    def of_keys(self, keys: DataFrame, number: int | None = None) -> DataFrame:
        """The rows of ``keys`` (the key's column), read from their buckets."""
        return self._of(keys, self.entry(number), [F.col(f"`{c}`") for c in self.columns])

    def _of(self, keys: DataFrame, entry: dict, columns: list[Column]) -> DataFrame:
        """``columns`` of the rows of ``keys``; what they are made from isn't moved."""
        keys = materialize(keys.select(F.col(self.key).alias("_want")).distinct(), "keys")
        within = [r.b for r in keys.select(F.pmod(F.xxhash64("_want"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]  # numbers of buckets
        rows = self._rows(entry, within).select(F.col(self.key).alias("_own"), *columns)
        return rows.join(small(keys), F.col("_own") == F.col("_want"), "left_semi").drop("_own")

    # --- writes

    def write(self, rows: DataFrame, gone: DataFrame | None = None, batch: int | None = None) -> int:
        """Put ``rows`` in the place of those of their keys, remove the keys of ``gone``; the number of the new entry.

        A key has one row in ``rows``; one that is in both is put. With ``batch``, a number that grows, nothing is
        written if the log has it.
        """
        number = self.number()
        entry = self.entry(number)
        if batch is not None and batch <= entry["batch"]:
            return number
        rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]).filter(F.col(self.key).isNotNull())
        new = rows.withColumn("_gone", F.lit(False))
        if gone is not None:
            kind = self.schema[self.key].dataType
            keys = gone.select(F.col(self.key).cast(kind).alias(self.key)).filter(F.col(self.key).isNotNull()).distinct()
            keys = keys.join(rows.select(F.col(self.key).alias("_put")), F.col(self.key) == F.col("_put"), "left_anti")
            blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != self.key else F.col(self.key) for f in self.schema.fields]
            new = new.unionByName(keys.select(*blank, F.lit(True).alias("_gone")))
        name = f"delta-{number + 1}-{uuid.uuid4().hex}"
        new.withColumn("_bucket", self._bucket()).write.parquet(f"{self.root}/segments/{name}")
        new = self._segment(name)
        size, distinct = new.agg(F.count("*"), F.count_distinct(self.key)).first()
        if size != distinct:
            raise ValueError("a key has more than one row")
        after = {**entry, "batch": entry["batch"] if batch is None else batch}
        if size:
            hashed = ["_bucket", self._hash().alias("_hash")]
            digests = self._digests(new.filter("not _gone").select(*hashed), 1) + self._digests(self._of(new, entry, [F.col("_bucket"), hashed[1]]), -1)
            after["digests"] = list(entry["digests"])
            for bucket, change in digests:
                after["digests"][bucket] = (after["digests"][bucket] + change) % (1 << 64)
            after["deltas"], after["delta_rows"] = [*entry["deltas"], name], entry["delta_rows"] + size
            if after["delta_rows"] > MERGE * after["base_rows"]:
                after = self._merged(after, number + 1)
        self._commit(after, number + 1)
        return number + 1

    def _digests(self, rows: DataFrame, sign: int) -> list[tuple[int, int]]:
        """(bucket, sum of its hashes) of (_bucket, _hash); as many as there are buckets."""
        return [(r["_bucket"], sign * int(r["s"])) for r in rows.groupBy("_bucket").agg(F.sum("_hash").alias("s")).collect()]

    def _merged(self, entry: dict, number: int) -> dict:
        name = f"base-{number}-{uuid.uuid4().hex}"
        rows = self._rows(entry)
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/segments/{name}")
        written = self._segment(name).count() if any(entry["digests"]) else 0
        return {**entry, "base": name if written else None, "deltas": [], "base_rows": written, "delta_rows": 0}

    def _commit(self, entry: dict, number: int) -> None:
        if not create_once(self.spark, f"{self.root}/log/{number}.json", json.dumps(entry)):
            raise Conflict("another write was first")


class NoteIndex:
    """An inverted table of notes, kept up by changes: the grams of a changed note alone are made and written anew."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.table = DeltaTable(spark, root, "path string, doc_hash string, grams array<string>", "path", buckets)

    def update(self, notes: DataFrame, text: Column, width: int = 3) -> dict[str, int]:
        """Bring the index to ``notes`` (path, doc_hash; unique paths); how many were added, changed and removed.

        A note is read only if its hash is new; ``text`` is what is indexed, in windows of ``width`` characters, each once.
        """
        known = self.table.read().select(F.col("path").alias("_path"), F.col("doc_hash").alias("_hash"))
        both = notes.select("path", "doc_hash").join(known, F.col("path") == F.col("_path"), "full")
        kind = F.when(F.col("_path").isNull(), "added").when(F.col("path").isNull(), "removed").when(~F.col("doc_hash").eqNullSafe(F.col("_hash")), "changed")
        todo = materialize(both.select(F.coalesce("path", "_path").alias("path"), kind.alias("kind")).filter("kind is not null"), "todo")
        fresh = notes.join(small(todo.filter("kind != 'removed'").select("path")), "path", "left_semi")
        grams = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))))
        self.table.write(fresh.select("path", "doc_hash", F.coalesce(grams, F.array().cast("array<string>")).alias("grams")), todo.filter("kind = 'removed'").select("path"))
        return {"added": 0, "changed": 0, "removed": 0} | {r.kind: r["count"] for r in todo.groupBy("kind").count().collect()}

    def postings(self) -> DataFrame:
        """(gram, path) of the notes as they are."""
        return self.table.read().select(F.explode("grams").alias("gram"), "path")

    def holding(self, needle: str, width: int = 3) -> DataFrame:
        """(path) of notes that have every gram of ``needle``: all that hold it, and few besides; to be verified in the text."""
        low = needle.lower()
        grams = sorted({low[i : i + width] for i in range(len(low) - width + 1)})
        rows = self.table.read()
        return (rows.filter(F.size(F.array_intersect("grams", F.array(*map(F.lit, grams)))) == len(grams)) if grams else rows).select("path")
