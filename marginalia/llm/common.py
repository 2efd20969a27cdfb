"""What the operators share: reading tables, held-out rows, bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.skew import small
from marginalia.plans.storage import materialize


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The column in which ``tucked`` keeps a row as it came.
ROW = "__row"


def tucked(docs: DataFrame, **columns: Column) -> DataFrame:
    """The named ``columns`` made from ``docs``, and each whole row as the struct ROW.

    An operator adds what columns it likes to that; none can clash with those of ``docs``. ``untucked`` gives them back.
    """
    return docs.select(*[c.alias(n) for n, c in columns.items()], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def untucked(rows: DataFrame, **changed: Column) -> DataFrame:
    """The rows kept by ``tucked`` with all their columns in order; those named in ``changed`` have new values, or
    come last if there were none of that name (in any case of letters)."""
    names = [f.name for f in rows.schema[ROW].dataType.fields]
    new = {n.lower(): c for n, c in changed.items()}
    kept = [new[n.lower()].alias(n) if n.lower() in new else F.col(ROW).getField(n).alias(n) for n in names]
    have = {n.lower() for n in names}
    return rows.select(*kept, *[c.alias(n) for n, c in changed.items() if n.lower() not in have])


#: Names of dropped rows that may be broadcast (24 bytes each).
DROPPED = 1_000_000


def keep_named(docs: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """``docs`` less the rows that ``kept`` (doc_id, h) doesn't name, h being the hash of a text; columns as they are.

    ``rows`` is (doc_id, h) of every row. Of rows equal in both any one stays: they are put together in each partition
    first, so that not even a hot one is gathered.
    """
    kept = kept.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))
    counted = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n")).join(kept, same, "left")
    counted = materialize(counted.withColumn("kept", F.col("_h").isNotNull()).drop("_d", "_h"), "counted")
    dropped = materialize(counted.filter("not kept").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")), "dropped")
    repeated = materialize(counted.filter("kept and n > 1").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")), "repeated")
    out = tucked(docs, doc_id=F.col("doc_id"), h=F.xxhash64("text")).join(small(dropped, DROPPED), same, "left_anti")
    if not repeated.isEmpty():
        again = small(repeated, DROPPED)
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "h"]))
    return untucked(out)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents whose labels no fit may see; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """Rows of ``docs`` with their 0/1 ``label`` as ``y``: at most ``max_rows``, held-out ids never among them.

    The sample is the ``max_rows`` ids with the smallest hashes, so reruns agree. An id that is labelled more than
    once counts once, with its largest label, and of the rows of one id that of the smallest hash, found in each
    partition first. The ids (at most ``max_rows``) are broadcast.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
    ids = ids.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    ids = materialize(ids.orderBy(F.xxhash64("_id"), "_id").limit(max_rows), "labelled")
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns], "y")
    return rows.groupBy("_id").agg(F.min_by(whole, F.xxhash64(whole)).alias("_row")).select("_row.*")
