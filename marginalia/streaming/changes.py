"""A feed of note changes, folded into a keyed table by deltas, with reviews that wait until they are acknowledged.

A batch reads the rows of the keys that it changes, from their buckets alone, and writes those rows (``plans.deltas``); so
what it takes is in proportion to the batch, not to the state. A batch that is run again after a failure finds its
number in the log and writes nothing, and readers always see a whole state, of any batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.deltas import DeltaTable
from marginalia.plans.storage import materialize


def latest(changes: DataFrame) -> DataFrame:
    """The last change (by seq) of every key among (key, seq, hash); a null hash is a removal."""
    return changes.groupBy("key").agg(F.max(F.struct("seq", "hash")).alias("c")).select("key", "c.seq", "c.hash")


def folded(state: DataFrame, changes: DataFrame) -> DataFrame:
    """``state`` (key, seq, hash, status) after ``changes``: added, modified, unchanged or removed."""
    new = latest(changes).select("key", F.col("seq").alias("ns"), F.col("hash").alias("nh"), F.lit(True).alias("_n"))
    both = state.select("key", "seq", "hash", F.lit(True).alias("_s")).join(new, "key", "full")
    newer = F.col("_n").isNotNull() & (F.col("_s").isNull() | (F.col("ns") > F.col("seq")))
    status = (
        F.when(~newer, "unchanged").when(F.col("nh").isNull(), "removed").when(F.col("_s").isNull() | F.col("hash").isNull(), "added")
        .when(F.col("nh") == F.col("hash"), "unchanged").otherwise("modified")
    )
    return both.select(
        "key", F.when(newer, F.col("ns")).otherwise(F.col("seq")).alias("seq"), F.when(newer, F.col("nh")).otherwise(F.col("hash")).alias("hash"), status.alias("status")
    )


STATE = "key string, seq bigint, hash string, status string"
#: A key whose change awaits a review: the hash that is to be acknowledged (null: it is gone), and the batch it came with.
PENDING = "key string, hash string, since bigint"


class ChangeFeed:
    """``foreachBatch`` target: folds every batch into the state and the pending reviews below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, root = spark, root.rstrip("/")
        self.table = DeltaTable(spark, f"{root}/state", f"{STATE}, batch bigint", "key", buckets)
        self.reviews = DeltaTable(spark, f"{root}/pending", PENDING, "key", buckets)

    def _number(self, batch: int) -> int:
        """The last entry of the log whose batch isn't later."""
        return max((n for n in range(self.table.number() + 1) if self.table.entry(n)["batch"] <= batch), default=-1)

    def state(self, batch: int) -> DataFrame:
        """(key, seq, hash, status) after a batch; what it didn't touch is unchanged, or removed if it is gone."""
        rows = self.table.read(self._number(batch))
        calm = F.when(F.col("hash").isNull(), "removed").otherwise("unchanged")
        return rows.select("key", "seq", "hash", F.when(F.col("batch") == batch, F.col("status")).otherwise(calm).alias("status"))

    def pending(self) -> DataFrame:
        return self.reviews.read()

    def acknowledge(self, acks: DataFrame) -> int:
        """Settle the reviews of ``acks`` (key, hash) that name the hash of now, null for what is gone; how many were.

        One that names an older hash settles nothing.
        """
        one = acks.select("key", "hash").distinct()
        held = self.reviews.of_keys(one.select("key")).select(F.col("key").alias("_key"), F.col("hash").alias("_hash"))
        done = one.join(held, (F.col("key") == F.col("_key")) & F.col("hash").eqNullSafe(F.col("_hash"))).select("key").distinct()
        done = materialize(done, "acknowledged")
        if n := done.count():
            self.reviews.write(self.spark.createDataFrame([], PENDING), done)
        return n

    def __call__(self, changes: DataFrame, batch: int) -> None:
        changes = materialize(changes.select("key", "seq", "hash").filter("key is not null"), "changes")
        old = self.table.of_keys(changes.select("key"), self._number(batch - 1)).select("key", "seq", "hash", "status")
        new = folded(old, changes).withColumn("batch", F.lit(batch).cast("long"))
        new = materialize(new.join(old.select(F.col("key").alias("_k"), F.col("seq").alias("_s")), F.col("key") == F.col("_k"), "left").filter("_s is null or seq > _s").drop("_k", "_s"), "folded")
        self.table.write(new, batch=batch)
        self.reviews.write(new.filter("status in ('added', 'modified', 'removed')").select("key", "hash", F.lit(batch).cast("long").alias("since")), batch=batch)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
