"""Best-fit packing planned over a histogram of lengths.

1. Every task tokenises its documents, cuts those longer than a sequence into pieces and numbers its pieces of each
   length: a piece's *rank* is its number in the task plus those of the tasks before.
2. The counts of the lengths (as many as a sequence has places, whatever the corpus) are all that the plan sees: from
   the longest on, each length fills the open sequences whose gap is the tightest, many alike at a time. A *slot* says
   where the ranks from one to another of a length go: so many a sequence, from this sequence and place on.
3. Slots are cut at the tasks' ranges of ranks and joined to the pieces by length and task.

Sequences alike are held as one range. Filling one with all that fit of a length leaves less than half of its gap, and
a length splits two ranges at most, so a plan has less than 11 x 6 slots for each length. No key of the joins holds
more rows than one task has read, whatever lengths, ids or texts repeat.

Defined cases: null and empty texts are one token, the closing 0; special strings in a text are what the library makes
of them; a text of any length is tokenised whole; repeated rows are packed each; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import read
from marginalia.llm.segments import RankEncoder, byte_ranks
from marginalia.plans.storage import materialize

CAPACITY = 2048
#: The id that ends a document.
END = 0


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: all full but the first."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): all pieces, numbered by task (``part``) and length.

    Numbers are settled only once the result is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, number = RankEncoder(path, *shared.value), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            row, out = [], []
            for k, text in enumerate(batch.column(1)):
                view = memoryview(np.array([*ids(text.as_py() or ""), END], "<u4").tobytes())
                for piece, (start, length) in enumerate(cuts(len(view) // 4, capacity)):
                    row.append(k)
                    out.append((piece, start, length, zlib.crc32(view[4 * start : 4 * (start + length)]), part, number[length]))
                    number[length] += 1
            if row:
                columns = [pa.array(v, kind) for v, kind in zip(zip(*out, strict=True), KINDS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *columns], names=["doc_id", *KINDS])

    shared = docs.sparkSession.sparkContext.broadcast(byte_ranks(path))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


KINDS = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "rank": pa.int64()}


@dataclass(frozen=True)
class Slot:
    """The pieces of a length with ranks from ``first`` to below ``last``: ``each`` a sequence, from the sequence
    ``sequence`` and the place ``place`` on."""

    length: int
    first: int
    last: int
    each: int
    sequence: int
    place: int


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Slots for all pieces of a histogram of lengths, best-fit from the longest on, and the number of sequences."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # gap -> (first sequence, how many alike)
    slots, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, total, gap = 0, counts[length], length
        while rank < total:
            while gap < capacity and not gaps[gap]:
                gap += 1
            each = gap // length
            if gaps[gap]:
                first, n = gaps[gap].pop()
            else:  # nothing open is wide enough
                first, n = sequences, -(-(total - rank) // each)
                sequences += n
            full = min(n, (total - rank) // each)
            for many, per in ((full, each), (int(full < n), min(each, total - rank - full * each))):
                if many and per:
                    slots.append(Slot(length, rank, rank + many * per, per, first, capacity - gap))
                    gaps[gap - per * length].append((first, many))
                    rank, first, n = rank + many * per, first + many, n - many
            if n:
                gaps[gap].append((first, n))
    return slots, sequences


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of the rows of ``docs``."""
    spark = docs.sparkSession
    rows = materialize(pieces(docs, path, capacity), "pieces")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("length", "part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = materialize(parts, "parts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found, _ = plan(counts, capacity)
    kinds = "length bigint, first bigint, last bigint, each bigint, sequence bigint, place bigint"
    slots = spark.createDataFrame([(s.length, s.first, s.last, s.each, s.sequence, s.place) for s in found], kinds)
    dealt = parts.join(F.broadcast(slots), "length").filter((F.col("first") < F.col("base") + F.col("n")) & (F.col("last") > F.col("base")))
    joined = rows.join(dealt, ["length", "part"]).withColumn("k", F.col("base") + F.col("rank") - F.col("first"))
    joined = joined.filter((F.col("k") >= 0) & (F.col("k") < F.col("last") - F.col("first")))
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.expr("k div each")).alias("sequence_id"), (F.col("place") + F.col("k") % F.col("each") * F.col("length")).alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every document in sequences of 2048 tokens."""
    import public_tokenizers

    return packed(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
