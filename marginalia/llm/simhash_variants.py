"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves. Of two fingerprints that differ in at most two bits, one half
differs in at most one bit, so the two share that half as it is or with that one bit wiped out. Every distinct
fingerprint is indexed under its halves and their 32 one-wildcard variants; equal keys meet in an aggregation.

Buckets of two are a pair. Buckets up to ``PAIR_BUCKET`` are verified inside one row. A larger bucket has more pairs
than may be made, so its members meet by the exact way for hot buckets: each is keyed once more, by its whole segments
with one bit wiped out on either side, that is by itself and the 64 values that are one bit away. Two share such a
value if and only if they are linked, so a key's members all are. The links of hot buckets are whole, and the rows made
grow in proportion to the members, never with their square.

Defined cases: null and blank texts have fingerprint zero and link like any other; texts of fewer words than a
shingle are one shingle; rows with equal text are one node; a null doc_id never is a component id unless it is all
there is; an empty table gives an empty result; further columns pass through untouched in ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import keep_named
from marginalia.plans.components import connected_components
from marginalia.plans.skew import attach, small
from marginalia.plans.storage import materialize

#: Members of a bucket that are compared with each other in one row.
PAIR_BUCKET = 16
#: Shingles hashed at once; bounds the memory that one very long text takes.
BLOCK = 65_536


def simhash(text: bytes | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of UTF-8 ``text`` (XXH64, seed 42, repeats counted)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        grams = zip(*(part[i:] for i in range(width)), strict=False) if len(words) >= width else [part]
        h = np.array([digest(join(g), 42) for g in grams], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, h, fp) for every row of ``docs``: the hash of the text, and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, width) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "h", "fp"])

    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, h bigint, fp bigint")


def _half(side: int) -> Column:
    fp = F.col("fp")
    return fp.bitwiseAND(F.lit(0xFFFFFFFF)) if side == 0 else F.shiftrightunsigned(fp, 32)


def _key(side: int, wild: int, value: Column) -> Column:
    """One long for (half, wiped bit or 32 for none, value)."""
    return value.bitwiseOR(F.lit((side * 64 + wild) << 32))


def _variants() -> Column:
    """Array of (key, bit): both halves whole (bit null), and with each bit wiped out (bit: its value)."""
    out = []
    for side in (0, 1):
        half = _half(side)
        out.append(F.struct(_key(side, 32, half).alias("key"), F.lit(None).cast("int").alias("bit")))
        for p in range(32):
            wiped = half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << p)))
            bit = F.shiftright(half, p).bitwiseAND(F.lit(1)).cast("int")
            out.append(F.struct(_key(side, p, wiped).alias("key"), bit.alias("bit")))
    return F.array(*out)


def _around() -> Column:
    """A fingerprint and the 64 values one bit from it. Two fingerprints share one if and only if they are linked."""
    masks = [0, *(1 << p for p in range(63)), -(1 << 63)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("fp").bitwiseXOR(m))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct ``fp`` such that the graph has exactly the components of "at most 2 bits apart"."""
    rows = fps.select("fp", F.explode(_variants()).alias("v")).select("fp", "v.key", "v.bit")
    buckets = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"),
        F.min("bit").alias("b0"), F.max("bit").alias("b1"),
    )
    buckets = buckets.filter((F.col("n") > 1) & (F.col("b0").isNull() | (F.col("b0") < F.col("b1"))))
    buckets = materialize(buckets.select("key", "n", "a", "b"), "buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = buckets.filter(F.col("n") == 2).filter(near).select("a", "b")

    big = small(materialize(buckets.filter(F.col("n") > 2).select("key", "n"), "big"))
    members = materialize(rows.select("fp", "key").join(big, "key"), "members")
    few = members.filter(F.col("n") <= PAIR_BUCKET).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    found = F.flatten(
        F.transform("m", lambda x: F.transform(
            F.filter("m", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= 2)), lambda y: F.struct(x.alias("a"), y.alias("b"))
        ))
    )
    few = few.select(F.explode(found).alias("e")).select("e.a", "e.b")

    hot = members.filter(F.col("n") > PAIR_BUCKET).select("fp").distinct()
    deep = hot.select("fp", F.explode(_around()).alias("near"))
    deep = deep.groupBy("near").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("m"))  # 65 at most
    deep = deep.filter(F.size("m") > 1).select("a", F.explode("m").alias("b")).filter((F.col("a") != F.col("b")) & near)
    return pairs.unionByName(few).unionByName(deep).distinct()


def components(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    rows = materialize(with_fingerprints(docs, width), "fingerprints")
    fps = rooted(rows).select("fp", "n", F.least("head", "low").alias("component_id"))
    return attach(rows.select("doc_id", "fp"), fps, "fp", ["component_id"], "n", F.col("doc_id"))


def rooted(rows: DataFrame) -> DataFrame:
    """(fp, n, low, root, head) for every fingerprint of ``rows``: its rows, their smallest id, its component and the
    smallest id of that; root and head are null for a fingerprint that nothing links."""
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    roots = connected_components(links(fps)).withColumnRenamed("node", "fp")
    linked = materialize(roots.join(fps.select("fp", "low"), "fp"), "linked")
    heads = linked.groupBy("root").agg(F.min("low").alias("head"), F.count("*").alias("m"))
    linked = attach(linked, heads, "root", ["head"], "m", F.col("fp")).select("fp", "root", "head")
    return fps.join(linked, "fp", "left")


def grouped(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, h, root) of every row of ``docs``: rows of one root are those of one component."""
    rows = materialize(with_fingerprints(docs, width), "fingerprints")
    return attach(rows, rooted(rows).select("fp", "n", F.coalesce("root", "fp").alias("root")), "fp", ["root"], "n", F.col("doc_id")).select("doc_id", "h", "root")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``docs`` less all rows but one of each component: the one with the smallest doc_id, and of those of that id in the
    component the one of the smallest hash of its text. Other rows of the id are in components of their own."""
    rows = materialize(with_fingerprints(docs, width), "fingerprints")
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("best"))
    found = best.join(rooted(rows).select("fp", F.coalesce("root", "fp").alias("root")), "fp")
    kept = found.groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.h")
    return keep_named(docs, rows, kept)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the fingerprint and the component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
