"""Document fingerprints by invertible Bloom lookup sketches (DataFrame operations only).

A text is a set of paragraph digests: its lines, a line of more than PIECE words cut into stretches of so many. A
sketch has three tables of cells; a digest enters one cell of each, where digests are counted, and they and their
checksums are XORed. The sketch of one text minus that of another holds just the digests in which the two differ;
peeling takes out cells that hold a single one, until all are recovered.

Where that gets stuck (attempt 0 are the sketches that are returned), both sets are hashed anew and sketched again
with twice the cells, and so on until everything is recovered: there is no attempt beyond which another method steps
in. Sets of more digests than PART are dealt into parts by bits of the digests, as many as their sizes call for, each
with sketches of its own, so that work grows with the digests and not their square; only parts that got stuck are
tried again. The number of the attempt that recovered the last part is returned.

Likeness is that of the digest sets: (common) / (all), from the sizes in the sketches and the recovered difference.

Defined cases: null and blank texts have the empty set, all empty sets are alike (1.0); repeated paragraphs count
once; rows with one doc_id follow each other in the order of a hash of their texts, null ids come first, and the
document after the last is the first; a single document is its own next; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.llm.common import read

#: Words of a stretch, and cells in each of the three tables of the returned sketch.
PIECE, CELLS = 32, 8
#: Digests of both sets that a part holds on average when sets are sketched again, and groups of parts are dealt in.
PART, GROUP = 16, 32
#: Times that each of the three tables is looked through for single digests.
ROUNDS = 8
#: Attempts, each of twice the cells; a part has about PART digests, and the last attempt half a million cells for them.
ATTEMPTS = 16


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs."""
    found = F.regexp_extract_all(text, F.lit(rf"(?:[^\s]++[^\S\n]*+){{1,{PIECE}}}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.xxhash64(x)))


def _place(digest: Column, table: int, cells: Column) -> Column:
    """The cell of a digest in one of the three tables, from bits of its own; ``cells`` is a power of two."""
    return F.shiftright(digest, 20 * table).bitwiseAND(cells - 1)


def _check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(0xFFFFFFFF))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated one time, as the variable of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(items: Column, cells: Column) -> Column:
    """Three tables of ``cells`` cells (c, k, h): how many digests, their XOR, the XOR of their checksums."""
    none = F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
    spots = F.sequence(F.lit(0).cast("long"), cells - 1)

    def filled(table: int) -> Column:
        cell = lambda j: F.aggregate(
            F.filter(items, lambda d: _place(d, table, cells) == j), none,
            lambda a, d: F.struct((a["c"] + 1).alias("c"), a["k"].bitwiseXOR(d).alias("k"), a["h"].bitwiseXOR(_check(d)).alias("h")),
        )
        return F.transform(spots, cell)

    return F.array(*[filled(t) for t in range(3)])


def subtracted(a: Column, b: Column) -> Column:
    less = lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h"))
    return F.zip_with(a, b, lambda s, t: F.zip_with(s, t, less))


def peeled(tables: Column, cells: Column) -> Column:
    """(ok, found): whether all of a subtracted sketch was recovered, and the digests (k, c: +1 or -1) that were.

    A step takes the single digests of one table, which are distinct, out of all three; three steps in a row without
    one mean that the sketch is empty or stuck, and later steps do nothing.
    """
    state = F.struct(tables.alias("t"), F.array().cast("array<struct<c:int,k:bigint,h:bigint>>").alias("found"), F.lit(0).alias("idle"))

    def taken(s: Column, got: Column) -> Column:
        def without(spots: Column, cell: Column, t: int, j: Column) -> Column:
            return F.aggregate(
                F.filter(spots, lambda q: _place(q["k"], t, cells) == j), cell,
                lambda a, q: F.struct((a["c"] - q["c"]).alias("c"), a["k"].bitwiseXOR(q["k"]).alias("k"), a["h"].bitwiseXOR(q["h"]).alias("h")),
            )

        def table(t: int) -> Column:
            return F.transform(s["t"][t], lambda cell, j: without(got, cell, t, j))

        left = F.array(*map(table, range(3)))
        idle = F.struct(s["t"].alias("t"), s["found"].alias("found"), (s["idle"] + 1).alias("idle"))
        return F.when(F.size(got) == 0, idle).otherwise(F.struct(left.alias("t"), F.concat(s["found"], got).alias("found"), F.lit(0).alias("idle")))

    def step(s: Column, i: Column) -> Column:
        def pure(t: int) -> Column:
            return F.filter(s["t"][t], lambda x, j: (F.abs(x["c"]) == 1) & (_place(x["k"], t, cells) == j) & (x["h"] == _check(x["k"])))

        got = F.when(i == 0, pure(0)).when(i == 1, pure(1)).otherwise(pure(2))
        return F.when(s["idle"] >= 3, s).otherwise(once(got, lambda got: taken(s, got)))

    def result(s: Column) -> Column:
        ok = F.forall(s["t"], lambda t: F.forall(t, lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0)))
        return F.struct(ok.alias("ok"), s["found"].alias("found"))

    return F.aggregate(F.array(*[F.lit(i % 3) for i in range(3 * ROUNDS)]), state, step, result)


def dealt(a: Column, b: Column, parts: Column) -> Column:
    """The sets ``a`` and ``b`` as an array of (a, b), dealt into ``parts`` (a power of two) by bits of the digests.

    More than GROUP parts are dealt in two steps, so that a digest is looked at parts / GROUP + GROUP times.
    """

    def of(items: Column, shift: int, mask: Column, part: Column) -> Column:
        return F.filter(items, lambda d: F.shiftrightunsigned(d, shift).bitwiseAND(mask) == part)

    def split(a: Column, b: Column, shift: int, ways: Column) -> Column:
        return F.transform(F.sequence(F.lit(0).cast("long"), ways - 1), lambda p: F.struct(of(a, shift, ways - 1, p).alias("a"), of(b, shift, ways - 1, p).alias("b")))

    within = F.least(parts, F.lit(GROUP).cast("long"))
    groups = once(F.greatest(F.lit(1).cast("long"), F.shiftright(parts, GROUP.bit_length() - 1)), lambda ways: split(a, b, 55, ways))
    return F.flatten(F.transform(groups, lambda g: split(g["a"], g["b"], 50, within)))


def recovered(a: Column, b: Column) -> Column:
    """(d, attempt): how many digests two sets differ in, by larger and larger sketches, and how many attempts it took.

    A part that not even the last attempt peels, half a million cells for about PART digests, counts as different whole.
    """
    parts = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.size(a) + F.size(b), F.lit(1)) / float(PART)))).cast("long")
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("attempt"), dealt(a, b, F.greatest(parts, F.lit(1).cast("long"))).alias("left"))
    again = lambda items: F.transform(items, lambda d: F.xxhash64(d))

    def one(part: Column, cells: Column) -> Column:
        own = once(part["a"], lambda x: sketch(x, cells))
        other = once(part["b"], lambda x: sketch(x, cells))
        got = once(peeled(subtracted(own, other), cells), lambda r: F.when(r["ok"], F.size(r["found"])))
        return F.struct(got.alias("d"), part.alias("part"))

    def attempt(s: Column, i: Column) -> Column:
        cells = F.element_at(F.array(*[F.lit(CELLS << k).cast("long") for k in range(1, ATTEMPTS + 1)]), i)
        fresh = F.transform(s["left"], lambda p: F.struct(again(p["a"]).alias("a"), again(p["b"]).alias("b")))
        tried = F.transform(fresh, lambda p: one(p, cells))

        def after(tried: Column) -> Column:
            more = F.aggregate(tried, s["d"], lambda n, t: n + F.coalesce(t["d"], F.lit(0)))
            left = F.transform(F.filter(tried, lambda t: t["d"].isNull()), lambda t: t["part"])
            return F.struct(more.alias("d"), i.alias("attempt"), left.alias("left"))

        return F.when(F.size(s["left"]) == 0, s).otherwise(once(tried, after))

    def result(s: Column) -> Column:
        stuck = F.aggregate(s["left"], s["d"], lambda n, p: n + F.size(p["a"]) + F.size(p["b"]))
        return F.struct(stuck.alias("d"), s["attempt"].alias("attempt"))

    return F.aggregate(F.array(*map(F.lit, range(1, ATTEMPTS + 1))), start, attempt, result)


def text_of(tables: Column, size: Column) -> Column:
    """The sketch as a string: the set's size, then count, XOR and checksum of every cell, in hexadecimal."""
    count = lambda c: F.lpad(F.right(F.hex(c), F.lit(4)), 4, "0")
    each = F.transform(F.flatten(tables), lambda x: F.concat(count(x["c"]), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["h"]), 8, "0")))
    return F.lower(F.concat(F.lpad(F.hex(size), 8, "0"), F.lit(":"), F.array_join(each, "")))


def with_difference(rows: DataFrame, a: str, b: str, cells_a: str, cells_b: str, name: str) -> DataFrame:
    """``rows`` with ``name``: (d, attempt), how many digests the sets ``a`` and ``b`` differ in, and which attempt
    recovered them; 0 is that of the sketches ``cells_a`` and ``cells_b``."""
    first = once(peeled(subtracted(F.col(cells_a), F.col(cells_b)), F.lit(CELLS).cast("long")), lambda r: F.when(r["ok"], F.size(r["found"])))
    again = once(first, lambda d: F.when(d.isNotNull(), F.struct(d.alias("d"), F.lit(0).alias("attempt"))).otherwise(recovered(F.col(a), F.col(b))))
    return rows.withColumn(name, again)


def likeness(a: str, b: str, difference: str) -> Column:
    """(common) / (all) of two sets from their sizes and difference; 1.0 for two empty sets."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise((both - F.col(difference)) / (both + F.col(difference)))


def with_next(docs: DataFrame, ways: int | None = None) -> DataFrame:
    """(doc_id, text, items, next_text, next_items): every document with the one that follows by doc_id.

    The ids are cut into ``ways`` ranges of about as many rows; rows of one id (or none) that fill several ranges are
    dealt among them by a hash of their texts, which orders them. Each range is sorted on its own, with the first row
    of the next range (the last's: of the first) at its end. At most ``ways`` numbers and rows are broadcast.
    """
    spark = docs.sparkSession
    ways = ways or min(1024, max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    steps = F.array(*[F.lit(i / ways) for i in range(1, ways)])
    found = docs.agg(F.percentile_approx("doc_id", steps, 10_000), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    cuts = found[0] or []
    empty = max(1, round(ways * found[2] / max(1, found[1])))  # ranges of the null ids
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 33))
    share = lambda n: F.floor(F.col("h") * n / float(1 << 31)).cast("int")
    below = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    hot = {c: n for c in set(cuts) if (n := cuts.count(c)) > 1}
    within = F.lit(0)
    for c, n in sorted(hot.items()):
        within = F.when(F.col("doc_id") == c, share(n)).otherwise(within)
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), share(empty)).otherwise(F.lit(empty) + below + within))

    one = W.orderBy("part")
    first = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")
    heads = rows.groupBy("part").agg(F.min(first).alias("low"))
    heads = heads.withColumn("to", F.lag("part").over(one)).withColumn("last", F.max("part").over(W.partitionBy()))
    heads = heads.select(F.coalesce("to", "last").alias("to"), F.col("part").alias("of"), "low")
    ends = rows.join(F.broadcast(heads), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("h") == F.col("low.h")))
    ends = ends.groupBy("to").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
    ends = ends.select("doc_id", "text", F.lit(0).cast("long").alias("h"), F.col("to").alias("part"), F.lit(True).alias("end"))
    rows = rows.withColumn("end", F.lit(False)).unionByName(ends).withColumn("items", digests(F.col("text")))
    order = W.partitionBy("part").orderBy("end", F.col("doc_id").asc_nulls_first(), "h", "text")
    rows = rows.withColumn("next", F.lead(F.struct("text", "items")).over(order)).filter(~F.col("end"))
    return rows.select("doc_id", "text", "items", F.col("next.text").alias("next_text"), F.col("next.items").alias("next_items"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the sketches of every document and its edited text, and how they compare."""
    rows = with_next(read(spark, sf_dir, "documents"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_k", (F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, int(n_chars) - _k)"), F.expr("substring(next_text, 1, _k)"))
    rows = rows.withColumn("edited", edited).withColumn("edited_items", digests(F.col("edited")))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "items", "edited_items", "next_items")
    for name in ("items", "edited_items", "next_items"):
        rows = rows.withColumn(f"{name}_cells", sketch(F.col(name), F.lit(CELLS).cast("long")))
    rows = with_difference(rows, "items", "edited_items", "items_cells", "edited_items_cells", "edited")
    rows = with_difference(rows, "items", "next_items", "items_cells", "next_items_cells", "next")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        text_of(F.col("items_cells"), F.size("items")).alias("fingerprint"),
        text_of(F.col("edited_items_cells"), F.size("edited_items")).alias("edited_fingerprint"),
        likeness("items", "edited_items", "edited.d").alias("near_edited"),
        likeness("items", "next_items", "next.d").alias("near_next"),
        F.col("edited.attempt").alias("edited_attempt"), F.col("next.attempt").alias("next_attempt"),
    )
