"""Near-duplicates by word shingles: MinHash bands for candidates, exact Jaccard similarity for the verdict.

The set of a text are the distinct hashes of its runs of ``WIDTH`` words (A-Z lower-cased). BANDS x ROWS minima of
that set make BANDS keys; two texts are candidates if they share one, which at a similarity s happens with probability
1 - (1 - s**ROWS)**BANDS (0.9996 at 0.8, more above). Every candidate pair is verified on the whole sets.

Equal sets are one node. Buckets of up to ``PAIR_BUCKET`` nodes are compared pair by pair. In larger ones all members
are compared with four of them first. Pairs within a component so found add nothing; of the others, bounds leave out
those that can't be similar. Shingles that RARE nodes or more of the large buckets have are frequent. A pair that
shares none of the others has at most as many in common as either has frequent ones, and two sets of A and B shingles
with o in common are similar only if 9 o >= 4 (A + B). So a set with many shingles of its own meets only the sizes that
its frequent ones allow, and pairs that share one of the others are found by it, RARE to one. No pair of a bucket that
can be similar is left out, and a group of copies with edits of their own costs rows in proportion to its members.

Defined cases: null and blank texts have the empty set and are one node; texts of fewer words than a shingle are one
shingle; one row of each component stays, of the smallest doc_id (null ids last); of rows equal in id and text any one
stays; an empty table gives an empty result; further columns, whatever their names, pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import keep_named
from marginalia.plans.components import connected_components
from marginalia.plans.skew import attach, small
from marginalia.plans.storage import discard, materialize

#: Words of a shingle and the similarity from which two texts are near-duplicates.
WIDTH, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
#: Nodes of a bucket that are compared with each other in one row, and members of a larger one that share a salt.
PAIR_BUCKET, PAIR_BLOCK = 16, 256
#: Nodes of large buckets that make a shingle a frequent one, and the ratio of sizes that share a class.
RARE, CLASS = 9, 1.05
#: Shingles that one batch of rows holds.
BATCH = 200_000
#: Shingles whose minima are taken at once; bounds the memory that one very long text takes.
BLOCK = 2048
#: Edges (32 MB) up to which one task finds the components, in place of some twenty jobs of the star rounds.
ONE_TASK = 2_000_000
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 150_000

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes | None, hashes: dict, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``width`` words in UTF-8 ``text``."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter((hashes[x] for x in words), dtype=np.uint64, count=len(words))
    width = min(width, len(w))
    n = len(w) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        h = (h ^ (h >> _TURN)) * _MIX + w[i : n + i]
    return np.unique((h ^ (h >> _TURN)) * _MIX)


def bands(items: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set that is not empty."""
    low = None
    for at in range(0, len(items), BLOCK):
        part = ((items[at : at + BLOCK, None] * _FACTORS + _OFFSETS) >> np.uint64(16)).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ (key >> _TURN)) * _MIX + column
    return (key ^ (key >> _TURN)) * _MIX


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text) of ``docs``: a row is known by its id and the hash of its text."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, node, size, bands) of every row: ``node`` is a hash of the set, ``bands`` its keys (none if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingles(t, hashes) for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
            node = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64))
            keys = pa.array([bands(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array([len(s) for s in sets], pa.int64()), keys], names=["doc_id", "h", "node", "size", "bands"])

    kind = dict(docs.dtypes)["doc_id"]
    return materialize(named(docs).mapInArrow(run, f"doc_id {kind}, h bigint, node bigint, size bigint, bands array<bigint>"), "signed")


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text), as a table, of the ``wanted`` nodes (node, doc_id, h): the text of one of their rows."""
    wanted = small(materialize(wanted.select("node", F.col("doc_id").alias("_d"), F.col("h").alias("_h")), "wanted"))
    found = named(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")))
    return materialize(found.groupBy("node").agg(F.first("text").alias("text")), "texts")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets are SIMILAR, by the texts of their rows.

    Nodes with many pairs stand as ``a``: their texts are repeated for every ``PAIR_BLOCK`` of them.
    """
    pairs = materialize(pairs.select("a", "b").distinct(), "candidates")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = texts_of(nodes.join(wanted, "node", "left_semi"), docs)

    many = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")), "degrees")
    blocks = many.withColumn("blocks", F.ceil(F.col("n") / PAIR_BLOCK))
    salted = attach(pairs, blocks, "a", ["blocks"], "n", F.col("b")).withColumn("salt", _salt(F.col("b")))
    own = texts.join(blocks.select(F.col("a").alias("node"), "blocks"), "node")
    own = own.select(F.col("node").alias("a"), F.col("text").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"))
    both = salted.select("a", "b", "salt").join(own, ["a", "salt"]).join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            near = [jaccard(shingles(x[i].as_py(), hashes), shingles(y[i].as_py(), hashes)) >= SIMILAR for i in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    out = materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "links")
    discard(pairs, texts, many)
    return out


def exploded(texts: DataFrame) -> DataFrame:
    """(node, s) for each shingle of ``texts`` (node, text), as a table; a long text leaves in several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items = shingles(text, hashes).view(np.int64)
                for at in range(0, len(items), BATCH):
                    part = items[at : at + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node, dtype=np.int64)), pa.array(part)], names=["node", "s"])

    return materialize(texts.select("node", "text").mapInArrow(run, "node bigint, s bigint"), "shingles")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the materialized ``edges`` (a, b); root is the smallest node of the component."""
    if edges.limit(ONE_TASK + 1).count() > ONE_TASK:
        return connected_components(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if not got:
            return
        nodes, at = np.unique(np.concatenate(got, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while (apart := root[a] != root[b]).any():
            x, y = root[a[apart]], root[b[apart]]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        for i in range(0, len(nodes), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], names=["node", "root"])

    return materialize(edges.select("a", "b").coalesce(1).mapInArrow(run, "node bigint, root bigint"), "roots")


def _salt(node: Column) -> Column:
    return F.pmod(F.xxhash64(node), F.col("blocks"))


def _pairs_within(members: Column) -> Column:
    """All (a, b), a < b by node, of an array of structs of which ``root`` differs and sizes allow a link."""
    fits = lambda x, y: (x["node"] < y["node"]) & (x["root"] != y["root"]) & (5 * x["size"] >= 4 * y["size"]) & (5 * y["size"] >= 4 * x["size"])
    each = F.transform(members, lambda x: F.transform(F.filter(members, lambda y: fits(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"))))
    return F.flatten(each)


def _without(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """``rows`` (node, s) less those whose shingle is ``frequent`` (s, times)."""
    if (hinted := small(frequent)) is not frequent:
        return rows.join(hinted, "s", "left_anti").select("node", "s")
    return attach(rows, frequent, "s", ["times"], "times", F.col("node")).filter(F.col("times").isNull()).select("node", "s")


def leftover(hot: DataFrame, found: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of large buckets ``hot`` (key, node, n) that ``found`` doesn't connect and that may be SIMILAR."""
    roots = materialize(components(found), "found")
    inside = hot.select("node").distinct()
    info = materialize(nodes.join(inside, "node", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "info")
    shingled = exploded(texts_of(info, docs))
    frequent = shingled.groupBy("s").agg(F.count("*").alias("times")).filter(F.col("times") >= RARE)
    own = materialize(_without(shingled, materialize(frequent, "frequent")), "own")
    discard(shingled)

    # What is frequent in a set is what is left of it without its own: those rows alone are looked at again.
    core = info.select("node", "size").join(own.groupBy("node").agg(F.count("*").alias("own")), "node", "left")
    core = core.select("node", (F.col("size") - F.coalesce("own", F.lit(0))).alias("core"))
    info = info.join(core, "node")
    # The sizes of sets that may be similar to a set of ``size`` of which ``core`` shingles can be shared.
    high = F.least(F.floor(9 * F.col("core") / 4) - F.col("size"), F.floor(5 * F.col("size") / 4))
    info = info.withColumn("low", F.ceil(4 * F.col("size") / 5)).withColumn("high", high)
    info = materialize(info.withColumn("class", F.floor(F.log(F.col("size").cast("double")) / math.log(CLASS))), "bounds")
    lone = own.groupBy("s").agg(F.collect_list("node").alias("m")).filter(F.size("m") > 1).select("s", F.explode("m").alias("node"))  # RARE at most
    lone = lone.join(info.select("node", "root", "size"), "node").groupBy("s").agg(F.collect_list(F.struct("node", "root", "size")).alias("m"))
    lone = lone.select(F.explode(_pairs_within(F.col("m"))).alias("e")).select("e.a", "e.b")

    hot = materialize(hot.select("key", "node").join(info, "node"), "placed")
    main = hot.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"))
    main = small(materialize(main, "main"))
    classes = hot.groupBy("key", "class").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.ceil(F.count("*") / PAIR_BLOCK).alias("blocks"))
    classes = small(materialize(classes, "classes"))
    mine = hot.join(main, "key").filter("root != main and low <= high").select("key", F.col("node").alias("a"), F.col("root").alias("ra"), "low", "high", F.col("size").alias("sa"), F.col("core").alias("ca"), F.col("bands").alias("ka"))
    mine = mine.join(classes, "key").filter("least <= high and most >= low").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    mine = mine.select("key", "class", "salt", "a", "ra", "low", "high", "sa", "ca", "ka")
    other = hot.join(main, "key").join(classes.select("key", "class", "blocks"), ["key", "class"])
    other = other.select("key", "class", _salt(F.col("node")).alias("salt"), F.col("node").alias("b"), F.col("root").alias("rb"), (F.col("root") == F.col("main")).alias("in_main"), F.col("size").alias("sb"), F.col("core").alias("cb"), F.col("bands").alias("kb"))
    fits = (F.col("ra") != F.col("rb")) & (F.col("in_main") | (F.col("a") < F.col("b"))) & F.col("sb").between(F.col("low"), F.col("high"))
    fits = fits & (9 * F.least("ca", "cb") >= 4 * (F.col("sa") + F.col("sb"))) & (F.col("key") == F.array_min(F.array_intersect("ka", "kb")))  # once a pair
    rest = mine.join(other, ["key", "class", "salt"]).filter(fits).select("a", "b")
    return rest.unionByName(lone)


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) over nodes: the components are those of all candidate pairs that are SIMILAR."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
    buckets = materialize(buckets.filter("n > 1"), "buckets")
    pairs = buckets.filter("n = 2").select("a", "b")
    big = small(materialize(buckets.filter("n > 2").select("key", "n"), "big"))
    members = materialize(keyed.join(big, "key").select("key", "node", "n"), "members")

    few = members.filter(F.col("n") <= PAIR_BUCKET).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("m"))
    each = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = pairs.unionByName(few.select(F.explode(each).alias("e")).select("e.a", "e.b"))

    hot = members.filter(F.col("n") > PAIR_BUCKET)
    if hot.isEmpty():
        return verified(pairs, docs, nodes)
    # A few members, the same in every bucket that has them, meet all others.
    firsts = hot.groupBy("key").agg(F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(4)])).alias("firsts"))
    star = hot.join(small(materialize(firsts, "firsts")), "key").select(F.explode("firsts").alias("a"), F.col("node").alias("b")).filter("a != b")
    found = verified(pairs.unionByName(star), docs, nodes)
    return found.unionByName(verified(leftover(hot, found, docs, nodes), docs, nodes))


def _among(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges (a, b) that make the nodes of each group one component: all lead to its smallest node."""
    own = rows.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "node").distinct()
    found = groups.join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).select("root", "node").distinct()
    found = materialize(found, "grouped")
    low = found.groupBy("root").agg(F.min("node").alias("a"), F.count("*").alias("n"))
    return attach(found, low, "root", ["a"], "n", F.col("node")).filter("a != node").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``docs`` less all rows but one of each component of texts with SIMILAR sets or more; ``docs`` is read several times.

    ``groups`` (doc_id, h, root), if given, links the rows of a root as well, h being the hash of a text.
    """
    rows = signed(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "size", "bands"))
    nodes = materialize(rows.groupBy("node").agg(best.alias("b")).select("node", "b.*"), "nodes")

    edges = links(docs, nodes)
    if groups is not None:
        edges = materialize(edges.unionByName(_among(rows, groups)), "links")
    linked = components(edges).join(nodes.select("node", "none", "doc_id", "h"), "node")
    linked = materialize(linked.select("node", "root", F.struct("none", "doc_id", "h").alias("id")), "linked")
    heads = linked.groupBy("root").agg(F.min("id").alias("head"), F.count("*").alias("m"))
    gone = attach(linked, heads, "root", ["head"], "m", F.col("node")).filter("id != head").select("node")
    return keep_named(docs, rows, nodes.join(gone, "node", "left_anti"))
