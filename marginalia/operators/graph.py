"""Reachability, closures and link audits over edge tables.

Frontiers are written to the shared folder level by level, so a lost executor repeats one level and plans stay short.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.plans.skew import attach
from marginalia.plans.storage import materialize


def impact(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(trigger, target, depth, chain) of all that depends on the seeds, over edges (dependent, dependency).

    The chain is the smallest of the shortest: each level keeps the least array for each (trigger, target). Targets
    seen before are not entered again, so cycles end; levels go on until nothing is new.
    """
    back = edges.select(F.col("dependency").alias("_from"), F.col("dependent").alias("_to")).distinct()
    start = seeds.select(F.col("node").alias("trigger")).distinct()
    front = start.select("trigger", F.col("trigger").alias("target"), F.lit(0).alias("depth"), F.array("trigger").alias("chain"))
    seen = front = materialize(front, "front")
    for depth in count(1):
        step = front.join(back, F.col("target") == F.col("_from"))
        step = step.select("trigger", F.col("_to").alias("target"), F.lit(depth).alias("depth"), F.concat("chain", F.array("_to")).alias("chain"))
        step = step.groupBy("trigger", "target", "depth").agg(F.min("chain").alias("chain"))
        front = materialize(step.join(seen.select("trigger", "target"), ["trigger", "target"], "left_anti").select(*seen.columns), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def change_impact(nodes: DataFrame, seeds: DataFrame, now: DataFrame, then: DataFrame, baseline: bool = True) -> DataFrame:
    """(trigger, target, kind, reason, depth, chain) of what changed nodes and newly declared edges have an effect on.

    ``nodes`` is (node, kind) of what is there, ``seeds`` (node, reason) of changed nodes, ``now`` and ``then`` are the
    edges (dependent, dependency, field) declared now and before. A changed node walks the edges of both times; an
    edge that ``then`` doesn't have starts at its dependent, which is a target itself, and walks the edges of ``now``
    alone, so that no sibling is touched. Without a ``baseline`` no edge is new. Targets are nodes that are there; the
    walk goes on through those that are not.

    Both kinds of seeds go in one walk, level by level, over one table of edges that tells which are current. For a
    (trigger, target) a changed node counts before a new edge, of new edges the first dependent, of its chains the
    least of the shortest.
    """
    pairs = ["dependent", "dependency"]
    back = now.select(*pairs, F.lit(True).alias("current")).unionByName(then.select(*pairs, F.lit(False).alias("current")))
    back = back.groupBy(*pairs).agg(F.bool_or("current").alias("current")).filter("dependent is not null and dependency is not null")
    back = materialize(back.select(F.col("dependency").alias("_from"), F.col("dependent").alias("_to"), "current"), "edges")
    known = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*pairs, "field")]
    fresh = now.select(*pairs, "field").distinct().join(then.select(*[F.col(c).alias(f"_{c}") for c in (*pairs, "field")]), known, "left_anti")
    fresh = fresh if baseline else fresh.limit(0)
    string = nodes.schema["node"].dataType.simpleString()
    front = seeds.groupBy("node").agg(F.min("reason").alias("reason")).select(
        F.col("node").alias("trigger"), F.lit(None).cast(string).alias("start"), F.col("node").alias("target"), F.lit(0).alias("depth"), F.array("node").alias("chain"), "reason"
    )
    edge = fresh.select(F.col("dependency").alias("trigger"), F.col("dependent").alias("start"), F.col("dependent").alias("target"), F.lit(1).alias("depth")).distinct()
    front = front.unionByName(edge.withColumn("chain", F.array("trigger", "target")).withColumn("reason", F.lit("declared_dependency_added")))
    seen = front = materialize(front, "front")
    walk = F.col("start").isNull()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("trigger", "start", "target")]
    while not front.isEmpty():
        step = front.join(back, F.col("target") == F.col("_from")).filter((walk | F.col("current")) & (F.col("_to") != F.col("trigger")))
        step = step.select("trigger", "start", F.col("_to").alias("target"), (F.col("depth") + 1).alias("depth"), F.concat("chain", F.array("_to")).alias("chain"), "reason")
        step = step.groupBy("trigger", "start", "target", "depth", "reason").agg(F.min("chain").alias("chain"))
        step = step.join(seen.select(*[F.col(c).alias(f"_{c}") for c in ("trigger", "start", "target")]), same, "left_anti")
        front = materialize(step.select(*seen.columns), "front")
        seen = seen.unionByName(front)
    out = seen.filter("depth > 0").groupBy("trigger", "target").agg(F.min_by(F.struct("reason", "depth", "chain"), F.struct(F.col("start").isNotNull(), F.col("start"), "depth", "chain")).alias("_b"))
    return out.join(nodes.select(F.col("node").alias("target"), "kind"), "target").select("trigger", "target", "kind", "_b.*")


def closure(edges: DataFrame) -> DataFrame:
    """(a, b) for every b that a reaches by one edge (a, b) or more; a node on a cycle reaches itself."""
    step = edges.select("a", "b").distinct()
    seen = front = materialize(step, "closure")
    while True:
        more = front.join(step.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        front = materialize(more.join(seen, ["a", "b"], "left_anti"), "closure")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) less those that lead nowhere or come from nowhere, until none is left of that kind."""
    left = edges.count()
    while left:
        nodes = edges.select(F.col("a").alias("n")).distinct().join(edges.select(F.col("b").alias("n")).distinct(), "n", "left_semi")
        nodes = materialize(nodes, "inner")
        kept = edges.join(nodes.withColumnRenamed("n", "a"), "a", "left_semi").join(nodes.withColumnRenamed("n", "b"), "b", "left_semi")
        edges = materialize(kept.select("a", "b"), "trimmed")
        if (now := edges.count()) == left:
            break
        left = now
    return edges


def _spread(start: DataFrame, steps: DataFrame, hops: int = 4) -> DataFrame:
    """(node, mark) after the largest marks have gone along ``steps`` (a, b) as far as they can; ``hops`` edges a round."""
    now, seen = materialize(start.select("node", "mark"), "marks"), None
    while True:
        total = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("node", "mark").cast("decimal(38,0)"))).first())
        if total == seen:
            return now
        seen, out = total, now
        for _ in range(hops):
            more = out.join(steps, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "mark")
            out = out.unionByName(more).groupBy("node").agg(F.max("mark").alias("mark"))
        now = materialize(out, "marks")


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node) of every node on a cycle of the edges (a, b), loops of one node included.

    Each node takes the largest node that reaches it as its colour; what reaches a colour's own node backwards within
    that colour is one cycle's component. It is set aside with all edges between colours, and the rest goes on. Rows
    grow with the edges, never with pairs of nodes.
    """
    edges = materialize(edges.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "edges")
    found = edges.filter("a = b").select(F.col("a").alias("node"))
    live = edges.filter("a != b")
    while not (live := _trimmed(live)).isEmpty():
        nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        colours = _spread(nodes.withColumn("mark", F.col("node")), live)
        of = lambda side: colours.select(F.col("node").alias(side), F.col("mark").alias(f"m{side}"))
        live = materialize(live.join(of("a"), "a").join(of("b"), "b").filter("ma = mb").select("a", "b"), "coloured")
        back = live.select(F.col("b").alias("a"), F.col("a").alias("b"))
        ring = materialize(_spread(colours.filter("node = mark"), back).join(live.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("node"), "ring")
        found = found.unionByName(ring)
        gone = ring.select(F.col("node").alias("a"))
        live = materialize(live.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti"), "rest")
    return found.distinct()


def reciprocal(edges: DataFrame) -> DataFrame:
    """(a, b, mutual) of directed edges (a, b): whether the edge back is there."""
    # both ways of a pair are one group: nothing is joined or sorted, and a pair is one row of one hash table
    ways = edges.select(F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi"), (F.col("a") <= F.col("b")).alias("up"))
    known = ways.filter("up is not null").groupBy("_lo", "_hi").agg(F.max("up").alias("up"), F.min("up").alias("down"))
    both = (F.col("_lo") == F.col("_hi")) | (F.col("up") & ~F.col("down"))
    sides = F.array(F.when(F.col("up"), F.struct(F.col("_lo").alias("a"), F.col("_hi").alias("b"))), F.when(~F.col("down"), F.struct(F.col("_hi").alias("a"), F.col("_lo").alias("b"))))
    out = known.select(F.explode(F.filter(sides, lambda e: e.isNotNull())).alias("e"), both.alias("mutual")).select("e.*", "mutual")
    lone = edges.select("a", "b").filter("a is null or b is null").distinct().withColumn("mutual", F.lit(False))
    return out.unionByName(lone)


def one_way(declared: DataFrame, citing: DataFrame) -> DataFrame:
    """(a, b, missing) of pairs that only one of two tables (a, b) has."""
    d = declared.select("a", "b", F.lit(True).alias("_d")).distinct()
    c = citing.select("a", "b", F.lit(True).alias("_c")).distinct()
    out = d.join(c, ["a", "b"], "full").filter(F.col("_d").isNull() | F.col("_c").isNull())
    return out.select("a", "b", F.when(F.col("_d").isNull(), "declaration").otherwise("citation").alias("missing"))


def resolve_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """``links`` (link_id, full, partial, stem) resolved among ``targets`` (target_id, full, partial, stem).

    In order: the full key, the partial key, a stem that only one target has; reason is hit, ambiguous or missing.
    """

    def by(key: str) -> DataFrame:
        return targets.groupBy(F.col(key).alias(f"_{key}")).agg(F.min("target_id").alias(f"{key}_id"), F.count("*").alias(f"{key}_n"))

    out = links
    for key in ("full", "partial", "stem"):
        out = out.join(by(key), F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
    unique = lambda k: F.when(F.col(f"{k}_n") == 1, F.col(f"{k}_id"))
    hit = F.coalesce(unique("full"), unique("partial"), unique("stem"))
    many = F.greatest(*[F.coalesce(f"{k}_n", F.lit(0)) for k in ("full", "partial", "stem")]) > 1
    reason = F.when(hit.isNotNull(), "hit").when(many, "ambiguous").otherwise("missing")
    return out.select("link_id", hit.alias("target_id"), reason.alias("reason"))


#: Reasons that a written link has: found from the root, from its own folder or by name; and why it isn't.
FOUND = ("root", "relative", "name")


def folded_path(path: Column) -> Column:
    """A path without empty and ``.`` parts, each ``..`` taking the part before; null if it leads out of the root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")

    def step(held: Column, part: Column) -> Column:
        up = F.when(F.size(held) > 0, F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))))
        return F.when(held.isNull(), None).when(part == "..", up).otherwise(F.concat(held, F.array(part)))

    return F.array_join(F.aggregate(parts, none, step), "/")


def resolve_paths(links: DataFrame, catalog: DataFrame, suffix: str = ".md") -> DataFrame:
    """(link_id, target, reason) of written links (link_id, raw, origin) among the files of ``catalog`` (path, indexed).

    A link's fragment goes, ``\\`` counts as ``/``, and ``suffix`` is added where it is missing. It is looked for from
    the root, then from its origin's folder, and, if it has no folder, by the name of one file alone; letters' case
    doesn't count. Reasons are root, relative and name; exists (a file that isn't indexed), ambiguous, missing, outside
    (absolute paths) and empty. Names, and nothing else, may be ambiguous; of paths equal but for case the least counts.

    All ways are keys of one lookup: each link has up to three, joined at once, and its first hit counts. Rows of a
    frequent name are spread (``attach``).
    """
    raw = F.trim(F.replace(F.element_at(F.split(F.coalesce("raw", F.lit("")), "#"), 1), F.lit("\\"), F.lit("/")))
    rows = links.select("link_id", "origin", raw.alias("_raw"))
    whole = F.when(F.endswith(F.lower("_raw"), F.lit(suffix)), F.col("_raw")).otherwise(F.concat("_raw", F.lit(suffix)))
    rows = rows.withColumn("_path", whole).withColumn("_away", F.startswith("_raw", F.lit("/")) | F.rlike("_raw", F.lit("^[a-zA-Z]:")))
    folder = F.regexp_replace(F.coalesce("origin", F.lit("")), "[^/]*$", "")
    ways = F.array(
        F.struct(F.lit(1).alias("way"), F.concat(F.lit("p"), F.lower(folded_path(F.col("_path")))).alias("key")),
        F.struct(F.lit(2).alias("way"), F.concat(F.lit("p"), F.lower(folded_path(F.concat(folder, F.col("_path"))))).alias("key")),
        F.struct(F.lit(3).alias("way"), F.when(~F.contains("_path", F.lit("/")), F.concat(F.lit("n"), F.lower("_path"))).alias("key")),
    )
    sought = rows.filter((F.col("_raw") != "") & ~F.col("_away")).select("link_id", F.explode(ways).alias("w")).select("link_id", "w.*").filter("key is not null")
    sought = materialize(sought, "sought")

    file = catalog.select("path", "indexed", F.lower("path").alias("_low"))
    keys = F.array(F.concat(F.lit("p"), F.col("_low")), F.concat(F.lit("n"), F.element_at(F.split("_low", "/"), -1)))
    file = file.select(F.explode(keys).alias("key"), F.struct((~F.col("indexed")).alias("out"), "path").alias("f")).groupBy("key").agg(F.min("f").alias("f"), F.count("*").alias("files"))
    asked = sought.groupBy("key").agg(F.count("*").alias("asked"))
    file = materialize(file.join(asked, "key").select("key", F.col("f.path").alias("path"), F.col("f.out").alias("_out"), "files", "asked"), "catalog")

    found = attach(sought, file, "key", ["path", "_out", "files"], "asked", F.col("link_id")).filter("files is not null")
    best = found.groupBy("link_id").agg(F.min(F.struct("way", "path", "_out", "files")).alias("b"))
    many = (F.col("b.way") == 3) & (F.col("b.files") > 1)
    reason = (
        F.when(F.col("_raw") == "", "empty").when(F.col("_away"), "outside").when(F.col("b").isNull(), "missing").when(many, "ambiguous").when(F.col("b._out"), "exists")
        .otherwise(F.element_at(F.array(*map(F.lit, FOUND)), F.col("b.way")))
    )
    out = rows.join(best.withColumnRenamed("link_id", "_id"), F.col("link_id").eqNullSafe(F.col("_id")), "left").withColumn("reason", reason)
    return out.select("link_id", F.when(F.col("reason").isin(*FOUND), F.col("b.path")).alias("target"), "reason")
