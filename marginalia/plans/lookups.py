"""Lookups over a graph of notes: who links where, what is lonely, and where a text stands.

All counts come from one table of resolved links (``graph.resolve_paths``); a substring is looked up in the inverted table
that changes keep up (``deltas.NoteIndex``) and verified in the few texts that have all of its grams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.graph import FOUND
from marginalia.plans.deltas import NoteIndex
from marginalia.plans.skew import small
from marginalia.plans.storage import materialize


def note_graph(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(path, links, backlinks, unresolved, orphan, dead_end) of each of ``notes`` (path).

    ``links`` is (origin, target, reason), a row for each written link. ``links`` and ``backlinks`` count the notes a
    note leads to and those that lead to it, each once and itself not; ``unresolved`` the links without a target that
    were meant to have one. No note leads to an orphan; a dead end leads to none. Pairs are put together where they
    are read, so that no much linked note is gathered.
    """
    pairs = links.filter(F.col("reason").isin(*FOUND) & (F.col("origin") != F.col("target"))).select("origin", "target").distinct()
    pairs = materialize(pairs, "edges")
    out = pairs.groupBy(F.col("origin").alias("path")).agg(F.count("*").alias("links"))
    back = pairs.groupBy(F.col("target").alias("path")).agg(F.count("*").alias("backlinks"))
    lost = links.filter(~F.col("reason").isin(*FOUND, "empty", "outside")).groupBy(F.col("origin").alias("path")).agg(F.count("*").alias("unresolved"))
    got = notes.select("path").distinct()
    for part in (out, back, lost):
        got = got.join(part, "path", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("links", "backlinks", "unresolved")}
    return got.withColumns(zero).withColumns({"orphan": F.col("backlinks") == 0, "dead_end": F.col("links") == 0})


def find(index: NoteIndex, notes: DataFrame, needle: str) -> DataFrame:
    """(path, at, times) of ``notes`` (path, text) that hold ``needle`` in any case of letters: the first place, from one
    on, and how often, places that overlap counted once. An empty needle is held by none."""
    if not needle:
        return notes.select("path", F.lit(0).alias("at"), F.lit(0).alias("times")).limit(0)
    near = materialize(index.holding(needle), "near")
    text = F.lower("text")
    rows = notes.join(small(near), "path", "left_semi").select("path", F.instr(text, needle.lower()).alias("at"), (F.size(F.split(text, r"\Q" + needle.lower().replace("\\E", "\\E\\\\E\\Q") + r"\E", -1)) - 1).alias("times"))
    return rows.filter("at > 0")
