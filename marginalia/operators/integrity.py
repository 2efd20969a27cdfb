"""Whether records of evidence still hold: their note's bytes, its reviewed prefix, the raw text, and every quote.

Contents are hashed where they are read; what moves are digests, and lines that an item names. Quotes are looked up by
an interval join: an item's range of lines is laid out as (text, line) keys, as far as the text goes, and joined by
equality with the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.plans.skew import small
from marginalia.plans.storage import materialize

#: Fixed value: how a note says which record it belongs to.
MARKER = r"<!--\s*source-evidence:\s*([^\s>]+)\s*-->"


def line_index(texts: DataFrame, key: str) -> DataFrame:
    """(key, line, start, end, text) of each line of texts (key, text): from one on, ``start`` and ``end`` its bytes (the end
    not included, nor the line feed)."""
    lines = F.split("text", "\n")
    rows = texts.filter("text is not null").select(key, F.posexplode(lines).alias("k", "text"))
    before = W.partitionBy(key).orderBy("k").rowsBetween(W.unboundedPreceding, -1)  # one text's lines: a row of the input
    rows = rows.withColumn("n", F.octet_length("text")).withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)))
    return rows.select(key, (F.col("k") + 1).alias("line"), "start", (F.col("start") + F.col("n")).alias("end"), "text")


def checked_quotes(items: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, id, code) of items (key, id, from, to, quote) against texts (key, text): ok, range (not within the text's
    lines), quote (the lines, joined by line feeds, don't hold it) or missing (no text). A null quote needs lines only.
    """
    # how long each text is, and no line of a text that nobody quotes
    wanted = items.select(key).distinct()
    texts = texts.join(wanted, key, "left_semi").select(key, "text")
    sizes = texts.select(F.col(key).alias("_key"), F.size(F.split("text", "\n")).alias("lines")).filter("lines >= 0")
    rows = items.join(sizes, F.col(key) == F.col("_key"), "left").drop("_key")
    good = F.coalesce((F.col("from") >= 1) & (F.col("from") <= F.col("to")) & (F.col("to") <= F.col("lines")), F.lit(False))
    rows = materialize(rows.withColumn("good", good), "items")
    lines = texts.filter("text is not null").select(F.col(key).alias("_key"), F.posexplode(F.split("text", "\n")).alias("k", "held"))
    asked = rows.filter("good and quote is not null").select(key, "id", "quote", F.explode(F.sequence("from", "to")).alias("line"))
    met = asked.join(lines, (F.col(key) == F.col("_key")) & (F.col("line") == F.col("k") + 1))
    met = met.groupBy(key, "id", "quote").agg(F.array_sort(F.collect_list(F.struct(F.col("k"), F.col("held")))).alias("held"))
    held = F.contains(F.array_join(F.transform("held", lambda x: x["held"]), "\n"), F.col("quote"))
    met = met.select(F.col(key).alias("_key"), F.col("id").alias("_id"), held.alias("held"))
    out = rows.join(met, (F.col(key) == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    code = F.when(F.col("lines").isNull(), "missing").when(~F.col("good"), "range").when(F.col("quote").isNull() | F.col("held"), "ok").otherwise("quote")
    return out.select(key, "id", code.alias("code"))


def _binding(there: Column, same: Column) -> Column:
    return F.when(~there, "missing").when(F.coalesce(same, F.lit(False)), "matches").otherwise("changed")


def bindings(records: DataFrame, notes: DataFrame, raw: DataFrame) -> DataFrame:
    """(source_id, repeated, note, prefix, marker, raw_source) of each record.

    ``records`` is (source_id, text_sha256, local, note_path, note_sha256, prefix_bytes, prefix_sha256), ``notes``
    (path, content) and ``raw`` (source_id, content), both binary. ``note``, ``prefix`` and ``raw_source`` are matches,
    changed or missing; a record without a prefix has none, one that isn't ``local`` has history_only. ``marker``
    tells whether the note names the record. Each record is judged on its own; ``repeated`` ids are told.
    """
    asked = materialize(records.filter("prefix_bytes is not null").select(F.col("note_path").alias("_path"), "prefix_bytes").distinct(), "prefixes")
    cut = notes.join(small(asked), F.col("path") == F.col("_path")).filter((F.col("prefix_bytes") > 0) & (F.col("prefix_bytes") <= F.octet_length("content")))
    cut = cut.select("_path", F.col("prefix_bytes").alias("_bytes"), F.sha2(F.expr("substring(content, 1, prefix_bytes)"), 256).alias("_prefix"))
    whole = notes.select(F.col("path").alias("_note"), F.sha2("content", 256).alias("_sha"), F.regexp_extract_all(F.col("content").cast("string"), F.lit(MARKER), F.lit(1)).alias("_marks"))
    text = raw.filter("content is not null").groupBy(F.col("source_id").alias("_raw")).agg(F.min(F.sha2("content", 256)).alias("_text"))
    often = records.groupBy(F.col("source_id").alias("_often")).agg(F.count("*").alias("_n")).filter("_n > 1")

    out = records.join(whole, F.col("note_path") == F.col("_note"), "left")
    out = out.join(cut, (F.col("note_path") == F.col("_path")) & (F.col("prefix_bytes") == F.col("_bytes")), "left")
    out = out.join(text, F.col("source_id") == F.col("_raw"), "left").join(often, F.col("source_id") == F.col("_often"), "left")
    note = _binding(F.col("_note").isNotNull(), F.col("_sha") == F.col("note_sha256"))
    prefix = F.when(F.col("prefix_bytes").isNull(), "none").otherwise(_binding(F.col("_note").isNotNull(), F.col("_prefix") == F.col("prefix_sha256")))
    source = F.when(~F.coalesce("local", F.lit(False)), "history_only").otherwise(_binding(F.col("_raw").isNotNull(), F.col("_text") == F.col("text_sha256")))
    marker = F.coalesce(F.array_contains("_marks", F.col("source_id")), F.lit(False))
    return out.select("source_id", F.col("_often").isNotNull().alias("repeated"), note.alias("note"), prefix.alias("prefix"), marker.alias("marker"), source.alias("raw_source"))


def stray_markers(records: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, source_id) of notes that name a record which isn't there or belongs to another note."""
    marks = notes.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.col("content").cast("string"), F.lit(MARKER), F.lit(1)))).alias("source_id"))
    own = records.select(F.col("source_id").alias("_id"), F.col("note_path").alias("_path"))
    return marks.join(own, (F.col("source_id") == F.col("_id")) & (F.col("path") == F.col("_path")), "left_anti")


def audited(records: DataFrame, items: DataFrame, notes: DataFrame, raw: DataFrame) -> DataFrame:
    """``bindings`` with ``bad_items``: of ``items`` (source_id, id, from, to, quote), those whose lines or quotes the raw text
    doesn't bear out; they are looked up where it is still the text that was recorded."""
    held = materialize(bindings(records, notes, raw), "bindings")
    sound = held.filter("raw_source = 'matches'").select("source_id").distinct()
    texts = raw.join(sound, "source_id", "left_semi").select("source_id", F.col("content").cast("string").alias("text"))
    bad = checked_quotes(items.join(sound, "source_id", "left_semi"), texts, "source_id").filter("code != 'ok'")
    bad = bad.groupBy(F.col("source_id").alias("_bad")).agg(F.count("*").alias("bad_items"))
    return held.join(bad, F.col("source_id") == F.col("_bad"), "left").drop("_bad").withColumn("bad_items", F.coalesce("bad_items", F.lit(0)).cast("long"))
