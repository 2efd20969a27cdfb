"""Readers for notes, review records, transcripts, manifests and media indexes.

Files are read by Spark's ``binaryFile`` and ``text`` sources, whatever store they are in. Parsing of one note keeps
a stack of headings and open fences and runs in an Arrow-batched UDF; all that follows is columnar.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marginalia.functions import markdown as M
from marginalia.functions.terms import lexical
from marginalia.functions.text import pieces

#: Directories that no scan enters.
SKIPPED = r"(^|/)(\.obsidian|\.git|\.trash|__pycache__)(/|$)"
BLOCK = "heading string, parents array<string>, line_start int, line_end int, text string, kind string, routing_only boolean, id string, context_ids array<string>, links array<string>, references array<struct<title:string,url:string,recorded_support:string,limits:string,line:int>>"
#: A passage of methods; ``owner`` is the title behind its last bar and the heading, the ``lexical_`` columns are folded.
CHUNK = "id string, heading string, text string, section string, owner string, lexical_owner string, lexical_heading string, lexical_text string"


def _array(fields: str) -> str:
    return f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in fields.split(', '))}>>"


NOTE = f"props map<string,array<string>>, title string, body string, parts map<string,string>, chunks {_array(CHUNK)}, blocks {_array(BLOCK)}"
#: Sections that a card of a topic shows.
PARTS = ("核心命题", "一分钟核心摘要", "适用边界", "我的默认做法")
HEADER_LIMIT = 65_536


def files(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path, content, size, doc_hash) of the files below ``root``; path is relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), rf"^\Q{base}\E/?", "")
    out = raw.select(path.alias("path"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("doc_hash"))
    return out.filter(~F.col("path").rlike(SKIPPED))


def _parsed(path: str, digest: str, text: str, fields: frozenset[str]) -> dict:
    """Those ``fields`` of a note that are asked for; no others are made."""
    props, body, first = M.properties(text)
    out: dict = {"props": list(props.items()), "body": body}
    if fields & {"title", "chunks"}:
        out["title"] = next((m[2] for x in body.split("\n") if (m := M.HEADING.match(x)) and len(m[1]) == 1), path.rsplit("/", 1)[-1].removesuffix(".md"))
    if "parts" in fields:
        found = {p: M.locate(body, p) for p in PARTS if p in body}
        out["parts"] = [(p, body[f["start"] : f["end"]]) for p, f in found.items() if f["error"] is None]
    if "chunks" in fields:
        out["chunks"] = _chunks(path, digest, out["title"], body)
    if "blocks" in fields:
        out["blocks"] = _blocks(path, digest, body, first)
    return {f: out[f] for f in fields}


def _blocks(path: str, digest: str, body: str, first: int) -> list[dict]:
    flat: list[M.Block] = []
    ids: list[list[str]] = []
    for section in M.sections(body):
        section.line_start += first - 1
        section.line_end += first - 1
        parts = M.split_tables(section)
        names = [M.block_id(path, digest, b) for b in parts]
        flat += parts
        ids += [[names[i], *(names[c] for c in b.context)] for i, b in enumerate(parts)]
    return [
        {
            "heading": b.heading, "parents": b.parents, "line_start": b.line_start, "line_end": b.line_end, "text": b.text, "kind": b.kind,
            "routing_only": b.routing_only, "id": i[0], "context_ids": i[1:], "links": [x[0].strip() for x in M.LINK.findall(b.text)], "references": M.references(b),
        }
        for b, i in zip(flat, ids, strict=True)
    ]


def _chunks(path: str, digest: str, title: str, body: str) -> list[dict]:
    tail = title.rsplit("｜", 1)[-1]
    return [
        {
            "id": hashlib.sha256(f"{path}|{digest}|{i}|{c['heading']}".encode()).hexdigest()[:20], **c, "owner": f"{tail} {c['heading']}",
            "lexical_owner": lexical(f"{tail} {c['heading']}"), "lexical_heading": lexical(c["heading"]), "lexical_text": lexical(c["text"]),
        }
        for i, c in enumerate(M.method_chunks(body))
    ]


def parse_note(path: str, digest: str, text: str, fields: tuple[str, ...] = ()) -> Column:
    """The note in columns (path, digest, text) as one struct of ``fields`` (all those of NOTE if none are named).

    Notes are parsed in ``pieces`` of a batch, so that a worker holds few at a time, however long they are.
    """
    whole = T.StructType.fromDDL(NOTE)
    kind = T.StructType([f for f in whole.fields if not fields or f.name in fields])
    made, wanted = to_arrow_type(kind), frozenset(kind.names)

    @F.arrow_udf(kind)
    def parse(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for start, stop in pieces(batch[2]):
                rows = zip(*(c.slice(start, stop - start).to_pylist() for c in batch), strict=True)
                yield pa.array([None if t is None else _parsed(p, d, t, wanted) for p, d, t in rows], made)

    return parse.asNondeterministic()(path, digest, text)  # else a filter on its fields parses a second time


def notes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(notes, errors): path, doc_hash, props, title, body, blocks of valid UTF-8 files; (path, code) of the others."""
    raw = files(spark, root)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.regexp_replace(F.col("content").cast("string"), "^﻿", ""), "\r\n", "\n")
    good = raw.filter(valid).select("path", "doc_hash", text.alias("text"))
    out = good.withColumn("n", parse_note("path", "doc_hash", "text")).select("path", "doc_hash", "n.*")
    return out, raw.filter(~valid).select("path", F.lit("invalid_utf8").alias("code"))


def blocks(parsed: DataFrame) -> DataFrame:
    """One row for each block of ``notes``."""
    return parsed.select("path", "doc_hash", "title", F.explode("blocks").alias("b")).select("path", "doc_hash", "title", "b.*")


def prop(name: str) -> Column:
    """The first value of a property, null if it has none."""
    return F.try_element_at(F.col("props")[name], F.lit(1))


def identities(spark: SparkSession, root: str, fields: list[str]) -> DataFrame:
    """(path, doc_hash, size, props) where props come from the first 64 KiB alone and keep only ``fields``."""

    @F.udf("map<string,array<string>>", useArrow=True)
    def header(raw: bytes) -> dict:
        found = M.properties(bytes(raw).decode("utf-8", "ignore").replace("\r\n", "\n"))[0]
        return {k: v for k, v in found.items() if k in fields}

    head = F.substring("content", 1, HEADER_LIMIT)
    return files(spark, root).select("path", "doc_hash", "size", header(head).alias("props"))


def manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256) of all files below ``root``."""
    return files(spark, root, glob).select("path", "size", F.col("doc_hash").alias("sha256"))


RECORD_DDL = (
    "schema STRING, source_id STRING, source STRUCT<kind: STRING, title: STRING, locator: STRING, text_sha256: STRING>, note STRUCT<path: STRING, sha256: STRING>, "
    "coverage STRUCT<version: INT, source_sha256: STRING, note_sha256: STRING, scope: ARRAY<ARRAY<INT>>, "
    "items: ARRAY<STRUCT<id: STRING, item: STRING, source: STRUCT<lines: ARRAY<INT>, quote: STRING>, note: STRUCT<lines: ARRAY<INT>, quote: STRING>, status: STRING, reason: STRING>>>, "
    "review STRUCT<date: STRING, scope: STRING, summary: STRING, method: STRING>, _corrupt_record STRING"
)


def records(spark: SparkSession, root: str) -> DataFrame:
    """Review records (``record.json``); a malformed one keeps its text in ``_corrupt_record``."""
    reader = spark.read.schema(RECORD_DDL).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "record.json")
    return reader.json(root).withColumn("file", F.col("_metadata.file_path"))


def cues(spark: SparkSession, rows: DataFrame, column: str = "payload") -> DataFrame:
    """(index, from, to, content) of subtitle payloads ``{"body": [...]}``; cues without text or finite times go."""
    body = F.from_json(column, "body array<struct<`from`: double, `to`: double, content: string>>")["body"]
    out = rows.select(*[c for c in rows.columns if c != column], F.posexplode(body).alias("index", "c")).select("*", "c.*").drop("c")
    good = F.col("from").isNotNull() & F.col("to").isNotNull() & ~F.isnan("from") & ~F.isnan("to") & (F.trim("content") != "")
    return out.filter(good & (F.abs("from") != float("inf")) & (F.abs("to") != float("inf")))


FRAGMENT = "array<struct<index:int,first:bigint,last:bigint,start:double,end:double,sap:boolean>>"


def _boxes(blob: bytes) -> list[tuple[bytes, int, int]]:
    """(kind, first byte of the content, end) of the boxes that make up ``blob``; ValueError if they don't."""
    out, at = [], 0
    while at < len(blob):
        size, kind = struct.unpack_from(">I4s", blob, at) if at + 8 <= len(blob) else (0, b"")
        if size < 8 or at + size > len(blob):
            raise ValueError("box")
        out.append((kind, at + 8, at + size))
        at += size
    return out


def segment_index(blob: bytes) -> list[dict]:
    """The fragments of the one flat segment index box: byte ranges and times by running sums.

    Raises ValueError for anything else: no such box or two, a version besides 0 and 1, references cut short, nested,
    empty, or followed by bytes of no meaning.
    """
    found = [(first, end) for kind, first, end in _boxes(blob) if kind == b"sidx"]
    if len(found) != 1:
        raise ValueError("one index")
    first, end = found[0]
    layout = {0: ">BxxxIIIIxxH", 1: ">BxxxIIQQxxH"}.get(blob[first] if first < end else -1)
    if layout is None or first + struct.calcsize(layout) > end:
        raise ValueError("version")
    _, _, scale, tick, skip, count = struct.unpack_from(layout, blob, first)
    rows = blob[first + struct.calcsize(layout) : end]
    if not scale or not count or len(rows) != 12 * count:
        raise ValueError("references")
    words, lengths, points = zip(*struct.iter_unpack(">III", rows), strict=True)
    if any(w >> 31 or not w for w in words) or not all(lengths):
        raise ValueError("reference")
    places = list(accumulate(words, initial=end + skip))
    times = list(accumulate(lengths, initial=tick))
    return [
        {"index": i, "first": places[i], "last": places[i + 1] - 1, "start": times[i] / scale, "end": times[i + 1] / scale, "sap": bool(points[i] >> 31)}
        for i in range(count)
    ]


def fragments(blob: str) -> Column:
    """``segment_index`` of a binary column; null where there is none."""

    def one(b: bytes | None) -> list[dict] | None:
        try:
            return None if b is None else segment_index(bytes(b))
        except (ValueError, struct.error):
            return None

    return F.udf(one, FRAGMENT, useArrow=True)(blob)


def select_fragments(rows: DataFrame, keys: list[str], start: float, end: float) -> DataFrame:
    """Fragments that overlap [start, end), with whether they cover it within 0.1 s and follow each other gaplessly."""
    from pyspark.sql.window import Window as W

    hit = rows.filter((F.col("start") < end) & (F.col("end") > start))
    w = W.partitionBy(*keys).orderBy("index")
    joined = (F.lag("last").over(w) + 1 == F.col("first")) & (F.abs(F.lag("end").over(w) - F.col("start")) <= 1e-6)
    hit = hit.withColumn("_j", F.coalesce(joined, F.lit(True)))
    return hit.groupBy(*keys).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("n"), F.bool_and("_j").alias("contiguous"),
        ((F.min("start") <= start + 0.1) & (F.max("end") >= end - 0.1)).alias("covers"), F.min_by("sap", "index").alias("starts_at_sap"),
    )
