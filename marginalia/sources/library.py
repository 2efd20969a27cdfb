"""More readers: routes of map notes, prompt boxes, synonym rules, file metadata, a signed index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import markdown as M
from marginalia.operators.diff import fingerprint
from marginalia.sources.notes import SKIPPED, files, prop

#: Categories and fields of a prompt box, and the marks of its index.
PROMPT_CATEGORIES = ("思考与决策", "学习与内化", "阅读与研究", "创意与策划", "对话与提问优化", "影视创作", "待分类")
PROMPT_FIELDS = ("用途", "标签", "来源", "收录日期", "适用场景", "适用边界", "验证状态")
INDEX_START, INDEX_END = "<!-- prompt-box-index:start -->", "<!-- prompt-box-index:end -->"
FENCED = re.compile(r"^(`{3,}|~{3,})[^\n]*\n(.*?)^\1[ \t]*$", re.S | re.M)
ROUTE = "array<struct<name:string,kind:string,stage:string,enter:string,order:string,stop:string,targets:array<string>,position:int>>"
PROMPT = "array<struct<category:string,title:string,body:string,organized:string,original:string,fenced:array<string>,missing:array<string>>>"


def _labelled(text: str, label: str) -> str:
    found = re.search(rf"^[-*]\s+\*\*{label}\*\*[：:]\s*(.+)$", text, re.M)
    return found[1].strip() if found else ""


def _targets(text: str) -> list[str]:
    return list(dict.fromkeys(x[0].split("#")[0].removesuffix(".md").rsplit("/", 1)[-1].strip() for x in M.LINK.findall(text)))


#: Sections of a map note that hold routes, the kind and the name of a cross route.
BY_STAGE, BY_PROBLEM, ACROSS, ACROSS_NAME = "按创作阶段调用", "按创作问题调用", "跨子域总入口", "跨子域入口"


def route_rows(body: str, category: str) -> list[dict]:
    """Route hints of a map note that link somewhere: stage bullets, parts on problems, and cross-domain bullets."""
    out = []
    for b in M.sections(body):
        bullets = [x.strip() for x in b.text.split("\n") if x.strip().startswith("-")]
        if b.heading == BY_STAGE:
            for name, order in (x[1:].replace("：", ":", 1).split(":", 1) for x in bullets if re.match(r"-\s+[^：:]+[：:]", x)):
                out.append({"name": f"{category}｜{name.strip()}", "kind": "stage", "stage": name.strip(), "enter": "", "order": order.strip(), "stop": ""})
        elif b.heading == ACROSS:
            out += [{"name": ACROSS_NAME, "kind": "cross", "stage": "", "enter": "", "order": x.lstrip("- "), "stop": ""} for x in bullets]
        elif BY_PROBLEM in b.parents:
            labels = {k: _labelled(b.text, v) for k, v in {"enter": "什么时候进入", "order": "调用顺序", "stop": "何时停止或返回"}.items()}
            out.append({"name": b.heading, "kind": "problem", "stage": ""} | labels)
    rows = [r | {"targets": _targets(f"{r['enter']} {r['order']} {r['stop']}")} for r in out]
    return [r | {"position": i} for i, r in enumerate(rows) if r["targets"]]


def routes(notes: DataFrame) -> DataFrame:
    """(path, category, and a route's fields) of map notes; a map without a category has that of its folder."""
    folder = F.try_element_at(F.split("path", "/"), F.lit(-2))
    maps = notes.filter(prop("类型") == "知识地图").withColumn("_category", F.coalesce(prop("分类"), folder, F.lit("")))
    rows = F.udf(lambda b, c: route_rows(b or "", c), ROUTE, useArrow=True)("body", "_category")
    return maps.select("path", F.col("_category").alias("category"), F.explode(rows).alias("r")).select("path", "category", "r.*")


def prompt_rows(text: str) -> list[dict]:
    """The entries (H3) of a prompt box below its categories (H2), with their fenced and quoted texts."""
    out = []
    text = re.sub(re.escape(INDEX_START) + ".*?" + re.escape(INDEX_END), "", text, flags=re.S)
    parts = re.split(r"^(#{2,3})[ \t]+(.+?)[ \t]*$", text, flags=re.M)
    category = ""
    for level, title, body in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
        if level == "##":
            category = title
            continue
        fenced = [m[1].strip("\n") for m in FENCED.findall(body)]
        quoted = "\n".join(re.sub(r"^>[ \t]?", "", x) for x in body.split("\n") if x.startswith(">")).strip()
        missing = [f for f in PROMPT_FIELDS if not re.search(rf"^[-*]\s+(?:\*\*)?{f}(?:\*\*)?[：:]\s*\S", body, re.M)]
        out.append({"category": category, "title": title, "body": body, "organized": fenced[0] if fenced else "", "original": quoted, "fenced": fenced, "missing": missing})
    return out


def prompts(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """One row for each entry of the prompt boxes below ``root``."""
    text = F.regexp_replace(F.col("content").cast("string"), "\r\n", "\n")
    rows = F.udf(lambda t: prompt_rows(t or ""), PROMPT, useArrow=True)(text)
    return files(spark, root, glob).select("path", F.explode(rows).alias("p")).select("path", "p.*")


def prompt_issues(entries: DataFrame) -> DataFrame:
    """(code, value): categories that are missing or unknown, titles that repeat, fields that an entry lacks."""
    spark = entries.sparkSession
    known = spark.createDataFrame([(c,) for c in PROMPT_CATEGORIES], "value string")
    seen = entries.select(F.col("category").alias("value")).distinct()
    parts = [
        known.join(seen, "value", "left_anti").select(F.lit("missing_category").alias("code"), "value"),
        seen.join(known, "value", "left_anti").select(F.lit("outside_category").alias("code"), "value"),
        entries.groupBy(F.col("title").alias("value")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_title").alias("code"), "value"),
        entries.select("title", F.explode("missing").alias("f")).select(F.lit("missing_field").alias("code"), F.concat_ws(": ", "title", "f").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def index_differences(entries: DataFrame, index: DataFrame) -> DataFrame:
    """(title, code) of an index (title, alias, position) against entries (title, category, position)."""
    e = entries.select("title", F.lit(True).alias("_e")).distinct()
    i = index.groupBy("title").agg(F.count("*").alias("n"), F.max(F.col("alias") != F.col("title")).alias("other"))
    both = e.join(i, "title", "full")
    codes = {"missing": F.col("n").isNull(), "stale": F.col("_e").isNull(), "duplicate": F.col("n") > 1, "alias": F.col("other")}
    found = F.filter(F.array(*[F.when(w, F.lit(c)) for c, w in codes.items()]), lambda x: x.isNotNull())
    return both.select("title", F.explode(found).alias("code"))


def synonym_rules(spark: SparkSession, path: str) -> list[dict]:
    """Synonym rules (id, any, all, add) of a JSON file; they are part of a question, so the driver gets them."""
    ddl = "rules ARRAY<STRUCT<id: STRING, any: ARRAY<STRING>, all: ARRAY<STRING>, add: ARRAY<STRING>>>"
    rows = spark.read.schema(ddl).option("multiLine", "true").json(path).select(F.explode("rules").alias("r")).select("r.*").collect()
    return [r.asDict() for r in rows]


def file_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(path, extension, folder, size, modified) of all files below ``root``; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    base = root.rstrip("/").removeprefix("file:").lstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", ""), rf"^\Q{base}\E/?", "")
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    folder = F.array_join(F.slice(F.split("path", "/"), 1, F.least(F.lit(2), F.size(F.split("path", "/")) - 1)), "/")
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return rows.filter(~F.col("path").rlike(SKIPPED)).withColumn("extension", extension).withColumn("folder", folder)


def storage_report(meta: DataFrame, referenced: DataFrame) -> DataFrame:
    """(folder, extension, files, bytes, referenced) with totals; ``referenced`` is (path) of files that records name."""
    r = referenced.select("path").distinct().withColumn("_r", F.lit(1))
    rows = meta.join(r, "path", "left")
    return rows.rollup("folder", "extension").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count("_r").alias("referenced"))


def changed_files(before: DataFrame, now: DataFrame) -> DataFrame:
    """Paths that are new, or whose time or size differs, since a snapshot (path, size, modified)."""
    b = before.select("path", F.col("size").alias("_s"), F.col("modified").alias("_m"))
    return now.join(b, "path", "left").filter(F.col("_s").isNull() | (F.col("_s") != F.col("size")) | (F.col("_m") != F.col("modified"))).select("path")


def signed_index(notes: DataFrame, root: str) -> DataFrame:
    """``notes`` as a table named by the digest of their contents: read if it is there whole, else written first."""
    spark = notes.sparkSession
    signature = fingerprint(notes.withColumn("_all", F.lit(0)).withColumn("_d", F.sha2(F.concat_ws("\0", "path", "doc_hash"), 256)), ["_all"], "_d").first()
    path = f"{root.rstrip('/')}/index-{signature.fingerprint if signature else 'empty'}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        notes.write.mode("overwrite").parquet(path)
    return spark.read.schema(notes.schema).parquet(path)


def scope(path: Column, roots: list[str]) -> Column:
    """Paths at or below any of ``roots``; roots below another root are dropped first."""
    plain = sorted({r.strip("/") for r in roots})
    kept = [r for r in plain if not any(r != o and r.startswith(o + "/") for o in plain)]
    out = F.lit(False)
    for r in kept:
        out = out | (path == r) | path.startswith(r + "/") if r else F.lit(True)
    return out


def ancestors(path: Column) -> Column:
    """All parent directories of a path, the nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def json_leaves(value: str) -> list[dict]:
    """(path, key, value) of the leaves of a JSON text, in order; [] if it is none."""
    import json

    def walk(v: object, trail: str, key: str):
        if isinstance(v, dict):
            for k, x in v.items():
                yield from walk(x, f"{trail}.{k}" if trail else k, k)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk(x, f"{trail}[{i}]", key)
        else:
            yield {"path": trail, "key": key, "value": None if v is None else v if isinstance(v, str) else json.dumps(v)}

    try:
        return list(walk(json.loads(value), "", ""))
    except (TypeError, ValueError):
        return []


def secrets_in_json(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path) of leaves whose name looks like a secret's and that are not empty."""
    leaves = F.udf(json_leaves, "array<struct<path:string,key:string,value:string>>", useArrow=True)(column)
    out = rows.select(key, F.explode(leaves).alias("l"))
    named = F.lower("l.key").rlike(r"(token|secret|password|passwd|api_?key|cookie|credential)")
    return out.filter(named & (F.trim(F.coalesce("l.value", F.lit(""))) != "")).select(key, "l.path")
