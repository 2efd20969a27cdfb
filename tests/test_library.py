"""The library's own operators: small hand-made notes, edges, intervals and states, and queries against DuckDB."""

import difflib
import json
import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.functions import markdown as M
from marginalia.functions import terms as T
from marginalia.functions import text as X
from marginalia.operators import audit, diff, graph, intervals
from marginalia.plans import retrieve as R
from marginalia.plans.components import connected_components
from marginalia.sources import notes as N
from marginalia.streaming.changes import STATE, ChangeFeed, folded

TOPIC = """---
类型: 主题笔记
分类: {category}
状态: 已整理
材料类型: 笔记
信息来源: 课程
完整程度: 完整
整理日期: 2026-01-01
知识库版本: 2.1
解决问题: {problem}
适用阶段:
  - 视觉设计
知识状态: 已提炼
成熟度: 生长
最后复核: 2026-01-01
掌握状态: {mastery}
最近检验: {date}
上位主题: []
---
# {title}
## 核心命题
{core}
## 适用边界
仅限示例。
## 知识单元
### 步骤
{method}
"""
PROBLEMS = {
    "轴线与视线": ("导演与视听语言", "轴线混乱时怎样恢复空间连续", "先确认轴线方向，再用中性镜头越过轴线，恢复空间连续。", "未检验"),
    "对白编辑": ("声音与后期", "对白底噪跳变", "铺设环境底噪并做交叉淡化，保留表演。", "能复述"),
    "因果冲突": ("故事与剧本", "冲突没有推进", "给阻力一个代价，让欲望升级。", "能迁移"),
}


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    for title, (category, problem, method, mastery) in PROBLEMS.items():
        text = TOPIC.format(category=category, problem=problem, core=problem + "的核心。", method=method, title=title, mastery=mastery, date="2026-02-03")
        (root / f"{title}.md").write_bytes(text.encode())
    (root / "sub").mkdir()
    (root / "sub/plain.md").write_text("no header [[轴线与视线|x]]\r\n# H\r\n```\n# not\n```\n")
    (root / "broken.md").write_bytes(b"\xff\xfe\xfa")
    (root / ".obsidian").mkdir()
    (root / ".obsidian/skip.md").write_text("x")
    notes, errors = N.notes(spark, str(root))
    return notes.cache(), errors, root


def test_notes_are_scanned(library, spark):
    notes, errors, root = library
    assert sorted(r.path for r in notes.collect()) == sorted([*(f"{t}.md" for t in PROBLEMS), "sub/plain.md"])
    assert [(r.path, r.code) for r in errors.collect()] == [("broken.md", "invalid_utf8")]
    row = notes.filter("path = '轴线与视线.md'").first()
    assert row.title == "轴线与视线" and row.props["适用阶段"] == ["视觉设计"] and row.props["上位主题"] == []
    spans = [(b.heading, b.parents, b.line_start) for b in row.blocks]
    assert spans == [("核心命题", ["轴线与视线"], 22), ("适用边界", ["轴线与视线"], 24), ("步骤", ["轴线与视线", "知识单元"], 27)]
    assert [(r.path, r.target) for r in R.links(notes).collect()] == [("sub/plain.md", "轴线与视线")]
    ids = N.identities(spark, str(root), ["分类"]).filter("path = '对白编辑.md'").first()
    assert ids.props == {"分类": ["声音与后期"]} and len(ids.doc_hash) == 64
    assert N.manifest(spark, str(root)).count() == 5


def test_retrieval_answers_or_says_gap(library):
    found = R.topics(library[0])
    got = R.retrieve(found, R.Question("轴线混乱之后怎样恢复空间连续？"), 3).collect()
    assert got[0].path == "轴线与视线.md" and got[0].kept and not got[0].gap and got[0]["rank"] == 1
    assert R.retrieve(found, R.Question("量子纠缠的贝尔不等式")).first().gap
    assert R.retrieve(found, R.Question("角色", role_categories=("故事与剧本",), stage="视觉设计")).first().gap
    wide = R.retrieve_scoped(found, R.Question("对白底噪跳变怎么办"), F.col("category") == "故事与剧本").first()
    assert wide.path == "对白编辑.md"
    assert [r.path for r in R.search(library[0], "阻力").collect()] == ["因果冲突.md"]


def test_rules_and_selection(library):
    notes = library[0]
    codes = {(r.path, r.code) for r in audit.validate(notes).collect()}
    assert not any(p != "sub/plain.md" for p, _ in codes) and ("sub/plain.md", "missing:类型") in codes
    topics = notes.filter("path != 'sub/plain.md'")
    assert audit.review_target(topics, focus="声音与后期").first().path == "对白编辑.md"
    assert audit.review_target(topics).first().path == "轴线与视线.md"
    assert audit.review_target(topics, category="故事与剧本").count() == 0


def test_terms():
    assert T.query_terms("Foley的room") == ["foley", "room"] and "的" not in "".join(T.query_terms("空间连续的轴线"))[:1]
    assert T.specific(["画面上", "面上", "轴线"]) == ["轴线"] and T.is_lookup("foley") and not T.is_lookup("轴线混乱时怎样恢复空间连续关系")
    assert T.expanded("没有音乐", [{"any": ["没有音乐"], "add": ["配乐"]}, {"all": ["x"], "add": ["y"]}]) == "没有音乐 配乐"


def test_markdown_tables_and_actions():
    assert M.cells(r"| a | [[b|c]] | d\|e |") == ["a", "[[b|c]]", "d|e"]
    table = "## T\nintro\n\n| a | b |\n|--|--|\n" + "\n".join(f"| [n{i}](https://x.y/{i}) | x |" for i in range(3))
    assert len(M.split_tables(M.sections(table.replace("](https://x.y/", "]]"))[0])) == 1  # links to notes don't cut a table
    parts = M.split_tables(M.sections(table)[0])
    assert [p.kind for p in parts] == ["table_parent", "table_context", "table_header", "table_row", "table_row", "table_row"] and parts[3].context == [1, 2]
    assert [p.heading for p in parts] == ["T", "T / 表格上下文", "T / 表头", "T / n0", "T / n1", "T / n2"]
    fenced = table + "\nend\n```\n| c | d |\n|--|--|\n| 1 | 2 |\n```"
    assert [p.kind for p in M.split_tables(M.sections(fenced)[0])].count("table_row") == 3
    state = "## Q\n| 标识 | 事项 | 依据 |\n|--|--|--|\n| A1 | do | why |\n| — | | |\n"
    assert M.actions(state, "Q") == ([{"id": "A1", "title": "do", "basis": "why"}], [])
    assert M.actions(state + "| A1 | again | x |\n", "Q")[0] == [] and M.actions("", "Q")[1]
    assert M.properties("---\na: 1\nno end") == ({}, "---\na: 1\nno end", 1)


def test_relations_need_a_row_back(spark):
    rows = [("a", "故事与剧本", "b", "故事与剧本", "前置", "r", "来源明示", "同类知识连接", 1), ("b", "故事与剧本", "a", "故事与剧本", "互补", "r", "多源综合", "同类知识连接", 2),
            ("a", "故事与剧本", "c", "声音与后期", "前置", "", "x", "同类知识连接", 3)]
    edges = spark.createDataFrame(rows, "source string, own_category string, target string, category string, relation string, reason string, basis string, section string, line int")
    titles = spark.createDataFrame([("a", "故事与剧本"), ("b", "故事与剧本"), ("c", "声音与后期")], "title string, category string")
    judged, errors = audit.audit_relations(edges, titles)
    assert sorted((r.line, r.valid) for r in judged.collect()) == [(1, True), (2, True), (3, False)]
    assert sorted(r.code for r in errors.collect()) == ["basis", "not_reciprocal", "reason", "section"]
    assert audit.edge_counts(judged).first()[:] == (1, 0, 2)


def test_review_records(spark, tmp_path):
    item = lambda i, lines, status, reason="", note=(1, 1): {"id": i, "item": "x", "source": {"lines": lines}, "note": {"lines": list(note)}, "status": status, "reason": reason}
    for sid, items in {"ok": [item("1", [1, 2], "保留"), item("2", [4, 4], "合并", "same")], "open": [item("1", [1, 2], "保留")], "bad": [item("1", [3, 9], "保留"), item("2", [1, 1], "合并")]}.items():
        (tmp_path / sid).mkdir()
        record = {"schema": "source-evidence-v1", "source_id": sid, "coverage": {"version": 1, "scope": [[1, 4]], "items": items}}
        (tmp_path / sid / "record.json").write_text(json.dumps(record))
    (tmp_path / "x").mkdir()
    (tmp_path / "x/record.json").write_text("{broken")
    records = N.records(spark, str(tmp_path)).cache()
    assert records.filter("_corrupt_record is not null").count() == 1
    good = records.filter("source_id is not null")
    texts = spark.createDataFrame([(s, "a\nb\n\nd\ne") for s in ("ok", "open", "bad")], "source_id string, text string")
    got = {r.source_id: (r.status, r.unregistered) for r in audit.coverage_verdict(good, texts).collect()}
    assert got["ok"] == ("closed", 0) and got["open"] == ("open", 1) and got["bad"][0] == "invalid"
    assert sorted((r.id, r.error) for r in audit.coverage_items(good).filter("source_id = 'bad'").collect()) == [("1", "scope"), ("2", "reason")]


def test_receipts(spark):
    known = spark.createDataFrame([("e1", "h1"), ("e2", "h2")], "evidence_id string, hash string")
    facets = spark.createDataFrame([("f1",), ("f2",), ("f2",)], "facet_id string")
    receipt = spark.createDataFrame([("f1", "e1", "h1"), ("f3", "e2", "old"), ("f2", "e9", "h")], "facet_id string, evidence_id string, hash string")
    got = {(r.id, r.code) for r in audit.receipt_errors(known, receipt, facets).collect()}
    assert got == {("e2", "stale_evidence"), ("e9", "unknown_evidence"), ("f3", "unknown_facet"), ("f2", "repeated_facet")}


def test_graphs(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("c", "d"), ("a", "c")], "dependent string, dependency string")
    got = {r.target: (r.depth, r.chain) for r in graph.impact(spark.createDataFrame([("a",)], "node string"), edges).collect()}
    assert got == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "d": (1, ["a", "d"]), "c": (2, ["a", "b", "c"])}
    ring = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "a int, b int")
    assert {(r.a, r.b) for r in graph.closure(ring).collect()} == {(1, 2), (2, 1), (1, 1), (2, 2), (1, 3), (2, 3)}
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(pairs).collect()}
    assert roots[40] == 1 and roots[101] == 100 and len(roots) == 42
    links = spark.createDataFrame([(1, "x/y/z", None, None), (2, None, None, "s"), (3, None, None, "u"), (4, None, None, None)], "link_id int, full string, partial string, stem string")
    targets = spark.createDataFrame([(10, "x/y/z", "x/y", "s"), (11, "q", "r", "s"), (12, "w", "v", "u")], "target_id int, full string, partial string, stem string")
    assert {r.link_id: (r.target_id, r.reason) for r in graph.resolve_links(links, targets).collect()} == {1: (10, "hit"), 2: (None, "ambiguous"), 3: (12, "hit"), 4: (None, "missing")}


def test_differences(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "k string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("x", "3"), ("y", "4"), ("z", "4")], "k string, h string")
    d = diff.snapshot_diff(old, new, "k", "h")
    assert {r.k: r.kind for r in d.collect()} == {"a": "unchanged", "b": "modified", "c": "removed", "d": "removed", "x": "added", "y": "added", "z": "added"}
    assert {(r.old_key, r.kind) for r in diff.renames(d, "k").collect()} == {("c", "renamed"), ("d", "ambiguous")}


def test_change_feed_survives_a_repeated_batch(spark, tmp_path):
    feed = ChangeFeed(spark, str(tmp_path))
    one = spark.createDataFrame([("a", 1, "h1"), ("b", 1, "h2"), ("a", 2, "h3")], "key string, seq bigint, hash string")
    two = spark.createDataFrame([("a", 3, "h3"), ("b", 2, None), ("c", 1, "h4")], "key string, seq bigint, hash string")
    for batch, rows in ((0, one), (1, two), (1, two)):
        feed(rows, batch)
    got = {r.key: (r.hash, r.status) for r in feed.state(1).collect()}
    assert got == {"a": ("h3", "unchanged"), "b": (None, "removed"), "c": ("h4", "added")}
    assert folded(spark.createDataFrame([], STATE), one).count() == 2


def test_change_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 1, "h")], "key string, seq bigint, hash string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    feed = ChangeFeed(spark, str(tmp_path / "state"))
    feed.start(spark.readStream.schema("key string, seq bigint, hash string").json(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination()
    assert feed.state(0).first()[:] == ("a", 1, "h", "added")


def test_segment_index_and_cues(spark):
    body = struct.pack(">II", 1, 1000) + struct.pack(">II", 0, 0) + struct.pack(">HH", 0, 2) + struct.pack(">III", 100, 2000, 0x90000000) + struct.pack(">III", 50, 1000, 0)
    box = struct.pack(">I4sI", len(body) + 12, b"sidx", 0) + body
    got = N.segment_index(box)
    assert [(g["first"] - len(box), g["last"] - len(box), g["start"], g["end"], g["sap"]) for g in got] == [(0, 99, 0.0, 2.0, True), (100, 149, 2.0, 3.0, False)]
    wide = struct.pack(">II", 1, 1000) + struct.pack(">QQ", 0, 7) + body[16:]
    far = N.segment_index(struct.pack(">I4sI", len(wide) + 12, b"sidx", 1 << 24) + wide)
    assert far[0]["first"] == len(wide) + 12 + 7 and far[1]["end"] == 3.0
    cut = box[:-3]
    odd = struct.pack(">I4sI", len(body) + 14, b"sidx", 0) + body + b"xx"
    newer = struct.pack(">I4sI", len(body) + 12, b"sidx", 2 << 24) + body
    for bad in (cut, odd, newer, box + box, box + b"tail", b""):
        with pytest.raises(ValueError):
            N.segment_index(bad)
    df = spark.createDataFrame([(1, bytearray(box)), (2, bytearray(b"x"))], "id int, blob binary").select("id", N.fragments("blob").alias("f"))
    rows = df.select("id", F.explode("f").alias("x")).select("id", "x.*")
    assert N.select_fragments(rows, ["id"], 0.5, 2.5).first()[:] == (1, len(box), len(box) + 149, 2, True, True, True)
    payload = json.dumps({"body": [{"from": 0, "to": 2, "content": "a"}, {"from": 2, "to": 3, "content": " "}, {"from": None, "to": 3, "content": "x"}]})
    assert N.cues(spark, spark.createDataFrame([(1, payload)], "id int, payload string")).count() == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("a<b>:c", 3725.5, 1536, "2026-02-30", "1-3, 7", "[[Dir/Note.md#x|y]] [[p.png]]", "../x", "> [!question] 为什么？\n> b")], "n string, s double, z long, d string, p string, w string, f string, q string")
    r = df.select(
        X.safe_name(F.col("n")), X.clock(F.col("s")), X.byte_size(F.col("z")), X.date_or_least(F.col("d")).cast("string"), X.page_ranges(F.col("p")),
        F.transform(X.wiki_links(F.col("w")), X.link_key), X.exclusion_reason(F.col("f")), X.question_of(F.col("q")), X.clip(F.lit("一二三。四五六七八"), 5), X.int_list(F.lit("a1b22")),
    ).first()
    assert r[:] == ("a b c", "01:02:06", "1.5 KiB", "0001-01-01", [1, 2, 3, 7], ["dir/note", None], "parent", "为什么？", "一二三。", [1, 22])


def test_intervals(spark):
    df = spark.createDataFrame([(1, x) for x in (1, 2, 3, 7, 9, 10)], "k int, n int")
    assert sorted(r[1:] for r in intervals.islands(df, ["k"], "n").collect()) == [(1, 3), (7, 7), (9, 10)]


def test_similarity_is_difflibs(spark):
    from marginalia.functions.similarity import similarity_to

    texts = ["abcdefgh", "abcdefgx", "zzz", None, "abcdxxgh"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(similarity_to("abcdefgh", F.col("t"), 0.7)).collect()]
    want = [None if t is None or (m := difflib.SequenceMatcher(None, "abcdefgh", t).ratio()) < 0.7 else m for t in texts]
    assert got == want


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 5) if isinstance(v, float) else str(v)


def _names():
    import __spark_entry__ as e

    return sorted(set(e.oracle_sql()) - {n for n in e.oracle_sql() if n.startswith("op")})


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as e

    got = e.queries()[name](spark, SF)
    want = duck.sql(e.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()])
    at = {c: i for i, c in enumerate(want.columns)}
    assert a == sorted([tuple(plain(r[at[c]]) for c in columns) for r in want.fetchall()])


def test_routes_and_prompts(spark, tmp_path):
    from marginalia.sources import library as L

    (tmp_path / "map.md").write_text(
        "---\n类型: 知识地图\n分类: 故事与剧本\n---\n# 图\n## 按创作问题调用\n### 冲突\n- **什么时候进入**：没有推进\n- **调用顺序**：[[因果冲突]] 再 [[a/代价.md|x]]\n- **何时停止或返回**：推进了\n### 空\n- 无\n## 按创作阶段调用\n- 视觉设计：[[轴线与视线]]\n- 无链接：x\n## 跨子域总入口\n- 见 [[代价]]\n"
    )
    notes, _ = N.notes(spark, str(tmp_path))
    got = sorted((r.name, r.kind, r.enter, r.targets) for r in L.routes(notes).collect())
    assert got == [("冲突", "problem", "没有推进", ["因果冲突", "代价"]), ("故事与剧本｜视觉设计", "stage", "", ["轴线与视线"]), ("跨子域入口", "cross", "", ["代价"])]
    (tmp_path / "box").mkdir()
    fields = "".join(f"- {f}：v\n" for f in L.PROMPT_FIELDS)
    (tmp_path / "box/b.md").write_text(f"# box\n## 阅读与研究\n### one\n{fields}```text\ntidy\n```\n> raw\n### one\n- 用途：v\n## 其他\n### two\n{fields}")
    entries = L.prompts(spark, str(tmp_path / "box")).cache()
    first = entries.filter("organized = 'tidy'").first()
    assert (first.category, first.title, first.original, first.missing) == ("阅读与研究", "one", "raw", [])
    issues = {(r.code, r.value) for r in L.prompt_issues(entries).collect()}
    assert {("duplicate_title", "one"), ("outside_category", "其他"), ("missing_field", "one: 标签"), ("missing_category", "影视创作")} <= issues
    index = spark.createDataFrame([("one", "One", 1), ("gone", "gone", 2)], "title string, alias string, position int")
    assert {(r.title, r.code) for r in L.index_differences(entries, index).collect()} == {("one", "alias"), ("gone", "stale"), ("two", "missing")}


def test_files_scopes_and_leaves(spark, tmp_path):
    from marginalia.sources import library as L

    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.TXT").write_text("12345")
    (tmp_path / "y.md").write_text("1")
    meta = L.file_metadata(spark, str(tmp_path)).cache()
    assert sorted((r.path, r.extension, r.folder, r.size) for r in meta.collect()) == [("a/b/x.TXT", ".txt", "a/b", 5), ("y.md", ".md", "", 1)]
    total = L.storage_report(meta, spark.createDataFrame([("y.md",)], "path string")).filter("folder is null and extension is null").first()
    assert (total.files, total.bytes, total.referenced) == (2, 6, 1)
    assert [r.path for r in L.changed_files(meta.filter("path = 'y.md'"), meta).collect()] == ["a/b/x.TXT"]
    df = spark.createDataFrame([("z/a/1",), ("z/ab",), ("q",)], "p string")
    assert [r.p for r in df.filter(L.scope(F.col("p"), ["z/a", "z/a/1/"])).collect()] == ["z/a/1"]
    assert df.select(L.ancestors(F.col("p"))).first()[0] == ["z", "z/a"]
    js = spark.createDataFrame([(1, '{"a": {"api_key": "x", "n": [1, {"Token": ""}]}}'), (2, "no")], "id int, j string")
    assert [tuple(r) for r in L.secrets_in_json(js, "id", "j").collect()] == [(1, "a.api_key")]
    notes = spark.createDataFrame([("p", "h")], "path string, doc_hash string")
    assert L.signed_index(notes, str(tmp_path / "ix")).count() == L.signed_index(notes, str(tmp_path / "ix")).count() == 1


def test_courses(spark):
    from marginalia.operators import courses as C

    e = spark.createDataFrame([("c", "p", 1, [1, 2]), ("c", "q", 3, [4, 3]), ("c", "r", 2, [2])], "course string, path string, first int, pages array<int>")
    x = spark.createDataFrame([("c", i) for i in (1, 2, 3, 5)], "course string, page int")
    assert {(r.code, r.page) for r in C.page_partition(e, x).collect()} == {("order", 3), ("first", 3), ("repeated", 2), ("missing", 5), ("extra", 4)}
    f = spark.createDataFrame([(1, "a", "h", "m", 5), (1, "b", "h", "m", 3), (1, "c", "none", "m", 1)], "v int, format_id string, vcodec string, acodec string, filesize long")
    assert C.smallest_muxed(f, "v").first()[:] == (1, "b")
    assert C.preferred(spark.createDataFrame([(1, "en"), (1, "zh")], "v int, lang string"), "v", "lang", ["zh", "en"]).first().lang == "zh"
    t = spark.createDataFrame([(1, i / 10) for i in range(11)] + [(2, 0.0), (2, 1.0)], "k int, t double")
    assert {r.k: r.ok for r in C.frame_timeline(t, "k", "t", 1.0, 24).collect()} == {1: True, 2: False}
    m = spark.createDataFrame([("a", ["b"]), ("b", ["a"]), ("c", ["d"])], "name string, requires array<string>")
    chosen = spark.createDataFrame([("a",), ("c",), ("z",)], "name string")
    assert {tuple(r) for r in C.selection_closure_errors(m, chosen).collect()} == {("a", "b"), ("c", "d"), ("z", "")}


def test_plans_apply_once_and_only_to_what_they_saw(spark, tmp_path):
    from marginalia.plans import upsert as U

    lib = U.Library(spark, str(tmp_path / "lib"))
    lib.create(spark.createDataFrame([("a", "mine"), ("b", "x <!-- managed:k:begin -->\nold\n<!-- managed:k:end --> y"), ("c", "<!-- managed:k:begin -->")], "path string, text string"))
    change = spark.createDataFrame([("a", "k", "new"), ("b", "k", "new"), ("d", "k", "new")], "path string, key string, block string")
    plan = U.build(lib.read(), change)
    token = U.plan_id(plan)
    assert lib.apply(plan, token) == 1
    texts = {r.path: r.text for r in lib.read().collect()}
    block = "<!-- managed:k:begin -->\nnew\n<!-- managed:k:end -->"
    assert texts == {"a": f"mine\n\n{block}\n", "b": f"x {block} y", "c": "<!-- managed:k:begin -->", "d": f"{block}\n"}
    with pytest.raises(ValueError):
        lib.apply(plan, token)
    again = U.build(lib.read(), change)
    assert again.filter("before_hash != after_hash").count() == 0 and lib.version() == 1
    broken = U.build(lib.read(), spark.createDataFrame([("c", "k", "new")], "path string, key string, block string"))
    with pytest.raises(ValueError):
        lib.apply(broken, U.plan_id(broken))


def test_review_packs_and_followups(library, spark):
    from marginalia.plans import review as V

    notes = library[0]
    got = V.pack(notes, ["轴线混乱怎样恢复空间连续", "贝尔不等式"], most=10).collect()
    assert {r.facet for r in got} == {0} and got[0].path == "轴线与视线.md" and any(r.role == "primary" for r in got) and any(r.read_required for r in got)
    assert [(r.path, r.heading) for r in got if r.role == "boundary"] == [(p, "适用边界") for p in sorted({r.path for r in got if r.role == "primary"})]
    rows = [("a.md", "1", {"来源材料": ["[[s]]"]}, "A", "x"), ("s.md", "2", {}, "S", "y"), ("b.md", "3", {"调用知识": ["[[a|z]]"]}, "A", "y")]
    small = spark.createDataFrame([(p, h, m, t, b, [{"links": ["gone", "s"]}]) for p, h, m, t, b in rows], "path string, doc_hash string, props map<string,array<string>>, title string, body string, blocks array<struct<links:array<string>>>")
    before = spark.createDataFrame([("a.md", "1"), ("s.md", "old"), ("c.md", "9")], "path string, doc_hash string")
    changes, impact, issues = V.followup(small, before)
    assert {r.path: r.kind for r in changes.collect()} == {"a.md": "unchanged", "s.md": "modified", "b.md": "added", "c.md": "removed"}
    assert {(r.trigger, r.target, tuple(r.chain)) for r in impact.collect()} == {("s.md", "a.md", ("s.md", "a.md")), ("s.md", "b.md", ("s.md", "a.md", "b.md"))}
    kinds = sorted((r.kind, r.path) for r in issues.collect())
    assert kinds == [("broken_link", "a.md"), ("broken_link", "b.md"), ("broken_link", "s.md"), ("duplicate_title", "a.md"), ("exact_duplicate", "b.md")]


def test_followup_walks_the_edges_of_the_checkpoint(spark):
    from marginalia.plans import review as V

    kind = "path string, doc_hash string, props map<string,array<string>>, title string, body string, blocks array<struct<links:array<string>>>"

    def notes(rows):
        return spark.createDataFrame([(p, h, m, p, p, []) for p, h, m in rows], kind)

    on = lambda x: {"来源材料": [f"[[{x}]]"]}
    old = notes([("gone.md", "1", {}), ("a.md", "2", on("gone")), ("b.md", "3", on("a")), ("c.md", "4", on("cut")), ("cut.md", "5", {})])
    # gone.md is removed; c.md no longer declares cut.md, which has changed.
    new = notes([("a.md", "2", on("gone")), ("b.md", "3", on("a")), ("c.md", "6", {}), ("cut.md", "7", {})])
    pending = spark.createDataFrame([("z.md", "b.md", 1, ["z.md", "b.md"]), ("gone.md", "a.md", 9, ["old"])], "trigger string, target string, depth int, chain array<string>")
    before = old.select("path", "doc_hash")
    impact = V.followup(new, before, V.dependencies(old), pending)[1]
    assert sorted((r.trigger, r.target, r.depth, r.chain) for r in impact.collect()) == [
        ("cut.md", "c.md", 1, ["cut.md", "c.md"]), ("gone.md", "a.md", 1, ["gone.md", "a.md"]),
        ("gone.md", "b.md", 2, ["gone.md", "a.md", "b.md"]), ("z.md", "b.md", 1, ["z.md", "b.md"]),
    ]


def test_graphs_are_walked_to_the_end(spark):
    chain = spark.createDataFrame([(f"n{i + 1:03}", f"n{i:03}") for i in range(66)], "dependent string, dependency string")
    seeds = spark.createDataFrame([("n000",)], "node string")
    assert graph.impact(seeds, chain).agg(F.max("depth")).first()[0] == 66


def test_cycles_are_found_without_pairs(spark):
    import random

    r = random.Random(2)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(75)] + [(100 + i, 100 + (i + 1) % 30) for i in range(30)] + [(200, 200), (300, 301), (None, 3)]
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)

    def returns(n):
        seen, todo = set(), list(after.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        return n in seen

    edges = spark.createDataFrame(pairs, "a long, b long")
    assert {x.node for x in graph.cycle_nodes(edges).collect()} == {n for n in after if n is not None and returns(n)}
    assert graph.cycle_nodes(edges.limit(0)).count() == 0 and graph.cycle_nodes(edges.filter("a >= 300")).count() == 0


def test_containment_is_letter_by_letter(spark):
    import random

    from marginalia.operators import containment

    r = random.Random(2)
    words = ["a", "bb", "ccc", "dd", "e", "ff"]
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(98, None), (99, ""), (1, "xbbx"), (1, "xbbx")]
    passages = list(enumerate(["bb", "b", "xbb", "b ccc", "bb ccc dd", "c dd e f", " ", "a  bb", "ccc dd e ff bb a", "", None, "bb", "dd\n"]))
    got = containment.contained(spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(passages, "item int, text string"), "text")
    assert sorted((x.doc_id, x.item) for x in got.collect()) == sorted((d, i) for d, t in texts for i, p in passages if p and t and p in t)
    none = spark.createDataFrame([], "item int, text string")
    assert containment.contained(spark.createDataFrame(texts, "doc_id int, text string"), none, "text").count() == 0


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    from marginalia.plans.skew import small

    df = spark.createDataFrame([(i, "x" * 100, ["a", "bc"]) for i in range(50)], "i int, t string, l array<string>")
    hinted = lambda d: "hint" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(df, 50)) and not hinted(small(df, 49)) and not hinted(small(df, 50, 5000)) and hinted(small(df, 50, 10_000))


ROLES = [
    ("平台曝光少，是否能按调色曝光做传播原因依据？", "borrowed_reference", {"release"}, {"color"}),
    ("参考知识：调色匹配。实际问题：播放量降低，能用调色匹配来解释平台曝光量吗？", "borrowed_reference", {"release"}, {"color"}),
    ("调色曝光方法能否解释平台曝光少？", "borrowed_reference", {"release"}, {"color"}),
    ("混音方法是否代表服装连续性？", "borrowed_reference", {"assets"}, {"sound"}),
    ("借调色曝光打个比方：我实际要检查行动、失败和策略之间的变化。", "borrowed_reference", set(), {"color"}),
    ("服装状态反复变化，能否用混音方法来判断服装连续性？", "borrowed_reference", {"assets"}, {"sound"}),
    ("肤色偏绿，是否可以按平台曝光量来判断白平衡？", "borrowed_reference", {"color"}, {"release"}),
    ("字幕错字很多，能否借用配乐方法作为字幕检查依据？", "borrowed_reference", {"text"}, {"music"}),
    ("调色流程是否能用于？", "applicability_unresolved", set(), {"color"}),
    ("比较平台曝光和镜头曝光各自的含义与适用条件。", "multiple_targets", {"release", "color"}, set()),
    ("角色折返后画面方向变了，需要比较哪些具体线索？", "direct", {"camera_space"}, set()),
    ("平台曝光少，怎样判断传播原因？", "direct", {"release"}, set()),
]


@pytest.mark.parametrize("question, mode, target, reference", ROLES)
def test_a_reference_is_told_from_the_target(question, mode, target, reference):
    from marginalia.functions.roles import reading

    got = reading(question)
    assert (got.mode, set(got.target_foci), set(got.reference_foci)) == (mode, target, reference)


def test_sections_and_method_parts_are_located():
    body = "# T\n## 知识单元\nintro\n### A\na1\n#### deep\nx\n```\n### no\n```\n### B\n\n## 别的\nmore\n## 相关知识\n### C\nc\n## 方法与案例\nonly text\n## A\n"
    assert [(c["heading"], c["section"]) for c in M.method_chunks(body)] == [("A", "知识单元"), ("别的", "别的"), ("方法与案例", "方法与案例")]
    deep = M.locate(body, "deep")
    assert body[deep["start"] : deep["end"]] == "x\n```\n### no\n```" and (deep["level"], deep["line_start"], deep["line_end"]) == (4, 7, 10)
    assert M.locate(body, "A") == {"error": "repeated"} and M.locate(body, "no") == {"error": "missing"} and M.locate(body, "T") == {"error": "missing"}


def _library(spark, root, topics, extra=""):
    for title, category, problem, methods in topics:
        (root / f"{title}.md").write_text(f"---\n类型: 主题笔记\n分类: {category}\n解决问题: {problem}\n---\n# {title}\n## 知识单元\n{methods}\n")
    if extra:
        (root / "map.md").write_text(extra)
    return N.notes(spark, str(root))[0].cache()


def test_borrowed_words_do_not_answer(spark, tmp_path):
    """The reference's domain is a gap for the target, and an answer for a question of its own."""
    notes = _library(spark, tmp_path, [
        ("曝光与肤色调色", "声音与后期", "曝光与肤色调色怎样判断", "### 曝光匹配方法\n先核对曝光和白平衡，再比较肤色与调色管线，保留混合光意图。"),
        ("现场声音", "声音与后期", "", "### 声音记录方法\n先比较声音曝光记录，再核对底噪与空间。"),
        ("行动失败与策略", "故事与剧本", "行动失败怎样改变策略", "### 行动检查方法\n先对照行动与失败结果，再检查下一次策略是否改变。"),
        ("创作决策复盘", "创作实践与项目复盘", "怎样区分事实、解释假设与反证", "### 事实与解释方法\n先列事实和真实结果，再区分解释假设与反证；一次结果不能证明整套方法有效。"),
    ])
    found = R.topics(notes).cache()
    first = lambda q: R.retrieve(found, R.Question(q)).first()
    assert first("平台曝光少，是否能按调色曝光做传播原因依据？").gap and first("调色曝光方法能否解释平台曝光少？").gap
    same = first("同一场戏肤色偏绿，是否可以按平台曝光量来判断白平衡？")
    assert not same.gap and same.title == "曝光与肤色调色"
    other = first("借调色曝光打个比方：我实际要检查行动、失败和策略之间的变化。")
    assert not other.gap and other.title == "行动失败与策略"
    neutral = first("一次短片播放量低，怎样区分作品、包装与发布条件的影响，避免凭一次结果改整套方法？")
    assert not neutral.gap and neutral.title == "创作决策复盘"
    wide = first("肤色与调色管线的白平衡ＬＯＯＫ")
    assert wide.title == "曝光与肤色调色" and not wide.gap


def test_routes_raise_and_never_make_a_match(spark, tmp_path):
    from marginalia.sources import library as L

    notes = _library(spark, tmp_path, [
        ("动作接口", "导演与视听语言", "动作接口怎样保持连续", "### 接口方法\n对照动作接口与相邻镜头的运动线索。"),
        ("动作节奏", "导演与视听语言", "动作节奏怎样保持连续", "### 节奏方法\n对照动作节奏与相邻镜头的运动线索。"),
        ("无关主题", "故事与剧本", "另一件事", "### 别的\n毫不相干。"),
    ], "---\n类型: 知识地图\n分类: 导演与视听语言\n---\n# 图\n## 按创作问题调用\n### 运动线索断裂\n- **什么时候进入**：动作线索断裂、运动线索断裂\n- **调用顺序**：[[动作节奏]] 再 [[无关主题]]\n- **何时停止或返回**：线索接上\n")
    found, routes = R.topics(notes).cache(), L.routes(notes)
    question = R.Question("动作线索断裂、运动线索断裂，怎样保持动作连续")
    plain = {r.title: r.score for r in R.retrieve(found, question, 3).collect()}
    led = {r.title: (r.score, r.route) for r in R.retrieve(found, question, 3, routes).collect()}
    assert led["动作节奏"][1] == "运动线索断裂" and led["动作节奏"][0] > plain["动作节奏"] and "无关主题" not in led


def test_cards_and_views(spark, tmp_path):
    from marginalia.operators import cards as C
    from marginalia.sources import library as L

    (tmp_path / "a").mkdir()
    (tmp_path / "a/map.md").write_text("---\n类型: 知识地图\n分类: 声音与后期\n---\n# 图\n## 知识骨架\n| 域 | 问题 | 答 | 状态 |\n|--|--|--|--|\n| x | 怎么做 | — | 待补 |\n| x | 已有 | 有 | 完成 |\n")
    (tmp_path / "a/t.md").write_text("---\n类型: 主题笔记\n分类: 声音与后期\n解决问题: 底噪\n整理日期: 2026-01-02\n---\n# 题\n## 方法\n短\n## 长\n" + "长" * 1900 + "\n")
    for p, pages in ((2, "[3, 4]"), (1, "[1, 2]")):
        (tmp_path / f"a/e{p}.md").write_text(f"---\n类型: 分集笔记\n课程: 课\n聚合单位: 课\n分集: 一\n主题: t\nBV: b\nP: {p}\n包含P: {pages}\n---\n# e{p}\n视频：[x](https://v.x/?p=1)\n[y](https://v.x/?p=2)\n## 时间线笔记\nz\n")
    notes = N.notes(spark, str(tmp_path))[0].cache()
    assert [tuple(r) for r in C.gaps(notes, "声音与后期").collect()] == [("声音与后期", "怎么做", "a/map.md", "| x | 怎么做 | — | 待补 |")]
    seen = {r.heading: (r.read_required, r.excerpt, r.source_type, r.note_date) for r in C.evidence(N.blocks(notes).filter("title = '题'"), notes).collect()}
    assert seen == {"方法": (False, "短", "未标注", "2026-01-02"), "长": (True, "", "未标注", "2026-01-02")}
    assert [r.path for r in C.lesson_units(notes, "课").collect()] == ["a/e1.md", "a/e2.md"]
    assert [(r.name, r.folder, r["解决问题"]) for r in C.topics_of(notes, "声音与后期").collect()] == [("t.md", "a", "底噪")]
    codes = {(r.path, r.code) for r in audit.validate(notes, strict=True).collect()}
    assert {("a/e2.md", "lesson_first"), ("a/e2.md", "lesson_links"), ("a/e1.md", "lesson_layers"), ("a/e1.md", "lesson_threads"), ("a/t.md", "topic_heading:学习材料")} <= codes
    assert not {("a/e1.md", c) for c in ("lesson_first", "lesson_links", "lesson_order", "episode_video", "episode_timeline")} & codes
    files = N.manifest(spark, str(tmp_path)).cache()
    assert C.manifest_totals(files).first()[0] == 4 and C.manifest_totals(files).first()[2] == 4
    C.write_manifest(files, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        C.write_manifest(files, str(tmp_path / "out"))
    fields = "".join(f"- {f}：v\n" for f in L.PROMPT_FIELDS)
    (tmp_path / "box").mkdir()
    (tmp_path / "box/b.md").write_text("# box\n## 阅读与研究\n" + "".join(f"### {t}\n{fields}```text\n{x}\n```\n" for t, x in {"same": "ABCD efgh", "near": "abcdefgx", "far": "zzzz"}.items()))
    entries = L.prompts(spark, str(tmp_path / "box"))
    assert {(r.title, r.similarity, r.exact) for r in C.best_matches(entries, "abcd-EFGH").collect()} == {("same", 1.0, True), ("near", 0.875, False)}
    assert C.best_matches(entries, " - ").count() == 0


def test_small_columns_of_cards(spark):
    from marginalia.operators import cards as C

    df = spark.createDataFrame([("1, 2.5", 10.0, "未检验", "", "题"), ("3,2", 0.5, "能辨析", "问", "题"), ("x", 4.0, "能复述", "问", "题"), (None, None, None, None, "题")], "c string, d double, m string, p string, t string")
    got = df.select(C.clip(F.col("c")).alias("c"), C.clips(F.col("d"), 4).alias("d"), C.frame_times(F.lit(1.0), F.col("d")).alias("f"), C.question(F.col("m"), F.col("p"), F.col("t")).alias("q")).collect()
    assert [tuple(r.c) if r.c else None for r in got] == [(1.0, 2.5), None, None, None]
    assert [[tuple(x) for x in r.d] for r in got[:3]] == [[(0, 4), (4, 8), (8, 10)], [], [(0, 4)]]
    assert got[0].f == [1.0, 5.5, 9.0] and got[1].f is None
    assert "题" in got[0].q and "核心因果" in got[0].q and "第一步" in got[1].q and "失效" in got[2].q
    refs = spark.createDataFrame([("refs/heads/main", "s1"), ("refs/tags/ok-1", "s1"), ("refs/heads/x", "s2")], "ref string, sha string")
    assert [tuple(r) for r in C.known_head(refs, "main", [], "ok-").collect()] == [("s1", True)] and [tuple(r) for r in C.known_head(refs, "x", [], "ok-").collect()] == [("s2", False)]
    rows = spark.createDataFrame([(1, None, "a|b\nc")], "z int, a string, t string")
    assert C.rendered(rows, "z").first().json == '{"a":null,"t":"a|b\\nc","z":1}'
    assert [r.line for r in C.report(rows, "R", {"z": "Z", "t": "T"}).orderBy("line_no").collect()] == ["# R", "", "| Z | T |", "|---|---|", "| 1 | a\\|b c |"]
    modules = spark.createDataFrame([("m/x.md", {"name": ["m"], "description": ["d"]}), ("n/x.md", {"name": ["m"], "description": ["d"]}), ("B_/x.md", {"name": ["B_"], "description": ["d"]}), ("k/x.md", {"name": ["k"], "description": ["<d>"]})], "path string, props map<string,array<string>>")
    assert {(r.path, r.code) for r in C.module_errors(modules).collect()} == {("n/x.md", "name_differs"), ("B_/x.md", "name"), ("k/x.md", "description")}


def test_fingerprints_of_large_groups_are_deeper_trees(spark):
    rows = spark.range(5000).select(F.lit("g").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    flat, deep = (diff.fingerprint(rows, ["g"], "d", leaf).first() for leaf in (1 << 20, 100))
    again = diff.fingerprint(rows.repartition(5, "d"), ["g"], "d", 100).first()
    assert flat.n_rows == deep.n_rows == 5000 and deep.fingerprint == again.fingerprint != flat.fingerprint


def test_a_crashed_write_is_replaced(spark, tmp_path):
    from marginalia.plans import upsert as U

    lib = U.Library(spark, str(tmp_path / "lib"))
    lib.create(spark.createDataFrame([("a", "x")], "path string, text string"))
    spark.createDataFrame([("a", "half")], "path string, text string").write.parquet(str(tmp_path / "lib/v=1"))  # no pointer to it
    plan = U.build(lib.read(), spark.createDataFrame([("a", "k", "new")], "path string, key string, block string"))
    assert lib.apply(plan, U.plan_id(plan)) == 1 and "new" in lib.read().first().text
    with pytest.raises(ValueError):
        lib.create(lib.read())


def test_hot_keys_are_summed_in_blocks(spark):
    import random

    r = random.Random(1)
    data = [(k, i, r.randint(0, 9)) for k, n in (("hot", 3000), ("b", 20), (None, 700)) for i in r.sample(range(10 * n), n)]
    rows = spark.createDataFrame(data, "k string, t int, v int")
    plain, cut = ({(x.k, x.t): x.before for x in intervals.running_before(rows, ["k"], "t", "v", "before", hot).collect()} for hot in (10**6, 100))
    assert plain == cut and cut["hot", max(t for k, t, _ in data if k == "hot")] == sum(v for k, _, v in data if k == "hot") - [v for k, t, v in data if k == "hot" and t == max(t for k, t, _ in data if k == "hot")][0]
    assert intervals.blocked(rows, ["k"], "t", 100)[0].filter("k = 'hot'").select("_block").distinct().count() > 500
    a, b = ({x.k: tuple(x) for x in intervals.gap_check(rows, ["k"], "t", 500, hot).collect()} for hot in (10**6, 100))
    assert a == b and a["hot"][1] == 3000
