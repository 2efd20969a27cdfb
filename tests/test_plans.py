"""Plans over many rows at once against their plain or one-by-one forms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.plans import evaluate as E
from marginalia.plans import retrieve as R
from marginalia.sources import library as L
from marginalia.sources import notes as N

TOPICS = [
    ("曝光与肤色调色", "声音与后期", "曝光与肤色调色怎样判断", "### 曝光匹配方法\n先核对曝光和白平衡，再比较肤色与调色管线，保留混合光意图。\n### 别的方法\n比较肤色与白平衡。"),
    ("现场声音", "声音与后期", "", "### 声音记录方法\n先比较声音曝光记录，再核对底噪与空间。room tone 与 foley 的记录。"),
    ("行动失败与策略", "故事与剧本", "行动失败怎样改变策略", "### 行动检查方法\n先对照行动与失败结果，再检查下一次策略是否改变。"),
    ("创作决策复盘", "创作实践与项目复盘", "怎样区分事实、解释假设与反证", "### 事实与解释方法\n先列事实和真实结果，再区分解释假设与反证；一次结果不能证明整套方法有效。"),
    ("动作接口", "导演与视听语言", "动作接口怎样保持连续", "### 接口方法\n对照动作接口与相邻镜头的运动线索。"),
    ("动作节奏", "导演与视听语言", "动作节奏怎样保持连续", "### 节奏方法\n对照动作节奏与相邻镜头的运动线索。"),
    ("无关主题", "故事与剧本", "另一件事", "### 别的\n毫不相干。"),
]
MAP = "---\n类型: 知识地图\n分类: 导演与视听语言\n---\n# 图\n## 按创作问题调用\n### 运动线索断裂\n- **什么时候进入**：动作线索断裂、运动线索断裂\n- **调用顺序**：[[动作节奏]] 再 [[无关主题]]\n- **何时停止或返回**：线索接上\n"
ASKED = [
    "平台曝光少，是否能按调色曝光做传播原因依据？", "调色曝光方法能否解释平台曝光少？", "同一场戏肤色偏绿，是否可以按平台曝光量来判断白平衡？",
    "借调色曝光打个比方：我实际要检查行动、失败和策略之间的变化。", "一次短片播放量低，怎样区分作品、包装与发布条件的影响，避免凭一次结果改整套方法？",
    "肤色与调色管线的白平衡ＬＯＯＫ", "动作线索断裂、运动线索断裂，怎样保持动作连续", "foley", "白平衡", "完全没有的词语组合", "", "底噪与空间的记录", "行动失败以后怎样改变策略？",
]


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    for title, category, problem, methods in TOPICS:
        (root / f"{title}.md").write_text(f"---\n类型: 主题笔记\n分类: {category}\n解决问题: {problem}\n适用阶段:\n  - 视觉设计\n---\n# {title}\n## 知识单元\n{methods}\n")
    (root / "map.md").write_text(MAP)
    return N.notes(spark, str(root))[0].cache()


@pytest.mark.parametrize("with_routes", [False, True])
def test_many_questions_get_what_each_gets_alone(spark, library, with_routes):
    found, routes = R.topics(library), L.routes(library).cache() if with_routes else None
    rows = [(i, q, "视觉设计" if i % 2 else None, ["故事与剧本"] if i % 3 == 0 else None) for i, q in enumerate(ASKED)]
    got = E.retrieve_many(found, spark.createDataFrame(rows, "question int, text string, stage string, categories array<string>"), 3, routes).collect()
    columns = ["title", "rank", "kept", "ambiguous", "route", "gap", "block_id"]
    for i, text, stage, categories in rows:
        alone = R.retrieve(found, R.Question(text, stage or "", tuple(categories or ())), 3, routes).collect()
        mine = [r for r in got if r.question == i]
        key = lambda r: str(r.asDict().get("rank"))
        for a, b in zip(sorted(mine, key=key), sorted(alone, key=key), strict=True):
            assert [a.asDict().get(c) for c in columns] == [b.asDict().get(c) for c in columns], text
            assert a.score == pytest.approx(b.asDict().get("score")) and sorted(a.hits or []) == sorted(b.asDict().get("hits") or [])
    assert len({r.question for r in got}) == len(ASKED) and {r.question for r in got if r.gap} >= {0, 1, 9, 10}


def test_no_questions_and_no_notes(spark, library):
    none = spark.createDataFrame([], "question int, text string")
    assert E.retrieve_many(R.topics(library), none).count() == 0
    asked = spark.createDataFrame([(1, "白平衡与肤色"), (2, None)], "question int, text string")
    assert [(r.question, r.gap, r.title) for r in E.retrieve_many(R.topics(library.limit(0)), asked).orderBy("question").collect()] == [(1, True, None), (2, True, None)]
    assert sorted((r.question, r.gap) for r in E.retrieve_many(R.topics(library), asked).collect()) == [(1, False), (2, True)]


def test_terms_are_matched_as_substrings(spark):
    r = random.Random(5)
    texts = [(f"r{i}", " ".join("".join(r.choice("ab动作c") for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 8)))) for i in range(200)] + [("none", None)]
    terms = sorted({"".join(r.choice("ab动作c") for _ in range(r.randint(2, 9))) for _ in range(80)})
    got = E.matches(spark.createDataFrame(texts, "row string, text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, t) for i, x in texts for t in terms if x and t in x)


def test_cases_are_judged(spark):
    answers = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, None, None, True), (3, 1, "x", False), (4, None, None, True)], "question int, rank int, title string, gap boolean")
    cases = spark.createDataFrame(
        [(1, ["a"], None, ["z"], False), (2, None, None, None, True), (3, ["y"], ["x"], ["x"], None), (4, ["q"], None, None, False), (5, None, None, None, True)],
        "question int, expected_top1 array<string>, expected_any array<string>, forbidden array<string>, expect_gap boolean",
    )
    judged = E.verdicts(answers, cases)
    assert {r.question: (r.top1_ok, r.hit3_ok, r.gap_ok, r.forbidden_ok, r.passed) for r in judged.collect()} == {
        1: (True, True, True, True, True), 2: (True, True, True, True, True), 3: (False, True, True, False, False), 4: (False, False, False, True, False), 5: (True, True, True, True, True),
    }
    total = E.summary(judged).first()
    assert (total.cases, total.supported, total.negatives, round(total.top1, 4), round(total.hit3, 4), total.gap, total.failures, total.accepted) == (5, 3, 2, 0.3333, 0.6667, 1.0, 2, False)
    assert E.summary(judged.limit(0)).first().accepted


# --- budgets -----------------------------------------------------------------------------------------------------------


def greedy(size, links, items, budget):
    """Pop links from the end, then blank the longest excerpts, one by one."""
    links, items, dropped, blank = list(links), dict(items), set(), set()
    while links and size > budget:
        k, n = links.pop()
        dropped.add(k)
        size -= n
    while size > budget:
        left = [(k, v) for k, v in sorted(items.items()) if v[0] and k not in blank]
        if not left:
            break
        k, (_, gain) = max(left, key=lambda x: (x[1][0], -x[0]))
        if gain <= 0:
            break
        blank.add(k)
        size -= gain
    return dropped, blank, size


@pytest.mark.parametrize("hot", [4_000_000, 5])
def test_packs_are_cut_as_one_by_one(spark, monkeypatch, hot):
    """Also where a pack of more than five rows is summed by blocks."""
    from marginalia.operators import intervals
    from marginalia.plans import budget as B

    monkeypatch.setattr(B, "running_before", lambda *a: intervals.running_before(*a, hot=hot))
    r = random.Random(hot)
    packs, links, items, want = [], [], [], {}
    for p in [None, *range(60)]:
        own_links = [(k, r.randint(5, 40)) for k in range(r.randint(0, 6))]
        own = {k: (n, n - 30 if r.random() < 0.9 else r.choice([0, -3])) for k in range(r.randint(0, 14)) for n in [r.choice([0, 20, 31, 50, 50, 50, 80, 200, 200])]}
        size = sum(n for _, n in own_links) + sum(n for n, _ in own.values()) + 100
        packs.append((p, size))
        links += [(p, k, n) for k, n in own_links]
        items += [(p, k, n, g) for k, (n, g) in own.items()]
        want[p] = greedy(size, own_links, own, 300)
    packs = spark.createDataFrame(packs, "pack int, size long")
    over = B.excess(packs, ["pack"], "size", 300)
    got_links = B.popped(spark.createDataFrame(links, "pack int, place int, size long"), over, ["pack"], "place", "size").cache()
    left = B.left_over(over, got_links, ["pack"], "size")
    got = B.deferred(spark.createDataFrame(items, "pack int, place int, len long, gain long"), left, ["pack"], "place", "len", "gain").cache()
    assert got.count() == len(items) and got_links.count() == len(links)
    for p, (dropped, blank, _) in want.items():
        assert {x.place for x in got_links.collect() if x.pack == p and x.dropped} == dropped
        assert {x.place for x in got.collect() if x.pack == p and x.deferred} == blank, p
    report = {x.pack: x for x in B.report(packs, got_links, got, ["pack"], "size", "size", "gain", 300).collect()}
    assert {p: (x.size, x.exceeded, x.deferred) for p, x in report.items()} == {p: (s, s > 300, len(b)) for p, (_, b, s) in want.items()}


# --- links, effects, integrity -------------------------------------------------------------------------------------------


def plain_path(raw, origin, catalog):
    """(target, reason) of one link."""
    raw = (raw or "").split("#")[0].strip(" ").replace("\\", "/")
    if not raw:
        return None, "empty"
    if raw.startswith("/") or re.match("[a-zA-Z]:", raw):
        return None, "outside"
    path = raw if raw.lower().endswith(".md") else raw + ".md"

    def fold(p):
        out = []
        for x in p.split("/"):
            if x == "..":
                if not out:
                    return None
                out.pop()
            elif x not in ("", "."):
                out.append(x)
        return "/".join(out).lower()

    for reason, full in (("root", path), ("relative", re.sub("[^/]*$", "", origin or "") + path)):
        hit = sorted((not indexed, p) for p, indexed in catalog if p.lower() == fold(full))
        if hit:
            return (hit[0][1], reason) if not hit[0][0] else (None, "exists")
    hit = [] if "/" in path else sorted((not indexed, p) for p, indexed in catalog if p.lower().split("/")[-1] == path.lower())
    if len(hit) > 1:
        return None, "ambiguous"
    return (None, "missing") if not hit else (None, "exists") if hit[0][0] else (hit[0][1], "name")


def test_written_links_are_resolved(spark):
    from marginalia.operators import graph

    r = random.Random(3)
    names = ["a.md", "B.md", "ü.md", "c d.md", "e.x.md"]
    catalog = [(f"{d}{n}", r.random() < 0.8) for d in ("", "x/", "x/y/", "Z/") for n in names if r.random() < 0.7]
    catalog += [("deep/Only.md", True), ("deep/hid.md", False), ("p/twice.md", True), ("q/Twice.md", False)]
    raws = [None, "", "#h", " ", "a", "A.MD", "./a", "../a", "../../a", "../../../a", "x/./y/../a", "y/B", "Z\\B", "/a", "C:/a", "b", "nope", "x/nope", "e.x", "c d#part", "a#b#c", "..", ".", "x//y//a", "Ü", "only", "hid", "twice", "deep/../deep/only"]
    links = [(i, raw, origin) for i, (raw, origin) in enumerate((raw, o) for raw in raws for o in ("", "x/o.md", "x/y/o.md", "q/w/e/o.md", None))] + [(9999, "a", "x/o.md"), (9999, "a", "x/o.md")]
    got = graph.resolve_paths(spark.createDataFrame(links, "link_id int, raw string, origin string").limit(145), spark.createDataFrame(catalog, "path string, indexed boolean")).collect()
    assert {x.link_id: (x.target, x.reason) for x in got} == {i: plain_path(raw, o, catalog) for i, raw, o in links[:145]}
    assert {x.reason for x in got} == {"root", "relative", "name", "exists", "ambiguous", "missing", "outside", "empty"}


def plain_impact(nodes, seeds, now, then):
    """Seeds over all edges, then each new edge over current ones; the first to reach a target counts."""
    found = {}

    def spread(trigger, chain, edges, reason, own):
        if own and chain[-1] in nodes:
            found.setdefault((trigger, chain[-1]), (reason, chain))
        queue, seen = [chain], set(chain)
        while queue:
            chain = queue.pop(0)
            for t in sorted({a for a, b, _ in edges if b == chain[-1]} - seen):
                seen.add(t)
                if t in nodes:
                    found.setdefault((trigger, t), (reason, [*chain, t]))
                queue.append([*chain, t])

    for s, reason in sorted(seeds):
        spread(s, [s], now | then, reason, False)
    for a, b, _ in sorted(now - then):
        spread(b, [b, a], now, "declared_dependency_added", True)
    return found


def test_effects_start_at_nodes_and_at_new_edges(spark):
    from marginalia.operators import graph

    r = random.Random(9)
    for _ in range(4):
        every = [f"n{i}" for i in range(14)]
        nodes = {n: r.choice(["topic", "application"]) for n in every if r.random() < 0.8}
        edge = lambda: (r.choice(every), r.choice(every), r.choice(["f", "g"]))
        then = {edge() for _ in range(14)}
        now = {e for e in then if r.random() < 0.7} | {edge() for _ in range(5)}
        seeds = {(n, "changed") for n in every if r.random() < 0.2}
        frame = lambda rows: spark.createDataFrame(sorted(rows), "dependent string, dependency string, field string")
        got = graph.change_impact(spark.createDataFrame(sorted(nodes.items()), "node string, kind string"), spark.createDataFrame(sorted(seeds), "node string, reason string"), frame(now), frame(then)).collect()
        want = plain_impact(nodes, seeds, now, then)
        assert {(x.trigger, x.target): x.reason for x in got} == {k: v[0] for k, v in want.items()}
        assert {(x.trigger, x.target): x.chain for x in got} == {k: v[1] for k, v in want.items()}
        assert all(x.kind == nodes[x.target] and x.depth == len(x.chain) - 1 for x in got)


def test_records_are_held_against_bytes_and_lines(spark):
    import hashlib

    from marginalia.operators import integrity as I

    sha = lambda b: hashlib.sha256(b).hexdigest()
    note, text = "é one\ntwo\n<!-- source-evidence: s1 -->".encode(), "first line\nsecond\n\nfourth é".encode()
    notes = spark.createDataFrame([("a.md", note), ("b.md", b"<!--source-evidence: s1--> <!-- source-evidence: s9 -->"), ("c.md", b"")], "path string, content binary")
    raw = spark.createDataFrame([("s1", text), ("s2", b"other"), ("s5", None)], "source_id string, content binary")
    records = [
        ("s1", sha(text), True, "a.md", sha(note), 2, sha(note[:2])), ("s2", sha(text), True, "a.md", "0" * 64, 3, sha(note[:2])), ("s3", sha(text), False, "gone.md", sha(note), 4, "x"),
        ("s4", sha(text), True, "c.md", sha(b""), 1, sha(b"")), ("s4", sha(text), None, "c.md", sha(b""), None, None), ("s5", sha(b""), True, "a.md", sha(note), 10_000, sha(note)),
    ]
    frame = spark.createDataFrame(records, "source_id string, text_sha256 string, local boolean, note_path string, note_sha256 string, prefix_bytes int, prefix_sha256 string")
    got = sorted(tuple(r) for r in I.bindings(frame, notes, raw).collect())
    assert got == sorted([
        ("s1", False, "matches", "matches", True, "matches"), ("s2", False, "changed", "changed", False, "changed"), ("s3", False, "missing", "missing", False, "history_only"),
        ("s4", True, "matches", "changed", False, "missing"), ("s4", True, "matches", "none", False, "history_only"), ("s5", False, "matches", "changed", False, "missing"),
    ])
    assert sorted(tuple(r) for r in I.stray_markers(frame, notes).collect()) == [("b.md", "s1"), ("b.md", "s9")]
    items = [("s1", "ok", 1, 2, "line\nsecond"), ("s1", "end", 4, 4, "é"), ("s1", "quote", 1, 1, "second"), ("s1", "far", 4, 5, "x"), ("s1", "back", 3, 2, None), ("s1", "lines", 2, 3, None), ("s1", "null", None, 2, "x"), ("s7", "none", 1, 1, "x"), ("s1", "blank", 3, 3, "")]
    asked = spark.createDataFrame(items, "source_id string, id string, from int, to int, quote string")
    texts = raw.select("source_id", F.col("content").cast("string").alias("text"))
    assert {r.id: r.code for r in I.checked_quotes(asked, texts, "source_id").collect()} == {
        "ok": "ok", "end": "ok", "quote": "quote", "far": "range", "back": "range", "lines": "ok", "null": "range", "none": "missing", "blank": "ok",
    }
    assert {r.source_id: r.bad_items for r in I.audited(frame, asked, notes, raw).collect()}["s1"] == 4
    lines = I.line_index(texts, "source_id").filter("source_id = 's1'").orderBy("line").collect()
    assert [text[x.start : x.end].decode() for x in lines] == text.decode().split("\n") == [x.text for x in lines]


def test_packs_support_bound_and_fit(spark, tmp_path):
    from marginalia.plans import review as V

    note = lambda kind, links, body: f"---\n类型: {kind}\n来源材料:\n" + "".join(f'  - "[[{x}]]"\n' for x in links) + f"---\n{body}\n"
    files = {
        "顶.md": note("主题笔记", ["源", "顶", "无"], "# 顶\n## 知识单元\n轴线混乱时恢复空间连续的方法：先核对轴线与空间连续。\n## 适用边界\n一般限制。\n## 适用边界\n又一条。\n## 风险\n轴线混乱的风险与空间连续。\n## 反例\n轴线混乱与空间连续的反例，轴线混乱。\n## 误区\n毫不相干。"),
        "次.md": note("主题笔记", [], "# 次\n## 知识单元\n轴线混乱时恢复空间连续的另一种方法：先核对轴线与空间连续。\n## 风险\n轴线混乱的风险与空间连续。\n## 反例\n轴线混乱与空间连续的反例，恢复。\n## 误区\n轴线混乱与空间连续的误区。"),
        "源.md": note("来源笔记", [], "# 源\n## 记录\n轴线混乱与空间连续的来源记录。\n## 别的\n轴线混乱，空间连续，恢复。"),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(re.sub("轴线混乱[^。]*。", lambda m: m[0] + "镜头与方向。", text))
    found = N.notes(spark, str(tmp_path))[0].cache()
    questions = ["轴线混乱怎样恢复空间连续", "贝尔不等式"]
    rows = V.pack(found, questions, most=1 << 30).collect()
    assert {r.facet for r in rows} == {0}
    primaries = {r.id: r.path for r in rows if r.role == "primary"}
    assert all((r.of in primaries) == (r.role != "alternative") for r in rows)
    support = [r for r in rows if r.role == "support"]
    assert all(r.path == "源.md" and primaries[r.of] == "顶.md" for r in support) and len(support) == ("顶.md" in primaries.values())
    for of, path in primaries.items():
        limits = sorted((r.rank, r.heading) for r in rows if r.role == "boundary" and r.of == of)
        if path == "顶.md":
            assert limits[0] == (1, "适用边界") and len(limits) == 2 and limits[1][1] in ("风险", "反例")
            assert next(r.excerpt for r in rows if r.role == "boundary" and r.of == of and r.rank == 1) == "一般限制。"
        elif path == "次.md":
            assert len(limits) == 2 and "适用边界" not in {h for _, h in limits}
    assert all((r.excerpt is None) == r.read_required == (r.role == "alternative") for r in rows)
    counts = V.pack_counts(found, V.pack(found, questions, most=1 << 30), questions).orderBy("facet").collect()
    assert [(c.status, c.source_gap) for c in counts] == [("needs_review", False), ("gap", True)]
    longest = sorted((len(r.excerpt) for r in rows if r.excerpt), reverse=True)
    tight = V.pack(found, questions, most=100).collect()
    assert [r.id for r in tight] == [r.id for r in rows] and all(r.excerpt is None or len(r.excerpt) <= longest[0] for r in tight)
