"""One Markdown note as records: properties, leaf sections, table rows, links. Plain functions over one text."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")
FENCE = re.compile(r"^[ \t]{0,3}(`{3,}|~{3,})")
LINK = re.compile(r"\[\[([^\]|]+?)(?:\\?\|([^\]]+))?\]\]")
URL = re.compile(r"\[([^\]]+)\]\((https?://[^)\s]+)\)")
KEY = re.compile(r"^([^\s:#][^:]*):[ \t]*(.*)$")
#: When a table is cut into its rows.
MANY_ROWS, LONG_TABLE, LINKED_ROWS = 8, 1800, 1


def _bare(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value


def properties(text: str) -> tuple[dict[str, list[str]], str, int]:
    """(properties, body, number of the body's first line). Without a closed header: ({}, text, 1).

    Every value is a list: a scalar has one element, ``[a, b]`` and indented ``- x`` lines any number; empty values,
    ``null``, ``~`` and ``[]`` have none.
    """
    lines = text.split("\n")
    if lines[0].rstrip() != "---":
        return {}, text, 1
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip() == "---"), 0)
    if not end:
        return {}, text, 1
    out: dict[str, list[str]] = {}
    key = None
    for line in lines[1:end]:
        item = re.match(r"^\s*-\s+(.*)$", line)
        if item and key is not None:
            out[key].append(_bare(item[1]))
        elif found := KEY.match(line):
            key, value = found[1].strip(), found[2].strip()
            if value in ("", "null", "~", "[]"):
                out[key] = []
            elif value[0] == "[" and value[-1] == "]":
                out[key] = [b for x in value[1:-1].split(",") if (b := _bare(x))]
            else:
                out[key] = [_bare(value)]
    return out, "\n".join(lines[end + 1 :]), end + 2


@dataclass
class Block:
    heading: str
    parents: list[str]
    line_start: int
    line_end: int
    text: str
    kind: str = "section"  # section, table_parent, table_header, table_context or table_row
    routing_only: bool = False
    context: list[int] = field(default_factory=list)


def outline(lines: list[str]) -> list[tuple[int, str] | None | bool]:
    """For each line the (level, text) of an ATX heading, True inside a code fence and at its marks, else None."""
    out: list[tuple[int, str] | None | bool] = []
    fence = ""
    for line in lines:
        mark = FENCE.match(line)
        if mark and not fence:
            fence = mark[1]
            out.append(True)
        elif fence:
            if mark and mark[1].startswith(fence) and not line[mark.end() :].strip():
                fence = ""
            out.append(True)
        else:
            found = HEADING.match(line)
            out.append((len(found[1]), found[2]) if found else None)
    return out


def _trimmed(lines: list[str], first: int, last: int) -> tuple[int, int]:
    """The stretch of lines (last excluded) without the blank ones at its ends."""
    while first < last and not lines[first].strip():
        first += 1
    while last > first and not lines[last - 1].strip():
        last -= 1
    return first, last


def sections(text: str, skip: frozenset[str] = frozenset()) -> list[Block]:
    """The leaf sections under ATX headings outside code fences, with the headings above; blank ends are trimmed.

    Sections that are, or lie below, a heading in ``skip`` are left out.
    """
    lines = text.split("\n")
    marks = outline(lines)
    heads = [i for i, m in enumerate(marks) if isinstance(m, tuple)]
    out: list[Block] = []
    above: list[tuple[int, str]] = []
    for at, end in zip([-1, *heads], [*heads, len(lines)], strict=True):
        if at >= 0:
            above = [h for h in above if h[0] < marks[at][0]] + [marks[at]]
        first, last = _trimmed(lines, at + 1, end)
        names = [h for _, h in above]
        if first < last and not skip.intersection(names):
            out.append(Block(names[-1] if names else "", names[:-1], first + 1, last, "\n".join(lines[first:last])))
    return out


#: Sections where methods begin, and those where they end.
METHODS = frozenset(("知识单元", "方法与案例"))
NO_METHODS = frozenset("来源差异与综合判断 外部补充与分歧 相关知识 我的默认做法 项目应用与验证 对我的创作有什么启发 我的理解、疑问与联想 复习区 学习材料 内容导览".split())


def method_chunks(body: str) -> list[dict]:
    """(heading, text, section) of a note's methods: the H3 parts of its method sections, or a section that has none.

    Methods begin at a section in METHODS and go on until one in NO_METHODS; other sections change nothing.
    """
    lines = body.split("\n")
    marks = [(i, m) for i, m in enumerate(outline(lines)) if isinstance(m, tuple) and m[0] <= 3]
    out: list[dict] = []
    within, section, parts = False, "", 0
    for k, (at, (level, name)) in enumerate(marks):
        end = marks[k + 1][0] if k + 1 < len(marks) else len(lines)
        if level == 2:
            within = (within or name in METHODS) and name not in NO_METHODS
            stop = next((i for i, m in marks[k + 1 :] if m[0] <= 2), len(lines))
            parts = sum(m[0] == 3 and at < i < stop and any(x.strip() for x in lines[i + 1 : _next(marks, i, len(lines))]) for i, m in marks)
            section = name
            end = end if parts else stop
        elif level == 1:
            section, parts = "", 0
        keep = within and section and (level == 3 or (level == 2 and not parts))
        first, last = _trimmed(lines, at + 1, end)
        if keep and first < last and (level == 2 or parts):
            out.append({"heading": name, "text": "\n".join(lines[first:last]), "section": section})
    return out


def _next(marks: list[tuple[int, tuple[int, str]]], at: int, last: int) -> int:
    """The line of the first of ``marks`` behind line ``at``."""
    return next((i for i, _ in marks if i > at), last)


def locate(text: str, heading: str) -> dict:
    """Where the section of an H2 to H6 heading stands: its level, the offsets of its trimmed text, and its lines.

    ``error`` is "missing" or "repeated" where no or more than one heading has that name; it is None otherwise.
    """
    lines = text.split("\n")
    marks = [(i, m) for i, m in enumerate(outline(lines)) if isinstance(m, tuple)]
    found = [(i, m[0]) for i, m in marks if m[1] == heading and m[0] >= 2]
    if len(found) != 1:
        return {"error": "repeated" if found else "missing"}
    at, level = found[0]
    end = next((i for i, m in marks if i > at and m[0] <= level), len(lines))
    start = sum(len(x) + 1 for x in lines[: at + 1])
    whole = "\n".join(lines[at + 1 : end])
    body = whole.strip()
    begin = start + len(whole) - len(whole.lstrip()) if body else start
    first = text.count("\n", 0, begin) + 1
    return {"error": None, "level": level, "start": begin, "end": begin + len(body), "line_start": first, "line_end": first + body.count("\n")}


def cells(line: str) -> list[str]:
    """The cells of a table row: pipes inside [[links]] and escaped pipes do not divide; the latter lose the escape."""
    out, now, depth, i = [], "", 0, 0
    row = line.strip()
    while i < len(row):
        two = row[i : i + 2]
        if two == "[[":
            depth, now, i = depth + 1, now + two, i + 2
        elif two == "]]":
            depth, now, i = max(0, depth - 1), now + two, i + 2
        elif two == "\\|":
            now, i = now + ("\\|" if depth else "|"), i + 2
        elif row[i] == "|" and not depth:
            out.append(now.strip())
            now, i = "", i + 1
        else:
            now, i = now + row[i], i + 1
    out.append(now.strip())
    return out[1 if row.startswith("|") else 0 : -1 if row.endswith("|") and len(out) > 1 else None]


def _is_rule(line: str) -> bool:
    return bool(re.match(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$", line))


def split_tables(block: Block) -> list[Block]:
    """The block itself, or, if it has a large or linked table, its parent, context, header and rows as blocks."""
    lines = block.text.split("\n")
    fenced = [m is True for m in outline(lines)]
    row = lambda i: i < len(lines) and not fenced[i] and lines[i].lstrip().startswith("|")
    tables: list[tuple[int, int]] = []
    at = 0
    while at < len(lines):
        end = at + 1
        if row(at) and row(at + 1) and _is_rule(lines[at + 1]):
            end = next((i for i in range(at + 2, len(lines) + 1) if not row(i)), len(lines))
            tables.append((at, end))
        at = end
    large = False
    for h, end in tables:
        large |= end - h - 2 > MANY_ROWS or len("\n".join(lines[h:end])) > LONG_TABLE or sum(bool(URL.search(r)) for r in lines[h + 2 : end]) > LINKED_ROWS
    if not large:
        return [block]

    def part(first: int, last: int, label: str, kind: str, routing: bool, context: list[int]) -> Block:
        heading = f"{block.heading} / {label}" if label else block.heading
        return Block(heading, block.parents, block.line_start + first, block.line_start + last, "\n".join(lines[first : last + 1]), kind, routing, context)

    out = [part(0, len(lines) - 1, "", "table_parent", True, [])]
    edges = [0, *(x for t in tables for x in t), len(lines)]
    for left, right in zip(edges[::2], edges[1::2], strict=True):
        first, last = _trimmed(lines, left, right)
        if first < last:
            out.append(part(first, last - 1, "表格上下文", "table_context", False, []))
    context = list(range(1, len(out)))
    for h, end in tables:
        out.append(part(h, h + 1, "表头", "table_header", True, []))
        head = len(out) - 1
        for i in range(h + 2, end):
            link = URL.search(lines[i])
            out.append(part(i, i, link[1] if link else " · ".join(cells(lines[i])[:2]), "table_row", False, [*context, head]))
    return out


def block_id(path: str, digest: str, block: Block) -> str:
    """20 hex digits that name a block by its document's path and digest and its place."""
    name = f"{path}|{digest}|{block.line_start}" + ("" if block.kind == "section" else f"|{block.kind}")
    return hashlib.sha256(name.encode()).hexdigest()[:20]


def references(block: Block) -> list[dict]:
    """[title](url) references with their lines; in a table row the second and third cell are what is recorded."""
    out = []
    for offset, line in enumerate(block.text.split("\n")):
        row = cells(line) if line.strip().startswith("|") else []
        for title, url in URL.findall(line):
            out.append(
                {"title": title, "url": url, "recorded_support": row[1] if len(row) > 1 else "", "limits": row[2] if len(row) > 2 else "", "line": block.line_start + offset}
            )
    return out


def relations(body: str, headings: tuple[str, ...] = ("同类知识连接", "跨域连接")) -> tuple[list[dict], list[dict]]:
    """(rows, errors) of the relation tables below the given headings: five cells, one link in the first."""
    rows, errors = [], []
    for b in sections(body):
        if b.heading not in headings:
            continue
        for offset, line in enumerate(b.text.split("\n")):
            if "|" not in line or _is_rule(line):
                continue
            got, number = cells(line), b.line_start + offset
            links = LINK.findall(got[0])
            if offset == 0 or got[0] == "相关主题":
                continue
            if len(got) != 5:
                errors.append({"line": number, "code": "columns"})
            elif len(links) != 1:
                errors.append({"line": number, "code": "link"})
            else:
                target = links[0][0].split("#")[0].removesuffix(".md").rsplit("/", 1)[-1].strip()
                rows.append({"target": target, "category": got[1], "relation": got[2], "reason": got[3], "basis": got[4], "line": number, "section": b.heading})
    return rows, errors


def actions(text: str, heading: str) -> tuple[list[dict], list[str]]:
    """(rows, errors) of a state table (id, title, basis); any error leaves no rows, so a broken table is never empty."""
    found = [b for b in sections(text) if b.heading == heading]
    if len(found) != 1:
        return [], [f"{heading}: {'missing' if not found else 'duplicated'}"]
    lines = [x for x in found[0].text.split("\n") if x.strip().startswith("|")]
    if len(lines) < 2 or cells(lines[0]) != ["标识", "事项", "依据"] or not _is_rule(lines[1]):
        return [], [f"{heading}: header"]
    rows, errors, seen = [], [], set()
    for line in lines[2:]:
        got = cells(line)
        if len(got) != 3:
            errors.append(f"{heading}: columns")
        elif not any(got) or got[0] in ("—", "-", "无", "暂无"):
            continue
        elif not got[0] or not got[1] or got[0] in seen:
            errors.append(f"{heading}: id")
        else:
            seen.add(got[0])
            rows.append({"id": got[0], "title": got[1], "basis": got[2]})
    return ([] if errors else rows), errors
