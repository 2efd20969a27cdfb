"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: All but digits, small letters and CJK characters, written as what it holds: Java takes six times as long over the negation.
TOKEN = r"[\x00-\x2F\x3A-\x60\x7B-" + "䷿ꀀ-\U0010ffff]+"


def text_key(value: Column) -> Column:
    """Lower-cased letters, digits and CJK characters only, joined."""
    return F.regexp_replace(F.lower(value), TOKEN, "")


def lexical_text(value: Column) -> Column:
    """Lower-cased runs of letters, digits and CJK characters, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(value), TOKEN, " "))


#: Bytes of texts that a Python worker turns into its own strings at once, whatever the rows of a batch.
PIECE = 1 << 20


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(start, stop) of the stretches that a batch's ``texts`` are worked on in: ``most`` bytes each, or one longer text."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n + 64
    yield start, len(texts)


def folded(value: Column) -> Column:
    """NFKC and full case folding, which no built-in has: an Arrow-batched function, for texts beyond ASCII. In ASCII that
    is lower case, so no other text goes to Python; there it is folded in ``pieces``."""

    @F.arrow_udf("string")
    def fold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start, stop in pieces(batch):
                part = batch.slice(start, stop - start).to_pylist()
                yield pa.array([None if v is None else unicodedata.normalize("NFKC", v).casefold() for v in part], pa.string())

    odd = F.octet_length(value) > F.length(value)
    return F.when(odd, fold(F.when(odd, value))).otherwise(F.lower(value))


def folded_key(value: Column) -> Column:
    """``text_key`` of folded text."""
    return F.regexp_replace(folded(value), TOKEN, "")


def folded_lexical(value: Column) -> Column:
    """``lexical_text`` of folded text."""
    return F.trim(F.regexp_replace(folded(value), TOKEN, " "))


def clock(seconds: Column) -> Column:
    """Seconds as mm:ss, or hh:mm:ss from an hour on; rounded half to even, never below zero."""
    s = F.greatest(F.lit(0), F.bround(seconds, 0)).cast("long")
    rest = F.format_string("%02d:%02d", F.floor(s / 60) % 60, s % 60)
    return F.when(s >= 3600, F.concat(F.format_string("%02d", F.floor(s / 3600)), F.lit(":"), rest)).otherwise(rest)


def byte_size(size: Column) -> Column:
    """Bytes with one decimal in the largest fitting unit of 1024."""
    out = F.format_string("%d B", size.cast("long"))
    for power, unit in enumerate(["KiB", "MiB", "GiB", "TiB"], 1):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / float(1024**power))).otherwise(out)
    return out


def safe_name(value: Column, limit: int = 80) -> Column:
    """A file name: forbidden characters become spaces, white space collapses, ``limit`` characters at most."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(value, r'[<>:"/\\|?*\x00-\x1f]', " "), r"\s+", " "))
    return F.coalesce(F.nullif(F.rtrim(F.substring(clean, 1, limit)), F.lit("")), F.lit("untitled"))


def stable_key(prefix: str, *parts: Column) -> Column:
    """``prefix`` and the first 12 hex digits, upper case, of the SHA-256 of the parts joined by NUL."""
    return F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 12)))


def clip(value: Column, limit: int) -> Column:
    """At most ``limit`` characters: up to the last sentence end beyond 65 % of them, else with an ellipsis."""
    head = F.substring(value, 1, limit)
    last = limit - F.least(*[F.when(F.instr(F.reverse(head), m) > 0, F.instr(F.reverse(head), m)).otherwise(limit + 1) for m in ("。", "；", "\n")]) + 1
    cut = F.when(last > int(limit * 0.65), F.rtrim(head.substr(F.lit(1), last))).otherwise(F.concat(F.rtrim(head), F.lit("…")))
    return F.when(F.length(value) <= limit, value).otherwise(cut)


def date_or_least(value: Column) -> Column:
    """An ISO date; anything else is the least date, so that it sorts first."""
    return F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.lit("0001-01-01").cast("date"))


def int_list(value: Column) -> Column:
    """All integers in a text, in order."""
    return F.transform(F.regexp_extract_all(value, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))


def page_ranges(value: Column) -> Column:
    """``a-b,c`` as the list of its numbers; null if a range descends or a part is no number."""
    parts = F.split(F.regexp_replace(value, r"\s+", ""), ",")
    good = F.forall(parts, lambda p: p.rlike(r"^\d+(-\d+)?$") & (F.split(p, "-")[0].cast("int") <= F.element_at(F.split(p, "-"), -1).cast("int")))
    each = F.transform(parts, lambda p: F.sequence(F.split(p, "-")[0].cast("int"), F.element_at(F.split(p, "-"), -1).cast("int")))
    return F.when(good, F.flatten(each))


def wiki_links(value: Column) -> Column:
    """Targets of [[target|alias]] links, in order."""
    return F.regexp_extract_all(value, F.lit(r"\[\[([^\]|]+)(?:\\?\|[^\]]+)?\]\]"), F.lit(1))


def link_key(target: Column) -> Column:
    """A link target without anchor and .md, slashes forward, lower case; null if it names another kind of file."""
    path = F.trim(F.replace(F.split(target, "#")[0], F.lit("\\"), F.lit("/")))
    key = F.lower(F.regexp_replace(path, r"(?i)\.md$", ""))
    return F.when(~key.rlike(r"/?[^/]+\.[a-z0-9]{1,5}$"), F.nullif(key, F.lit("")))


def exclusion_reason(path: Column) -> Column:
    """Why a path may not be used, or null: absolute, drive, parent, colon, hidden directory, denied suffix."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return (
        F.when(path.startswith("/"), "absolute")
        .when(path.rlike(r"^[A-Za-z]:"), "drive")
        .when(F.array_contains(parts, ".."), "parent")
        .when(path.contains(":"), "colon")
        .when(F.exists(parts, lambda p: p.rlike(r"^\.[A-Za-z]")), "hidden")
        .when(F.lower(path).rlike(r"\.(key|pem|pfx|env)$"), "denied_suffix")
    )


def question_of(value: Column) -> Column:
    """The first question in a callout: its title if that asks, else its first quoted line that is not empty."""
    title = F.trim(F.regexp_extract(value, r"(?m)^>\s*\[!question\][-+]?[ \t]*(.*)$", 1))
    line = F.trim(F.regexp_extract(value, r"(?m)^>\s*\[!question\].*(?:\n>[ \t]*)*\n>[ \t]*([^\s>].*)$", 1))
    asks = title.contains("?") | title.contains("？")
    return F.coalesce(F.when(asks, title), F.nullif(line, F.lit("")))
