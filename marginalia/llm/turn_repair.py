"""Repair of conversations by the cheapest edits, with ranks in place of audit strings.

The result's role initials must be ``(s?(ua)+)?``: an automaton of four states (nothing yet, after s, after u, after
a). Each row takes one *macro*: up to two inserted turns, then the row kept, given another role or deleted. Macros are
words of which none begins another, so two audit strings of equally many rows compare as their first different macros
do, and "the ASCII-least string" needs no strings: a layer (the rows so far) holds, for each state, the least cost and
the rank of its string among the layer's; a candidate is (cost, rank before, macro), its place in the order of
(rank before, macro) is the new rank, and (state before, macro) its pointer. Strings are read off the pointers at last.

Rows are dealt out by ranges of (conversation, turn) and numbered there; *blocks* are at most ``BLOCK`` rows of one
conversation. A block is solved from each state that it may begin in; a conversation is the layers of its blocks, with
a block's (start, end) in place of a macro. So a conversation of any length is solved by many tasks; only its digest,
which is one hash over all that is kept, is made by one, as a stream in bounded memory.

Defined cases: nulls in any column stand for one space, but a null turn has no part in the gaps and comes first; a
role counts by its initial, one of no known initial can only be replaced or deleted; rows of one turn are ordered by
role, the first 32 characters and the digest of their text; equal rows are repeats of the first; a conversation all of
whose rows are gone has zeros, an empty audit and the digest of nothing; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import read
from marginalia.plans.skew import attach
from marginalia.plans.storage import materialize

#: Rows of a block.
BLOCK = 1024
WHITE = " \t\n\x0b\x0c\r"
#: Faults of rows.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States: nothing yet, after system, after user, after assistant. Where each letter leads from each; None: nowhere.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Up to two inserted turns before what becomes of a row, in ASCII order. More return to a state had before.
MACROS = sorted("I" * k + op for k in range(3) for op in "DKR")
#: What a state needs at the end: letters, cost.
TAILS = {NOTHING: ("", 0), SYSTEM: ("II", 4), USER: ("I", 2), ASSISTANT: ("", 0)}
COSTS = {"I": 2, "D": 3, "K": 0, "R": 2}
#: A layer: for each state None or (cost above the layer's least, rank).
Layer = tuple[tuple[int, int] | None, ...]


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by crc32(conv_id:turn) % 20: dropped, emptied, without full stops, repeated, or user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("kind"))
    rows = rows.filter("kind != 0").withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def same() -> Column:
    """A digest of (conversation, role, text)."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    parts = [F.col("conv_id").isNull().cast("string"), F.char_length(conv), F.char_length("role")]
    return F.sha2(F.concat_ws(",", *parts, F.concat(conv, "role", "text")), 256)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with block, pos (place in the block), initial and fault; settled once the result is written."""
    rows = rows.withColumn("same", same())
    first = rows.groupBy("same").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max(F.col("turn").isNull()).alias("untimed")).filter("n > 1")
    rows = attach(rows, materialize(first, "repeats"), "same", ["low", "untimed"], "n", F.struct("conv_id", "turn"))
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    earlier = F.coalesce(F.col("turn").isNotNull() & (F.col("untimed") | (F.col("low") < F.col("turn"))), F.lit(False))
    fault = F.when(last == "", BLANK).when(earlier, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.left("text", F.lit(32)), F.col("same")]
    rows = rows.select("conv_id", "turn", "role", "text", "same", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pos, before = TaskContext.get().partitionId() << 40, -1, None
        for batch in batches:
            blocks, places, faults = [], [], []
            for conv, turn, digest, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "same", "fault")), strict=True):
                pos += 1
                if before is None or before[0] != conv or pos == BLOCK:
                    block, pos = block + 1, 0
                faults.append(DUPLICATE if fault != BLANK and before == (conv, turn, digest) else fault)
                blocks.append(block)
                places.append(pos)
                before = (conv, turn, digest)
            columns = [batch.column(c) for c in ("conv_id", "turn", "role", "text", "initial")]
            columns += [pa.array(faults, pa.int32()), pa.array(blocks, pa.int64()), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "initial", "fault", "block", "pos"])

    kinds = dict(rows.dtypes)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, initial string, fault int, block bigint, pos int"
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def after(state: int, letter: str, initial: str) -> int | None:
    """The state that an edit leads to: what is inserted or given a role is a user's turn but after a user's."""
    if letter == "D":
        return state
    if letter == "K":
        return {"s": SYSTEM if state == NOTHING else None, "u": USER if state != USER else None, "a": ASSISTANT if state == USER else None}.get(initial)
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=None)
def moves(initial: str, fault: int) -> tuple[tuple[int, int, int, int], ...]:
    """(state, macro, state after, cost) of all that may become of a row."""
    out = []
    for state in STATES:
        for number, macro in enumerate(MACROS):
            now, cost = state, 0
            for letter in macro:
                now = None if now is None else after(now, letter, initial)
                cost += COSTS[letter] + (letter in "KR" and fault == TRUNCATED)
            if now is not None and (macro[-1] == "D" or fault not in (BLANK, DUPLICATE)):
                out.append((state, number, now, cost))
    return tuple(out)


def ranked(best: dict[int, tuple[int, int, int, int]]) -> tuple[int, Layer, tuple]:
    """Of the least (cost, rank before, step, state before) of each state: what all cost, the layer, the pointers."""
    least = min(b[0] for b in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    layer = tuple((best[s][0] - least, order.index(s)) if s in best else None for s in STATES)
    return least, layer, tuple((best[s][3], best[s][2]) if s in best else None for s in STATES)


@lru_cache(maxsize=65536)
def advance(layer: Layer, initial: str, fault: int) -> tuple[int, Layer, tuple]:
    """The next layer, what it costs at least, and for each of its states (state before, macro)."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for state, macro, now, cost in moves(initial if initial in ("s", "u", "a") else "", fault):
        if layer[state] is not None:
            found = (layer[state][0] + cost, layer[state][1], macro, state)
            if now not in best or found < best[now]:
                best[now] = found
    return ranked(best)


def start_at(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in STATES)


def solve(rows: list[tuple[str, int]]) -> list[tuple[int, int, int, int, str]]:
    """(start, end, cost, rank, codes) of a block of (initial, fault): the least from each state to each, its rank among
    those of that start, and a digit for each row's macro."""
    out = []
    for start in STATES:
        layer, cost, pointers = start_at(start), 0, []
        for initial, fault in rows:
            more, layer, back = advance(layer, initial, fault)
            cost += more
            pointers.append(back)
        for end in STATES:
            if layer[end] is not None:
                state, codes = end, []
                for back in reversed(pointers):
                    state, macro = back[state]
                    codes.append(str(macro))
                out.append((start, end, cost + layer[end][0], layer[end][1], "".join(reversed(codes))))
    return out


def join_blocks(blocks: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """The cost of a conversation, (start, end) of each of its blocks of (start, end, cost, rank), and the last inserts."""
    layer, total, pointers = start_at(NOTHING), 0, []
    for paths in blocks:
        best: dict[int, tuple[int, int, int, int]] = {}
        for start, end, cost, rank in paths:
            if layer[start] is not None:
                found = (layer[start][0] + cost, layer[start][1], rank, start)
                if end not in best or found < best[end]:
                    best[end] = found
        more, layer, back = ranked(best)
        total += more
        pointers.append(back)
    cost, _, state = min((layer[s][0] + TAILS[s][1], layer[s][1], s) for s in STATES if layer[s] is not None)
    tail, chosen = TAILS[state][0], []
    for back in reversed(pointers):
        chosen.append((back[state][0], state))
        state = back[state][0]
    return total + cost, chosen[::-1], tail


def solved(rows: DataFrame) -> DataFrame:
    """A row for each block: paths (start, end, cost, rank, codes), its first and last initials, illegal pairs inside."""
    path = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("codes", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, held = None, None, []

        def made() -> pa.RecordBatch:
            paths = [dict(zip(("start", "end", "cost", "rank", "codes"), p, strict=True)) for p in solve(held)]
            initials = [i for i, _ in held]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            columns = [pa.array([conv], kind), *(pa.array([v]) for v in (now, initials[0], initials[-1], illegal)), pa.array([paths], pa.list_(path))]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "head", "last", "illegal", "paths"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for c, block, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "initial", "fault")), strict=True):
                if block != now and held:
                    yield made()
                    held = []
                now, conv = block, c
                held.append((initial, fault))
        if held:
            yield made()

    kind = dict(rows.dtypes)["conv_id"]
    slim = rows.select("conv_id", "block", "pos", "initial", "fault").repartition("block").sortWithinPartitions("block", "pos").drop("pos")
    return slim.mapInArrow(run, f"conv_id {kind}, block bigint, head string, last string, illegal bigint, paths array<struct<start int, end int, cost bigint, rank int, codes string>>")


def chosen(blocks: DataFrame) -> DataFrame:
    """For each block its start, end and last inserts in the cheapest repair; cost and illegal pairs of the whole
    conversation stand at its first block, zeros at the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def made() -> pa.RecordBatch:
            cost, ways, tail = join_blocks([b[1] for b in held])
            illegal = sum(b[4] for b in held) + sum(a[3] + b[2] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
            rest = [0] * (len(held) - 1)
            columns = [[b[0] for b in held], [w[0] for w in ways], [w[1] for w in ways], ["" for _ in rest] + [tail], [cost, *rest], [illegal, *rest]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["block", "start", "end", "tail", "cost", "illegal"])

        for batch in batches:
            paths = ([(p["start"], p["end"], p["cost"], p["rank"]) for p in row] for row in batch.column("paths").to_pylist())
            for conv, block, head, last, illegal, ways in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "head", "last", "illegal")), paths, strict=True):
                if held and conv != now:
                    yield made()
                    held = []
                now = conv
                held.append((block, ways, head, last, illegal))
        if held:
            yield made()

    slim = blocks.withColumn("paths", F.transform("paths", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["cost"].alias("cost"), p["rank"].alias("rank"))))
    slim = slim.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return slim.mapInArrow(run, "block bigint, start int, end int, tail string, cost bigint, illegal bigint")


def written(rows: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256) from rows with ``code`` and ``tail``: each conversation as a stream in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, audit, digest = None, None, [], None

        def put(role: str, text: str) -> None:
            digest.update(("" if lines[0] == 0 else "\n").encode() + f"{role}:{text}".encode())
            lines[0] += 1

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

        lines = [0]
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, text, code, tail in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "code", "tail")), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        yield made()
                    now, state, audit, digest, lines = conv, NOTHING, [], hashlib.sha256(), [0]
                macro = MACROS[int(code)] + tail
                audit.append(macro)
                for letter in macro:
                    state = after(state, letter, role[:1])
                    if letter == "K":
                        put(role, text)
                    elif letter != "D":
                        put("user" if state == USER else "assistant", text if letter == "R" else "")
        if digest is not None:
            yield made()

    kind = dict(rows.dtypes)["conv_id"]
    rows = rows.select("conv_id", "block", "pos", "role", "text", "code", "tail").repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")
    return rows.mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of ``conversations`` with what ``rows`` (conv_id, turn, role, text; no null texts or
    roles) hold of it: gaps, faults, illegal pairs, and the cheapest repair."""
    rows = materialize(numbered(rows), "numbered")
    blocks = materialize(solved(rows), "blocks")
    ways = materialize(chosen(blocks), "ways")
    paths = blocks.select("conv_id", "block", F.explode("paths").alias("p")).join(ways, "block").filter("p.start = start and p.end = end")
    paths = paths.select("block", F.col("p.codes").alias("codes"), "tail")
    # a block's codes are as many as its rows, so that each row carries at most BLOCK characters through the join
    coded = rows.join(paths, "block").withColumn("code", F.substring("codes", F.col("pos") + 1, F.lit(1)))
    coded = coded.withColumn("tail", F.when(F.col("pos") == F.char_length("codes") - 1, F.col("tail")).otherwise("")).drop("codes")

    turns = rows.groupBy("conv_id", "turn").agg(*[F.count_if(F.col("fault") == k).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    stats = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    costs = blocks.select("conv_id", "block").join(ways, "block").groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    out = conversations.select("conv_id").distinct()
    for part in (stats, costs, written(coded)):
        part = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every conversation after damage, and its cheapest repair."""
    rows = read(spark, sf_dir, "conversations")
    return repaired(damaged(rows), rows)


#: States 0 nothing yet, 1 after s, 2 after u, 3 after a; audits are plain strings here, and rows are taken one by one.
ORACLE_SQL = r"""
with recursive crc as (
  select list(v order by i) as t from (
    select i, list_reduce([i] || range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as v from range(256) r(i)
  )
), keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
  from conversations
), kinds as (
  select conv_id, turn, role, text,
    xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda c: cast(ascii(c) as bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as kind
  from keyed, crc
), after_damage as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from kinds, range(2) c(copy) where kind <> 0 and (copy = 0 or kind = 3)
), placed as (
  select *, dense_rank() over (order by conv_id nulls first) as g, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from after_damage
), judged as (
  select *, left(role, 1) as initial, case
    when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
    when row_number() over (partition by g, role, text order by pos) > 1 then 'duplicate'
    when regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) not in ('.', '!', '?') then 'truncated' end as fault
  from placed
), inserts(state, letters, cost, lines, then_state) as (
  values (0, '', 0, []::varchar[], 0), (1, '', 0, [], 1), (2, '', 0, [], 2), (3, '', 0, [], 3),
    (0, 'I', 2, ['user:'], 2), (1, 'I', 2, ['user:'], 2), (2, 'I', 2, ['assistant:'], 3), (3, 'I', 2, ['user:'], 2),
    (0, 'II', 4, ['user:', 'assistant:'], 3), (1, 'II', 4, ['user:', 'assistant:'], 3), (2, 'II', 4, ['assistant:', 'user:'], 2), (3, 'II', 4, ['user:', 'assistant:'], 3)
), edits(state, letter, cost, initial, then_state) as (
  values (0, 'D', 3, null, 0), (1, 'D', 3, null, 1), (2, 'D', 3, null, 2), (3, 'D', 3, null, 3),
    (0, 'K', 0, 's', 1), (0, 'K', 0, 'u', 2), (1, 'K', 0, 'u', 2), (3, 'K', 0, 'u', 2), (2, 'K', 0, 'a', 3),
    (0, 'R', 2, null, 2), (1, 'R', 2, null, 2), (3, 'R', 2, null, 2), (2, 'R', 2, null, 3)
), walk as (
  select distinct g, cast(0 as bigint) as pos, 0 as state, 0 as cost, '' as audit, []::varchar[] as lines from placed
  union all
  select g, pos, state, cost, audit, lines from (
    select w.g, j.pos, e.then_state as state, w.cost + i.cost + e.cost + case when e.letter <> 'D' and j.fault is not null then 1 else 0 end as cost, w.audit || i.letters || e.letter as audit,
      w.lines || i.lines || case when e.letter = 'D' then [] when e.letter = 'K' then [j.role || ':' || j.text] else [case when e.then_state = 2 then 'user:' else 'assistant:' end || j.text] end as lines,
      row_number() over (partition by w.g, e.then_state order by w.cost + i.cost + e.cost + case when e.letter <> 'D' and j.fault is not null then 1 else 0 end, w.audit || i.letters || e.letter) as place
    from walk w join judged j on j.g = w.g and j.pos = w.pos + 1 join inserts i on i.state = w.state
      join edits e on e.state = i.then_state and (e.initial is null or e.initial = j.initial) and (e.letter = 'D' or coalesce(j.fault, 'truncated') = 'truncated')
  ) where place = 1
), tails(state, letters, cost, lines) as (
  values (0, '', 0, []::varchar[]), (1, 'II', 4, ['user:', 'assistant:']), (2, 'I', 2, ['assistant:']), (3, '', 0, [])
), sizes as (select g, max(pos) as n from placed group by g
), ends as (
  select w.g, w.cost + t.cost as cost, w.audit || t.letters as audit, w.lines || t.lines as lines, row_number() over (partition by w.g order by w.cost + t.cost, w.audit || t.letters) as place
  from walk w join sizes s on s.g = w.g and s.n = w.pos join tails t on t.state = w.state
), pairs as (
  select g, initial, lag(initial) over (partition by g order by pos) as before from judged
), illegal as (select g, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from pairs group by g
), stats as (
  select any_value(conv_id) as conv_id, g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated
  from judged group by g
), found as (
  select s.conv_id, s.gaps, s.blank, s.duplicate, s.truncated, i.illegal, e.cost, e.audit, sha256(array_to_string(e.lines, chr(10))) as repaired_sha256
  from stats s join illegal i using (g) join ends e on e.g = s.g and e.place = 1
)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate,
  cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(cost, 0) as bigint) as cost, coalesce(audit, '') as audit,
  coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join found f on c.conv_id is not distinct from f.conv_id
"""
