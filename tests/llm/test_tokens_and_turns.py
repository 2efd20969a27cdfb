"""Alignment, packing and repair against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marginalia.llm import histogram_packing, segments, token_alignment, turn_repair

SCHEMA = "doc_id bigint, text string"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD_WHITE = ["\t", "\r\n", " ", "　", "\x1c", "\x85", " ", "᠎", "​", "\x0b", " \n ", "\n\n\n", "  ", "   \t"]


def texts():
    r = random.Random(11)
    words = ["the", "Größe", "l'été", "don't", "x" * 700, "中文字", "𝒳", "12,345", "...", "<|endoftext|>", "a<|endoftext|>b", "</s>", "<s>", "<0x41>", "é", "\x00", "!\x1c", "'s", "’s", "�"]
    out = [None, "", " ", "\n", "a", "a ", " a", "\na", "a\n", "▁", "has ▁ inside", "<|endoftext|>", "the the the the"]
    out += [white + "w" + white + white + "v" + white for white in ODD_WHITE]
    for _ in range(150):
        out.append("".join(r.choice(words) + r.choice([" ", " ", " ", "\n", *ODD_WHITE]) for _ in range(r.randint(1, 60))))
    return [*out, " ".join(r.choice(words) for _ in range(6000)), "z" * 30_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[20], rows[20], (None, "the cat"), (20, "another")], SCHEMA).repartition(3).cache()


def plain_encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def test_segments_put_together_are_the_text_and_tokenise_alone():
    a, b = plain_encoders()
    a.encode_special_tokens = True
    mine_a, mine_b = segments.ByteEncoder(A, plain=True), segments.PieceEncoder(B)
    for t in texts():
        if not t or "▁" in t:
            continue
        cut = [segments.text_of(k) for k in segments.keys(t)]
        assert "".join(cut) == " " + t
        assert sum(mine_a(cut), []) == a.encode(" " + t, add_special_tokens=False).ids
        assert sum(mine_b(cut), []) == b.encode(t)


def test_no_character_joins_what_a_cut_separates():
    a, b = plain_encoders()
    points = [c for c in range(1, 0x3100) if c != 0x2581]
    for white in (" z", "\nz", "  z", "\n "):
        whole = [chr(c) + white for c in points]
        halves = a.encode_batch_fast([white] * len(points), add_special_tokens=False)
        for c, w, h in zip(points, a.encode_batch_fast(whole, add_special_tokens=False), halves, strict=True):
            if not chr(c).isspace():
                assert w.ids == a.encode(chr(c), add_special_tokens=False).ids + h.ids, hex(c)
        mark = len(b.encode("\n"))
        for c, w in zip(points, b.encode(whole), strict=True):
            if not chr(c).isspace():
                assert w == b.encode(chr(c)) + b.encode("\n" + white)[mark:], hex(c)


def plain_alignment(rows):
    a, b = plain_encoders()
    a.encode_special_tokens = True
    a_bytes, b_bytes = segments.byte_tokens(A), segments.piece_tokens(B)
    out, pairs = [], Counter()
    for i, t in rows:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if not t or not b"".join(a_bytes[x] for x in ids_a) == b"".join(b_bytes[x] for x in ids_b) == (" " + t).encode():
            out.append((i, 0, 0, 0, [], ""))
            continue
        ends_a = np.cumsum([len(a_bytes[x]) for x in ids_a]).tolist()
        ends_b = np.cumsum([len(b_bytes[x]) for x in ids_b]).tolist()
        groups, from_a, from_b, links = [], 0, 0, []
        for e in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(e, from_a) + 1, ends_b.index(e, from_b) + 1
            groups.append(",".join(map(str, ids_a[from_a:to_a])) + "|" + ",".join(map(str, ids_b[from_b:to_b])))
            links.append((ids_a[to_a - 1], ids_b[to_b - 1]))
            from_a, from_b = to_a, to_b
        pairs.update(links)
        out.append((i, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return [(i, x, y, g, len(k), sum(pairs[p] == most[p[1]] for p in k), sum(pairs[p] for p in k), h) for i, x, y, g, k, h in out]


@pytest.mark.parametrize("most", [200, 32_000_000])
def test_alignment_equals_whole_texts(docs, most):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = [tuple(r) for r in token_alignment.alignments(docs.withColumn("segment", F.lit(1)), A, B, most).select(columns).collect()]
    assert sorted(got, key=str) == sorted(plain_alignment([tuple(r) for r in docs.collect()]), key=str)


def test_alignment_of_nothing_and_of_texts_without_tokens(spark):
    assert token_alignment.alignments(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    rows = token_alignment.alignments(spark.createDataFrame([("k", None), ("l", "▁")], "doc_id string, text string"), A, B).collect()
    assert sorted(tuple(r) for r in rows) == [("k", 0, 0, 0, 0, 0, 0, ""), ("l", 0, 0, 0, 0, 0, 0, "")]


def test_a_vocabulary_that_merges_across_cuts_is_refused(tmp_path):
    import json

    spec = json.load(open(A, encoding="utf-8"))
    spec["model"]["vocab"]["eĠa"] = 60_000
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="across"):
        segments.byte_tokens(str(tmp_path / "v.json"))


# --- packing ---------------------------------------------------------------------------------------------------------


def check_packing(rows, docs, capacity):
    a, _ = plain_encoders()
    want = Counter()
    for i, t in docs:
        ids = np.array([*a.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % capacity or capacity
        if len(ids) <= capacity:
            first = len(ids)
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[(i, k, s, e - s, zlib.crc32(ids[s:e].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing_places_every_piece_once(docs, capacity):
    rows = histogram_packing.packed(docs.withColumn("length", F.lit(1)), A, capacity).collect()
    n = check_packing(rows, [tuple(r) for r in docs.collect()], capacity)
    assert n <= -(-sum(r.length for r in rows) // capacity) * 1.02 + 2


def best_fit(lengths, capacity):
    """Item by item, the tightest gap first."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - n)
    return gaps


def test_plan_is_best_fit_over_counts():
    r = random.Random(4)
    for _ in range(300):
        capacity = r.choice([10, 37, 100])
        counts = {r.randint(1, capacity): r.randint(1, 40) for _ in range(r.randint(1, 12))}
        slots, n = histogram_packing.plan(counts, capacity)
        gaps = best_fit([k for k, v in counts.items() for _ in range(v)], capacity)
        assert n == len(gaps)
        filled = Counter()
        for s in slots:
            for k in range(s.last - s.first):
                filled[s.sequence + k // s.each] += s.length
        assert sorted(capacity - v for v in filled.values()) == sorted(gaps)
        for length, total in counts.items():
            own = sorted((s.first, s.last) for s in slots if s.length == length)
            assert own[0][0] == 0 and own[-1][1] == total and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))


def test_a_plan_is_as_small_for_many_as_for_few():
    r = random.Random(6)
    shares = [r.random() ** 3 for _ in range(2048)]
    small, large = ({k + 1: int(s * n) + 1 for k, s in enumerate(shares)} for n in (1000, 1_000_000_000))
    assert len(histogram_packing.plan(large, 2048)[0]) < 3 * len(histogram_packing.plan(small, 2048)[0]) < 200_000


def test_ranks_give_the_ids_of_the_library():
    a, _ = plain_encoders()
    mine = segments.RankEncoder(A, *segments.byte_ranks(A))
    for t in [*texts(), " " * 3_000_000 + "x", "\n " * 100_000]:
        assert mine(t or "") == a.encode(t or "", add_special_tokens=False).ids
    points = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    cases = [f"a{c}1{c} {c}!{c} b  {c} \n{c}{c}  c" for c in points]
    assert [mine(t) for t in cases] == [e.ids for e in a.encode_batch_fast(cases, add_special_tokens=False)]
    assert mine.slow is not None  # a run of white space that the fast one can't take


def test_packing_of_nothing(spark):
    assert histogram_packing.packed(spark.createDataFrame([], SCHEMA), A).count() == 0


# --- repair ----------------------------------------------------------------------------------------------------------


def plain_repair(rows):
    """(cost, audit, lines) by all strings of edits, cheapest first: rows are (role, text, fault)."""
    import heapq

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, lines = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, lines
        state = (at, initials[-1:], bool(initials))
        if (state, "done") in done:
            continue
        done.add((state, "done"))
        options = [("I", 2, 0, x, f"{n}:") for x, n in (("u", "user"), ("a", "assistant"))]
        if at < len(rows):
            role, text, fault = rows[at]
            options.append(("D", 3, 1, "", None))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                options.append(("K", more, 1, role[:1] or "?", f"{role}:{text}"))
                options += [("R", 2 + more, 1, x, f"{n}:{text}") for x, n in (("u", "user"), ("a", "assistant"))]
        for letter, price, step, initial, line in options:
            if initial and not ((not initials and initial in "su") or (initials and initials[-1] + initial in ("su", "ua", "au"))):
                continue
            heapq.heappush(heap, (cost + price, audit + letter, at + step, initials + initial, lines + ((line,) if line is not None else ())))
    raise AssertionError


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def plain_row(rows):
    """The result's columns for (turn, role, text) rows in order."""
    judged = plain_faults([(r, t) for _, r, t in rows])
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = plain_repair(judged)
    count = Counter(f for _, _, f in judged)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def conversations(n, longest, seed):
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            turn = None if r.random() < 0.02 else t + r.choice([0, 0, 0, 1])
            out.append((c, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), r.choice(["Yes.", "no", " \n", "", "What? ", f"Row {t}.", "end!\x0b"])))
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize(("block", "longest"), [(1024, 7), (2, 7), (3, 40)])
def test_repair_equals_a_search_over_all_edits(spark, monkeypatch, block, longest):
    """Also with blocks of few rows, so that conversations are put together from many."""
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rows = conversations(150 if longest < 10 else 25, longest, block)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    want = defaultdict(list)
    for c, turn, role, text in rows:
        same = hashlib.sha256(f"false,{len(str(c))},{len(role)},{c}{role}{text}".encode()).hexdigest()
        want[c].append(((turn is not None, turn or 0, role, text[:32], same), (turn, role, text)))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turn_repair.repaired(frame, frame).collect()}
    assert got == {c: plain_row([x for _, x in sorted(v)]) for c, v in want.items()}


def test_macros_compare_as_strings_do():
    m = turn_repair.MACROS
    assert m == sorted(m) and not any(a != b and b.startswith(a) for a in m for b in m)


def test_damage_is_that_of_the_contract(spark):
    rows = [(c, t, r, "One. Two! Three?") for c in (*range(60), None) for t, r in ((1, "assistant"), (None, None))] + [(7, 9, "user", None)]
    want = Counter()
    for c, t, r, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, r = text or " ", r or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            want[(c, t, "user" if kind == 4 else r, text)] += 2 if kind == 3 else 1
    got = turn_repair.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_repair_equals_its_sql_on_odd_rows(spark, tmp_path):
    rows = [(c, t, r, x) for c, t, r, x in conversations(200, 9, 8)] + [(None, 1, "user", "a"), (None, None, None, None), (900, 5, None, "x."), (901, None, "system", "Only.")]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())  # SQL leaves ties of a turn open
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in turn_repair.query(spark, str(tmp_path)).collect()}
    want = {r[0]: r[1:] for r in con.sql(f"select conv_id, {', '.join(COLUMNS)} from ({turn_repair.ORACLE_SQL.strip()})").fetchall()}
    assert got == want and len(want) == 203


def test_a_conversation_without_rows_is_empty(spark):
    frame = spark.createDataFrame([(1, 1, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    gone = turn_repair.repaired(frame.filter("false"), frame).first()
    assert tuple(gone[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
