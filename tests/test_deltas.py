"""Tables written by changes, the feed and the index on top of them, and writers that meet."""

import os
import random

import pytest
from pyspark.sql import functions as F

from marginalia.plans.deltas import Conflict, DeltaTable, NoteIndex
from marginalia.streaming.changes import ChangeFeed

SCHEMA = "key string, v int, s string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(table, number=None):
    return {r.key: (r.v, r.s) for r in table.read(number).collect()}


def test_a_table_by_changes_is_the_table_built_at_once(spark, tmp_path):
    r = random.Random(2)
    table, want = DeltaTable(spark, str(tmp_path / "t"), SCHEMA, "key", 8), {}
    states = []
    for step in range(6):
        put = {f"k{i}": (r.choice([None, step]), r.choice(["a", None, "é"])) for i in (range(60) if step == 0 else r.sample(range(70), 4))}
        gone = [k for k in r.sample(sorted(want), min(len(want), 2)) if k not in put] + ["never"]
        number = table.write(frame(spark, [(k, *v) for k, v in put.items()]), spark.createDataFrame([(k,) for k in gone], "key string"))
        want = {k: v for k, v in want.items() if k not in gone} | put
        assert number == step and held(table) == want
        states.append(dict(want))
    assert [held(table, n) for n in (0, 3)] == [states[0], states[3]]
    assert any(table.entry(n)["deltas"] for n in range(6)) and any(table.entry(n)["base"] for n in range(6))
    other = DeltaTable(spark, str(tmp_path / "o"), SCHEMA, "key", 8)
    other.write(frame(spark, [(k, *v) for k, v in want.items()]))
    assert other.signature() == table.signature() != table.signature(2)
    assert {x.key for x in table.of_keys(spark.createDataFrame([("k1",), ("k2",), ("zz",)], "key string")).collect()} == {"k1", "k2"} & set(want)


def test_defined_cases_of_a_table(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path), SCHEMA, "key", 4)
    assert table.read().count() == 0 and table.number() == -1
    empty = table.signature()
    assert table.write(frame(spark, [])) == 0 and table.signature() == empty
    table.write(frame(spark, [(None, 1, "x"), ("a", 1, "x")]), spark.createDataFrame([("a",), (None,)], "key string"))
    assert held(table) == {"a": (1, "x")}
    with pytest.raises(ValueError, match="more than one"):
        table.write(frame(spark, [("b", 1, "x"), ("b", 2, "x")]))
    table.write(frame(spark, []), spark.createDataFrame([("a",)], "key string"))
    assert held(table) == {} and table.signature() == empty


def test_one_of_two_writers_fails_and_a_batch_counts_once(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path), SCHEMA, "key", 4)
    table.write(frame(spark, [("a", 1, "x")]), batch=0)
    slow = DeltaTable(spark, str(tmp_path), SCHEMA, "key", 4)
    commit = slow._commit

    def late(entry, number):
        table.write(frame(spark, [("b", 2, "y")]), batch=1)
        commit(entry, number)

    slow._commit = late
    with pytest.raises(Conflict):
        slow.write(frame(spark, [("c", 3, "z")]))
    assert held(table) == {"a": (1, "x"), "b": (2, "y")}
    assert table.write(frame(spark, [("a", 9, "again")]), batch=1) == 1 and held(table)["a"] == (1, "x")


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_writes_are_as_large_as_changes(spark, tmp_path):
    table = DeltaTable(spark, str(tmp_path), SCHEMA, "key", 16)
    table.write(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("int").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("s")))
    whole = size_of(tmp_path)
    table.write(spark.range(200).select(F.concat(F.lit("k"), F.col("id") * 100).alias("key"), F.lit(-1).alias("v"), F.lit("new").alias("s")))
    assert size_of(tmp_path) - whole < 0.05 * whole and table.read().filter("v = -1").count() == 200 and table.read().count() == 20_000


def test_the_feed_keeps_reviews_until_the_hash_of_now_is_acknowledged(spark, tmp_path):
    kind = "key string, seq bigint, hash string"
    feed = ChangeFeed(spark, str(tmp_path), 4)
    batches = [[("a", 1, "h1"), ("b", 1, "h2"), (None, 1, "x")], [("a", 2, "h1"), ("b", 2, "h3"), ("c", 1, "h4")], [("b", 3, None), ("a", 1, "old")], []]
    for n, rows in enumerate(batches):
        feed(spark.createDataFrame(rows, kind), n)
        again = ChangeFeed(spark, str(tmp_path), 4)  # a driver that starts anew and runs its last batch again
        again(spark.createDataFrame(rows, kind), n)
    state = lambda n: {r.key: (r.seq, r.hash, r.status) for r in feed.state(n).collect()}
    assert state(0) == {"a": (1, "h1", "added"), "b": (1, "h2", "added")}
    assert state(1) == {"a": (2, "h1", "unchanged"), "b": (2, "h3", "modified"), "c": (1, "h4", "added")}
    assert state(2) == {"a": (2, "h1", "unchanged"), "b": (3, None, "removed"), "c": (1, "h4", "unchanged")}
    assert state(3) == {"a": (2, "h1", "unchanged"), "b": (3, None, "removed"), "c": (1, "h4", "unchanged")}
    assert {r.key: (r.hash, r.since) for r in feed.pending().collect()} == {"a": ("h1", 0), "b": (None, 2), "c": ("h4", 1)}
    acks = spark.createDataFrame([("a", "h1"), ("b", "h3"), ("c", "h4"), ("z", None)], "key string, hash string")
    assert feed.acknowledge(acks) == 2 and {r.key for r in feed.pending().collect()} == {"b"}
    assert feed.acknowledge(spark.createDataFrame([("b", None)], "key string, hash string")) == 1 and feed.pending().count() == 0
    feed(spark.createDataFrame([("c", 2, "h5")], kind), 4)
    assert [tuple(r) for r in feed.pending().collect()] == [("c", "h5", 4)]


def test_an_index_by_changes_equals_one_built_anew(spark, tmp_path):
    r = random.Random(4)
    notes = {f"n{i}.md": "".join(r.choice("abcd é") for _ in range(60)) for i in range(120)}

    def table(texts):
        return spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("doc_hash", F.sha2("text", 256))

    index = NoteIndex(spark, str(tmp_path / "a"), 16)
    assert index.update(table(notes), F.col("text")) == {"added": 120, "changed": 0, "removed": 0}
    before = size_of(tmp_path / "a")
    notes["n3.md"], notes["new.md"] = "completely different", ""
    del notes["n7.md"]
    assert index.update(table(notes), F.col("text")) == {"added": 1, "changed": 1, "removed": 1}
    assert size_of(tmp_path / "a") - before < 0.3 * before
    anew = NoteIndex(spark, str(tmp_path / "b"), 16)
    anew.update(table(notes), F.col("text"))
    assert index.table.signature() == anew.table.signature()
    assert sorted(map(tuple, index.postings().collect())) == sorted({(t[i : i + 3].lower(), p) for p, t in notes.items() for i in range(len(t) - 2)})
    for needle in ("abc", "Different", "zzz", "a", "d é"):
        assert {p for p, t in notes.items() if needle.lower() in t.lower()} <= {x.path for x in index.holding(needle).collect()}
    assert [x.path for x in index.holding("completely").collect()] == ["n3.md"]
    assert index.update(table(notes), F.col("text")) == {"added": 0, "changed": 0, "removed": 0}


def test_one_of_two_library_writers_fails(spark, tmp_path):
    from marginalia.plans import upsert as U

    lib = U.Library(spark, str(tmp_path))
    lib.create(spark.createDataFrame([("a", "x")], "path string, text string"))
    plan = U.build(lib.read(), spark.createDataFrame([("a", "k", "new")], "path string, key string, block string"))
    slow = U.Library(spark, str(tmp_path))
    write = slow._write

    def late(rows, version):
        lib.apply(plan, U.plan_id(plan))
        write(rows, version)

    slow._write = late
    with pytest.raises(ValueError, match="has changed"):
        slow.apply(plan, U.plan_id(plan))
    assert lib.version() == 1 and "new" in lib.read().first().text
