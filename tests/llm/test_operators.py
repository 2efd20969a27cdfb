"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import (
    bloom_sketch, ftrl_toxicity, html_blocks, license_digest, line_dedup, pareto_mix, positional_index, rule_ensemble, shingle_pairs, simhash_variants,
    token_counts,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns with names that operators use inside.
CLASH = "fp string, key string, n int, score double, row int, k1 int, size int, copies int, _size int, h int, tid int, items int, word string"
random.seed(5)
VOCABULARY = ["".join(random.choice("abcdeéö") for _ in range(random.randint(1, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def rows():
    line = [prose(60, s) for s in range(8)]
    texts = [
        None, "", " \n\t ", "one", "One  two\nthree", line[0], line[0], "\n\n" + line[0] + "\n\n" + line[1] + "\n" + line[2], line[1] + "\n \n" + line[2] + "\nnew end",
        "\n".join(f"w{i % 7}" for i in range(160)), "\n".join(f"w{i % 7}" for i in range(200)), prose(5000, 9), "x" * 20000, line[3] + "\nMIT License", "Released under the MIT licence!",
        line[4][:100] + " idiot moron " + line[4][100:], "é" * 50 + " 中文 𝒳", "a b", "a b",
    ]
    out = [(i, t, "en", ["s1", "s2", None][i % 3], len(t) if t else None) for i, t in enumerate(texts)]
    return [*out, out[7], (None, line[5], "en", "s1", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def clashing(docs):
    out = docs
    for c in CLASH.split(", "):
        name, kind = c.split()
        out = out.withColumn(name, F.lit(None).cast(kind))
    return out


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def save(df, path):
    df.write.parquet(str(path))


# --- 1 ---------------------------------------------------------------------------------------------------------------


def pieces(text):
    return set(re.findall(r"(?:[^\s]+[^\S\n]*){1,32}", text, re.A))


def test_a_sketch_that_is_never_peeled_counts_as_different(spark, monkeypatch):
    monkeypatch.setattr(bloom_sketch, "ATTEMPTS", 1)
    monkeypatch.setattr(bloom_sketch, "CELLS", 2)
    rows = [(list(range(0, n)), list(range(k, n + k))) for n, k in ((300, 250), (40, 3), (0, 0), (5, 0))]
    got = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select("a", "b", bloom_sketch.recovered(F.col("a"), F.col("b")).alias("r")).collect()
    true = [len(set(x.a) ^ set(x.b)) for x in got]
    assert all(t <= x.r.d <= len(x.a) + len(x.b) for t, x in zip(true, got, strict=True)) and got[0].r.d > true[0]


def test_sketch_compares_every_pair(spark, docs, tmp_path):
    clean = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    save(clean, tmp_path / "documents.parquet")
    got = {r.doc_id: r for r in bloom_sketch.query(spark, str(tmp_path)).collect()}
    texts = {r[0]: r[1] or "" for r in rows() if r[0] is not None}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        t, nxt = texts[a], texts[ids[(i + 1) % len(ids)]]
        k = len(t) // 2
        edited = t[: len(t) - k] + nxt[:k]
        assert got[a].n_chars == len(t) and got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((got[a].near_edited, edited), (got[a].near_next, nxt)):
            x, y = pieces(t), pieces(other)
            assert near == pytest.approx(1.0 if not x | y else len(x & y) / len(x | y))
    assert got[5].fingerprint == got[6].fingerprint and got[0].fingerprint == got[1].fingerprint


def test_sketch_takes_nulls_repeats_and_empty_tables(spark, clashing, empty, tmp_path):
    save(clashing, tmp_path / "a/documents.parquet")
    save(empty, tmp_path / "b/documents.parquet")
    assert bloom_sketch.query(spark, str(tmp_path / "a")).count() == len(rows())
    assert bloom_sketch.query(spark, str(tmp_path / "b")).count() == 0


def test_growing_sketches_recover_every_difference(spark):
    r = random.Random(4)
    data = []
    for n in (0, 1, 5, 20, 40, 300, 1500):
        common = [r.getrandbits(63) for _ in range(30 + n)]
        data.append((common + [r.getrandbits(63) for _ in range(n)], common + [-r.getrandbits(63) for _ in range(n // 2)], n + n // 2))
    # Digests that fall into the same cells of the returned sketch, and into one part, still come apart.
    data.append(([i << 60 for i in range(1, 8)], [i << 48 for i in range(1, 40)], 46))
    df = spark.createDataFrame(data, "a array<bigint>, b array<bigint>, d int")
    got = df.select(bloom_sketch.recovered(F.col("a"), F.col("b")).alias("got"), "d").collect()
    assert [x.got.d for x in got] == [x.d for x in got] and all(1 <= x.got.attempt <= 4 for x in got)
    dealt = df.select(bloom_sketch.dealt(F.col("a"), F.col("b"), F.lit(128).cast("long")).alias("p"), "a", "b").collect()
    for x in dealt:
        assert len(x.p) == 128 and sorted(d for q in x.p for d in q.a) == sorted(x.a) and sorted(d for q in x.p for d in q.b) == sorted(x.b)


def test_sketch_of_long_texts_and_a_hot_id(spark, tmp_path):
    """Texts of 20,000 words are compared through sketches; rows of one id (or none) that fill many ranges stay in order."""
    long = [prose(20_000, 31 + i) for i in range(2)]
    edited = long[0].split(" ")
    texts = [long[0], " ".join([*edited[:9_000], "new", *edited[9_001:]]), long[1]]
    data = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(7, f"copy {i % 40} of a hot id", "en", "s", 0) for i in range(400)] + [(None, f"none {i}", "en", "s", 0) for i in range(200)]
    save(spark.createDataFrame(data, SCHEMA), tmp_path / "documents.parquet")
    rows = bloom_sketch.query(spark, str(tmp_path)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(data)
    for i in (0, 1):
        x, y = pieces(texts[i]), pieces(texts[i + 1])
        assert got[i].near_next == pytest.approx(len(x & y) / len(x | y)) and (got[i].next_attempt >= 1) == (i == 1)
    # Each row has one follower: all rows in a ring, those of one id together.
    ring = bloom_sketch.with_next(spark.read.parquet(str(tmp_path / "documents.parquet")), 32).collect()
    assert sorted(r.text for r in ring) == sorted(r.next_text for r in ring) == sorted(t for _, t, *_ in data)
    assert sum(r.doc_id is None and not r.next_text.startswith("none") for r in ring) == 1
    assert sum(r.doc_id == 7 and not r.next_text.startswith("copy") for r in ring) == 1


# --- 2 ---------------------------------------------------------------------------------------------------------------


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(texts, items):
    out = []
    for t in texts:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(13, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    ids.add(str(item))
        out.append((len(w), len(hit), sorted(ids)))
    return out


def test_index_finds_every_window(spark, docs, clashing, empty):
    passage = prose(40, 77)
    extra = [(100 + i, prose(30, i) + " " + passage[i * 3 :] + ". " + prose(20, i + 50), "en", "s1", 0) for i in range(6)]
    extra += [(200, "A B a b a b A", "en", "s", 0), (201, passage.upper(), "en", "s", 0)]
    items = [(1, passage), (2, passage[20:]), (3, "a b"), (4, None), (5, ""), (6, "zz yy xx"), (7, prose(13, 3)), (7, "one")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = sorted((r.n_words, r.n_hit, list(r.item_ids)) for r in positional_index.decontaminate(both, table).collect())
    assert got == sorted(brute_hits([r[1] for r in rows()] + [r[1] for r in extra], items))
    assert positional_index.decontaminate(empty, table).count() == 0
    assert positional_index.decontaminate(clashing, table.limit(0)).filter("n_hit > 0").count() == 0
    kept = positional_index.keep_uncontaminated(clashing, table)
    assert kept.columns == clashing.columns and 0 < kept.count() < len(rows())


def test_index_finds_terms_nearby(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "a x x x x b c"), (3, "c b a")], "doc_id bigint, text string")
    terms = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "word string, tid bigint")
    index = positional_index.build_index(docs, terms)
    near = positional_index.proximity_matches(index, [0, 1, 2], 5).join(index.filter("tid = -1"), "row")
    assert sorted((r.doc_id, r.start) for r in near.collect()) == [(1, 1), (3, 1)]


# --- 3, 4 ------------------------------------------------------------------------------------------------------------


def labelled(spark, n=400):
    data, marks = [], []
    for i in range(n):
        text, bad, toxic = prose(80, i), i % 4 == 0, i % 5 == 1
        if bad:
            text = " | ".join(text.split())
        if toxic:
            text += " you idiot scum"
        data.append((i, text, "en", "s", len(text)))
        marks.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(data, SCHEMA), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_toxicity_learns_and_holds_out(spark, clashing, empty):
    docs, labels = labelled(spark)
    model = ftrl_toxicity.train(docs, labels, ftrl_toxicity.Ftrl(l1=1.0))
    got = {r.doc_id: r.score for r in ftrl_toxicity.score(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 5 == 1) for i in held]) > 0.97
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = ftrl_toxicity.train(docs, flipped, ftrl_toxicity.Ftrl(l1=1.0))
    assert np.array_equal(model.at, again.at) and np.array_equal(model.weight, again.weight)
    scores = [r.score for r in ftrl_toxicity.score(clashing, model).collect()]
    assert len(scores) == len(rows()) and all(0 <= s <= 1 for s in scores)
    assert ftrl_toxicity.score(empty, model).count() == 0
    kept = ftrl_toxicity.keep_clean(clashing, model)
    assert kept.columns == clashing.columns and kept.count() == sum(s < 0.5 for s in scores)
    nothing = ftrl_toxicity.train(docs, labels.limit(0))
    assert {r.score for r in ftrl_toxicity.score(docs, nothing).collect()} == {0.5}


def test_quality_rules_compile_to_columns(spark, clashing, empty):
    docs, labels = labelled(spark)
    stats = rule_ensemble.with_statistics(docs).cache()
    model = rule_ensemble.train(stats, labels)
    got = {r.doc_id: r.score for r in stats.select("doc_id", rule_ensemble.compiled(model).alias("score")).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 4 != 0) for i in held]) > 0.97
    assert 0 < len(model.rules) + len(model.linear) < 200
    scored = rule_ensemble.with_statistics(clashing).select(rule_ensemble.compiled(model).alias("s")).collect()
    assert len(scored) == len(rows()) and all(0 <= r.s <= 1 for r in scored)
    assert rule_ensemble.with_statistics(empty).count() == 0
    alone = rule_ensemble.RuleFit().fit(np.zeros((0, len(rule_ensemble.STATISTICS))), np.zeros(0))
    assert alone.rules == [] and alone.intercept == 0.0


def test_rules_mean_what_their_columns_say(spark):
    """Compiled scores equal a direct evaluation; the lasso weights are at their optimum (subgradient conditions)."""
    docs, labels = labelled(spark)
    stats = rule_ensemble.with_statistics(docs).cache()
    model = rule_ensemble.train(stats, labels)
    got = {r.doc_id: r.score for r in stats.select("doc_id", rule_ensemble.compiled(model).alias("score")).collect()}
    for r in stats.collect():
        x = [r[c] for c in rule_ensemble.STATISTICS]
        z = model.intercept + sum(w for rule, w in model.rules if all((x[f] > t) == above for f, above, t in rule))
        z += sum(w * min(max(x[f], low), high) for f, low, high, w in model.linear)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)))
    fit = rule_ensemble.RuleFit(l1=0.02, rounds=4000)
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 12))
    y = (a[:, 0] - 0.5 * a[:, 1] + rng.normal(size=300) > 0).astype(float)
    w, b = fit._lasso(a, y)
    g = a.T @ (1 / (1 + np.exp(-(a @ w + b))) - y) / len(y)
    on = w != 0
    assert 1 < on.sum() < 12 and np.allclose(g[on], -fit.l1 * np.sign(w[on]), atol=1e-5) and (np.abs(g[~on]) <= fit.l1 + 1e-6).all()


def test_ftrl_equals_a_plain_loop():
    """Weights by dictionaries and scalars, one coordinate at a time."""
    r = random.Random(9)
    data = [(np.array(sorted(r.sample(range(64), r.randint(0, 12))), dtype=np.int32), r.randint(0, 1)) for _ in range(120)]
    p = ftrl_toxicity.Ftrl(bits=6, l1=1.5, l1_share=0.05, l2=0.1, epochs=2)
    model = p.fit(data)
    z, n, l1 = {}, {}, max(1.0, min(p.l1, p.l1_share * len(data)))

    def weight(i):
        zi, least = z.get(i, 0.0), 0.0 if i == 64 else l1
        return 0.0 if abs(zi) <= least else -(zi - (least if zi > 0 else -least)) / ((p.beta + n.get(i, 0.0) ** 0.5) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for x, y in data:
            at = [*map(int, x), 64]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / p.alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    dense = model.dense()
    assert [weight(i) for i in range(64)] == pytest.approx(list(dense)) and weight(64) == pytest.approx(model.intercept)
    assert 0 < len(model.at) < 64


# --- 5 ---------------------------------------------------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1)):
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        rest = sum(w[s] for s in order if s not in full)
        t = {s: 3 * sizes[s] if s in full else left * w[s] / rest for s in order}
        new = {s for s in order if s not in full and t[s] > 3 * sizes[s]}
        if not new:
            return t
        full |= new


@pytest.mark.parametrize("seed", range(4))
def test_targets_reshare_the_excess(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 3, 100, 2000, 90000]) for i in range(r.randint(1, 12))} | ({None: 7} if seed % 2 else {})
    got = {x.source: x.target for x in pareto_mix.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    assert got == pytest.approx(water(sizes))


def test_mix_comes_near_its_targets(spark, clashing, empty):
    data = [(i, prose(1 + i % 40, i), "en", "abc"[i % 3] if i % 7 else None, 0) for i in range(900)]
    docs = spark.createDataFrame(data, SCHEMA)
    got = pareto_mix.mix(docs).collect()
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    target = water(sizes)
    assert all(abs(taken[s] - target[s]) <= 20 for s in sizes)
    assert all(0 <= r.copies <= 3 for r in got)
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in pareto_mix.mix(docs.repartition(5)).collect())
    assert pareto_mix.mix(empty).count() == 0
    assert pareto_mix.mix(docs.withColumn("text", F.lit(None).cast("string"))).filter("copies > 0").count() == 0
    odd = pareto_mix.mix(clashing)
    assert odd.count() == len(rows()) and odd.columns == clashing.columns
    assert sorted(odd.select("size").dtypes) == [("size", "bigint")] and odd.filter("size is null or copies is null").count() == 0


def brute_mix(rows, seed=42):
    """Copies of each row (doc_id, source, text), by one sorted pass over each source."""
    seen, made = {}, []
    for d, s, t in rows:
        digest = hashlib.sha256((t or "").encode()).hexdigest()
        copy = seen[d, s, digest] = seen.get((d, s, digest), -1) + 1
        key = f"{'null' if d is None else d}/{digest}/{copy}/{seed}"
        u = (int(hashlib.sha256(key.encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        made.append((s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), u))
    sizes = {}
    for s, n, _ in made:
        sizes[s] = sizes.get(s, 0) + n
    target, out = water(sizes), [0] * len(rows)
    for source in sizes:
        mine = [i for i, m in enumerate(made) if m[0] == source]
        full, level = set(), 0.0
        digits = lambda i: len(bin(made[i][1])) - 2
        while True:
            rest = sum(digits(i) * made[i][1] for i in mine if digits(i) not in full)
            level = (target[source] - 3 * sum(made[i][1] for i in mine if digits(i) in full)) / rest if rest else 0.0
            new = {digits(i) for i in mine if digits(i) not in full and made[i][1] and digits(i) * level >= 3}
            if not new:
                break
            full |= new
        times = {i: 3.0 if digits(i) in full else min(3.0, digits(i) * level) for i in mine}
        lack = target[source] - sum(int(times[i]) * made[i][1] for i in mine)
        ranked = sorted((made[i][2] / (1 - made[i][2]) / ((times[i] % 1) / (1 - times[i] % 1)), i) for i in mine if times[i] % 1 > 0)
        before = 0
        for i in mine:
            out[i] = int(times[i])
        for _, i in ranked:
            out[i] += before + made[i][1] / 2 <= lack
            before += made[i][1]
    return out, target, made


def test_mix_is_a_pareto_sample_with_unequal_odds(spark):
    """Against a plain version, with half of the ids null, repeated rows, and equal texts under one id."""
    r = random.Random(6)
    data = [(None if i % 2 else i, "abc"[i % 3], prose(r.choice([1, 3, 9, 30, 100, 400]), i % 350)) for i in range(1200)]
    data += [data[0]] * 5 + [(None, "b", prose(20, 1))] * 40 + [(3, None, None), (3, None, "")]
    docs = spark.createDataFrame([(d, t, "en", s, 0) for d, s, t in data], SCHEMA).repartition(7)
    want, target, made = brute_mix(data)
    key = lambda d, s, t: (str(d), str(s), t or "")
    got = pareto_mix.mix(docs).collect()
    assert sorted((*key(x.doc_id, x.source, x.text), x.copies) for x in got) == sorted((*key(*d), c) for d, c in zip(data, want, strict=True))
    for s in "abc":
        taken = sum(x.size * x.copies for x in got if x.source == s)
        assert abs(taken - target[s]) <= 400
    short, long = ([c for c, m in zip(want, made, strict=True) if m[0] == "b" and lo <= m[1] <= hi] for lo, hi in ((1, 9), (100, 400)))
    assert sum(short) / len(short) < 0.7 * sum(long) / len(long)  # longer texts are likelier


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_counts_equal_the_library(spark, clashing, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    signs = "abcdehinorst é\n\t  ▁中𝒳<>/s0129.,aaabee"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 90))) for _ in range(1500)]
    texts += [" " * n + "x" + " " * n for n in range(40)] + ["a" * n for n in range(60)] + ["<s></s><0x0A>", "a" * 30000, "\r\n", "▁▁"]
    count = token_counts.Counter(token_counts.load(path))
    assert count(texts) == [len(x) for x in sp.encode(texts)]
    got = token_counts.token_counts(clashing, path).collect()
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in rows())
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_bytes, x.n_tokens) for x in got) == want
    assert token_counts.token_counts(empty, path).count() == 0


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_licences_match_in_any_dress(spark, clashing, empty):
    mit = license_digest.TEXTS["MIT"][0]
    dressed = "\n".join(["# Copyright (c) 2001 Someone", *("// " + x.upper().replace(",", " ,") for x in mit.replace("sublicense", "sub-licence").split("\n"))])
    data = [(1, mit), (2, dressed), (3, mit + " and more"), (4, "x\nreleased  under the MIT LICENCE\ny\nReleased under the MIT License."), (5, None), (6, ""), (1, mit)]
    got = sorted((r.doc_id, r.license_id, list(r.notices), r.n_notice_lines) for r in license_digest.scan(spark.createDataFrame(data, "doc_id bigint, text string")).collect())
    assert got == [(1, "MIT", [], 0), (1, "MIT", [], 0), (2, "MIT", [], 0), (3, None, [], 0), (4, None, ["MIT"], 2), (5, None, [], 0), (6, None, [], 0)]
    assert license_digest.scan(clashing).count() == len(rows()) and license_digest.scan(empty).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------


def brute_lines(texts, least=50):
    """Texts (in order) without the lines of runs of ``least`` words that occur earlier, by comparing all starts."""
    parsed = [[p for p in re.split(r"\n(?=[ \t\x0b\f\r]*[^\s])", t)] if t is not None else [] for t in texts]
    keys = [[(i, p.strip(" \t\n\r\x0b\x0c")) for i, p in enumerate(ps) if re.search(r"[^\s]", p, re.A)] for ps in parsed]
    where = [(d, k) for d, ks in enumerate(keys) for k in range(len(ks))]
    gone = [set() for _ in texts]
    for n, (d, s) in enumerate(where):
        best = 0
        for e, q in where[:n]:
            m = 0
            while s + m < len(keys[d]) and q + m < len(keys[e]) and keys[d][s + m][1] == keys[e][q + m][1]:
                m += 1
            best = max(best, m)
        if sum(len(re.findall(r"[^\s]+", keys[d][s + x][1], re.A)) for x in range(best)) >= least:
            gone[d].update(keys[d][s + x][0] for x in range(best))
    return [None if t is None else "\n".join(p for i, p in enumerate(ps) if i not in g) for t, ps, g in zip(texts, parsed, gone, strict=True)]


def test_line_runs_go_as_by_brute_force(spark):
    r = random.Random(8)
    lines = [prose(r.choice([1, 3, 9, 20, 55]), 900 + i) for i in range(12)]
    texts = ["\n".join(r.choice([*lines, "", "  "]) for _ in range(r.randint(0, 30))) for _ in range(40)] + [None, "", "\n\n"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {x.doc_id: x.text for x in line_dedup.deduplicated(docs.repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


def test_lines_keep_columns_and_repeated_rows(spark, clashing, empty):
    out = line_dedup.deduplicated(clashing)
    assert out.columns == clashing.columns and out.count() == len(rows())
    assert {x.text for x in out.filter("doc_id = 7").collect()} == {"\n\n" + rows()[7][1].split("\n")[-2] + "\n" + rows()[7][1].split("\n")[-1]} or out.filter("doc_id = 7").count() == 2
    assert out.filter("doc_id = 6").first().text == "" and line_dedup.deduplicated(empty).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------------------


def naive_simhash(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def groups_of(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= 2:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_simhash_components(spark, clashing, empty):
    texts = [r[1] for r in rows()]
    base = prose(300, 41).split()
    for i in range(25):
        texts.append(" ".join([*base[: 10 * i], f"new{i}", *base[10 * i :]]))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in simhash_variants.components(docs).collect()}
    fps = [naive_simhash(t) for t in texts]
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == groups_of(fps)
    assert simhash_variants.components(clashing).count() == len(rows()) and simhash_variants.components(empty).count() == 0
    kept = simhash_variants.near_duplicates(clashing)
    assert kept.columns == clashing.columns and kept.filter("doc_id = 7").count() == 1


def test_near_duplicates_lose_no_row_of_a_repeated_id(spark):
    data = [(1, prose(80, 500)), (1, prose(80, 501)), (1, prose(80, 501)), (2, prose(80, 500)), (None, prose(80, 502)), (None, prose(80, 503)), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in data], SCHEMA)
    want = sorted([(1, data[0][1]), (1, data[1][1]), (None, data[4][1]), (None, data[5][1]), (3, "")], key=str)
    for operator in (simhash_variants, shingle_pairs):
        assert sorted(((r.doc_id, r.text) for r in operator.near_duplicates(docs).collect()), key=str) == want


def test_simhash_links_in_hot_buckets(spark):
    r = random.Random(3)
    seen = set()
    for _ in range(3):
        b = r.getrandbits(64)
        for spread, n in ((64, 60), (12, 120)):
            for _ in range(n):
                x = b
                for _ in range(r.randint(0, 4)):
                    x ^= 1 << r.randrange(spread)
                seen.add(x)
    fps = sorted(seen)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp bigint")
    from marginalia.plans.components import connected_components

    got = {}
    for x in connected_components(simhash_variants.links(df)).collect():
        got.setdefault(x.root, set()).add(x.node & (1 << 64) - 1)
    want = {}
    for x, g in zip(fps, groups_of(fps), strict=True):
        want.setdefault(g, set()).add(x)
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


# --- 10 --------------------------------------------------------------------------------------------------------------

PAGES = [
    (None, ""), ("", ""), ("plain", "plain"), ("<p", ""), ("<article>a<br>b<br/>c<!-- x", "a b c"), ("<p>a&lt;b&gt; &#233; &hellip;", "a<b> é …"),
    ("<nav><a href=x>m</a></nav><main><h1>T</h1><p>One&nbsp;two\n three<p>Four<ul><li>i<li>j</ul></main><footer>f</footer>", "T\nOne two three\nFour\ni\nj"),
    ("<article><header><h1>T</h1></header><p>x</p><aside>no</aside><section class='comments'><p>c</p></section></article>", "T\nx"),
    ("<div class=ad>buy</div><article><p>it<script>var a='</p>'</script> is</p><form><p>no</p></form><div id='related-posts'>r</div></article>", "it is"),
    ("<form><main><p>in a form</p></main></form>", "in a form"),
    ("<div class='cookie-notice'>we</div><p>Short</p><p>" + "the cat and the dog of the house is in a box " * 4 + "</p><div><a href=x>link link</a></div><p>tail</p>", None),
]


def test_pages(spark):
    for page, want in PAGES[:-1]:
        assert html_blocks.extract(page) == want
    long = " ".join(("the cat and the dog of the house is in a box " * 4).split())
    assert html_blocks.extract(PAGES[-1][0]) == f"Short\n{long}"
    df = spark.createDataFrame([(i, None, p) for i, (p, _) in enumerate(PAGES)], "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    assert html_blocks.with_main_text(df).count() == len(PAGES) and html_blocks.with_main_text(df.limit(0)).count() == 0


STOPS = "the cat and the dog of the house is in a box "
GOLDEN = {
    "related work": ("<article><section class='related-work'><p>We discuss related work at length.</p></section></article>", "We discuss related work at length."),
    "legal history": ("<article><h1>T</h1><div class='legal-history'><p>Law.</p></div></article>", "T\nLaw."),
    "post header": ("<article><div class='post-header'><h1>Title</h1></div><p>x</p></article>", "Title\nx"),
    "post header, no article": (f"<div class='post-header'><h1>Title</h1></div><div class=post-body><p>{STOPS * 4}</p></div>", "Title\n" + (STOPS * 4).strip()),
    "Chinese": ("<body><div class=nav><a href=x>首页</a></div><p>" + "这是一个很长的中文段落，没有空格。" * 8 + "</p><p>短句。</p></body>", "这是一个很长的中文段落，没有空格。" * 8 + "\n短句。"),
    "code": ("<body><pre>for (int i = 0; i < n; i++) { total += values[i] * weights[i]; } return total / n; /* done, and more of it */</pre></body>", "for (int i = 0; i < n; i++) { total += values[i] * weights[i]; } return total / n; /* done, and more of it */"),
    "a language without a list": ("<p>" + "Pikk lause ilma tuntud sõnadeta läheb edasi ja edasi kuni lõpuni välja. " * 2 + "</p>", ("Pikk lause ilma tuntud sõnadeta läheb edasi ja edasi kuni lõpuni välja. " * 2).strip()),
    "words without sentences": (f"<p>{STOPS * 4}</p><p>{'alpha beta gamma delta ' * 6}</p>", (STOPS * 4).strip()),
    "comments beside": (f"<article><p>x</p></article><div id=comments class='comments-area'><article class='comment'><p>{STOPS * 4}</p></article></div>", "x"),
    "comments inside": (f"<article><p>x</p><div class='userComments'><p>{STOPS * 4}</p></div><p>y</p></article>", "x\ny"),
    "links inside": (f"<article><p>{STOPS * 3}</p><ul><li><a href=a>one link</a></li><li>|</li><li><a href=b>two links</a></li></ul><p>End.</p></article>", (STOPS * 3).strip() + "\none link\n|\ntwo links\nEnd."),
    "linked title": (f"<article><h1><a href=x>{'Title ' * 20}</a></h1><p>{STOPS * 3}</p></article>", ("Title " * 20).strip() + "\n" + (STOPS * 3).strip()),
    "value of a title": (f"<p title='the hidden valley'>{STOPS * 3}</p>", (STOPS * 3).strip()),
    "value of a label": (f"<section aria-label='Hidden figures'><p>{STOPS * 3}</p></section>", (STOPS * 3).strip()),
    "data attribute": (f"<div data-hidden='false'><p>{STOPS * 3}</p></div><p data-style='display:none'>{STOPS * 3}</p>", (STOPS * 3).strip() + "\n" + (STOPS * 3).strip()),
    "title of a link": (f"<p>{STOPS * 3}<a title='Hidden costs' data-role=menu>more</a> of it</p>", STOPS * 3 + "more of it"),
    "hidden": (f"<p hidden>gone<p>{STOPS * 3}</p><div style='display: none'>x</div><span aria-hidden=true>y</span><p class=a hidden=''>z</p>", (STOPS * 3).strip()),
    "unclosed button": (f"<body><div><button>Menu</div><p>{STOPS * 3}</p><p>End.</p>", (STOPS * 3).strip() + "\nEnd."),
    "unclosed button, block": (f"<body><button>Menu<p>{STOPS * 3}</p><button><div>Go</div></button><p>End.</p>", (STOPS * 3).strip() + "\nEnd."),
    "unclosed script": (f"<p>{STOPS * 3}</p><script>var a = 1;<p>no</p>", (STOPS * 3).strip()),
    "a form around all": (f"<body><form id=f><p>{STOPS * 3}</p><p>End.</p></form></body>", (STOPS * 3).strip() + "\nEnd."),
    "a form beside": (f"<body><form id=f><p>{STOPS * 3}</p></form><p>{STOPS * 4}</p></body>", (STOPS * 4).strip()),
    "Russian": ("<body><p>" + "длинный абзац текста без знаков препинания " * 4 + "</p></body>", ("длинный абзац текста без знаков препинания " * 4).strip()),
    "rejected by neighbours": (
        f"<article><p>{STOPS * 3}</p><p>Near.</p><div><a>{'more offers here ' * 8}</a></div><p>Hot</p><div><a>{'other offers there ' * 8}</a></div></article>", (STOPS * 3).strip() + "\nNear.",
    ),
    "layout around": ("<div class='sidebar-right'><article><p>body</p></article></div>", "body"),
    "sidebar": (f"<div class=sidebar><p>{STOPS * 3}</p></div><p>{STOPS * 4}</p>", (STOPS * 4).strip()),
    "misnested": ("<a href=x><p>one</a> two</p><p>three</p>", "one two\nthree"),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_pages(name):
    page, want = GOLDEN[name]
    assert html_blocks.extract(page) == want


def test_both_passes_decide_on_the_given_pages(spark):
    """Inside articles density, links and neighbours decide, not the element."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    why = {}
    for page in pages:
        found = html_blocks.blocks(page or "")
        for b, (_, by) in zip(found, html_blocks.judged(found), strict=True):
            if b.inside and not b.outside:
                why[by] = why.get(by, 0) + 1
    assert why["density"] > 100 and why["neighbours"] > 100 and "region" not in why


class PlainReader(HTMLParser):
    """Blocks of well-formed pages with all that stands around them, from a tree walk of the standard library."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.runs, self.text = [], [], []
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        text = " ".join("".join(t for t, _ in self.text).split())
        if text:
            self.runs.append((text, sum(len(t.strip()) for t, around in self.text if any(x[0] == "a" for x in around)), list(self.text[-1][1])))
        self.text = []

    def handle_starttag(self, tag, attributes):
        if tag in html_blocks.BLOCKS:
            self.cut()
        self.open.append((tag, dict(attributes)))

    def handle_endtag(self, tag):
        if tag in html_blocks.BLOCKS:
            self.cut()
        self.open.pop()

    def handle_data(self, data):
        hidden = any(t in ("script", "button") or "hidden" in a or a.get("style") == "display:none" for t, a in self.open)
        if not hidden:
            self.text.append((data, list(self.open)))


NAMES = {"comments": html_blocks.APART, "sidebar": html_blocks.LAID_OUT, "related-work": html_blocks.DOUBTED, "intro": html_blocks.PLAIN}


def plain_text(page):
    """Both passes in their plainest form, over the standard library's reading."""
    found = []
    for text, linked, around in PlainReader(page).runs:
        tags = [t for t, _ in around]
        words = re.findall(r"[^\W\d_]+", text.lower())
        share = sum(w in html_blocks.STOP_WORDS for w in words) / max(1, len(words))
        listed = sum("a" <= c <= "ɏ" for c in text.lower()) * 2 >= sum(map(len, words))
        name = max((NAMES.get(a.get("class"), 0) for t, a in around if t not in ("body", "main", "article")), default=0)
        ends = re.search(r"[.!?…]$", text) and len(words) >= 8
        dense = None if len(text) < 80 else True if share >= 0.15 else None if ends or share >= 0.05 or not listed else False
        found.append(dict(text=text, linked=2 * linked > len(text), inside="article" in tags, region=bool({"nav", "aside", "footer"} & set(tags)), form="form" in tags, name=name, dense=dense, head="h2" in tags))
    candidates = [b for b in found if not b["region"] and b["name"] < 2]
    if any(b["inside"] for b in candidates):
        candidates = [b for b in candidates if b["inside"]]
    dense = [b for b in candidates if b["dense"]]
    formless = bool(dense) and all(b["form"] for b in dense)
    inside = any(b["inside"] and not b["region"] and (formless or not b["form"]) and b["name"] < 2 for b in found)
    left = [b for b in found if not b["region"] and (formless or not b["form"]) and (b["inside"] or not inside)]
    known = any(b["dense"] for b in left)
    other = inside or any(b["dense"] and b["name"] < 2 for b in left)
    for b in found:
        b["silent"] = False
        if not any(b is x for x in left) or b["name"] == 3 or (b["name"] == 2 and other):
            b["label"], b["silent"] = False, True
        elif b["linked"] and not (inside and (b["head"] or len(b["text"]) < 80)):
            b["label"] = False
        elif b["dense"]:
            b["label"] = True
        elif inside:
            b["label"] = None
        elif b["name"] == 1:
            b["label"], b["silent"] = False, True
        else:
            b["label"] = False if b["dense"] is False and known else None
    row = [b for b in found if b["inside"]] if any(b["inside"] for b in found) else found
    labels = [None if b["silent"] else b["label"] for b in row]
    if any(b["inside"] for b in found):
        row, labels = [None, *row, None], [True, *labels, True]
    tie = True if row and row[0] is None else None
    for i, b in enumerate(row):
        if b is None or b["label"] is not None:
            continue
        near = sorted((abs(i - k), k > i, x) for k, x in enumerate(labels) if x is not None)
        b["final"] = near[0][2] if near else True
        if len(near) > 1 and near[0][0] == near[1][0] and near[0][2] != near[1][2] and tie is not None:
            b["final"] = tie
    return "\n".join(b["text"] for b in found if b.get("final", b["label"]))


def random_page(r):
    attributes = lambda: r.choice(["", "", " title='the hidden valley'", " aria-label=\"Hidden figures\"", " data-hidden='false'", " data-style='display:none'", " hidden", " style='display:none'", " class=intro data-role=menu", " class=related-work", " class=sidebar", " class=comments"])
    phrase = lambda: r.choice([STOPS * r.randint(2, 4), "Short.", "no stop words", "alpha beta gamma delta " * 6, "Un lungo testo senza parole note che finisce con un punto qui. " * 2, "длинный абзац текста " * 6])

    def piece(depth):
        kind = r.randrange(9)
        if kind < 4:
            return f"<p{attributes()}>{phrase()}</p>"
        if kind == 4:
            return "<ul>" + "".join(f"<li><a href='x'>{r.choice(['one', 'more offers here ' * 8])}</a></li>" for _ in range(r.randint(1, 3))) + "</ul>"
        if kind == 5:
            return f"<h2><a title='Hidden costs'>{phrase()}</a></h2>"
        if kind == 6:
            return r.choice(["<button>Go <b>on</b></button>", "<script>var a = '<p>';</script>", "<br>text".replace("<br>", "")])
        tag = r.choice(["div", "section", "nav", "aside", "footer", "form"])
        return f"<{tag}{attributes() if tag in ('div', 'section') else ''}>{''.join(piece(depth + 1) for _ in range(r.randint(1, 3)))}</{tag}>" if depth < 3 else "<p>x</p>"

    body = [piece(0) for _ in range(r.randint(1, 6))]
    if r.random() < 0.5:
        body.insert(r.randint(0, len(body)), "<article>" + "".join(piece(0) for _ in range(r.randint(1, 6))) + "</article>")
    return "<body>" + "".join(body) + "</body>"


def test_random_pages_read_as_by_a_plain_reader():
    r = random.Random(17)
    seen = {"rejected": 0, "kept": 0}
    for _ in range(3000):
        page = random_page(r)
        assert html_blocks.extract(page) == plain_text(page), page
        found = html_blocks.blocks(page)
        for keep, why in html_blocks.judged(found):
            if why == "neighbours":
                seen["kept" if keep else "rejected"] += 1
    assert min(seen.values()) > 100


@pytest.mark.parametrize("page", ["<button>" * 100_000, "<svg><div>" * 50_000, "<button></div>" * 60_000, "<p a='" * 60_000, "<div>" * 100_000 + "</b>" * 100_000, "<b>" * 60_000 + "<p>" * 60_000 + "</b>" * 60_000, "<form><article>" * 60_000, "<![CDATA[" * 100_000, "<head>" * 150_000, '<a b="' * 100_000, "<p>x<b>" * 100_000])
def test_odd_markup_takes_linear_time(page):
    import time

    began = time.process_time()
    html_blocks.extract(page)
    assert time.process_time() - began < 5


def test_open_blocks_follow_the_nearest_decided_one():
    assert html_blocks._inherit([True, None, False], True) == [True, True, False] and html_blocks._inherit([False, None, False], True)[1] is False
    assert html_blocks._inherit([None, True, None, None, False, None]) == [True, True, True, False, False, False]
    assert html_blocks._inherit([True, None, False]) == [True, True, False] and html_blocks._inherit([None]) == [True]


def test_the_training_sample_has_one_row_of_an_id(spark):
    from marginalia.llm.common import training_rows

    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.range(100_000).select(F.lit(ids[0]).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 50).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(i, f"of {i}") for i in range(200)] + [(None, "x"), (ids[1], None)], "doc_id bigint, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(ids[0], 1), (None, 1)], "doc_id bigint, toxic int")
    got = training_rows(docs, labels, "toxic", 1000).collect()
    assert sorted(r.doc_id for r in got) == ids and next(r.y for r in got if r.doc_id == ids[0]) == 1
    assert len(training_rows(docs, labels, "toxic", 3).collect()) == 3
    assert sorted(got) == sorted(training_rows(docs.repartition(7), labels, "toxic", 1000).collect())
    model = ftrl_toxicity.train(docs, labels, params=ftrl_toxicity.Ftrl(max_rows=2))
    assert model.fitted


def test_toxicity_without_training_rows_keeps_all(spark, clashing):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    for given in ([], [(1, None), (2, None)], [(i, 1) for i in held]):
        labels = spark.createDataFrame(given, "doc_id bigint, toxic int")
        model = ftrl_toxicity.train(clashing, labels)
        assert ftrl_toxicity.keep_clean(clashing, model).count() == len(rows())
        assert {r.score for r in ftrl_toxicity.score(clashing, model).collect()} == {0.5}


def test_pipeline_drops_edited_copies(spark, clashing, empty):
    """Against a brute force over 5-word shingles, with a hot bucket whose members do not all match each other."""
    import corpus_pipeline

    r = random.Random(3)
    long = [prose(400, 900 + i).split(" ") for i in range(3)]
    texts = [" ".join(x) for x in long]
    texts += [" ".join([*x[:200], "edited", *x[201:]]) for x in long] + [" ".join([*x[:100], *x[300:]]) for x in long]
    body = prose(200, 950).split(" ")
    for i in range(60):
        at = r.randrange(200 - 25 * (i % 3))
        texts.append(" ".join([*body[:at], *(f"n{i}_{k}" for k in range(25 * (i % 3))), *body[at + 25 * (i % 3) :]]))
    texts += ["", None, " ", "a b", "A  b", "b a"]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            union = sets[i] | sets[j]
            if not union or len(sets[i] & sets[j]) / len(union) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(len(texts)) if root(i) == i]
    assert not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    assert shingle_pairs.near_duplicates(clashing).columns == clashing.columns
    assert shingle_pairs.near_duplicates(empty).count() == 0
    edges = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(200)], "a long, b long").filter("a != b").cache()
    assert {tuple(x) for x in shingle_pairs.components(edges).collect()} == {tuple(x) for x in simhash_variants.connected_components(edges).collect()}


def test_wrapped_licences_keep_their_sentences(spark):
    """Standard texts, wrapped at every width, under notices of several forms."""
    import textwrap

    heads = ["Copyright (c) 2001 Someone", "Copyright 2020, The Authors. All rights reserved.", "(c) 1999 A. Person", "© Someone", "Copyright Some Company", "COPYRIGHT: [yyyy] [name]", "All rights reserved."]
    data = [(i, "\n".join(["// " + heads[(w + k) % len(heads)], "", *(x for part in t.split("\n") for x in textwrap.wrap(part, w))])) for w in range(40, 90, 3) for k, (i, ts) in enumerate(license_digest.TEXTS.items()) for t in ts]
    usual = heads[0] + "\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n" + license_digest._WARRANTY_ISC
    data.append(("ISC", usual))
    got = license_digest.scan(spark.createDataFrame(list(enumerate(t for _, t in data)), "doc_id bigint, text string")).collect()
    assert [r.license_id for r in sorted(got, key=lambda r: r.doc_id)] == [i for i, _ in data]


def test_long_licences_match_by_their_digests(spark):
    """Whole standard texts, where this machine has them: as they are, commented, indented and wrapped anew."""
    import pathlib
    import textwrap

    folder = pathlib.Path("/usr/share/common-licenses")
    known = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    data = []
    for name, want in known.items():
        if not (folder / name).exists():
            continue
        text = (folder / name).read_text(errors="replace")
        data += [(want, text), (want, "\n".join("// " + x for x in text.split("\n"))), (want, text.upper() if "http" not in text else "    " + text.replace("\n", "\r\n    "))]
        data += [(None, text + "\nand more"), (None, text[: len(text) // 2])]
        if name in ("Apache-2.0", "MPL-2.0", "CC0-1.0"):
            data += [(want, "\n\n".join("\n".join(textwrap.wrap(" ".join(p.split()), w)) for p in re.split(r"\n\s*\n", text))) for w in range(56, 100, 7)]
    if not data:
        pytest.skip("no standard texts here")
    got = license_digest.scan(spark.createDataFrame(list(enumerate(t for _, t in data)), "doc_id bigint, text string")).collect()
    assert [r.license_id for r in sorted(got, key=lambda r: r.doc_id)] == [w for w, _ in data]


def test_notices_are_told_by_their_form():
    """Lines that go, and sentences of licences that begin alike and stay."""
    notice = re.compile(license_digest.COPYRIGHT.replace("(?<=\\b(?:inc|ltd|llc|co|corp)\\.)", "(?<=\\binc\\.)"))
    gone = ["copyright (c) 2001 someone", "* copyright 2020, the authors", "(c) 1999 a. person", "© someone", "copyright some company", "copyright: [yyyy] [name]", "all rights reserved.", "copyright acme inc."]
    kept = ["copyright holder or contributors be liable", "copyright, patent, trademark, and attribution", "(c) representations.", "copyrighted material outside", 'copyright" line and a pointer', "copyright ownership.", "copyright doctrines of fair use, fair dealing"]
    assert all(notice.fullmatch(x) for x in gone) and not any(notice.match(x) for x in kept)


def test_maximal_runs_are_what_repeats(spark):
    """Every maximal run equals its first place line by line, and can't be longer at either end as a repeat of that place."""
    r = random.Random(21)
    lines = [prose(r.choice([9, 20, 55]), 700 + i) for i in range(8)]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 25))) for _ in range(25)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    keyed = docs.select("doc_id", F.xxhash64("doc_id").alias("k1"), F.xxhash64("text").alias("k2"))
    found = line_dedup.maximal_runs(docs).join(keyed, ["k1", "k2"]).collect()
    assert found
    parsed = [t.split("\n") for t in texts]
    for x in found:
        own, other = parsed[x.doc_id][x.s : x.e + 1], parsed[x.first_doc_id][x.s - x.by : x.e - x.by + 1]
        assert own == other and sum(len(t.split()) for t in own) >= 50
        assert (x.first_doc_id, x.s - x.by) < (x.doc_id, x.s)


def test_very_long_and_odd_texts_lose_their_lines(spark, clashing):
    block = "\n".join(prose(12, 40 + i) for i in range(400))
    texts = [block, "head\n" + block + "\ntail", "\n".join([block] * 3), "z " * 60_000]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert [x.text for x in line_dedup.deduplicated(docs).orderBy("doc_id").collect()] == [block, "head\ntail", "", texts[3]]
    named = clashing.withColumn("_spans", F.lit("x")).withColumn("_new", F.lit(1)).withColumn("_k1", F.lit(2)).withColumn("__row", F.lit(3))
    out = line_dedup.deduplicated(named)
    assert out.columns == named.columns and {r["_spans"] for r in out.collect()} == {"x"}
