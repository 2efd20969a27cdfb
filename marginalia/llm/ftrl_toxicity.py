"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, its pairs of neighbouring words and its pairs with one word
between them (words: runs of letters and digits, A-Z lower-cased). The fit keeps the two sums of FTRL-proximal for
each coordinate, so every coordinate has its own learning rate, and its L1 term leaves all but a few thousand weights
at zero; only those are broadcast (2**bits numbers at most).

The fit reads at most ``max_rows`` labelled rows (a bounded sample, see ``training_rows``) with ``max_features``
features in all, and runs in one task of an executor, so that the driver gets nothing but the weights. Scoring reads
every whole text.

Defined cases: null and empty texts have no features and get the score of the intercept, as does any text without
known features; with no labelled row at all every score is 0.5 and ``keep_clean`` keeps every row; documents with equal texts get equal scores; repeated
rows stay; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import held_out, read, training_rows
from marginalia.plans.storage import discard, materialize

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words hashed at once; bounds the memory that one very long text takes.
BLOCK = 200_000
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 150_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _numbers(text: bytes | None, bits: int, hashes: dict[bytes, int]) -> Iterator[np.ndarray]:
    """The feature numbers of a text, repeats included, a block of words at a time."""
    words = WORD.findall((text or b"").lower())
    for at in range(0, len(words), BLOCK):
        h = np.array([hashes[w] for w in words[at : at + BLOCK + 2]], dtype=np.uint64)
        one = h * np.uint64(0x9E3779B97F4A7C15)
        two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[1:] * np.uint64(0x165667B19E3779F9))
        skip = (h[:-2] * np.uint64(0xD6E8FEB86659FD93)) ^ (h[2:] * np.uint64(0xA0761D6478BD642F))
        both = np.concatenate([one, two, skip]) * np.uint64(0x9FB21C651E98DF25)
        yield (both >> np.uint64(64 - bits)).astype(np.int32)


def features(text: bytes | None, bits: int, hashes: dict[bytes, int]) -> np.ndarray:
    """The distinct feature numbers of a text, ascending."""
    found = [np.unique(x) for x in _numbers(text, bits, hashes)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int32)


def margin(text: bytes | None, model: Model, dense: np.ndarray, hashes: dict[bytes, int]) -> float:
    """The log odds of label 1; ``dense`` is ``model.dense()``. Only features with a weight are made distinct."""
    hit = [x[dense[x] != 0] for x in _numbers(text, model.bits, hashes)]
    hit = np.unique(np.concatenate(hit)) if hit else np.zeros(0, dtype=np.int32)
    return model.intercept + float(dense[hit].sum())


@dataclass(frozen=True)
class Model:
    """Weights that are not zero: feature numbers, ascending, and values; and the intercept."""

    bits: int
    at: np.ndarray
    weight: np.ndarray
    intercept: float
    #: False if there was no labelled row to fit: such a model scores 0.5 and rejects nothing.
    fitted: bool = True

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.at] = self.weight
        return out


@dataclass(frozen=True)
class Ftrl:
    """The fit's parameters. ``max_rows`` and ``max_features`` (numbers in all) bound the labelled sample that the
    fit reads, in the order of the rows' hashes.

    ``l1_share`` is the L1 term for each labelled row, as sums of gradients grow with the rows; ``l1`` bounds it above.
    """

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l1_share: float = 0.0015
    l2: float = 0.0
    epochs: int = 3
    max_rows: int = 12_000
    max_features: int = 24_000_000

    def fit(self, rows: list[tuple[np.ndarray, int]]) -> Model:
        """FTRL-proximal over ``rows`` in the order given; coordinate 2**bits is the intercept, without L1."""
        n_at = 1 << self.bits
        z, n = np.zeros(n_at + 1), np.zeros(n_at + 1)
        least = max(1.0, min(self.l1, self.l1_share * len(rows)))

        def weights(i: np.ndarray) -> np.ndarray:
            zi = z[i]
            l1 = np.where(i == n_at, 0.0, least)
            w = -(zi - np.sign(zi) * l1) / ((self.beta + np.sqrt(n[i])) / self.alpha + self.l2)
            return np.where(np.abs(zi) <= l1, 0.0, w)

        for _ in range(self.epochs):
            for x, y in rows:
                i = np.append(x, n_at)
                w = weights(i)
                p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
                g = p - y
                s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / self.alpha
                z[i] += g - s * w
                n[i] += g * g
        at = np.nonzero(np.abs(z[:n_at]) > least)[0]
        return Model(self.bits, at.astype(np.int32), weights(at), float(weights(np.array([n_at]))[0]), bool(rows))


def train(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), label: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    bits = params.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            made = [features(t, bits, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], names=["h", "x", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, int]] = []
        held = 0
        for batch in batches:  # in the order of the rows' hashes; features stay where Arrow has them
            for x, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x.as_buffer() or b"", dtype=np.int32)
                held += len(x)
                if held <= params.max_features:
                    kept.append((x, y))
        m = params.fit(kept)
        kept.clear()
        batch = x = None  # what held the features goes before other work of this process
        pa.default_memory_pool().release_unused()
        at = np.append(m.at, 1 << bits) if m.fitted else m.at
        weight = np.append(m.weight, m.intercept) if m.fitted else m.weight
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(weight, pa.float64())], names=["at", "weight"])

    rows = training_rows(docs.select("doc_id", "text"), labels, label, params.max_rows)
    rows = rows.select(F.xxhash64("doc_id", F.lit(7)).alias("h"), F.col("text").cast("binary").alias("text"), "y")
    rows = materialize(rows.mapInArrow(run, "h bigint, x binary, y int"), "features")
    # One task holds the sample, which its two bounds keep below 100 MB; feature 2**bits is the intercept.
    one = rows.coalesce(1).sortWithinPartitions("h", "x", "y").select("x", "y")
    model = materialize(one.mapInArrow(fit, "at int, weight double"), "weights")
    got = model.orderBy("at").toPandas()
    discard(rows, model)
    if not len(got):
        return Model(bits, np.zeros(0, dtype=np.int32), np.zeros(0), 0.0, False)
    return Model(bits, got["at"].to_numpy(np.int32)[:-1], got["weight"].to_numpy()[:-1], float(got["weight"].iloc[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs``: the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = shared.value, _Hashes()
        dense = m.dense()
        for batch in batches:
            z = np.array([margin(t, m, dense, hashes) for t in batch.column(1).to_pylist()])
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, reject_at: float = 0.5) -> DataFrame:
    """``docs`` less the rows with a score of ``reject_at`` or more; columns and other rows as they are.

    A model that had no labelled row to learn from tells nothing, so all rows stay.
    """
    if not model.fitted:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    least = float(np.log(reject_at / (1 - reject_at)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = shared.value, _Hashes()
        dense = m.dense()
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary()).to_pylist()
            yield batch.filter(pa.array([margin(t, m, dense, hashes) < least for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the toxicity of every document."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", predicted)
