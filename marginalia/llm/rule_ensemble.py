"""Quality: a sparse ensemble of rules over text statistics.

Small regression trees are boosted on the statistics of labelled texts; every path from a root to an inner node or a
leaf is a rule, a conjunction of thresholds. A logistic regression with an L1 term is fitted on the rules (and on the
statistics themselves, cut off at their extremes), which leaves few of them, and what is left is compiled into one
Spark column expression over the statistics: nothing of the model runs in Python when texts are scored.

The statistics are made once for every whole text, in Arrow batches, and kept as a table in the shared folder; the
fit reads at most ``max_rows`` labelled rows of it. Labels, language, source and id are no inputs.

Defined cases: null and empty texts have all statistics zero and are scored like any other; without labelled rows,
or with one class alone, the score is the (smoothed) share of label 1; repeated rows stay; equal texts score alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import held_out, read, training_rows
from marginalia.plans.storage import materialize

STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "long_words", "short_words", "upper", "digits",
    "symbols", "stops", "spaces", "high_bytes", "bars", "bangs", "distinct_words", "top_word", "symbol_words",
    "upper_words", "lines", "line_words", "distinct_lines", "closed_lines", "repeated_pairs", "letters_only",
    "deflate",
]
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_STOP, _SPACE = b".,;:?'\"", b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOP)
#: Bytes deflated at once, and words paired at once; sums over blocks, so whole texts count in bounded memory.
BLOCK = 65_536


def statistics(text: bytes | None) -> list[float]:
    """The values of STATISTICS, from the whole text."""
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    size, n = len(text), len(words)

    def share(of: bytes) -> float:
        return (size - len(text.translate(None, of))) / size

    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs, seen = set(), 0
    for at in range(0, n - 1, BLOCK):
        pairs.update(map(hash, zip(words[at : at + BLOCK], words[at + 1 : at + BLOCK + 1], strict=False)))
    seen = n - 1
    odd = sum(c for w, c in counts.items() if w.translate(None, _SYMBOL) != w)
    loud = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    plain = sum(c for w, c in counts.items() if w.isalpha())
    packed = sum(len(zlib.compress(text[at : at + BLOCK], 1)) for at in range(0, size, BLOCK))
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()),
        float((lengths > 12).mean()), float((lengths < 4).mean()), share(_UPPER), share(_DIGIT), share(_SYMBOL),
        share(_STOP), share(_SPACE), share(_HIGH), text.count(b"|") / n, text.count(b"!") / n, len(counts) / n,
        max(counts.values()) / n, odd / n, loud / n, float(np.log1p(len(lines))), n / len(lines),
        len(set(lines)) / len(lines), sum(x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in lines) / len(lines),
        1 - len(pairs) / seen if seen else 0.0, plain / n, packed / size,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, one double for each of STATISTICS) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made.T.copy())], names=["doc_id", *STATISTICS])

    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


#: A rule: (number of the statistic, True for above and False for at most, threshold) for each condition.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    """Rules and linear terms whose weights are not zero."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[int, float, float, float]] = field(default_factory=list)  # statistic, low, high, weight


@dataclass(frozen=True)
class RuleFit:
    """``max_rows`` bounds the labelled sample; trees * 2 ** (depth + 1) bounds the rules."""

    trees: int = 40
    depth: int = 3
    bins: int = 48
    rate: float = 0.2
    least: int = 15
    share: float = 0.6
    l1: float = 0.0015
    rounds: int = 400
    max_rows: int = 20_000
    seed: int = 11

    def _tree(self, codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, rows: np.ndarray) -> tuple[list[Rule], np.ndarray]:
        """The paths of one tree fitted to ``grad`` over ``rows``, and its step for every row of ``codes``."""
        step, paths = np.zeros(len(codes)), []
        stack: list[tuple[np.ndarray, np.ndarray, Rule]] = [(rows, np.arange(len(codes)), ())]
        while stack:
            part, every, path = stack.pop()
            if path:
                paths.append(path)
            best = (1e-9, -1, -1)
            if len(path) < self.depth and len(part) >= 2 * self.least:
                g = grad[part]
                base = g.sum() ** 2 / len(g)
                for f, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    s = np.bincount(codes[part, f], weights=g, minlength=len(cut) + 1).cumsum()[:-1]
                    c = np.bincount(codes[part, f], minlength=len(cut) + 1).cumsum()[:-1]
                    ok = (c >= self.least) & (len(g) - c >= self.least)
                    gain = np.where(ok, s**2 / np.maximum(c, 1) + (g.sum() - s) ** 2 / np.maximum(len(g) - c, 1) - base, 0)
                    if gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] < 0:
                step[every] = grad[part].mean() if len(part) else 0.0
                continue
            _, f, b = best
            for above in (False, True):
                stack.append((part[(codes[part, f] > b) == above], every[(codes[every, f] > b) == above], (*path, (f, above, float(cuts[f][b])))))
        return paths, step

    def fit(self, x: np.ndarray, y: np.ndarray) -> RuleModel:
        if len(y) == 0 or y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2)
            return RuleModel(float(np.log(share / (1 - share))))
        rng = np.random.default_rng(self.seed)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        cuts = [c[c < v.max()] for c, v in zip(cuts, x.T, strict=True)]
        codes = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        margin, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            rows = np.sort(rng.permutation(len(y))[: max(1, int(self.share * len(y)))])
            paths, step = self._tree(codes, cuts, y - p, rows)
            margin = margin + self.rate * step / max(1e-6, float((p * (1 - p)).mean()))
            rules.update(dict.fromkeys(tuple(sorted(r)) for r in paths))
        kept = list(rules)
        columns = [np.all([(x[:, f] > t) == above for f, above, t in r], axis=0).astype(float) for r in kept]
        low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
        flat = np.clip(x, low, high)
        a = np.stack([*columns, *flat.T], axis=1)
        mean, spread = a.mean(axis=0), a.std(axis=0)
        use = np.nonzero(spread > 1e-9)[0]
        w, b = self._lasso((a[:, use] - mean[use]) / spread[use], y)
        b -= float((w * mean[use] / spread[use]).sum())
        got = [(int(j), float(v / spread[j])) for j, v in zip(use, w, strict=True) if v != 0]
        k = len(kept)
        return RuleModel(
            b, [(kept[j], v) for j, v in got if j < k], [(j - k, float(low[j - k]), float(high[j - k]), v) for j, v in got if j >= k]
        )

    def _lasso(self, a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Logistic loss with an L1 term on all but the intercept, by accelerated proximal gradient steps."""
        n, k = a.shape
        v = np.ones(k) / max(1, k) ** 0.5
        for _ in range(20):
            v = a.T @ (a @ v)
            v /= max(1e-12, np.linalg.norm(v))
        size = 1.0 / (0.25 * (float(np.linalg.norm(a @ v)) ** 2 / n + 1.0) + 1e-9)
        w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
        u, c, t = w.copy(), b, 1.0
        for _ in range(self.rounds):
            g = (1 / (1 + np.exp(-(a @ u + c))) - y) / n
            new = u - size * (a.T @ g)
            new = np.sign(new) * np.maximum(np.abs(new) - size * self.l1, 0)
            newb, newt = c - size * float(g.sum()), (1 + (1 + 4 * t * t) ** 0.5) / 2
            u, c = new + (t - 1) / newt * (new - w), newb + (t - 1) / newt * (newb - b)
            w, b, t = new, newb, newt
        return w, b


def compiled(model: RuleModel) -> Column:
    """The probability of label 1 as one Spark expression over the columns of STATISTICS."""
    total = F.lit(model.intercept)
    for rule, weight in model.rules:
        met = F.lit(True)
        for f, above, cut in rule:
            met = met & (F.col(STATISTICS[f]) > cut if above else F.col(STATISTICS[f]) <= cut)
        total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
    for f, low, high, weight in model.linear:
        total = total + F.least(F.greatest(F.col(STATISTICS[f]), F.lit(low)), F.lit(high)) * F.lit(weight)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(stats: DataFrame, labels: DataFrame, params: RuleFit = RuleFit(), label: str = "quality") -> RuleModel:
    """Fit on a bounded sample of the labelled rows that are not held out; ``stats`` is from ``with_statistics``."""
    rows = training_rows(stats, labels, label, params.max_rows).select(F.xxhash64("doc_id", F.lit(5)).alias("h"), *STATISTICS, "y")
    got = rows.toArrow().sort_by([("h", "ascending"), *((s, "ascending") for s in STATISTICS[:4])])
    x = np.stack([got.column(s).to_numpy() for s in STATISTICS], axis=1) if got.num_rows else np.zeros((0, len(STATISTICS)))
    return params.fit(x, got.column("y").to_numpy().astype(float))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the quality of every document."""
    stats = materialize(with_statistics(read(spark, sf_dir, "documents")), "statistics")
    scored = stats.withColumn("score", compiled(train(stats, read(spark, sf_dir, "labels"))))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
