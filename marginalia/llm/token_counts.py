"""Token counts by rank-synchronous merging of ragged arrays.

A text is cut where no piece of the vocabulary can reach across: before every run of spaces that follows something
else, and between two characters that stand side by side in no piece. What is left are short sequences of symbols,
held one after the other in flat numpy arrays. In every round each sequence finds its pair of the lowest rank and
merges all its places at once, from left to right; a sequence without a pair is done, and the symbols that survive
are its tokens (an unknown character is as many tokens as it has UTF-8 bytes).

Merging all places at once is the same as one after the other only if a merge cannot make a pair of a lower rank.
Pieces for which it can are known from the vocabulary; of those only the leftmost place of a sequence is merged.

Defined cases: null and empty texts have no tokens; special strings in a text are ordinary text; texts of any length
are counted whole; repeated rows stay, and further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import read

SPACE = "▁"
PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Pre-tokens whose counts a worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 1_000_000, 64
#: Characters merged at once.
BLOCK = 4_000_000
NONE = np.int32(2**31 - 1)
TOP = 0x110000


@dataclass(frozen=True)
class Merges:
    """A vocabulary as arrays: symbols by character, mergeable pairs, and which ranks merge one place at a time."""

    chars: np.ndarray  # code point -> symbol, or -1
    weight: np.ndarray  # symbol -> tokens that it is
    pairs: np.ndarray  # left * n + right, ascending
    rank: np.ndarray  # of pairs
    merged: np.ndarray  # of pairs
    single: np.ndarray  # rank -> True: leftmost place only
    beside: np.ndarray  # code points left * TOP + right that stand side by side in a piece, ascending
    size: int


def load(model_path: str) -> Merges:
    """The merges of a SentencePiece BPE model with byte fallback and identity normalisation."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    usual = [i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    score = {sp.id_to_piece(i): sp.get_score(i) for i in usual}
    order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
    symbols = {p: k for k, p in enumerate([*score, *sorted({c for p in score for c in p} - score.keys())])}
    n = len(symbols)
    weight = np.array([1 if p in score else len(p.encode()) for p in symbols] + [0, 1, 2, 3, 4], dtype=np.int64)
    chars = np.full(TOP, -1, dtype=np.int32)
    for p, k in symbols.items():
        if len(p) == 1:
            chars[ord(p)] = k
    known: list[tuple[int, int, int]] = []
    single = np.zeros(len(order), dtype=bool)
    for piece, s in score.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in symbols and right in symbols:
                known.append((symbols[left] * n + symbols[right], order[s], symbols[piece]))
                for part in (left, right):
                    if len(part) > 1 and score[part] <= s:
                        single[order[score[part]]] = True
    known.sort()
    keys, ranks, made = (np.array(x) for x in zip(*known, strict=True))
    beside = np.unique([ord(a) * TOP + ord(b) for p in score for a, b in zip(p, p[1:], strict=False)])
    return Merges(chars, weight, keys.astype(np.int64), ranks.astype(np.int32), made.astype(np.int32), single, beside.astype(np.int64), n)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def merge_counts(words: list[str], m: Merges) -> np.ndarray:
    """Tokens of each pre-token, merged in ragged arrays."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    sym = m.chars[points]
    width = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    sym = np.where(sym < 0, m.size + width, sym).astype(np.int64)
    total = np.zeros(len(words), dtype=np.int64)
    if not len(sym):
        return total
    joined = np.zeros(len(sym), dtype=bool)
    joined[1:] = (word[1:] == word[:-1]) & _find(m.beside, points[:-1] * TOP + points[1:])[1]
    seq = np.cumsum(~joined) - 1
    while len(sym):
        rank = np.full(len(sym), NONE, dtype=np.int32)
        made = np.zeros(len(sym), dtype=np.int64)
        inner = np.nonzero(seq[1:] == seq[:-1])[0]
        at, hit = _find(m.pairs, sym[inner] * m.size + sym[inner + 1])
        hit &= (sym[inner] < m.size) & (sym[inner + 1] < m.size)
        inner, at = inner[hit], at[hit]
        rank[inner], made[inner] = m.rank[at], m.merged[at]
        first = np.nonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))[0]
        low = np.minimum.reduceat(rank, first)
        number = np.cumsum(np.concatenate([[False], seq[1:] != seq[:-1]]))
        going = (low < NONE)[number]
        np.add.at(total, word[~going], m.weight[sym[~going]])
        take = (rank == low[number]) & going
        places = np.nonzero(take)[0]
        if not len(places):
            break
        of = number[places]
        new = np.concatenate([[True], of[1:] != of[:-1]])
        gap = np.concatenate([[True], (places[1:] != places[:-1] + 1) | new[1:]])
        run_start = np.maximum.accumulate(np.where(gap, np.arange(len(places)), 0))
        chosen = np.where(m.single[rank[places]], new, (np.arange(len(places)) - run_start) % 2 == 0)
        places = places[chosen]
        sym[places] = made[places]
        keep = going
        keep[places + 1] = False
        sym, seq, word = sym[keep], seq[keep], word[keep]
    return total


class Counter:
    """Token counts of whole texts, a batch at a time."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.seen = merges, {}

    def _learn(self, words: list[str], into: dict[str, int]) -> None:
        at = 0
        while at < len(words):
            size, end = 0, at
            while end < len(words) and (end == at or size + len(words[end]) <= BLOCK):
                size += len(words[end])
                end += 1
            into.update(zip(words[at:end], merge_counts(words[at:end], self.merges).tolist(), strict=True))
            at = end

    def __call__(self, texts: list[str | None]) -> list[int]:
        cut = [PRETOKEN.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen = {}
        fresh = {w for words in cut for w in words} - self.seen.keys()
        long = {w for w in fresh if len(w) > LONGEST}
        self._learn(list(fresh - long), self.seen)
        if not long:
            get = self.seen.__getitem__
            return [sum(map(get, words)) for words in cut]
        rare: dict[str, int] = {}
        self._learn(list(long), rare)
        return [sum(self.seen[w] if w in self.seen else rare[w] for w in words) for words in cut]


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``; ``model_path`` is read on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(shared.value)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            sizes = [len(t or b"") for t in raw]
            tokens: list[int] = []
            for at in range(0, len(raw), 500):
                tokens += count([t and t.decode("utf-8", "replace") for t in raw[at : at + 500]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


def query(spark: SparkSession, sf_dir: str, limit: int = 4096) -> DataFrame:
    """op6: the tokens of every document."""
    import public_tokenizers

    counts = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
