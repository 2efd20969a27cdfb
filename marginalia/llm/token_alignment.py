"""Alignment of two tokenizers by distinct segments.

Texts are cut where tokens of neither vocabulary can reach across (``segments``), so that a text's alignment is its
segments' alignments one after the other, and each distinct segment is tokenised and aligned once:

1. Tasks write their documents in *chunks* of bounded size, each a dictionary of distinct segments with counts and the
   documents as codes of that dictionary.
2. The dictionaries' entries are dealt by segment and sorted. Each segment is tokenised by both vocabularies and cut
   into groups at the byte offsets where tokens of both end, and keeps the places (chunk, code) it came from, in runs
   of bounded length.
3. Counts of linked id pairs follow from segments and their counts. Of two tokens that end together one's bytes end
   with the other's, so a vocabulary has at most as many pairs as its tokens have bytes, about 850,000 here, whatever
   the corpus: the pairs are broadcast.
4. Alignments go back to the chunks by the places, those of one batch and chunk put together before they are dealt,
   and each chunk composes its documents from its own.

A segment has at most one place a chunk, so no key holds more than one row of each chunk, however often it occurs; a
hot document id or text is spread over the chunks as its rows are read.

Defined cases: null and empty texts, and texts with U+2581 (their pieces' bytes are spaces), have no tokens: zeros and
''. Special strings are ordinary text. Repeated rows each have a result and count in the pairs; further columns are
not read; any type of id goes.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import read
from marginalia.llm.segments import MARK, ByteEncoder, PieceEncoder, byte_tokens, keys, piece_tokens, text_of
from marginalia.plans.storage import materialize

#: Characters of a chunk; a longer document is a chunk of its own.
CHUNK = 48_000_000
#: Segments tokenised at once, and places of a segment in one row.
BATCH, RUN = 20_000, 4096


def squeezed(codes: np.ndarray) -> bytes:
    """32-bit codes, their first bytes first, compressed."""
    return pa.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True) if len(codes) else b""


def unsqueezed(data: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(data, 4 * n, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Chunk:
    """Documents as codes of a dictionary of segments."""

    def __init__(self) -> None:
        self.book: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids: list = []
        self.sizes = array("q")
        self.codes: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id, text: str | None) -> None:
        self.ids.append(doc_id)
        if not text or MARK in text:
            self.sizes.append(0)
            return
        found = keys(text)
        self.codes.append(np.fromiter(map(self.book.__getitem__, found), np.int32, len(found)))
        self.sizes.append(len(found))
        self.chars += len(text)

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        """Frequent segments have small codes, so that the compressed codes take little."""
        codes = np.concatenate([np.empty(0, np.int32), *self.codes])
        counts = np.bincount(codes, minlength=len(self.book))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        columns = [
            pa.array([number], pa.int64()), pa.array([pa.array(list(self.book), pa.string()).take(pa.array(order)).to_pylist()], pa.list_(pa.string())),
            pa.array([counts[order]], pa.list_(pa.int64())),
            pa.array([self.ids], pa.list_(kind)), pa.array([np.array(self.sizes, np.int64)], pa.list_(pa.int64())), pa.array([squeezed(rank[codes])], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "segments", "counts", "ids", "sizes", "codes"])


def chunks(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` as chunks; which rows share one is settled only once the result is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk, kind = TaskContext.get().partitionId() << 32, Chunk(), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                chunk.add(doc_id, text.as_py())
                if chunk.chars >= most:
                    yield chunk.row(number, kind)
                    number, chunk = number + 1, Chunk()
        if chunk.ids:
            yield chunk.row(number, kind)

    kind = dict(docs.dtypes)["doc_id"]
    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"chunk bigint, segments array<string>, counts array<bigint>, ids array<{kind}>, sizes array<bigint>, codes binary")


def align(a: list[int], b: list[int], a_len: list[int], b_len: list[int]) -> tuple[str, list[int], list[int]]:
    """The groups of two id lists over the same bytes, and the ids of either that end each group."""
    groups, last_a, last_b = [], [], []
    i = j = at_a = at_b = from_a = from_b = 0
    while i < len(a):
        at_a += a_len[a[i]]
        i += 1
        while at_b < at_a:
            at_b += b_len[b[j]]
            j += 1
        if at_a == at_b:
            groups.append(",".join(map(str, a[from_a:i])) + "|" + ",".join(map(str, b[from_b:j])))
            last_a.append(a[i - 1])
            last_b.append(b[j - 1])
            from_a, from_b = i, j
    return ";".join(groups), last_a, last_b


def aligned(entries: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The alignment of each segment of ``entries`` (segment: key, chunk, code, n): numbers of tokens, groups, linked ids,
    with its places; a row for each RUN of these, ``n`` being theirs."""
    a_bytes, b_bytes = byte_tokens(a_path), piece_tokens(b_path)
    shared = entries.sparkSession.sparkContext.broadcast((a_bytes, b_bytes))
    names = ["n", "n_a", "n_b", "groups", "last_a", "last_b", "chunks", "codes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_of, b_of = shared.value
        a_len, b_len = list(map(len, a_of)), list(map(len, b_of))
        a_encoder, b_encoder = ByteEncoder(a_path, plain=True), PieceEncoder(b_path)

        def made(held: list[tuple[str, list[list]]]) -> pa.RecordBatch:
            texts, out = [text_of(k) for k, _ in held], []
            for text, a, b, (_, runs) in zip(texts, a_encoder(texts), b_encoder(texts), held, strict=True):
                if not b"".join(map(a_of.__getitem__, a)) == b"".join(map(b_of.__getitem__, b)) == text.encode():
                    raise ValueError(f"the tokens of {text[:80]!r} are not its bytes")
                found = align(a, b, a_len, b_len)
                out += [(n, len(a), len(b), *found, chunk, code) for n, chunk, code in runs]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        held: list[tuple[str, list[list]]] = []
        for batch in batches:
            for segment, chunk, code, n in zip(*(batch.column(c).to_pylist() for c in ("segment", "chunk", "code", "n")), strict=True):
                if not held or held[-1][0] != segment:
                    if len(held) >= BATCH:
                        yield made(held)
                        held = []
                    held.append((segment, []))
                runs = held[-1][1]
                if not runs or len(runs[-1][1]) == RUN:
                    if len(runs) == BATCH:  # what is full goes, so that a worker holds a bounded number of places
                        yield made(held)
                        held = [(segment, runs := [])]
                    runs.append([0, [], []])
                runs[-1][0] += n
                runs[-1][1].append(chunk)
                runs[-1][2].append(code)
        if held:
            yield made(held)

    schema = "n bigint, n_a bigint, n_b bigint, groups string, last_a array<int>, last_b array<int>, chunks array<bigint>, codes array<int>"
    return entries.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, schema)


def link_counts(segments: DataFrame) -> DataFrame:
    """(a, b, links, best): how many links of the corpus hold each pair, and whether that is the most of its ``b``."""
    pairs = segments.select("n", F.explode(F.arrays_zip("last_a", "last_b")).alias("p"))
    pairs = pairs.groupBy(F.col("p.last_a").alias("a"), F.col("p.last_b").alias("b")).agg(F.sum("n").alias("links"))
    return pairs.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def weighed(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """What each chunk gets of ``segments``: codes, NUMBERS of each, sums of their links' counts, and groups.

    ``pairs`` comes to the driver as arrays; the vocabularies bound it.
    """
    table = pairs.toArrow()
    key = table["a"].to_numpy().astype(np.int64) << 32 | table["b"].to_numpy()
    order = np.argsort(key)
    shared = segments.sparkSession.sparkContext.broadcast((key[order], table["links"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, links, best = shared.value
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch.column("last_a").value_lengths().to_numpy())])
            at = np.searchsorted(known, batch.column("last_a").flatten().to_numpy().astype(np.int64) << 32 | batch.column("last_b").flatten().to_numpy())
            sums, n_best = (np.diff(np.concatenate([[0], np.cumsum(v[at])])[ends]) for v in (links, best))
            numbers = np.stack([batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), np.diff(ends), n_best], 1).astype("<i8")
            source = np.repeat(np.arange(batch.num_rows), batch.column("chunks").value_lengths().to_numpy())
            place, code = batch.column("chunks").flatten().to_numpy(), batch.column("codes").flatten().to_numpy()
            by = np.argsort(place, kind="stable")
            bounds = np.flatnonzero(np.diff(place[by], prepend=-1, append=-1)).tolist()
            rows, groups = [], np.array(batch.column("groups").to_pylist(), object)
            for s, e in zip(bounds, bounds[1:], strict=False):
                of = source[by[s:e]]
                rows.append((int(place[by[s]]), code[by[s:e]].astype("<i4").tobytes(), numbers[of].tobytes(), sums[of].astype("<i8").tobytes(), "\n".join(groups[of])))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["of", "codes", "numbers", "sums", "groups"])

    return segments.mapInArrow(run, "of bigint, codes binary, numbers binary, sums binary, groups string")


#: Of each code in a row of ``weighed``.
NUMBERS = ["n_a", "n_b", "n_groups", "n_best"]
SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def composed(chunk_rows: DataFrame, books: DataFrame) -> DataFrame:
    """Every document of the chunks from the alignments of its segments: numbers, and ``groups`` as a digest."""
    kind = chunk_rows.schema["ids"].dataType.elementType.simpleString()

    def run(rows: pa.Table, book: pa.Table) -> pa.Table:
        import hashlib

        def flat(column: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(book[column].to_pylist()), kind)

        places = np.argsort(flat("codes", "<i4"))
        split = [g for text in book["groups"].to_pylist() for g in text.split("\n")]
        groups = [split[k] for k in places.tolist()]
        values = dict(zip(NUMBERS, flat("numbers", "<i8").reshape(-1, len(NUMBERS))[places].T, strict=True))
        values |= {"n_links": values["n_groups"], "count_sum": flat("sums", "<i8")[places]}  # a group's last tokens are its link
        out = []
        for row in range(rows.num_rows):
            sizes = rows["sizes"][row].values.to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            codes = unsqueezed(rows["codes"][row].as_py(), int(ends[-1]))
            sums = [np.concatenate([[0], np.cumsum(values[c][codes])])[ends] for c in SUMS]
            digests = [
                hashlib.sha256(";".join(map(groups.__getitem__, codes[s:e].tolist())).encode()).hexdigest() if s < e else ""
                for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            ]
            out.append(pa.Table.from_arrays([rows["ids"][row].values, *[pa.array(np.diff(v), pa.int64()) for v in sums], pa.array(digests, pa.string())], names=["doc_id", *SUMS, "groups_sha256"]))
        return pa.concat_tables(out)

    slim = chunk_rows.select("chunk", "ids", "sizes", "codes")
    return slim.groupBy("chunk").cogroup(books.groupBy("of")).applyInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in SUMS)}, groups_sha256 string")


def alignments(docs: DataFrame, a_path: str, b_path: str, most: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    ``a_path`` is a byte-level BPE file of the tokenizers library, given each text with a space before it; ``b_path``
    a SentencePiece BPE model, which adds that space itself.
    """
    rows = materialize(chunks(docs, most), "chunks")
    entries = rows.select("chunk", F.posexplode(F.arrays_zip("segments", "counts")).alias("code", "s"))
    entries = entries.select(F.col("s.segments").alias("segment"), "chunk", "code", F.col("s.counts").alias("n"))
    segments = materialize(aligned(entries, a_path, b_path), "segments")
    return composed(rows, weighed(segments, link_counts(segments)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the alignment of every document's tokens by two vocabularies."""
    import public_tokenizers

    return alignments(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
