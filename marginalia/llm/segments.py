"""Texts cut into segments that tokenise on their own.

A cut lies before a run of white space that begins with a space or a line feed and follows something else. No token of
either vocabulary reaches across such a place; ``byte_tokens`` and ``piece_tokens`` verify that for the files they
load, so that the tokens of a text are those of its segments, one after the other.

A segment of the text with one space before it is held as its *key*: less its leading space if it has just one, else
as it is. ``keys`` and ``text_of`` turn texts into keys and keys into texts.
"""

from __future__ import annotations

import json
import os
import re

#: Texts without these are cut by plain splitting: white space at the start, runs of it, and other than space or \n.
ODD = re.compile(r"\A\s|\s\s|[^\S \n]")
SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: The mark that stands for a space in pieces.
MARK = "▁"


def keys(text: str) -> list[str]:
    """The keys of the segments of a space and ``text``, in order."""
    if not ODD.search(text):
        return text.replace("\n", " \n").split(" ")
    return [s[1:] if s[0] == " " and not s[1:2].isspace() else s for s in SEGMENT.findall(" " + text)]


def text_of(key: str) -> str:
    return key if key[:1].isspace() else " " + key


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest
    from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE file, after verifying that its segments tokenise on their own."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec["pre_tokenizer"]
    if spec["normalizer"] or spec["model"]["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        raise ValueError("not a plain byte-level vocabulary")
    of = byte_alphabet()
    vocabulary = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [b""] * (max(vocabulary.values()) + 1)
    special = {t["content"] for t in spec["added_tokens"]}
    for token, i in vocabulary.items():
        out[i] = token.encode() if token in special else bytes(map(of.__getitem__, token))
    if {bytes([b]) for b in range(256)} - set(out) or any(re.search(r"\S[ \n]", b.decode("utf-8", "replace")) for b in out):
        raise ValueError("a token may reach across a cut, or a byte has none")
    return out


def piece_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a SentencePiece BPE model, after verifying that its segments tokenise on their own."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
    plain = model.normalizer_spec
    if plain.name != "identity" or plain.remove_extra_whitespaces or not plain.add_dummy_prefix or not model.trainer_spec.byte_fallback:
        raise ValueError("not a model with byte fallback, an added space and no normalisation")
    size = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(size)]
    usual = [p for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    if any("\n" in p and p != "\n" or re.search(f"[^{MARK}]{MARK}", p) for p in usual) or sum(map(sp.is_byte, range(size))) != 256:
        raise ValueError("a piece may reach across a cut, or a byte has none")
    return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]


class ByteEncoder:
    """Ids of texts by a byte-level BPE file."""

    def __init__(self, path: str, plain: bool) -> None:
        """``plain``: special strings in a text are ordinary text; else they are what the library makes of them."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if plain:
            self.tokenizer.encode_special_tokens = True

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


#: Fixed value: the pattern by which byte-level vocabularies cut texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RankEncoder:
    """Ids of texts by a byte-level BPE file as the tokenizers library gives them by default, from its tokens as ranks.

    A token's id must be its merge's place, as ``byte_ranks`` verifies; then the tiktoken library, which takes a
    quarter of the time, gives the same ids. Texts that it can't take go to the tokenizers library.
    """

    def __init__(self, path: str, ranks: dict[bytes, int], special: dict[str, int]) -> None:
        import tiktoken

        self.path, self.special, self.slow = path, set(special), None
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special=self.special)
        except ValueError:
            self.slow = self.slow or ByteEncoder(self.path, plain=False)
            return self.slow([text])[0]


def byte_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(id of each token's bytes, ids of special strings) of a byte-level BPE file whose ids are in order of merges."""
    tokens = byte_tokens(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    if any(spec["model"]["vocab"]["".join(m)] != 256 + k for k, m in enumerate(merges)) or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("ids are not in the order of merges, or special strings take what is beside them")
    return {b: i for i, b in enumerate(tokens) if i not in special.values()}, special


class PieceEncoder:
    """Ids of segments by a SentencePiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.before = len(self.model.encode("\n"))

    def __call__(self, segments: list[str]) -> list[list[int]]:
        """What the model adds goes before a line feed, which no piece holds; neither is part of the result."""
        return [ids[self.before :] for ids in self.model.encode(["\n" + s for s in segments], num_threads=1)]
