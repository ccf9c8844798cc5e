"""Public vocabularies as byte-pair encoders inside Python workers."""

from __future__ import annotations

import base64
import json
import re

import numpy as np
import tiktoken

from emberwatch.llm.shared import process_cache, tokenizer_file

#: The pattern that splits text before the merges of the byte vocabulary (a fixed value; possessive where that changes nothing).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
END_OF_TEXT = "<|endoftext|>"


def byte_encoder() -> tiktoken.Encoding:
    """The 50k byte vocabulary; ids equal those of its tokenizers file."""
    cache = process_cache()
    if "byte_encoder" not in cache:
        with open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache["byte_encoder"] = tiktoken.Encoding(
            "byte-50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)}
        )
    return cache["byte_encoder"]


def byte_ids(text: str) -> list[int]:
    """Ids of a whole text; the special token's string in it is the special token."""
    encoder = byte_encoder()
    if END_OF_TEXT in text:
        return encoder.encode(text, allowed_special="all")
    return encoder.encode_ordinary(text)


class WordVocabulary:
    """The 49k vocabulary with word ends: normal form, pieces of unspaced runs, and merges over bytes.

    A word's end is a byte that UTF-8 never uses, merged into the last byte before any other merge; then
    every step is a merge of two neighbours by rank and any piece can be encoded as plain bytes.
    """

    END = b"\xff"
    #: Splits a run without white space into pieces (a fixed value, for letters below U+0250).
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.specials = [t["content"] for t in spec["added_tokens"]]
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        shown = _shown_bytes()
        raw = lambda token: bytes(shown[c] for c in token.removesuffix("</w>")) + (self.END if token.endswith("</w>") else b"")
        ranks: dict[bytes, int] = {}
        names: list[str] = []
        for char, byte in shown.items():
            ranks[bytes([byte]) + self.END] = len(names)
            names.append(char + "</w>")
        for pair in merges:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks[raw(left + right)] = len(names)
            names.append(left + right)
        for char, byte in shown.items():
            ranks[bytes([byte])] = len(names)
            names.append(char)
        ranks[self.END] = len(names)
        names.append("")
        self.ids = np.array([vocab.get(name, -1) for name in names], np.int64)
        self.names = names
        self.token_of = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.lengths = np.zeros(len(names), np.int64)
        for piece, rank in ranks.items():
            self.lengths[rank] = len(piece)
        self.merger = tiktoken.Encoding("word-49k", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def merge(self, piece: bytes) -> list[int]:
        """Ranks of the tokens of some bytes without splitting."""
        return self.merger.encode_single_piece(piece)

    def plain(self, run: str) -> bool:
        """Whether the run's normal form and pieces are those of the rules here; others are left to the library."""
        return max(run) < "ɐ" and not _ODD.search(run) and not any(s in run for s in self.specials)

    def pieces(self, run: str) -> list[bytes]:
        run = run.lower()
        if run.isalpha():
            return [run.encode() + self.END]
        return [p.encode() + self.END for p in self.PIECES.findall(run)]


#: White space that is not ASCII, other controls, and digits or marks where rules of libraries may differ.
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0ª²³¹º¼-¾İ]")


def _shown_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, in order of ids."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def word_vocabulary(path: str | None = None) -> WordVocabulary:
    cache, path = process_cache(), path or tokenizer_file("word_bpe_49k.json")
    if ("words", path) not in cache:
        cache["words", path] = WordVocabulary(path)
    return cache["words", path]
