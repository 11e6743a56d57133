"""Byte-level BPE ids of whole texts, equal to those of the tokenizers library.

The vocabulary is read from the library's own JSON file. Ids of a byte-level vocabulary ascend in the
order of its merges, so the same file drives a faster encoder; texts on which encoders could differ go
through the tokenizers library itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Texts with these go through the library: special tokens, and characters that not every
#: pattern library takes for white space.
ODD = re.compile("<\\||[\x1c-\x1f\x85᠎​]")
#: The split before the merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_encoders: dict[str, "ByteEncoder"] = {}


def byte_encoder(path: str) -> "ByteEncoder":
    """The process's encoder for a vocabulary file; loading one takes a second."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


class ByteEncoder:
    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of one whole text."""
        if ODD.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def array(self, text: str | None, end: int | None = None) -> np.ndarray:
        """Ids of a text (null: none) and the end id, as little-endian unsigned 32-bit integers."""
        ids = self.encode(text) if text else []
        if end is not None:
            ids.append(end)
        return np.array(ids, "<u4")


def byte_chars() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, by rule: printable Latin-1
    stands for itself, all other bytes take the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
