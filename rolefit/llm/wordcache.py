"""Whole-text tokenising with remembered chunks.

A byte-level BPE of this family splits a text into words before it merges, and a
single space followed by a non-space always begins a new word.  So a text is cut
at such spaces, each distinct chunk of a list of texts is encoded once, and chunks
are remembered up to a number that is a parameter.
Texts in which a space meets other white space, or begins or ends the text, are
encoded as a whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

#: Chunks that an encoder remembers, entries of a generation of a two-generation memory, and the longest text that is remembered.
CHUNKS, LONGEST = 400_000, 64
_MEETS = re.compile(r" \s")

# --- fixed value: the words of a byte-level pre-tokenizer ---
BYTE_LEVEL_WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TwoGenerations(dict):
    """A bounded memory: when it is full it becomes the old generation, and what is used again is carried over."""

    def __init__(self, make: Callable[[str], bytes], size: int) -> None:
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key) or self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def word_chunks(text: str) -> list[str]:
    """Parts of a text that are encoded alone as they are in the text, each with the space before it."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or "\0" in text or _MEETS.search(text):
        return [text]
    return text.replace(" ", "\0 ").split("\0")


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level ``tokenizers`` file."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    byte = {c: b for b, c in byte_characters().items()}
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for s, i in vocabulary.items():
        tokens[i] = bytes(byte[c] for c in s)
    return tokens


@lru_cache(maxsize=2)
def byte_level_encode(path: str) -> Callable[[str], list[int]]:
    """A text's ids by a byte-level ``tokenizers`` file; special tokens are neither parsed nor added.

    The file's merges, if their products' ids rise with them, are the same as merging the pair whose
    product has the lowest id, which ``tiktoken`` does in less time and returns as plain lists."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, words = spec["model"], spec["pre_tokenizer"] or {}
    products = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][p] for p in products]
    rising = all(a < b for a, b in zip(ids, ids[1:])) and not (ids and ids[0] < 256)
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
    if spec["normalizer"] is not None or not plain or not rising or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError("this file's texts can't be encoded by merging the pair of the lowest id")
    byte = {c: b for b, c in byte_characters().items()}
    ranks = {bytes(byte[c] for c in s): model["vocab"][s] for s in (*byte, *products)}
    return tiktoken.Encoding("byte level", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids of texts (little-endian unsigned 32-bit, as bytes).  No special tokens are parsed or added."""

    def __init__(self, path: str, remembered: int = CHUNKS) -> None:
        self.encode, self.remembered, self.known = byte_level_encode(path), remembered, {}

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text of a list."""
        if len(self.known) > self.remembered:
            self.known.clear()
        parts = [word_chunks(t) for t in texts]
        new = list(set().union(*parts).difference(self.known))
        self.known.update((c, array("I", self.encode(c)).tobytes()) for c in new)
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        for c in new:
            if len(c) > LONGEST:
                del self.known[c]
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=4)
def encoder(path: str, remembered: int = CHUNKS) -> Encoder:
    """The encoder of a file, one in a Python worker."""
    return Encoder(path, remembered)
