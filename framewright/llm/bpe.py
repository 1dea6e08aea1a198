"""Token ids of whole texts by a public byte-level BPE vocabulary, exactly as its merges give them, in linear time.

Within a pre-token all vocabulary entries are found at once by an Aho-Corasick automaton over the bytes mapped to
Latin-1. The encoding then goes left to right, taking the longest entry that may stand beside the one before it, and
steps back where none may. Two entries may stand side by side if the merges of their joint text would not cross the
border between them; that answer is memoised. A byte position is tried with each entry once, so the time is linear.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: The published pre-token pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker keeps of each memo; memos only save time.
MEMO = 200_000


def _byte_of_char() -> dict[str, int]:
    """The published byte alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder for a vocabulary file with ``model.vocab`` and ``model.merges`` in merge order."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        alphabet = _byte_of_char()
        as_bytes = lambda token: bytes(alphabet[c] for c in token).decode("latin-1")
        vocab: dict[str, int] = model["vocab"]
        self.find = regex.compile(PATTERN).findall
        self.words = ahocorasick.Automaton()
        for token, i in vocab.items():
            text = as_bytes(token)
            self.words.add_word(text, (i, len(text)))
        self.words.make_automaton()
        # rank: single bytes below all merges, then the merges in their order
        self.rank = {i: -1 for i in vocab.values()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            whole = vocab[left + right]
            pair = (vocab[left], vocab[right])
            self.merged.setdefault(pair, r)
            if whole not in self.halves:
                self.halves[whole] = pair
                self.rank[whole] = r
        self.beside: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, list[int]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of the joint text leave a border between the two entries."""
        key = (left, right)
        known = self.beside.get(key)
        if known is None:
            known = self._compatible(left, right)
            if len(self.beside) >= 4 * MEMO:
                self.beside.clear()
            self.beside[key] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the latest merge on either side of the border until both sides are single bytes. A merge across the
        # border that ranks before the merges undone so far would have happened first.
        limit = len(self.merged)
        last_left = False  # which side was undone last decides ties: on equal ranks the left one happens first
        while True:
            r = self.merged.get((left, right))
            if r is not None and (r < limit or (r == limit and last_left is False and limit != len(self.merged))):
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, last_left = a, True
                left = self.halves[left][1]
            else:
                limit, last_left = b, False
                right = self.halves[right][0]

    def word(self, text: str) -> list[int]:
        """The ids of one pre-token."""
        got = self.seen.get(text)
        if got is None:
            got = self._word(text.encode("utf-8").decode("latin-1"))
            if len(text) <= 64:
                if len(self.seen) >= MEMO:
                    self.seen.clear()
                self.seen[text] = got
        return got

    def _word(self, text: str) -> list[int]:
        n = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (i, size) in self.words.iter(text):
            at[end - size + 1].append((size, i))
        for entries in at:
            entries.sort(reverse=True)
        out: list[int] = []
        tried = [0] * n  # entries already tried at each position
        starts: list[int] = []
        dead = bytearray(n + 1)  # positions from which the rest cannot be reached
        pos = 0
        while pos < n:
            entries, k = at[pos], tried[pos]
            while k < len(entries):
                size, i = entries[k]
                k += 1
                if not dead[pos + size] and (not out or self.compatible(out[-1], i)):
                    tried[pos] = k
                    out.append(i)
                    starts.append(pos)
                    pos += size
                    break
            else:
                if not out:
                    raise ValueError("text outside the vocabulary")
                tried[pos] = 0
                dead[pos] = 1
                out.pop()
                pos = starts.pop()
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; empty for null and empty texts."""
        if not text:
            return []
        word = self.word
        return [i for w in self.find(text) for i in word(w)]


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, built once in every Python worker."""
    return ByteBpe(path)


def token_ids(text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """array<int>: the ids of ``text`` without special tokens; their strings in a text are ordinary text.

    Null, empty: an empty list. Blank texts and texts of any length are encoded whole; equal texts get equal ids.
    """
    path = f"{tokenizers}/{vocabulary}"

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode
        for part in parts:
            yield pd.Series([encode(x) for x in part], dtype=object)

    return ids(text)


def token_count(text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """bigint: how many ids ``token_ids`` gives; 0 for null and empty texts."""
    path = f"{tokenizers}/{vocabulary}"

    @F.pandas_udf("long")
    def size(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode
        for part in parts:
            yield pd.Series([len(encode(x)) for x in part], dtype="int64")

    return size(text)
