"""Encoding with a public byte-level BPE vocabulary, by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that BPE makes. It is
built from one state that accepts any bytes by adding a gadget for each merge
(a, b) -> c in rank order: the state behind a becomes a copy of itself that no longer
takes b, and c leads where b led. So every state is its parent minus one token, a
state takes a token made after it exactly if it takes that token's left part, and the
whole table of transitions is given by four arrays (``_compiled``). A word has one
accepted path; it is found by one pass over the word, as the last token of each
prefix is unique, and its arc labels are the ids. Decoding emits the labels' bytes.

Words come from the vocabulary's pre-splitting pattern. Each worker keeps the ids of
the words it has met, in a bounded table.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codesim.session import spread

VOCABULARY = os.environ.get("CODESIM_BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the vocabulary's authors split text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII alone.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"""
ARCS_KEPT = 1_000_000  # answers about arcs that a worker keeps
WORDS_KEPT = 150_000  # words of up to WORD_KEPT characters whose ids a worker keeps
WORD_KEPT = 48


def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary in a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


class Automaton:
    """The tokenization automaton of a ranked vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values()) + 1
        self.left = array("i", [-1]) * size  # left part of a merged token
        self.made = array("i", [0]) * size  # the merge that made a token, 0 for bytes
        self.target = array("i", [0]) * size  # the state behind a token
        self.parent, self.removed = array("i", [-1]), array("i", [-1])  # of a state, which has its merge's number
        self._reset(ranks)
        self._arcs = {t: i for t, i in ranks.items() if len(t) == 1}
        for token, c in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self._merge(token, c)

    def _reset(self, ranks: dict[bytes, int]) -> None:
        self.ids = ranks
        self.text = {i: t for t, i in ranks.items()}
        self._known: dict[int, bool] = {}
        self._arcs: dict[bytes, int] = {}  # beginnings of tokens; -1 where none ends

    def _merge(self, token: bytes, c: int) -> None:
        """Add the gadget of the merge that makes ``token``: its path so far is the pair that merges."""
        a, b = self.encode(token)
        state, behind_b = len(self.parent), self.target[b]
        self.parent.append(self.target[a])
        self.removed.append(b)
        self.left[c], self.made[c] = a, state
        self.target[a], self.target[c] = state, behind_b
        for n in range(2, len(token)):
            self._arcs.setdefault(token[:n], -1)
        self._arcs[token] = c

    def takes(self, state: int, token: int) -> bool:
        """Is there an arc for the token out of the state?"""
        key = state << 20 | token
        known = self._known.get(key)
        if known is None:
            t, known, made, left, parent, removed = token, True, self.made, self.left, self.parent, self.removed
            while state:
                if state <= made[t]:  # the state was there when t was made, and takes it as it takes its left part
                    t = left[t]
                elif removed[state] == t:
                    known = False
                    break
                else:
                    state = parent[state]
            if len(self._known) >= ARCS_KEPT:
                self._known.clear()
            self._known[key] = known
        return known

    def encode(self, word: bytes) -> list[int]:
        """The labels of the word's accepted path."""
        n = len(word)
        last, begun = [-1] * (n + 1), [0] * (n + 1)  # the last token of each prefix, and where it begins
        arcs, takes, target = self._arcs.get, self.takes, self.target
        state = 0
        for s in range(n):
            if s:
                state = target[last[s]]
            for e in range(s + 1, n + 1):
                t = arcs(word[s:e])
                if t is None:
                    break
                if t >= 0 and last[e] < 0 and takes(state, t):
                    last[e], begun[e] = t, s
        out = []
        while n:
            out.append(last[n])
            n = begun[n]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the arcs' labels."""
        return b"".join(map(self.text.__getitem__, ids))

    def __getstate__(self) -> dict:
        return {"ranks": self.ids, "arrays": [self.left, self.made, self.target, self.parent, self.removed]}

    def __setstate__(self, state: dict) -> None:
        self._reset(state["ranks"])
        self.left, self.made, self.target, self.parent, self.removed = state["arrays"]
        for t, i in self.ids.items():
            for n in range(1, len(t)):
                self._arcs.setdefault(t[:n], -1)
            self._arcs[t] = i


class Encoder:
    """Texts to ids: words of the pattern, each by the automaton, kept in a bounded table."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.split, self.split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        ids = self.automaton.encode(word.encode("utf-8", "replace"))
        if len(word) <= WORD_KEPT:
            if len(self.kept) >= WORDS_KEPT:
                self.kept.clear()
            self.kept[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        add, kept, miss = out.extend, self.kept, self.word
        for w in self.split_ascii(text) if text.isascii() else self.split(text):
            try:
                add(kept[w])
            except KeyError:
                add(miss(w))
        return out


_held: list[Encoder] = []


def worker_encoder(automaton: Automaton) -> Encoder:
    """The encoder this worker holds for the automaton; its table of words lasts from task to task."""
    if not _held or _held[0].automaton is not automaton:
        _held[:] = [Encoder(automaton)]
    return _held[0]


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array of int) of each row: the BPE ids of its text, no special tokens, nothing added.

    Empty and null texts have the empty list. Every row comes out, repeated rows
    too; strings of special tokens are ordinary text. The compiled automaton is broadcast;
    its size is that of the vocabulary (about 3 MB for 50,000 tokens).
    """
    shared = documents.sparkSession.sparkContext.broadcast(Automaton(ranks_of(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(shared.value).encode
        for batch in batches:
            values, lengths = array("i"), [0]
            for t in batch.column(1).to_pylist():
                if t:
                    values.extend(encode(t))
                lengths.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.frombuffer(values, np.int32) if values else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    return spread(documents.select(key, text)).mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, ids array<int>")
