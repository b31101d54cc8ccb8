"""k-gram and winnowed fingerprints of token streams.

The hash of a token sequence reads its characters as digits in base BASE, a separator
after each token, modulo PRIME. As BIGINT products overflow and DECIMAL ones are slow, it is computed
from prefix hashes in Arrow batches: two multiplications a gram, whatever k is.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base, modulus and separator of the hash.
BASE, PRIME, SEPARATOR = 31, (1 << 61) - 1, 0x7F


@dataclass(frozen=True)
class Scheme:
    """All k-grams, or those that winnowing selects; k = 0 chooses k and window by the number of tokens."""

    name: str
    k: int
    winnowed: bool = False


def stream_k(n: int) -> tuple[int, int]:
    """k and window for a stream of n tokens."""
    k = max(8, min(15, n // 200))
    return k, max(4, min(8, k // 2))


def function_k(n: Column) -> Column:
    """k for a function of n tokens."""
    return F.when(n < 20, 3).when(n < 50, 5).when(n < 150, 8).when(n < 300, 12).otherwise(F.least(F.lit(18), 15 + F.floor((n - 300) / 300).cast("int")))


def size_k(n: int) -> int:
    """The same of a number."""
    return 3 if n < 20 else 5 if n < 50 else 8 if n < 150 else 12 if n < 300 else min(18, 15 + (n - 300) // 300)


DUCK_FUNCTION_K = "CASE WHEN n < 20 THEN 3 WHEN n < 50 THEN 5 WHEN n < 150 THEN 8 WHEN n < 300 THEN 12 ELSE least(18, 15 + (n - 300) // 300) END"

_powers = [1]


def token_hash(token: str) -> int:
    """The hash of one token with its separator."""
    h = 0
    for c in token:
        h = (h * BASE + ord(c)) % PRIME
    return (h * BASE + SEPARATOR) % PRIME


def gram_hashes(tokens: list[str], k: int, kept: dict[str, int] | None = None) -> list[int]:
    """The hash of each k tokens in a row."""
    if k <= 0:
        raise ValueError("k must be 1 or more")
    if len(tokens) < k:
        return []
    kept = {} if kept is None else kept
    prefix, length = [0], [0]
    h = n = 0
    longest = sum(sorted((len(t) + 1 for t in set(tokens)), reverse=True)[:1]) * k
    while len(_powers) <= longest:
        _powers.append(_powers[-1] * BASE % PRIME)
    for t in tokens:
        v = kept.get(t)
        if v is None:
            v = kept[t] = token_hash(t)
        size = len(t) + 1
        h = (h * _powers[size] + v) % PRIME
        n += size
        prefix.append(h)
        length.append(n)
    powers = _powers
    return [(b - a * powers[y - x]) % PRIME for a, b, x, y in zip(prefix, prefix[k:], length, length[k:])]


def winnowed(hashes: list[int], window: int) -> list[int]:
    """The places winnowing selects: of each window of hashes the rightmost smallest; all if there is no whole window."""
    if len(hashes) < window:
        return list(range(len(hashes)))
    out: list[int] = []
    best: deque[int] = deque()
    for i, h in enumerate(hashes):
        while best and hashes[best[-1]] >= h:
            best.pop()
        best.append(i)
        if best[0] <= i - window:
            best.popleft()
        if i >= window - 1 and (not out or out[-1] != best[0]):
            out.append(best[0])
    return out


def _tokens(stream: list[str] | bytes) -> list[str]:
    from codesim.operators.submissions import unpacked

    return unpacked(stream)


def fingerprints(streams: DataFrame, key: str, tokens: str, schemes: list[Scheme]) -> DataFrame:
    """``key, scheme, k, hash, pos`` of array-of-string streams. Null and too short streams have none."""
    kind = streams.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for batch in batches:
            for one, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stream = _tokens(stream)
                for s in schemes:
                    k, window = (s.k, 4) if s.k else stream_k(len(stream))
                    hashes = gram_hashes(stream, k, kept)
                    places = winnowed(hashes, window) if s.winnowed else range(len(hashes))
                    n = len(places)
                    if n:
                        values = [hashes[p] for p in places] if s.winnowed else hashes
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([one] * n, batch.schema.field(0).type), pa.array([s.name] * n), pa.array([k] * n, pa.int32()), pa.array(values, pa.int64()), pa.array(list(places), pa.int32())],
                            [key, "scheme", "k", "hash", "pos"],
                        )
            if len(kept) > 1_000_000:
                kept.clear()

    return streams.select(key, tokens).where(F.col(tokens).isNotNull()).mapInArrow(run, f"`{key}` {kind}, scheme string, k int, hash bigint, pos int")


def hashed(cls: DataFrame, stream: str, scheme: Scheme) -> DataFrame:
    """``rep, set`` (distinct hashes with k, sorted) and ``first`` (hash, first place) of a scheme; submissions without any have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for batch in batches:
            reps, sizes, values, places = [], [0], [], []
            for rep, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = _tokens(tokens)
                k, window = (scheme.k, 4) if scheme.k else stream_k(len(tokens))
                hashes = np.array(gram_hashes(tokens, k, kept), np.int64)
                at = np.array(winnowed(hashes.tolist(), window), np.int32) if scheme.winnowed else np.arange(len(hashes), dtype=np.int32)
                if len(at):
                    own, first = np.unique(hashes[at], return_index=True)
                    reps.append(rep)
                    sizes.append(sizes[-1] + len(own))
                    values.append(own)
                    places.append(at[first])
            h, p = (pa.array(np.concatenate(x) if x else [], t) for x, t in ((values, pa.int64()), (places, pa.int32())))
            first = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([h, p], ["hash", "pos"]))
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.string()), first, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), h)], ["rep", "first", "set"])
            if len(kept) > 1_000_000:
                kept.clear()

    return cls.select("rep", stream).where(F.col(stream).isNotNull()).mapInArrow(run, "rep string, first array<struct<hash:bigint,pos:int>>, `set` array<bigint>")
