"""Long exact spans shared between records, by level-wise doubling.

A character is shared if a window of LEAST characters around it occurs again in a
text of another group; so the shared stretches are the union of the repeated windows of
that one length, and longer repeats need no levels of their own. Repetition is tested
at LEAST / 4, / 2 and / 1 characters, and only what is repeated (in different groups) at one
length is extended to the next:

1. Each window of LEAST is represented by the window of LEAST / 4 with the smallest
   hash within it, its anchor. Equal windows have equal anchors at equal places, so
   windows whose anchor occurs in one group only are not repeated. (Anchors are
   about 1 in LEAST / 3 positions; hashes of the others are never shuffled.)
2. An anchor is doubled to its left and to its right. A window contains one of the
   two doubles, and lives on only if that one is repeated.
3. The surviving windows of one anchor are neighbours: they form a run, which is
   hashed as a whole. A run repeated as a whole needs no more; of an anchor some of
   whose runs are not, the windows are hashed one by one, once for each different run.

Hashes of 64 bits are compared within the texts of one anchor alone (runs by anchor, hash and length,
windows by anchor and hash), so a false match needs two texts that share an anchor and
whose windows have one hash: of m windows around an anchor about m^2 / 2^65 are expected.

What is shuffled are hashes with the least and greatest group that has them, which are
combined before the shuffle; nowhere do two texts meet as a pair. Work is linear
in the characters, whatever number of texts share a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesim.session import checkpointed, spread

LEAST = 200
BLOCK = 1 << 22  # characters hashed at once


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of all windows of a run of characters: differences of a prefix sum of scrambled characters times powers."""

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

    _powers = _inverses = np.ones(1, np.uint64)

    def __init__(self, characters: np.ndarray) -> None:
        n = len(characters)
        if len(Hashes._powers) <= n:
            # the inverse power moves every window to the same place
            Hashes._powers = self._geometric(int(self.BASE), 2 * n)
            Hashes._inverses = self._geometric(pow(int(self.BASE), -1, 1 << 64), 2 * n)
        self.inverses = Hashes._inverses
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(characters.astype(np.uint64) + np.uint64(1)) * Hashes._powers[:n], out=self.sums[1:])

    @staticmethod
    def _geometric(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """Hashes of the windows [start, start + length)."""
        return _mix((self.sums[start + length] - self.sums[start]) * self.inverses[start] + np.asarray(length).astype(np.uint64))


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the (leftmost) place of the smallest of values[i : i + width]."""
    n = len(values) - width + 1
    packed = (values & ~np.uint64((1 << 26) - 1)) | np.arange(len(values), dtype=np.uint64)
    padded = np.concatenate([packed, np.full(-len(packed) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64((1 << 26) - 1)).astype(np.int64)


def anchors(text: str, least: int) -> dict[str, np.ndarray] | None:
    """The anchors of a text: place, first and last window start, hashes of anchor and of its two doubles.

    None if the text has no window. A double that would leave the text has hash 0.
    Long texts are read in overlapping blocks.
    """
    part = least // 4
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < least:
        return None
    found: list[np.ndarray] = []
    for begin in range(0, len(codes) - least + 1, BLOCK):
        block = codes[max(0, begin - least) : begin + BLOCK + 2 * least]
        shift = max(0, begin - least)
        h = Hashes(block)
        starts = np.arange(begin - shift, min(begin + BLOCK, len(codes) - least + 1) - shift)
        small = h.of(np.arange(len(block) - part + 1), part)
        at = _sliding_argmin(small[: starts[-1] + least - part + 1], least - part + 1)[starts]
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        place = at[new]
        first, last = starts[new], np.r_[starts[new[1:]] - 1, starts[-1]]
        left = np.where(place >= part, h.of(np.maximum(place - part, 0), 2 * part), 0)
        fits = place + 2 * part <= len(block)
        right = np.where(fits, h.of(np.where(fits, place, 0), 2 * part), 0)
        found.append(np.stack([place + shift, first + shift, last + shift, small[place].view(np.int64), left.view(np.int64), right.view(np.int64)]))
    rows = np.concatenate(found, axis=1)
    return dict(zip(("place", "first", "last", "small", "left", "right"), rows, strict=True))


ANCHOR_SCHEMA = "cls binary, place int, first int, last int, small bigint, left bigint, right bigint"


def _anchors(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            ids, parts = [], []
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = anchors(text, least)
                if rows is not None:
                    ids.extend([cls] * len(rows["place"]))
                    parts.append(rows)
            columns = [pa.array(ids, pa.binary())]
            for name, kind in (("place", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("small", pa.int64()), ("left", pa.int64()), ("right", pa.int64())):
                columns.append(pa.array(np.concatenate([p[name] for p in parts]) if parts else np.empty(0, np.int64), pa.int64()).cast(kind))
            yield pa.RecordBatch.from_arrays(columns, ["cls", "place", "first", "last", "small", "left", "right"])

    return run


def _windows(least: int, whole: bool):
    """Of (cls, text, spans[small, first, last, run]): a hash for each span as a whole, or for each of its windows (h; first counts from the span's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for cls, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                spans.sort(key=lambda s: s["first"])
                for a in range(0, len(spans), 2_000):  # of one text's spans so many at once, which lie close to each other
                    some = spans[a : a + 2_000]
                    small, first, last, of = (np.array([s[k] for s in some], np.int64) for k in ("small", "first", "last", "run"))
                    begin = int(first[0])
                    h = Hashes(codes[begin : int(last.max()) + least])
                    if whole:
                        out = [small, of, first, last, h.of(first - begin, last - first + least).view(np.int64)]
                    else:
                        count = last - first + 1
                        offset = np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
                        out = [np.repeat(small, count), np.repeat(of, count), offset, np.repeat(last - first, count), h.of(np.repeat(first - begin, count) + offset, least).view(np.int64)]
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([cls] * len(out[0]), pa.binary()), *(pa.array(o, pa.int64()).cast(k) for o, k in zip(out, kinds, strict=True))], ["cls", "small", "run", "first", "last", "h"])

    return run


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys whose rows come from more than one group (columns g0 and g1: least and greatest group of a row)."""
    return rows.groupBy(*keys).agg(F.min("g0").alias("g0"), F.max("g1").alias("g1")).where("g0 <> g1").select(*keys)


def shared_spans(texts: DataFrame, keys: list[str], group: str, text: str, least: int = LEAST) -> DataFrame:
    """``keys``, ``start_pos``, ``end_pos``: each maximal run of characters that lie in a span of at least ``least`` characters that also occurs in a text with another ``group``.

    Positions count code points from 1, ends included. ``least`` is a multiple of 4. Rows with a
    null text are in no case; a null group is a group of its own. Equal rows of keys give
    one case each position. Equal texts are handled once.
    """
    if least < 8 or least % 4:
        raise ValueError("least must be a multiple of 4, and 8 or more")
    part = least // 4
    rows = texts.select(*keys, F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("g"), F.col(text).alias("t")).where(F.length(text) >= least)
    rows = rows.withColumn("cls", F.unhex(F.md5("t")))
    classes = checkpointed(rows.groupBy("cls").agg(F.first("t").alias("t"), F.min("g").alias("g0"), F.max("g").alias("g1")))
    groups = classes.select("cls", "g0", "g1")
    found = checkpointed(spread(classes.select("cls", "t")).mapInArrow(_anchors(least), ANCHOR_SCHEMA).join(groups, "cls"))
    # 1: anchors
    live = checkpointed(found.join(_repeated(found, ["small"]), "small", "left_semi"))
    # 2: doubles; a window that starts at or before place - part holds the left one, all others the right one
    doubles = live.select(F.explode(F.array("left", "right")).alias("d"), "g0", "g1").where("d <> 0")
    again = _repeated(doubles, ["d"])
    split = F.col("place") - part
    sides = live.select("cls", "g0", "g1", "small", F.explode(F.array(
        F.struct(F.col("left").alias("d"), F.col("first"), F.least("last", split).alias("last"), F.lit(0).alias("side")),
        F.struct(F.col("right").alias("d"), F.greatest(F.col("first"), split + 1).alias("first"), F.col("last"), F.lit(1).alias("side")),
    )).alias("s")).select("cls", "g0", "g1", "small", "s.d", "s.first", "s.last", "s.side").where("first <= last")
    runs = sides.join(again, "d", "left_semi").select("cls", F.struct("small", "first", "last", F.lit(0).cast("bigint").alias("run")).alias("span"))

    def hashed(spans: DataFrame, whole: bool) -> DataFrame:
        listed = spans.groupBy("cls").agg(F.collect_list("span").alias("spans"))  # those of one text
        return classes.select("cls", "t").join(listed, "cls").select("cls", "t", "spans").mapInArrow(_windows(least, whole), "cls binary, small bigint, run bigint, first int, last int, h bigint")

    # 3: runs as a whole; of each different run the least and greatest group and one text
    whole = checkpointed(hashed(runs, True).join(groups, "cls").select("cls", "small", "h", "first", (F.col("last") - F.col("first")).alias("size"), "g0", "g1"))
    run = ["small", "h", "size"]
    met = checkpointed(whole.groupBy(*run).agg(F.min("g0").alias("g0"), F.max("g1").alias("g1"), F.min(F.struct("cls", "first")).alias("at")))
    # windows of those of one group, and of all others with the same anchor
    alone = met.where("g0 = g1")
    asked = met.join(alone.select("small").distinct(), "small", "left_semi")
    spans = asked.select("at.cls", F.struct("small", F.col("at.first").alias("first"), (F.col("at.first") + F.col("size")).alias("last"), F.col("h").alias("run")).alias("span"))
    windows = hashed(spans, False).select("small", F.col("run").alias("h"), F.col("last").alias("size"), F.col("first").alias("offset"), F.col("h").alias("w"))
    windows = checkpointed(windows.join(asked.select(*run, "g0", "g1"), run))
    # equal windows have equal anchors, so only windows of one anchor can be taken for each other
    single = windows.where("g0 = g1").join(_repeated(windows, ["small", "w"]), ["small", "w"], "left_semi").select(*run, "offset")
    island = F.col("offset") - F.row_number().over(Window.partitionBy(*run).orderBy("offset"))
    pieces = single.withColumn("i", island).groupBy(*run, "i").agg(F.min("offset").alias("a"), F.max("offset").alias("b")).drop("i")
    entire = met.where("g0 <> g1").select(*run, F.lit(0).alias("a"), F.col("size").alias("b"))
    # back to every text that has the run, and joined up
    covered = whole.join(pieces.unionByName(entire), run).select("cls", (F.col("first") + F.col("a") + 1).alias("s"), (F.col("first") + F.col("b") + least).alias("e"))
    order = Window.partitionBy("cls").orderBy("s", "e")
    begins = F.col("s") > F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) + 1
    merged = covered.withColumn("k", F.sum(F.when(begins, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("cls", "k").agg(F.min("s").alias("start_pos"), F.max("e").alias("end_pos"))
    return rows.select(*keys, "cls").distinct().join(merged, "cls").select(*keys, "start_pos", "end_pos")


def shared_code(evidence: DataFrame, reports: DataFrame, least: int = LEAST) -> DataFrame:
    """``field, rec_id, start_pos, end_pos`` of code_a and code_b of evidence and full_source_a of similarity_evidence, shared with other results."""
    sides = [(evidence, "block_id", "code_a"), (evidence, "block_id", "code_b"), (reports, "evidence_id", "full_source_a")]
    texts = [t.select(F.lit(c).alias("field"), F.col(k).alias("rec_id"), "result_id", F.col(c).alias("t")) for t, k, c in sides]
    return shared_spans(texts[0].union(texts[1]).union(texts[2]), ["field", "rec_id"], "result_id", "t", least)
