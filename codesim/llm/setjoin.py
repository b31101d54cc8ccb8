"""All similar pairs between records that are sets, by multi-index binary sketches.

Each set is sketched by one-bit minhashes packed into a code: two sets of Jaccard
similarity J agree in a bit with probability (1 + J) / 2. The code is cut into segments; records that
agree in any whole segment are candidates (by the pigeonhole principle all pairs
within as many differing bits as there are segments but one are, and for more differing bits the number of
segments is calibrated). A segment is about log2 of the number of sets long, so that chance
agreements stay few a record at any size. CHECK more bits of the code travel with the segments: candidates that differ in
more of them than a calibrated radius are dropped within the join, the rest are verified on the
original sets. ``calibrated`` derives segments and radius from the threshold and
the recall wanted there; pairs above the threshold are found more surely still.

Equal sets are one class throughout, so copies never meet in the join; what comes out
are pairs between classes and the members of each class (``similar_sets``, whose size is that of the answer
between different sets), or all pairs of records if asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesim.session import checkpointed, spread

BITS = 20  # of a segment, unless the number of sets tells
CHECK = 128  # bits that every segment's row carries
MISS = 5e-5  # share of the pairs exactly at the threshold that may agree in no segment
FAR = 1e-7  # share of the pairs exactly at the threshold that may lie outside the radius


def calibrated(threshold: float, miss: float = MISS, bits: int = BITS, checked: int | None = None) -> tuple[int, int]:
    """``segments, radius``: at Jaccard = threshold at most ``miss`` of the pairs agree in no segment, and at most FAR differ in more than radius of the ``checked`` bits (all segments' if None)."""
    agree = (1 + threshold) / 2
    segments = max(1, math.ceil(math.log(miss) / math.log1p(-(agree**bits)))) if agree < 1 else 1
    n, p = checked or segments * bits, 1 - agree
    if p == 0:
        return segments, 0
    share = lambda k: math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(agree))
    radius, beyond = n, 0.0
    while radius > 0 and beyond + share(radius) <= FAR:  # the binomial's tail
        beyond += share(radius)
        radius -= 1
    return segments, radius


def bits_for(sets: int) -> int:
    """Of a segment, for so many different sets."""
    return max(8, min(40, math.ceil(math.log2(max(sets, 2))) + 1))


def _mixers(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def sketch_bits(elements: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One bit per hash function for a non-empty set of 64-bit element hashes."""
    low = (elements & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    high = (elements >> np.uint64(32)).astype(np.uint32)
    best = None
    for x, y in zip(low, high, strict=True):
        h = (x * mul + (y ^ add)).astype(np.uint32)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        best = h if best is None else np.minimum(best, h)
    best ^= best >> np.uint32(16)  # the bit comes from a mix of the smallest value, not from its (small) head
    best *= np.uint32(0x297A2D39)
    best ^= best >> np.uint32(15)
    return (best & np.uint32(1)).astype(np.uint8)


def _sketches(segments: int, bits: int):
    mul, add = _mixers(segments * bits + CHECK)
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            keys, codes = [], []
            for elements in batch.column(1).to_pylist():
                b = sketch_bits(np.array(elements, dtype=np.int64).view(np.uint64), mul, add)
                keys.append(b[: segments * bits].reshape(segments, bits) @ weights)
                codes.append(np.packbits(b[segments * bits :]).view(np.int64))
            values = np.concatenate(keys) if keys else np.empty(0, np.int64)
            code = np.stack(codes) if codes else np.empty((0, CHECK // 64), np.int64)
            offsets = np.arange(len(keys) + 1, dtype=np.int32) * segments
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64())), *(pa.array(code[:, k]) for k in range(CHECK // 64))],
                ["id", "n", "parts", *(f"c{k}" for k in range(CHECK // 64))],
            )

    return run


def similar_sets(records: DataFrame, key: str, elements: str, threshold: float, miss: float = MISS, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``pairs(ca, cb, jaccard)`` of similar classes of equal sets, ca < cb, and ``members(key, cls)``.

    ``elements`` is an array of strings; one row per key. Nulls and repeats in it do not
    count, records with no element are in no class. jaccard >= threshold, exactly
    computed on the sets. Extra columns are ignored. A smaller ``miss`` costs more segments, in proportion to its logarithm.
    """
    sets = records.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(F.filter(elements, lambda x: x.isNotNull()))).alias("els")).where(F.size("els") > 0)
    named = F.array_join(F.transform("els", lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), "")
    sets = checkpointed(sets.withColumn("name", F.unhex(F.md5(named))))
    classes = checkpointed(sets.groupBy("name").agg(F.first("els").alias("els")).withColumns({"n": F.size("els"), "id": F.monotonically_increasing_id()}))
    members = sets.select("key", "name").join(classes.select("name", "id"), "name").select(F.col("key").alias(key), F.col("id").alias("cls"))
    bits = bits or bits_for(classes.count())
    segments, radius = calibrated(threshold, miss, bits, CHECK)
    hashed = spread(classes.select("id", F.transform("els", lambda x: F.xxhash64(x)).alias("h"), "n"))
    checks = [f"c{k}" for k in range(CHECK // 64)]
    sketched = hashed.mapInArrow(_sketches(segments, bits), f"id bigint, n int, parts array<bigint>, {', '.join(c + ' bigint' for c in checks)}")
    keyed = checkpointed(sketched).select("id", "n", *checks, F.posexplode("parts").alias("seg", "part")).withColumn("part", F.col("seg").cast("bigint") * F.lit(1 << bits) + F.col("part")).drop("seg")
    a, b = (keyed.select("part", *[F.col(c).alias(c + side) for c in ("id", "n", *checks)]) for side in "ab")
    apart = sum((F.bit_count(F.col(c + "a").bitwiseXOR(F.col(c + "b"))) for c in checks[1:]), F.bit_count(F.col(checks[0] + "a").bitwiseXOR(F.col(checks[0] + "b"))))
    # sizes alone bound the similarity
    near = a.join(b, "part").where((F.col("ida") < F.col("idb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold - 1e-9)) & (apart <= radius)).select(F.col("ida").alias("ca"), F.col("idb").alias("cb")).distinct()
    full = near.join(classes.select(F.col("id").alias("ca"), F.col("els").alias("ea")), "ca").join(classes.select(F.col("id").alias("cb"), F.col("els").alias("eb")), "cb")
    both = F.size(F.array_intersect("ea", "eb"))
    pairs = full.select("ca", "cb", both.alias("i"), (F.size("ea") + F.size("eb") - both).alias("u")).where(F.col("i") >= F.lit(threshold - 1e-12) * F.col("u"))
    return pairs.select("ca", "cb", (F.col("i") / F.col("u")).alias("jaccard")), members


def similar_records(subtrees: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``sub_a, sub_b`` (sub_a < sub_b): records of subtree_hashes whose sets of (level, hash) have jaccard >= threshold.

    A record is all rows with one sub_id; hashes are trimmed and in lower case. Null sub_ids are
    no records. Equal sets pair with each other by their class.
    """
    levels = ("statement", "block", "method")
    arrays = [F.transform(F.coalesce(level, F.array().cast("array<string>")), lambda x: F.concat(F.lit(level[0] + ":"), F.lower(F.trim(x)))) for level in levels]
    rows = subtrees.where("sub_id IS NOT NULL").select("sub_id", F.explode(F.concat(*arrays)).alias("e")).where("e IS NOT NULL").distinct()
    records = rows.groupBy("sub_id").agg(F.collect_list("e").alias("els"))
    pairs, members = similar_sets(records, "sub_id", "els", threshold)
    left, right = members.select(F.col("cls").alias("ca"), F.col("sub_id").alias("x")), members.select(F.col("cls").alias("cb"), F.col("sub_id").alias("y"))
    crossed = pairs.join(left, "ca").join(right, "cb").select(F.least("x", "y").alias("sub_a"), F.greatest("x", "y").alias("sub_b"))
    equal = left.join(right.withColumnRenamed("cb", "ca"), "ca").where("x < y").select(F.col("x").alias("sub_a"), F.col("y").alias("sub_b"))
    return crossed.union(equal)
