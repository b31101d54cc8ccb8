"""Only new or changed records: Merkle trees over key ranges of a table.

A record has a 64-bit code: the hash of its key, or, if records come in some order (a time
of arrival, a serial number), its period in that order and then the hash, so that new records
share their ranges. Codes are cut into ranges by their leading bits, FANOUT_BITS a level; there are
as many levels as leave about LEAF_RECORDS to a leaf. A leaf's digest covers its records
independent of their order, an inner node's digest covers its children. Two trees are
compared from the root down, and only below nodes whose digests differ; the records
of the leaves found so are the only ones read in full.

``ChangeLog`` keeps the tree of the last published run beside its output. Both
become visible by one rename, so a run that fails leaves no trace: the
next one sees the old tree and neither skips nor repeats a record.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesim.session import checkpointed

FANOUT_BITS = 4
PERIOD_BITS = 32  # of a code, if records have periods
LEAF_RECORDS = 4_096
BROADCAST_LEAVES = 100_000  # changed leaves (8 bytes each) that are sent to every task; more are joined by a shuffle
HOMES = 32  # runs over which entries may lie before they are written together


def depth_for(records: int, periods: bool = False) -> int:
    """Levels below the root for a table of so many records."""
    hashed = max(1, math.ceil(math.log(max(records, 1) / LEAF_RECORDS, 1 << FANOUT_BITS)))
    return min(hashed, (64 - PERIOD_BITS) // FANOUT_BITS) + PERIOD_BITS // FANOUT_BITS if periods else min(hashed, 64 // FANOUT_BITS)


def _period(by: tuple[str, float] | None) -> Column | None:
    """The number of a record's period: of a column of numbers, dates or times (then in seconds), and its width; 0 for null."""
    if by is None:
        return None
    column, width = by
    return F.pmod(F.coalesce(F.floor(F.unix_micros(F.col(f"`{column}`").cast("timestamp")) / F.lit(width * 1e6)), F.lit(0)).cast("bigint"), F.lit(1 << PERIOD_BITS))


def _marked(df: DataFrame, key: list[str], payload: list[str], by: tuple[str, float] | None = None) -> DataFrame:
    """The rows as ``record``, with ``_code`` and ``_row`` (digest of key and payload); whatever their columns are called.

    Null keys and payloads are values of their own: columns are written as JSON, in which nulls are kept.
    """
    if by is not None and by[0] not in key + payload:
        payload = [*payload, by[0]]
    as_json = lambda cols: F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"})
    code = F.xxhash64(as_json(key))
    period = _period(by)
    if period is not None:
        code = F.shiftleft(period, 64 - PERIOD_BITS).bitwiseOR(F.shiftrightunsigned(code, PERIOD_BITS))
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), code.alias("_code"), F.md5(as_json(key + payload)).alias("_row"))


def _leaf(depth: int) -> Column:
    return F.shiftrightunsigned("_code", 64 - FANOUT_BITS * depth) if FANOUT_BITS * depth < 64 else F.col("_code")


def _leaves(rows: DataFrame, depth: int) -> DataFrame:
    """``_leaf, n, x, y`` of rows (_code, _row): the number and the sums modulo 2 of different row digests. Repeated records count once."""
    half = lambda a: F.conv(F.substring("_row", a, 15), 16, 10).cast("bigint")
    return rows.select(_leaf(depth).alias("_leaf"), "_row").distinct().groupBy("_leaf").agg(F.count("*").alias("n"), F.bit_xor(half(1)).alias("x"), F.bit_xor(half(16)).alias("y"))


def tree(marked: DataFrame, depth: int) -> DataFrame:
    """The tree as a checkpointed table: level (0 is the root), node, digest, n, x, y.

    A parent's digest follows from its children's; the table has at most one row for each range.
    """
    return checkpointed(_grown(_leaves(marked, depth), depth))


def _grown(leaves: DataFrame, depth: int) -> DataFrame:
    """All levels over leaves (_leaf, n, x, y)."""
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.shiftrightunsigned("_leaf", FANOUT_BITS * (depth - k)) if k else F.lit(0).cast("bigint")).alias("node")) for k in range(depth + 1)]))
    nodes = leaves.withColumn("at", levels).groupBy("at.level", "at.node").agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    return nodes.withColumn("digest", F.md5(F.concat_ws(":", "n", "x", "y")))


def changed_leaves(current: DataFrame, saved: DataFrame, depth: int) -> DataFrame:
    """The leaves (column ``_leaf``) whose digests differ, found from the root down; checkpointed."""
    open_ = None
    for level in range(depth + 1):
        a, b = (t.where(F.col("level") == level).select("node", F.col("digest").alias(c)) for t, c in ((current, "da"), (saved, "db")))
        differing = a.join(b, "node", "full_outer").where(~F.col("da").eqNullSafe(F.col("db"))).select("node")
        if open_ is not None:  # only children of nodes that differ
            parent = F.shiftrightunsigned("node", FANOUT_BITS) if level > 1 else F.lit(0).cast("bigint")
            differing = differing.withColumn("parent", parent).join(open_.withColumnRenamed("node", "parent"), "parent", "left_semi").drop("parent")
        open_ = differing
    return checkpointed(open_.withColumnRenamed("node", "_leaf"))


def _sent(leaves: DataFrame) -> DataFrame:
    """Changed leaves, to be broadcast if they are few; they are counted, as their number grows with the table."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def changed_records(current: DataFrame, saved: DataFrame, key: list[str], payload: list[str], depth: int | None = None, by: tuple[str, float] | None = None) -> DataFrame:
    """The records of ``current`` that ``saved`` lacks or holds with another payload.

    Columns are those of ``current``; only ``key`` and ``payload`` are compared, and
    ``saved`` needs just these. A repeated record comes out as often as it is there.
    Empty tables give no rows, or all of ``current`` when ``saved`` is empty. ``by`` names a column in whose
    order records come, and the width of its periods; it belongs to the payload. ``depth`` follows from the records' number if it is None.
    """
    depth = depth_for(max(current.count(), saved.count()), by is not None) if depth is None else depth
    a, b = (_marked(t, key, payload, by).withColumn("_leaf", _leaf(depth)) for t in (current, saved))
    leaves = _sent(changed_leaves(tree(a, depth), tree(b, depth), depth))
    return a.join(leaves, "_leaf", "left_semi").join(b.join(leaves, "_leaf", "left_semi").select("_row"), "_row", "left_anti").select("record.*")


class ChangeLog:
    """Runs over a growing table, each of which processes only what was added or changed.

    ``root`` is a folder all executors share, on a file system that renames folders at once. A run writes
    into a folder of its own: ``changed`` (the records of the leaves that differ, read from the source
    once; all that follows is made of these), ``output``, ``entries`` (their digests) and ``leaves`` (all leaves,
    each with the run that holds its entries). The folder becomes ``run-n`` by a rename, which only one of
    several runs at a time can do. Runs without it never happened.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], payload: list[str], depth: int | None = None, by: tuple[str, float] | None = None) -> None:
        self.spark, self.root, self.key, self.payload, self.depth, self.by = spark, root.rstrip("/"), key, payload, depth, by

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The number of the last published run, 0 before the first."""
        fs, p = self._fs(), self._path(self.root)
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([0, *(int(n.split("-")[1]) for n in names if n.startswith("run-"))])

    def _publish(self, at: str, n: int) -> None:
        """The run's folder gets its number; fails if another run has it already."""
        rename = self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename", True, self.spark._jvm.Thread.currentThread().getContextClassLoader())
        array = self.spark._jvm.java.lang.reflect.Array.newInstance(rename, 0)  # no option: nothing is overwritten
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._path(at), self._path(f"{self.root}/run-{n}"), array)
        except Exception as e:
            raise OSError(f"run {n} of {self.root} could not be published") from e

    def run(self, current: DataFrame, work) -> int:
        """Give ``work`` the new and changed records, keep what it returns, publish both. Returns the run's number.

        Whatever arrives while the run goes on is in ``changed``, and so in both output and tree, or is left to the next run.
        """
        last = self.last()
        at = f"{self.root}/attempt-{uuid.uuid4().hex}"
        try:
            self._write(current, work, last, at)
            self._publish(at, last + 1)
        finally:
            self._fs().delete(self._path(at), True)
        return last + 1

    def _write(self, current: DataFrame, work, last: int, at: str) -> None:
        read = self.spark.read.parquet
        depth = self.depth or depth_for(current.count(), self.by is not None)
        marked = _marked(current, self.key, self.payload, self.by).withColumn("_leaf", _leaf(depth))
        together = True  # are entries of all leaves written, or of changed ones?
        if last:
            old = read(f"{self.root}/run-{last}/leaves")
            homes = [tuple(r) for r in old.select("run", "depth").distinct().collect()]  # a number a run, HOMES at most
            entries = reduce(DataFrame.unionByName, [read(f"{self.root}/run-{h}/entries").select("_code", "_row", _leaf(d).alias("_leaf"), F.lit(h).alias("run")) for h, d in homes])
            entries = entries.join(old.select("_leaf", "run"), ["_leaf", "run"], "left_semi").withColumn("_leaf", _leaf(depth))
            together = len(homes) >= HOMES or any(d != depth for _, d in homes)
            before = (_leaves(entries, depth) if together else old.select("_leaf", "n", "x", "y"))
            leaves = _sent(changed_leaves(tree(marked, depth), checkpointed(_grown(before, depth)), depth))
            known = entries.join(leaves, "_leaf", "left_semi").select("_row", F.lit(True).alias("_known")).distinct()
            fresh = marked.join(leaves, "_leaf", "left_semi").join(known, "_row", "left").select("record", "_code", "_row", F.col("_known").isNull().alias("_new"))
        else:
            fresh = marked.select("record", "_code", "_row", F.lit(True).alias("_new"))
        fresh.write.parquet(f"{at}/changed")
        changed = read(f"{at}/changed")
        work(changed.where("_new").select("record.*")).write.parquet(f"{at}/output")
        mine = changed.select("_code", "_row").distinct()
        if last and together:
            mine = mine.unionByName(entries.join(leaves, "_leaf", "left_anti").select("_code", "_row"))
        mine.write.parquet(f"{at}/entries")
        table = _leaves(read(f"{at}/entries"), depth).withColumn("run", F.lit(last + 1))
        if last and not together:
            table = table.unionByName(old.join(leaves, "_leaf", "left_anti").select("_leaf", "n", "x", "y", "run"))
        table.withColumn("depth", F.lit(depth)).write.parquet(f"{at}/leaves")
        self._fs().delete(self._path(f"{at}/changed"), True)


def unread_uploads(submissions: DataFrame, runs: DataFrame) -> DataFrame:
    """``sub_id, artifact_id`` of each current upload that no successful run read.

    Rows without artifact_id do not count. The current upload is that of the row with the
    latest submitted_at, then the latest arrived_at (null times are earliest, the
    greater artifact_id wins what is left). Null run statuses and artifact lists count
    as nothing. A null sub_id is one submission of its own.
    """
    sent = submissions.where("artifact_id IS NOT NULL").select("sub_id", "artifact_id", "submitted_at", "arrived_at")
    good = runs.where(F.lower(F.trim("status")) == "completed").select("run_id").distinct()
    read = runs.join(good, runs.run_id.eqNullSafe(good.run_id), "left_semi").select(F.explode("artifact_ids").alias("artifact_id")).where("artifact_id IS NOT NULL").distinct()
    unread = changed_records(sent.select("artifact_id").distinct(), read, ["artifact_id"], [])
    current = sent.groupBy("sub_id").agg(F.max(F.struct("submitted_at", "arrived_at", "artifact_id")).alias("last")).select("sub_id", F.col("last.artifact_id").alias("artifact_id"))
    return current.join(unread, "artifact_id", "left_semi").select("sub_id", "artifact_id")
