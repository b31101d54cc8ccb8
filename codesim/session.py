"""Session helpers: settings every plan relies on, and where lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, app: str = "codesim") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CODESIM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut ``df``'s lineage by an eager reliable checkpoint.

    The folder is that of ``spark.checkpoint.dir`` (shared by the cluster). Only in a local
    session that names none, as in tests, a temporary one is set; elsewhere that is an error.
    ``forget`` removes the files once nothing reads them.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or _own_folder())
    kept = df.checkpoint(eager=True)
    # A checkpoint keeps its plan's estimated size, which joins multiply: over a chain of checkpoints the
    # number's digits double until planning costs more than running. A frame over its rows has none.
    rows = kept._jdf.queryExecution().toRdd()
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, kept._jdf.schema(), False), spark)
    out._checkpoint = kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    return out


def forget(*kept: DataFrame | None) -> None:
    """Delete the files of ``checkpointed`` tables that no later plan reads. Others are left alone."""
    for df in kept:
        file = getattr(df, "_checkpoint", None)
        if file is not None and file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _own_folder() -> str:
    """A temporary folder of a local session, gone when the process ends."""
    folder = tempfile.mkdtemp(prefix="codesim-checkpoint-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def parallelism(spark: SparkSession) -> int:
    """Partitions for stages whose cost is in the rows' content: adaptive execution would size them by their few bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


SPREAD_BYTES = 4 << 20  # of a small input's files that a task may hold


def spread(df: DataFrame) -> DataFrame:
    """Repartition ``df``, a scan without shuffles, when it has fewer partitions than the cluster has cores.

    One row-group files are read by one task; a Python stage after them would then run
    on one core. There are as many partitions as cores, and more for more bytes. Inputs that already have enough splits are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, min(size // SPREAD_BYTES, 16 * cores)))


def clean_id(c: Column | str) -> Column:
    """Ids compared trimmed and in lower case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
