"""Archives of source files as a table, with every limit checked on actual bytes.

An archive is hostile input: names are cleaned, links and junk skipped, sizes, counts,
ratios and nesting bounded. Nothing is written to disk. An archive that breaks a
limit gives one row with its error and no files; it never fails the job.
"""

from __future__ import annotations

import io
import stat
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are taken, and the limits.
SUFFIXES = (".java", ".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hxx")
MB = 1 << 20


class EngineError(Exception):
    """An archive or file that cannot be taken."""


class CorruptZipError(EngineError):
    pass


class EmptySubmissionError(EngineError):
    pass


class UnsupportedFileTypeError(EngineError):
    pass


class ZipTooLargeError(EngineError):
    pass


class ZipBombError(EngineError):
    pass


class PathTraversalError(EngineError):
    pass


class NestedZipDepthError(EngineError):
    pass


@dataclass(frozen=True)
class Limits:
    files: int = 5000
    archive: int = 100 * MB
    expanded: int = 500 * MB
    file: int = 10 * MB
    depth: int = 10
    path: int = 260
    ratio: float = 100.0


def clean_name(name: str, limits: Limits = Limits()) -> str:
    """An entry's path without empty parts, ``.`` and ``..``."""
    path = "/".join(p for p in name.replace("\\", "/").split("/") if p not in ("", ".", ".."))
    if len(path) > limits.path:
        raise PathTraversalError(f"path of {len(path)} characters")
    return path


def junk(name: str) -> bool:
    return name.startswith("__MACOSX") or name.endswith(".DS_Store")


def _read(z: zipfile.ZipFile, entry: zipfile.ZipInfo, most: int) -> bytes | None:
    """The entry's bytes, None if there are more than ``most``."""
    with z.open(entry) as f:
        data = f.read(most + 1)
    return None if len(data) > most else data


def unpack(data: bytes, limits: Limits = Limits(), depth: int = 0, under: str = "") -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of the files in an archive, those of nested archives in a folder of their name. Nested archives that break a limit are left out."""
    if depth > limits.depth:
        raise NestedZipDepthError(f"more than {limits.depth} levels")
    if len(data) > limits.archive:
        raise ZipTooLargeError(f"{len(data)} bytes")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            entries = z.infolist()
            declared = sum(e.file_size for e in entries)
            if len(entries) > limits.files:
                raise ZipTooLargeError(f"{len(entries)} entries")
            if declared > limits.expanded:
                raise ZipBombError(f"{declared} bytes declared")
            if data and declared / len(data) > limits.ratio:
                raise ZipBombError(f"ratio of {declared / len(data):.0f}")
            total = 0
            for e in entries:
                if e.is_dir() or junk(e.filename) or stat.S_ISLNK(e.external_attr >> 16) or e.file_size > limits.file:
                    continue
                name = clean_name(e.filename, limits)
                content = _read(z, e, limits.file)
                if content is None:
                    continue
                total += len(content)
                if total > limits.expanded:
                    raise ZipBombError(f"more than {limits.expanded} bytes")
                path = f"{under}{name}"
                if name.lower().endswith(".zip"):
                    try:
                        yield from list(unpack(content, limits, depth + 1, path[: -len(".zip")] + "/"))
                    except EngineError:
                        pass
                else:
                    yield path, content
    except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, zipfile.zlib.error) as e:
        raise CorruptZipError(str(e)) from e


def taken(name: str, data: bytes, limits: Limits = Limits()) -> list[tuple[str, str]]:
    """(path, text) of the source files of an upload, an archive or one file. UTF-8, what is not replaced."""
    if name.lower().endswith(".zip"):
        found = [(p, b) for p, b in unpack(data, limits) if p.lower().endswith(SUFFIXES) and 0 < len(b) <= limits.file]
    elif name.lower().endswith(SUFFIXES) or "." not in name.rsplit("/", 1)[-1]:
        found = [(clean_name(name, limits).rsplit("/", 1)[-1], data)] if data else []
    else:
        raise UnsupportedFileTypeError(name.rsplit(".", 1)[-1])
    if not found:
        raise EmptySubmissionError("no source file")
    return [(p, b.decode("utf-8", "replace")) for p, b in found]


SCHEMA = "path string, file string, text string, status string, error string"


def _rows(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(path, f, t, "ok", None) for f, t in taken(path, content or b"", limits)]
                except EngineError as e:
                    rows = [(path, None, None, "failed", f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], ["path", "file", "text", "status", "error"])

    return run


def archive_files(uploads: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """SCHEMA: one row a source file of ``uploads(path, content)``, or one with the error of an upload that cannot be taken."""
    return uploads.select("path", "content").mapInArrow(_rows(limits), SCHEMA)


def read_archives(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """The source files of all uploads below a folder. Small partitions, as one row may expand a hundred times."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    small = F.col("length") <= Limits().archive
    none = F.lit(None).cast("string")
    large = files.where(~small).select("path", none.alias("file"), none.alias("text"), F.lit("failed").alias("status"), F.concat(F.lit("ZipTooLargeError: "), F.col("length").cast("string"), F.lit(" bytes")).alias("error"))  # never read
    return archive_files(files.where(small)).unionByName(large)
