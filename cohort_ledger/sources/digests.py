"""Digests of files of any size, read in ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGE_BYTES = 8 << 20  #: bytes of a file that are held at a time
LOCAL = "file:"


def located(path: str) -> tuple:
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if path.startswith(LOCAL):  # Spark writes file:/x as well as file:///x
        return fs.LocalFileSystem(), "/" + path[len(LOCAL) :].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _open(path: str):
    """A stream of the bytes at a path or URI."""
    system, inner = located(path)
    return system.open_input_stream(inner, compression=None)


def _digest(path: str | None, algorithm: str, step: int) -> tuple[str | None, int | None]:
    if path is None:
        return None, None
    found, size = hashlib.new(algorithm), 0
    try:
        with _open(path) as stream:
            while part := stream.read(step):
                found.update(part)
                size += len(part)
    except FileNotFoundError:
        return None, None
    return found.hexdigest(), size


def file_digests(paths: DataFrame, column: str = "path", algorithm: str = "md5", step: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """(path, digest, size) of every distinct path of a table of paths.

    ``binaryFile`` reads a file as one row, which ends at 2 GiB.  Here a task
    opens a path and carries its digest from range to range, so memory stays at
    one range however long the file is.  Paths are dealt to tasks by hash, in
    ``tasks`` parts or as many as a shuffle has, and never gathered on the driver;
    a list of paths is small, so its size says nothing of the work.  A digest runs
    through its file in order, so one file is one task's work.  Paths may be of
    any file system that pyarrow opens from a URI (local, HDFS, S3, GCS).

    A file that is not there, or a NULL path, has a NULL digest and size.  Other
    faults (no access, a folder) end the job, so that they do not pass for gone.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [_digest(name, algorithm, step) for name in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([d for d, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["path", "digest", "size"]
            )

    tasks = tasks or int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt before it is made distinct: a like exchange behind would be left out, and its parts joined by size.
    dealt = paths.select(F.col(column).cast("string").alias("path")).repartition(tasks, "path").distinct()
    return dealt.mapInArrow(run, "path string, digest string, size long")
