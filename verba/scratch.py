"""Scratch tables in the shared folder that the session names, and counted broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verba.runtime import prepare

#: Rows of (long, long) pairs up to which a side may be broadcast: about 64 MB as a hash relation.
BROADCAST_ROWS = 1_000_000
#: Rows of a few numbers that a file of a scratch table holds, where their count is known.
FILE_ROWS = 250_000
#: Bytes of rows that are written at once.
GROUP_BYTES = 8 << 20

_ROOTS: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """This session's scratch folder below ``spark.checkpoint.dir``.

    In local mode without such a setting (tests), a folder of its own is set; on a
    cluster that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("spark.checkpoint.dir is not set: scratch tables need a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="verba-scratch-")
            spark.sparkContext.setCheckpointDir(base)
        root = f"{base.rstrip('/')}/verba-{uuid.uuid4().hex}"
        _ROOTS[app] = (spark, root)
        atexit.register(sweep, spark)
    return _ROOTS[app][1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Delete this session's scratch folders; a stopped session's only where they are local files."""
    for app, (own, root) in list(_ROOTS.items()):
        if own is spark:
            del _ROOTS[app]
            try:
                remove(spark, root)
            except Exception:  # the session is gone
                if root.startswith("file:"):
                    shutil.rmtree(root[5:].replace("//", "/", 1), ignore_errors=True)


def plainly(path: str) -> dict[str, str]:
    """Write options of scratch files: no marker file, and in a local folder no checksum files.

    Without Hadoop's native library each new local file starts a process to set its
    mode, for a moment with the executor's whole memory; checksums make that four.
    """
    out = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
    if path.startswith("file:"):
        out |= {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    return out


def settled(run):
    """A function over Arrow batches that leaves its worker without what the partition needed."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return whole


_PLAIN = {T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType}


def plain(kind: T.DataType) -> bool:
    """Whether Arrow's Parquet files hold such values as Spark's do."""
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and all(plain(f.dataType) for f in kind.fields)
    return plain(kind.elementType) if isinstance(kind, T.ArrayType) else type(kind) in _PLAIN and kind == type(kind)()


def filed(folder: str, made=None):
    """A function over Arrow batches: writes them, or what ``made`` makes of them, into a file of a local folder, and gives the number of rows.

    A file gets its name, that of its partition, when it is whole; a repeated task replaces it.
    """

    def run(batches):
        part, own = TaskContext.get().partitionId(), f"{folder}/_{uuid.uuid4().hex}"
        writer, held, size, total = None, [], 0, 0
        try:
            for b in made(batches) if made else batches:
                if not b.num_rows:
                    continue
                writer = writer or pq.ParquetWriter(own, b.schema)
                held.append(b)
                size += b.nbytes
                total += b.num_rows
                if size >= GROUP_BYTES:
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                writer.write_table(pa.Table.from_batches(held))
            if writer:
                writer.close()
                os.replace(own, f"{folder}/part-{part:05d}.parquet")
        finally:
            with contextlib.suppress(FileNotFoundError):
                os.remove(own)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    return settled(run)


class Scratch:
    """A folder of one operator call; ``keep`` writes a table there and rereads it.

    Written tables cut lineage and survive lost executors.  ``drop`` deletes
    tables that nothing reads any more.  With ``workers``, files of a local folder are
    written by Python workers, which start no process for them (see ``plainly``); any
    other store, and columns that are not ``plain``, by Spark.
    """

    def __init__(self, spark: SparkSession, name: str, workers: bool = False):
        self.spark, self.workers = spark, workers
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, rows: int | None = None, per: int = FILE_ROWS, apart: bool = False, made=None, workers: bool = True) -> DataFrame:
        """Write and reread; of a table that has at most ``rows`` rows, ``per`` of them go into a file.

        ``apart`` is for few narrow rows that are made of wide ones: the tasks that make
        them stay as small as they are, and only the made rows are brought together.
        ``made`` is a function over Arrow batches and its columns: what it makes of the rows
        is written, by the same worker.  Without ``workers`` Spark writes, which rows that
        come out of a worker need: two workers for each task hold more memory.
        """
        path = f"{self.root}/{name}"
        if rows is not None:
            files = max(1, ceil_div(rows, per))
            df = df.repartition(files) if apart else df.coalesce(files)
        schema = T._parse_datatype_string(made[1]) if made else df.schema
        if self.workers and workers and path.startswith("file:") and plain(schema):
            folder = re.sub("^file:/+", "/", path)
            shutil.rmtree(folder, ignore_errors=True)
            os.makedirs(folder)
            prepare(self.spark)
            df.mapInArrow(filed(folder, made[0] if made else None), "n long").collect()
        else:
            df = df.mapInArrow(*made) if made else df
            df.write.mode("overwrite").options(**plainly(path)).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str, files: bool = True) -> None:
        """Delete tables; with ``files``, shuffle files of the jobs that wrote them may go too."""
        for name in names:
            remove(self.spark, f"{self.root}/{name}")
        if files:  # Spark deletes shuffle files when the driver has collected the plans that hold them
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The frame, hinted for broadcast if its counted rows are within the bound."""
    return (F.broadcast(df), True) if df.limit(rows + 1).count() <= rows else (df, False)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
