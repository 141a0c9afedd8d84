"""Shared folders, staged tables and small helpers for the operators here."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Arrow hands to Python at once; whole texts are long, so few.
BATCH_ROWS = 2000
#: Bytes of its own that a Python worker may keep between tasks.
KEPT = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the cluster's ``spark.checkpoint.dir``.  Only where that is unset and everything runs in one process, as in
    tests, a temporary folder is made and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage: a lost executor costs the lost tasks only, and rows that two
    consumers need are computed once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Staged tables of one computation, which go when it ends.

    Use it only around work whose result is staged elsewhere: what is read later must not be scratch.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.made = spark, fresh_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.path)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """As ``stage``.  The files of shuffles that nothing needs any more go, too."""
        self.made += 1
        path = f"{self.path}/{name}-{self.made}"
        df.write.option("compression", "lz4_raw").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        sweep(self.spark)
        return out

    def drop(self, name: str) -> None:
        """Delete the tables of this name."""
        jvm = self.spark.sparkContext._jvm
        for found in self._files(self.path).globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}-*")) or []:
            self._delete(found.getPath().toString())

    def _files(self, path: str):
        context = self.spark.sparkContext
        return context._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(context._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        self._files(path).delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps: it does so when the driver's JVM finds their plans unused."""
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of whole texts small (a session setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def own_bytes() -> int:
    """Resident bytes of this process without mapped files; 0 where the system does not tell."""
    try:
        with open("/proc/self/statm") as f:
            _, resident, shared = map(int, f.read().split()[:3])
    except OSError:
        return 0
    return (resident - shared) * os.sysconf("SC_PAGE_SIZE")


def hand_back() -> None:
    """Return memory that is free in this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(run: Callable, forget: Callable[[], None] | None = None) -> Callable:
    """``run``, a function for ``mapInArrow``, whose worker keeps at most ``KEPT`` bytes when the task ends.

    Workers stay for later tasks, of other steps too, and allocators keep what the largest task took.  ``forget`` empties what
    the worker holds from task to task, if it holds more.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if own_bytes() > KEPT:
                if forget:
                    forget()
                hand_back()

    return tidied


class Maybe:
    """A filter of fixed size for values: rows whose value is not among them mostly go.

    It has ``2 ** bits`` bits however many values there are, in at most ``2 ** bits / 64`` rows, so it may be broadcast.  It only
    spares work: rows that it lets through wrongly are dealt with by the join that follows.  Beyond some hundred million
    values it lets nearly all rows through.
    """

    def __init__(self, values: DataFrame, bits: int = 24):
        self.mask = (1 << bits) - 1
        place = self._place(values.columns[0])
        words = values.select(place.alias("b")).groupBy(F.expr("b div 64").alias("word_")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("bits_"))
        self.words = F.broadcast(stage(words, "filter"))

    def _place(self, column: str) -> F.Column:
        return F.xxhash64(F.col(column)).bitwiseAND(F.lit(self.mask))

    def _joined(self, df: DataFrame, column: str, how: str) -> DataFrame:
        known = df.withColumn("at_", self._place(column))
        return known.join(self.words, F.expr("at_ div 64") == F.col("word_"), how)

    def of(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of ``df`` whose value may be among the filter's."""
        hit = F.expr("bits_ & shiftleft(1L, cast(at_ % 64 as int)) <> 0")
        return self._joined(df, column, "inner").where(hit).select(*[F.col(f"`{c}`") for c in df.columns])

    def beside(self, df: DataFrame, column: str) -> DataFrame:
        """The rows whose value is certainly not among them; those that ``of`` leaves out."""
        miss = F.expr("coalesce(bits_ & shiftleft(1L, cast(at_ % 64 as int)), 0L) = 0")
        return self._joined(df, column, "left").where(miss).select(*[F.col(f"`{c}`") for c in df.columns])


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that columns of other names never clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
