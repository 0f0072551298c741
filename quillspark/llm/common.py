"""Small helpers that every operator of the subpackage shares."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table of ids, or of ids with short arrays, is broadcast only up to this many entries; beyond it a shuffle join is used. The driver
#: holds a broadcast's rows, its hash table and its blocks at once, some 100 bytes an entry and more.
BROADCAST_ROWS = 100_000
#: Narrow rows that one task writes at least, where their number is known.
ROWS_PER_TASK = 50_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local master without one gets a folder of its own."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, written to the checkpoint folder. ``rows`` bounds its rows: what a shuffle made of them is written by no more tasks than they need.

    Give ``rows`` only where the last step is a join or an aggregate, as the tasks of a step before it would be merged too.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))).checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Delete the files of results of ``checkpointed`` that nothing reads any more."""
    for df in frames:
        jvm, plan = df.sparkSession._jvm, df._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() != "LogicalRDD":
            raise ValueError("only a checkpointed table itself can be released")
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            path = jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark wrote it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; a null text counts as an empty one."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    batch = None
    give_back()


def give_back() -> None:
    """Return freed memory to the system, as a Python worker waits for its next task beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def carried(df: DataFrame, fields: list[T.StructField], make: Callable[[Callable[[str], pa.Array]], list[pa.Array]], rows: int = 1024) -> DataFrame:
    """df with more columns, computed in Arrow batches of at most ``rows`` rows; columns of their names are replaced.

    ``make`` gets a function from a column's name to its array. Columns travel under numbers, so their names may hold anything.
    """
    new = {f.name.lower() for f in fields}
    keep = [i for i, f in enumerate(df.schema) if f.name.lower() not in new]
    place = {f.name: i for i, f in reversed(list(enumerate(df.schema)))}
    schema = T.StructType([*(T.StructField(f"c{i}", df.schema[i].dataType) for i in keep), *(T.StructField(f"n{k}", f.dataType) for k, f in enumerate(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, rows):
            made = make(lambda name: batch.column(place[name]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], names=schema.names)

    out = df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)
    return out.toDF(*(df.schema[i].name for i in keep), *(f.name for f in fields))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text: str = "text") -> DataFrame:
    """Whole texts of at most ``per_class`` labelled rows of each class 0 and 1, chosen by a hash of doc_id.

    The ids are bounded by 2 * per_class, so their side of the join is broadcast.
    """
    clean = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("_label"))
    order = F.xxhash64("doc_id", F.lit("labelled sample"))
    picked = [clean.where(F.col("_label") == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    return docs.select("doc_id", text).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")


def among(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is in ``ids`` (distinct keys), broadcast if their count allows it and shuffled otherwise."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_semi")


_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_powers = np.array([1], dtype=np.uint64)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of UTF-8 bytes; words are runs without space, tab and line breaks.

    A polynomial of the word's bytes, modulo 2**64, is summed for all words at once, mixed with the length.
    """
    global _powers
    word = ~_BREAKS[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    if (most := int(sizes.max())) > len(_powers):
        _powers = np.cumprod(np.full(2 * most, _BASE, dtype=np.uint64))
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    total = np.add.reduceat((raw[word].astype(np.uint64) + np.uint64(1)) * _powers[place], first)
    total += sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(29))


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not in ``ids`` (distinct keys); a null key stays."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, key, "left_anti")
