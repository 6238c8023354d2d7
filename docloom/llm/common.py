"""What the operators share: tables in the shared folder, a bounded key filter, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the key filter: 512 bitmaps of 32768 bits, 2 MB whatever the input.
FILTER_BITMAPS, FILTER_BITS = 512, 32768


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only a local master without that setting gets a
    temporary folder, removed at exit. A cluster without it is an error, as a folder of
    one machine would not do.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="docloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/docloom-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: computed once, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._docloom_path = path
    return table


def sweep(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose results are stored.

    They go when the driver collects its garbage, which in a long job may be after its last step.
    """
    spark._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_docloom_path", None)
        if path:
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark's file systems have it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows and bytes that Spark hands to Python at once; texts can be long. One longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, which hold whole texts on both sides; smaller bounds stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, most)


def trimmed(run):
    """``run`` (for mapInArrow), giving freed memory back when a task ends: its worker stays for the tasks of later steps."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def _give_back() -> None:
    import ctypes

    import pyarrow as pa

    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """At most 512 bitmaps that hold ``key`` (a long): a filter of fixed size, without misses."""
    return (
        keys.select(F.pmod(F.col(key), F.lit(FILTER_BITMAPS)).cast("int").alias("fb"), _bit(F.col(key)).alias("bit"))
        .groupBy("fb")
        .agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    )


def maybe_in(df: DataFrame, key: Column, filter_: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter; a join with the true keys must follow.

    The broadcast holds 2 MB at most by construction.
    """
    return flagged(df, key, filter_, "_maybe", "inner").where("_maybe").drop("_maybe")


def flagged(df: DataFrame, key: Column, filter_: DataFrame, name: str, how: str = "left") -> DataFrame:
    """``df`` with a boolean ``name``: false if the key is not in the filter; all rows stay in a left join."""
    filter_ = filter_.select(F.col("fb").alias("_fb"), F.col("bits").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, _at div 8 + 1, 1)")), 16, 10).cast("int")
    held = F.coalesce(F.call_function("getbit", byte, F.expr("cast(_at % 8 as int)")) == 1, F.lit(False))
    keyed = df.withColumns({"_fb": F.pmod(key, F.lit(FILTER_BITMAPS)).cast("int"), "_at": _bit(key)})
    return keyed.join(F.broadcast(filter_), "_fb", how).withColumn(name, held).drop("_fb", "_at", "_bits")


def _bit(key: Column) -> Column:
    return F.pmod(F.shiftright(key, 9), F.lit(FILTER_BITS))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (the steps of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def batches_of(rows: list, size: int):
    for i in range(0, len(rows), size):
        yield rows[i : i + size]


def utf8_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its offsets; a null counts as empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n + 1`` of each."""
    size = 1 << max(16, int(n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        made = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            made.append(np.cumprod(row, dtype=np.uint64))
        _POWERS[size] = (made[0], made[1])
    return _POWERS[size]


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def segment_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`segment_hash` takes the hash of any stretch of ``data``."""
    forward, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * forward[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def segment_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from each start to each end; equal bytes hash equally anywhere."""
    _, backward = powers(len(sums))
    return mix64((sums[ends] - sums[starts]) * backward[starts] + (ends - starts).astype(np.uint64) * _M2)
