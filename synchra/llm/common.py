"""Helpers that the text operators share: scratch folders, Arrow kernels, partition sizing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch; texts are a few kB on average and may reach megabytes, so batches stay small.
BATCH_ROWS = 512
#: Bytes per Arrow batch; a single longer text has a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes that all caches of a worker process may hold together.
CACHE_BYTES = 160 << 20
#: Strings longer than this aren't cached.
LONGEST_KEY = 64
_roots: list[tuple[SparkSession, str]] = []


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that kernels receive, by rows and by bytes, for the session: Spark reads both settings when a query runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _roots:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; the cluster's own clean-up takes over
            return


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``, which all executors share; it goes when the driver's Python ends.

    Only a session in one process (``local[n]``, as in tests) may lack that setting; it gets a folder of this machine.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="synchra-")
        spark.conf.set("spark.checkpoint.dir", root)
        _roots.append((spark, root))
    path = f"{root.rstrip('/')}/synchra-{uuid.uuid4().hex}"
    _roots.append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor afterwards costs a re-read, not a recomputation,
    and what a task wrote is seen exactly once.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system, so that a reused worker starts its next partition small."""
    for c in list(BoundedDict.every):
        c.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def in_worker(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``fn`` with Arrow memory from the C library (Arrow's own pool keeps what it once had) and a release after each partition."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from fn(batches)
        finally:
            release()

    return run


def kernel(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches; memory of a partition is released at its end."""
    tune(df.sparkSession)
    return df.mapInArrow(in_worker(fn), schema)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, as ``doc_id`` and ``text`` (null text: empty).

    Other columns, whatever their names, never reach a kernel.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_partitions(docs: DataFrame, per_partition: int, text_col: str = "text") -> int:
    """How many partitions of about ``per_partition`` bytes of text ``docs`` fills."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-int(total) // per_partition))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch from one list or array per field."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of the splitmix generator, over unsigned 64-bit integers (wraps)."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class BoundedDict(dict):
    """A cache with a maker for missing keys, bounded in bytes together with all others of its process.

    ``trim``, called now and then, empties it where the process's caches hold more than ``CACHE_BYTES``,
    or half of that in entries of its own.  Sizes are estimated from ``cost``, a bound of an entry's bytes.
    """

    every: weakref.WeakSet[BoundedDict] = weakref.WeakSet()

    def __init__(self, make: Callable, cost: int = 256):
        super().__init__()
        self.make, self.cost = make, cost
        BoundedDict.every.add(self)

    def __hash__(self):
        return id(self)

    def __missing__(self, key):
        value = self.make(key)
        if not isinstance(key, str) or len(key) <= LONGEST_KEY:
            self[key] = value
        return value

    def trim(self) -> None:
        own = len(self) * self.cost
        if 2 * own > CACHE_BYTES or own and sum(len(c) * c.cost for c in list(BoundedDict.every)) > CACHE_BYTES:
            self.clear()
