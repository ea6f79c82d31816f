"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import glob
import os
import tempfile
import threading
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace that parts words: \x09-\x0D and \x20, as bytes.split() has it.
SPACES = "\t\n\x0b\x0c\r "
#: Arrow batches hold so many rows and bytes at most, so a worker's memory doesn't follow the rows' lengths.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Seconds between two requests to free shuffle files.
FREE_EVERY = 4.0
_shipped: set[str] = set()
#: What operators keep in a worker between tasks: function -> the modules that use it, and how to drop it.
_kept: dict[str, tuple[tuple[str, ...], Callable[[], None]]] = {}
#: A worker that got no task for so many seconds drops all of that.
IDLE = 1.5
_tasks = [0]
_turn = threading.Lock()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches and send the package to the executors, once per application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for at, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns with exactly these names, whatever other columns there are (also names that differ by case only, or doubled ones: then the first)."""
    order = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(order))])
    return plain.select(*[F.col(f"c{order.index(n)}").alias(n) for n in names])


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """All columns under names c0, c1, ... and where each name first stands."""
    order = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(order))]), {n: f"c{i}" for i, n in reversed(list(enumerate(order)))}


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | list], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from fn(b)

    return df.mapInArrow(lean(run, fn.__module__), schema)


def kept_in_worker(*users: str):
    """Registers a cached function whose results a worker keeps between tasks of these modules; other modules' tasks drop them."""

    def register(fn):
        _kept[f"{fn.__module__}.{fn.__name__}"] = (users, fn.cache_clear)
        return fn

    return register


def lean(fn, module: str | None = None):
    """fn for mapInArrow: drops what operators of other modules left in the worker, and gives freed memory back at both ends.

    Workers outlive their stages, so otherwise each operator of a chain adds to what the ones before it hold. Spark takes
    the worker that has been idle longest, so what one keeps may wait through several stages: it goes after IDLE seconds.
    """
    module = module or fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = begin_task(module)
        one_blas_thread()
        trim()
        try:
            yield from fn(batches)
        finally:
            trim()
            end_task(task)

    return run


def begin_task(module: str) -> int:
    """Drops what other modules keep; gives the task's number within this worker."""
    with _turn:
        _tasks[0] += 1
        for users, drop in list(_kept.values()):
            if module.rpartition(".")[2] not in users:
                drop()
        return _tasks[0]


def end_task(task: int) -> None:
    """Drops everything kept, unless another task begins soon."""
    later = threading.Timer(IDLE, drop_if_idle, (task,))
    later.daemon = True
    later.start()


def drop_if_idle(task: int) -> None:
    with _turn:
        if _tasks[0] == task:
            for _, drop in list(_kept.values()):
                drop()
            gc.collect()
            trim()


@lru_cache(maxsize=1)
def one_blas_thread() -> None:
    """Numpy's products on small matrices gain nothing from more threads, which spin while they wait; one core per task is what Spark counts on."""
    import numpy as np

    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


def trim() -> None:
    """Gives memory that is free within this process back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or, where that is unset on one machine (tests), a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        base = os.path.join(tempfile.gettempdir(), "tessella-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


class Scratch:
    """Written tables in the shared folder, which cut the lineage and give the planner real sizes. drop() removes them."""

    freed = 0.0

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.made = spark, shared_dir(spark), []

    def path(self, name: str) -> str:
        p = f"{self.base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made.append(p)
        return p

    def table(self, df: DataFrame, name: str) -> DataFrame:
        p = self.path(name)
        df.write.parquet(p)
        self.free()
        return self.spark.read.schema(df.schema).parquet(p)

    def free(self) -> None:
        """A written table needs no shuffle files behind it any more; Spark removes them once the driver has collected its garbage, which is asked for every few seconds at most."""
        if time.monotonic() - Scratch.freed < FREE_EVERY:
            return
        Scratch.freed = time.monotonic()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, path: str | None = None) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in [path] if path else list(self.made):
            h = jvm.org.apache.hadoop.fs.Path(p)
            h.getFileSystem(conf).delete(h, True)
            self.made.remove(p)

    def drop_table(self, df_name: str) -> None:
        for p in [x for x in self.made if f"/{df_name}-" in x]:
            self.drop(p)


def id_remainder(doc_id: int | None, mod: int) -> int | None:
    """crc32 of the id as text, modulo; None for no id."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


def id_remainder_col(col, mod: int):
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(mod))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def lower_ascii(b: bytes) -> bytes:
    return b.translate(_LOWER)


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bitmap(hashes: DataFrame, column: str, bits: int) -> bytes:
    """A bitmap of fixed size (a power of two) of the column's low bits: what is collected doesn't grow with the rows."""
    import numpy as np

    h = F.col(column).bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(31)).cast("int"))
    words = hashes.select(F.shiftright(h, 5).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[words.w.to_numpy(np.int64)] = words.b.to_numpy(np.int64).astype(np.uint32)
    return out.tobytes()


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """rows, with the columns of `table` (one row per key; `count`: how many of `rows` have the key) joined to them.

    Keys that hold at least 1 / share of the rows are at most `share` many, so they are broadcast and no task gathers their rows; the others are joined as usual.
    """
    total = table.agg(F.sum(count).alias("n")).collect()[0].n or 0
    hot = table.where(F.col(count) * share >= total)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(count) * share < total).drop(count), key)
    return rows.join(F.broadcast(hot.drop(count)), key).unionByName(cold)
