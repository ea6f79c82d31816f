"""LmKernel.java for the executors: compiled once per application by the driver's JDK, sent as a jar, run on partitions.

It computes what lm_score.py does with numpy, in single precision too but in another order, so
results agree up to rounding. Where the driver has no compiler or the weights have other
widths than it is written for, available() is False and numpy does the work.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
import warnings
import zipfile
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: What LmKernel.java is written for: width, hidden, groups; the span is 16 at most.
WIDTHS, SPANS, STRIDES = (16, 32, 32), 16, 16
_loaders: dict = {}


@lru_cache(maxsize=1)
def compiled(java_home: str, jars: str) -> bytes | None:
    """The jar, or None where there is no compiler."""
    source = os.path.join(os.path.dirname(os.path.abspath(__file__)), "LmKernel.java")
    javac = os.path.join(java_home, "bin", "javac")
    if not os.path.exists(javac) or not os.path.exists(source):
        return None
    with tempfile.TemporaryDirectory() as out:
        done = subprocess.run([javac, "--add-modules", "jdk.incubator.vector", "-nowarn", "-cp", jars, "-d", out, source], capture_output=True, check=False)
        if done.returncode:
            warnings.warn(f"LmKernel.java doesn't compile, numpy does its work: {done.stderr.decode(errors='replace')[:2000]}", stacklevel=2)
            return None
        path = os.path.join(out, "kernel.jar")
        with zipfile.ZipFile(path, "w") as z:
            for at, _, names in os.walk(out):
                for n in names:
                    if n.endswith(".class"):
                        z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), out))
        with open(path, "rb") as f:
            return f.read()


def loader(spark: SparkSession):
    """A class loader with the kernel, whose jar the executors have too; None where it can't be had."""
    app = spark.sparkContext.applicationId
    if app not in _loaders:
        _loaders.clear()
        _loaders[app] = _load(spark)
    return _loaders[app]


def _load(spark: SparkSession):
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    system = jvm.java.lang.System
    try:
        jvm.java.lang.Class.forName("jdk.incubator.vector.FloatVector")
    except Exception:  # noqa: BLE001 - the driver's JVM has no vectors
        return None
    where = jvm.java.lang.Class.forName("org.apache.spark.sql.Row").getProtectionDomain().getCodeSource().getLocation().getPath()
    raw = compiled(system.getProperty("java.home"), os.path.join(os.path.dirname(where), "*"))
    if raw is None:
        return None
    path = os.path.join(tempfile.mkdtemp(), "lm-kernel.jar")
    with open(path, "wb") as f:
        f.write(raw)
    sc._jsc.addJar(path)
    urls = sc._gateway.new_array(jvm.java.net.URL, 1)
    urls[0] = jvm.java.io.File(path).toURI().toURL()
    return jvm.java.net.URLClassLoader(urls, jvm.java.lang.Thread.currentThread().getContextClassLoader())


def available(spark: SparkSession, widths: tuple[int, int, int], span: int, stride: int) -> bool:
    return widths == WIDTHS and span <= SPANS and stride <= STRIDES and loader(spark) is not None


def blob(model, span: int, stride: int, end_id: int) -> bytes:
    """A model as LmKernel reads it."""
    head = np.array([len(model.p["E"]), model.pad, model.start, span, stride, end_id, len(model.symbol)], "<i4")
    weights = [np.ascontiguousarray(model.p[k], "<f4") for k in sorted(model.p)]
    return b"".join(x.tobytes() for x in [head, *weights, model.symbol.astype("<i4"), model.of_class.astype("<i4"), model.share.astype("<f8")])


def head_blob(hashes: np.ndarray, values: np.ndarray) -> bytes:
    return np.array([len(hashes)], "<i4").tobytes() + hashes.astype("<i8").tobytes() + values.astype("<f8").tobytes()


def run(rows: DataFrame, name: str, sent: bytes, schema: str, *more) -> DataFrame:
    """The rows that class `name` of the kernel makes of each partition; `sent`, if any, is broadcast."""
    from pyspark.sql.types import _parse_datatype_string

    spark = rows.sparkSession
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    made = loader(spark).loadClass(f"tessella.LmKernel${name}").getConstructors()[0]
    args = [sc._jsc.broadcast(bytearray(sent)), *more] if sent else more
    given = sc._gateway.new_array(jvm.java.lang.Object, len(args))
    for i, x in enumerate(args):
        given[i] = x
    shape = jvm.org.apache.spark.sql.types.DataType.fromJson(_parse_datatype_string(schema).json())
    return DataFrame(rows._jdf.mapPartitions(made.newInstance(given), jvm.org.apache.spark.sql.Encoders.row(shape)), spark)
