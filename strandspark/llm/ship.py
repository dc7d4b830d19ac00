"""Arrow mappers that executors import by name, and tables written to the cluster's shared folder."""

from __future__ import annotations

import hashlib
import io
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def remote(target: str, **settings) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper for ``mapInArrow`` which runs ``module:function(batches, **settings)``.

    The executor imports the function, so what its module keeps (tables, word scores) lives as long as the worker does.
    """
    root = _ROOT
    _send_package()

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)  # executors on the driver's machine; others find the package that was sent
        module, name = target.split(":")
        yield from getattr(importlib.import_module(module), name)(batches, **settings)

    return run


def _send_package() -> None:
    """Once a session, executors on other machines get this package as a zip file, by way of the shared folder."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.master.split("[")[0] == "local" or getattr(spark.sparkContext, "_strandspark_sent", False):
        return
    packed = io.BytesIO()
    top = os.path.join(_ROOT, "strandspark")
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(top)):
            for name in sorted(f for f in files if f.endswith(".py")):
                z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), _ROOT))
    data = packed.getvalue()
    path = f"{shared_folder(spark)}/strandspark/package-{hashlib.sha256(data).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}.zip"
    system, at = _hadoop(spark, path)
    out = system.create(at)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._strandspark_sent = True


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def map_whole_rows(docs: DataFrame, mapper: Callable) -> DataFrame:
    """``mapInArrow`` that keeps the columns, whatever their names are."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(mapper, plain.schema).toDF(*docs.columns)


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if current := spark.sparkContext.getCheckpointDir():
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandspark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Shuffle files go at the end of the execution that made them; else they stay until the driver happens to collect its garbage.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What is written or collected meanwhile leaves no shuffle files."""
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SWEEP)
        else:
            spark.conf.set(_SWEEP, before)


_written: list[str] = []


def stash(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for path in [t.stashed_at for t in tables]:
        system, at = _hadoop(spark, path)
        system.delete(at, True)
        if path in _written:
            _written.remove(path)


def stashed() -> int:
    """How many stashed tables there are; :func:`release_since` deletes those made after."""
    return len(_written)


def release_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete the tables stashed since ``mark`` but those to keep: once results that read them are written, and no other is waiting."""
    kept = {t.stashed_at for t in keep}
    for path in [p for p in _written[mark:] if p not in kept]:
        system, at = _hadoop(spark, path)
        system.delete(at, True)
        _written.remove(path)
