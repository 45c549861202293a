"""Session helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and benchmarks use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plotline")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of ``spark``, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="plotline-code-"), "plotline.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("plotline", os.path.relpath(path, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


_own_folder: str | None = None
#: What ``written`` has stored and nobody has deleted yet, for ``scratch``.
_open_tables: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary one, deleted when Python ends; on a cluster executors
    would each write to their own disk, so that there it is an error."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="plotline-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, the plan
    above it is small, and the rows outlive the executors that made them. ``keep``
    exempts the table from ``scratch``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plotline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for tables in _open_tables[-1:] if not keep else ():
        tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path  # type: ignore[attr-defined]
    return out


def forget(df: DataFrame) -> None:
    """Delete what ``written`` stored, once nothing reads it any more."""
    path = getattr(df, "written_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, what ``written`` stores meanwhile. The work must have been done
    by then: what is to stay is written with ``keep``, or by other means."""
    _open_tables.append([])
    try:
        yield
    finally:
        for path in _open_tables.pop():
            delete(spark, path)
