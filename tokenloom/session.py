"""Session helpers: the shared working folder and written intermediate tables."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: dict[str, str] = {}
_SCRATCH: list[list[str]] = []  # what was written inside each open ``scratch``


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder of its own;
    on a cluster such a folder would not be visible to the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL_BASE.setdefault(app, tempfile.mkdtemp(prefix="tokenloom-"))
    path = f"{base.rstrip('/')}/tokenloom/{label}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


def materialize(df: DataFrame, label: str, wide: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage. ``wide`` is for
    rows that hold texts or lists (see ``write_wide``)."""
    spark = df.sparkSession
    path = work_path(spark, label)
    write_wide(df, path) if wide else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROW_GROUP_BYTES = 16 << 20
_ROWS_UNWEIGHED = 64


def write_wide(df: DataFrame, path: str) -> None:
    """Write rows that hold whole texts or lists of ids as Parquet, in row groups of about ``ROW_GROUP_BYTES``
    and at most ``_ROWS_UNWEIGHED`` rows more.

    A reader unpacks 4,096 rows together, whatever they hold, but never over the end of a row group. Groups are
    weighed before they are compressed, as their pages are not closed earlier: copies count like other rows.
    """
    df.write.options(
        **{
            "parquet.block.size": ROW_GROUP_BYTES,
            "parquet.page.size": 2 * ROW_GROUP_BYTES,
            "parquet.page.size.row.check.min": 1,
            "parquet.page.size.row.check.max": _ROWS_UNWEIGHED,
        }
    ).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority of the file system it belongs to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables that are written inside, when their result is in its place.

    Nothing that is read later may depend on them.
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Have the session hand rows to Python functions in batches of at most ``BATCH_BYTES`` or one row: a
    batch is otherwise bounded by its number of rows alone, and rows are whole texts here."""
    now = spark.conf.get(_ARROW_BYTES, None)
    if not now or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > BATCH_BYTES:
        spark.conf.set(_ARROW_BYTES, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tokenloom-zip-"), "tokenloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


_SHIPPED: set[str] = set()
