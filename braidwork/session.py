"""Session helpers: shared storage for intermediate tables, and guards on what may be broadcast or collected."""

from __future__ import annotations

import gc
import hashlib
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Rows a lookup table may have before it is refused as a broadcast or driver-side lookup.
LOOKUP_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        found = tempfile.mkdtemp(prefix="braidwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Folders of tables that this process made in the shared folder.
_MADE: list[str] = []


def table_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder, which :func:`drop_all` deletes."""
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def drop_all(spark: SparkSession) -> None:
    """Delete every intermediate table that this process made; for when no result is read any more."""
    while _MADE:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage.

    The table outlives lost executors. :func:`drop_all` deletes it once the results were read.
    """
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_shuffles(df: DataFrame) -> None:
    """Let the shuffle files of ended jobs go, which otherwise stay until the driver happens to collect its garbage; for loops."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def bounded_rows(df: DataFrame, limit: int = LOOKUP_ROWS, what: str = "lookup table") -> list[Row]:
    """Rows of a table that must be small; a larger one raises ValueError instead of filling the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows")
    return rows


def fingerprint(spark: SparkSession, inputs: list[str], version: str = "") -> str:
    """Hash of the names, sizes and times of the files below ``inputs``, and of ``version``."""
    found, jvm = [version], spark.sparkContext._jvm
    for path in inputs:
        p = jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:32]


def cached_table(spark: SparkSession, build: Callable[[], DataFrame], inputs: list[str], folder: str, version: str = "1") -> DataFrame:
    """The table that ``build`` makes of the files ``inputs``, kept under ``folder`` until they or ``version`` change.

    A table counts as kept once its write has ended; one that was broken off is made again.
    """
    path = f"{folder.rstrip('/')}/{fingerprint(spark, inputs, version)}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors as a zip file in the shared folder; needed where it is not installed on them."""
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = table_path(spark, "package") + ".zip"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)
