"""Reading the project's tables, and tables written between the steps of a job."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``; with ``columns``, only those."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir`` of the session.

    Where that is unset (local mode, tests) a folder of our own is made and set
    as the checkpoint directory of the context.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        sc.setCheckpointDir(found)
    # Spark gives back a folder of this machine with a single slash
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def _delete(spark: SparkSession, path: str) -> None:
    local = path.removeprefix("file://")
    if os.path.isdir(local):
        shutil.rmtree(local, ignore_errors=True)
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


#: The folders of tables that were written and not yet deleted.
_folders: dict[str, SparkSession] = {}
_folder_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage without holding blocks on executors: a lost executor loses
    nothing. The files go with ``forget``, at the end of ``temporary_tables``, or
    when the driver's Python ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"table-{uuid.uuid4().hex}")
    _folders[path] = spark
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    out = spark.read.schema(df.schema).parquet(path)
    _folder_of[out] = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes what ``written`` made of the ``tables``; no later step may read them, nor what is not yet computed from them."""
    for df in tables:
        path = _folder_of.pop(df, None) if df is not None else None
        if path is not None:
            _delete(_folders.pop(path), path)


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Deletes at its end all tables that were written within; what is to stay must be stored elsewhere by then."""
    before = set(_folders)
    try:
        yield
    finally:
        for path in set(_folders) - before:
            _delete(_folders.pop(path), path)


@atexit.register
def _delete_all() -> None:
    while _folders:
        path, spark = _folders.popitem()
        _delete(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
