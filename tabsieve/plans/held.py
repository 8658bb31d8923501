"""Tables written once and read many times.

An operator that needs an intermediate result in several jobs writes it as
Parquet into the shared folder named by ``spark.checkpoint.dir``, or below the
warehouse where none is named. Losing an executor then costs nothing, lineage
ends there, and later jobs read only the columns they name.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FOLDER, _WAREHOUSE = "spark.checkpoint.dir", "spark.sql.warehouse.dir"


def _named_folder(spark: SparkSession) -> str | None:
    return spark.conf.get(_FOLDER, None) or spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: the one named, else the warehouse."""
    return (_named_folder(spark) or f"{spark.conf.get(_WAREHOUSE).rstrip('/')}/held").rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{_session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tabsieve/{spark.sparkContext.applicationId}"


def hold(df: DataFrame, label: str, file_rows: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; 0 sets no limit to the rows of a file."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    # Parquet has no type for a column of bare NULLs.
    void = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)]
    stored = df.drop(*void)
    stored.write.option("maxRecordsPerFile", file_rows).parquet(path)
    back = spark.read.schema(stored.schema).parquet(path)
    return back.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns]) if void else back


def drop_held(df: DataFrame) -> None:
    """Delete the files behind a held table once nothing reads it any more."""
    root = _session_folder(df.sparkSession)
    for table in _behind(df):
        _delete(df.sparkSession, f"{root}/{table}")


def _behind(df: DataFrame) -> set[str]:
    """Names of the held tables that a table reads."""
    mark = f"/tabsieve/{df.sparkSession.sparkContext.applicationId}/"
    return {f.split(mark, 1)[1].split("/", 1)[0] for f in df.inputFiles() if mark in f}


@contextmanager
def released(spark: SparkSession):
    """Deletes, at the end of the block, what was held in it and is still there, but for
    what the tables read that the block adds to the list it is given."""
    before, kept = _tables(spark), []
    try:
        yield kept
    finally:
        spared = {name for df in kept for name in _behind(df)}
        for table in _tables(spark) - before - spared:
            _delete(spark, f"{_session_folder(spark)}/{table}")


def _tables(spark: SparkSession) -> set[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(_session_folder(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()


def release_held(spark: SparkSession) -> None:
    """Delete every table this session held, including those behind lazy results."""
    _delete(spark, _session_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def held(df: DataFrame, label: str):
    """A held table for the length of a block that only fetches small results."""
    table = hold(df, label)
    try:
        yield table
    finally:
        drop_held(table)
