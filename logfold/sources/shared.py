"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); one of our own only in a local session, as in tests."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="logfold-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so a lost executor costs no replay of the loop."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Paths written in each open ``scope``, innermost last.
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that were written inside: what is to stay must have been written elsewhere by then.

    Scopes nest; each removes its own tables, after an error too.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        remove(spark, *paths)


def written_at(df: DataFrame, **options: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table in the shared folder, and its path; options are those of the writer."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/logfold-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path  # known, so no job looks for it


def written(df: DataFrame, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: read more than once, computed once."""
    return written_at(df, **options)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of ``written_at`` that nothing reads any more: what came of them must have been written itself."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
