"""Cutting long lineage: a table in the folder all executors share, so that a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
#: Paths written inside each open ``scratch`` block, innermost last.
_open_blocks: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder of a session whose driver is its
    only executor; a cluster must name a folder that all its executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="faultline-"))
        found = _own_dir[0]
    return found.rstrip("/")


def place(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _open_blocks:
        _open_blocks[-1].append(path)
    return path


def written(df: DataFrame, label: str = "cut") -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and where it is."""
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    return written(df, label)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes tables that nothing reads any more, by the file system they are on."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        p = hadoop(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession, keep: list[str] | None = None) -> Iterator[None]:
    """Removes at its end what was written inside it, but for the paths in ``keep``: results that are still lazy then
    have lost what they read, so write or collect them inside."""
    _open_blocks.append([])
    try:
        yield
    finally:
        paths = _open_blocks.pop()
        stay = set(keep or ())
        discard(spark, *[p for p in paths if p not in stay])
        if _open_blocks:
            _open_blocks[-1].extend(p for p in paths if p in stay)
