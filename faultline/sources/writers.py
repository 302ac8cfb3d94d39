"""Writers: splits, predictions, indexes, results and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import versions


def splits(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one folder a split."""
    samples.write.mode(mode).partitionBy("split").json(path)


def predictions_tsv(predictions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """idx and 0 or 1, tab-separated, no heading."""
    predictions.select("idx", F.col("prediction").cast("int")).write.mode(mode).option("sep", "\t").csv(path)


def index(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors and metadata in one versioned table; ``append`` adds without looking for repeats. What the path held before
    stays readable until the new version is whole."""
    versions.publish(vectors, path, append=mode == "append")


def rebuild_index(parts: list[DataFrame], path: str) -> None:
    """One index from all parts, which may be read from the index itself; repeats stay."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    versions.publish(rows, path)


def results_json(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """index, label and the result as one object a line."""
    results.write.mode(mode).json(path)


def metrics_json(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row of aggregates as one object."""
    metrics.coalesce(1).write.mode(mode).json(path)


def text(rows: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    rows.select(column).write.mode(mode).text(path)
