"""Growing an index from a stream of new vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.cell_index import CellIndex
from ..operators.vector_search import label_fraction, top_k, with_metadata


def append_index(new: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Every new row becomes part of the index at ``path``, each exactly once by the stream's checkpoint; no dedup."""
    writer = new.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def grow_cells(new: DataFrame, root: str, checkpoint: str, stream: str = "new", split_above: int | None = None) -> StreamingQuery:
    """New vectors join the stored cells at ``root`` micro-batch by micro-batch, each exactly once: the version that takes
    a batch in names it, so one that is run again changes nothing. Cells that outgrow ``split_above`` are split."""

    def take(batch: DataFrame, batch_id: int) -> None:
        grown = CellIndex.open(batch.sparkSession, root).append(batch, stream, batch_id)
        if split_above:
            grown.split_overfull(split_above)

    return new.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(queries: DataFrame, index: DataFrame, path: str, checkpoint: str, k: int = 5) -> StreamingQuery:
    """Neighbour scores of each micro-batch against the index as it stands, appended to ``path`` under its batch."""

    def score(batch: DataFrame, batch_id: int) -> None:
        near = with_metadata(top_k(batch, index, k), index.select("vec_id", "label"))
        label_fraction(near, batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return queries.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
