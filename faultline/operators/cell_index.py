"""A vector index stored in cells: fitted once, read cell by cell, grown and split without a rewrite.

``build`` fits the cells, writes the vectors partitioned by cell and publishes both as a version; ``search`` reads the folders
of the cells it asks for and no others; ``append`` puts new vectors into the cells as they are, widens the radii, and skips a
micro-batch that an earlier run has published; ``split_overfull`` replaces a cell that has outgrown its bound by two. All of
them leave what readers see whole: they add parts and hide partitions of old ones in one commit.

Vectors that are unusable or of another length than the cells' take no part; repeats stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from . import vector_search as search

STATISTICS = "cell int, centre array<double>, n long, least double"


@dataclass
class CellIndex:
    spark: SparkSession
    root: str
    version: versions.Version
    cells: search.Cells

    # ---- writing --------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, vectors: DataFrame, root: str, cells: int = search.CELL_COUNT, id_name: str = "vec_id", vector_name: str = "embedding") -> CellIndex:
        """A new version of these vectors alone; further columns of ``vectors`` are kept as metadata."""
        spark = vectors.sparkSession
        before = versions.current(spark, root)
        known = search.Cells.around(search.fit_cells(vectors, cells, id_name=id_name, vector_name=vector_name))
        names = {"id": id_name, "vector": vector_name, "d": known.d}
        part, schema = cls._write(vectors, root, known, names)
        return cls._commit(spark, root, before, [part] if part else [], schema, (), known, names | {"batches": {}})

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int | None = None) -> CellIndex:
        found = versions.current(spark, root) if version is None else versions.version(spark, root, version)
        if found is None:
            raise FileNotFoundError(f"no index at {root}")
        rows = spark.read.schema(STATISTICS).parquet(f"{root}/{found.note['cells']}").orderBy("cell").collect()  # one row a cell
        cells = search.Cells(
            np.array([r.cell for r in rows], dtype=np.int64), np.array([r.centre for r in rows]).reshape(len(rows), -1),
            np.array([r.n for r in rows], dtype=np.int64), np.array([r.least for r in rows]),
        )
        return cls(spark, root, found, cells)

    @staticmethod
    def _write(vectors: DataFrame, root: str, cells: search.Cells, names: dict) -> tuple[str | None, object]:
        """Places vectors, writes them, counts them into ``cells``; the part and its schema."""
        meta = [F.col(c) for c in vectors.columns if c not in (names["id"], names["vector"])]
        rows = search.usable_vectors(vectors, names["id"], names["vector"], *meta).filter(F.col("d") == names["d"]).drop("d")
        if not cells.d:
            return None, rows.withColumns({"cosine": F.lit(0.0), "cell": F.lit(0)}).schema
        rows = search.placed(rows, cells)
        rows = rows.select("id", "v", *meta, "cosine", "cell")
        part = versions.write_part(rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))), root, ("cell",))
        spark = vectors.sparkSession
        cells.count(versions.rows_of(spark, root, versions.Version(0, (part,), rows.schema)))
        return part, rows.schema

    @classmethod
    def _commit(cls, spark, root, before, parts, schema, hidden, cells: search.Cells, note: dict) -> CellIndex:
        rows = [(int(c), [float(x) for x in v], int(n), float(x)) for c, v, n, x in zip(cells.ids, cells.centres, cells.sizes, cells.least, strict=True)]
        at = "cells/" + versions.fresh()
        spark.createDataFrame(rows, STATISTICS).coalesce(1).write.parquet(f"{root}/{at}")
        made = versions.commit(spark, root, before, parts, schema, hidden, note | {"cells": at})
        return cls(spark, root, made, cells)

    def append(self, vectors: DataFrame, stream: str | None = None, batch: int = 0) -> CellIndex:
        """The next version, with these vectors in the cells that are there. A batch of a stream that this index or an
        earlier version has taken in is left out."""
        note = self.version.note
        if stream is not None and note["batches"].get(stream, -1) >= batch:
            return self
        if not self.cells.d:  # nothing was there to fit cells to
            made = CellIndex.build(vectors, self.root, id_name=note["id"], vector_name=note["vector"])
            return made if stream is None else made._noted(stream, batch)
        vectors = vectors.withColumn(note["vector"], F.col(note["vector"]).cast(self.version.schema["v"].dataType))
        cells = search.Cells(self.cells.ids, self.cells.centres, self.cells.sizes.copy(), self.cells.least.copy())
        part, _ = self._write(vectors, self.root, cells, note)
        batches = note["batches"] | ({stream: batch} if stream is not None else {})
        v = self.version
        return self._commit(self.spark, self.root, v, [*v.parts, part], v.schema, v.hidden, cells, note | {"batches": batches})

    def _noted(self, stream: str, batch: int) -> CellIndex:
        v = self.version
        return self._commit(self.spark, self.root, v, v.parts, v.schema, v.hidden, self.cells, v.note | {"batches": {stream: batch}})

    def split_overfull(self, most: int) -> CellIndex:
        """Replaces each cell of more than ``most`` vectors by two, fitted to a bounded sample of it; its vectors move to the
        nearest cells that are there then. A cell of equal vectors stays."""
        full = [int(c) for c, n in zip(self.cells.ids, self.cells.sizes, strict=True) if n > most]
        halves: dict[int, np.ndarray] = {}
        for c in full:
            drawn = self.members([c]).orderBy(F.xxhash64("id"), "id").limit(search.CENTROID_SAMPLE).select("v").collect()
            data = search._units(np.array([r.v for r in drawn], dtype=np.float64))
            apart = data @ data[0]
            if apart.min() < 1 - 1e-9:
                halves[c] = search.k_means(data, data[[0, int(apart.argmin())]])
        if not halves:
            return self
        stay = ~np.isin(self.cells.ids, list(halves))
        first = int(self.version.note.get("next", self.cells.ids.max() + 1))
        new = np.concatenate(list(halves.values()))
        cells = search.Cells(
            np.concatenate((self.cells.ids[stay], first + np.arange(len(new)))), np.concatenate((self.cells.centres[stay], new)),
            np.concatenate((self.cells.sizes[stay], np.zeros(len(new), np.int64))), np.concatenate((self.cells.least[stay], np.ones(len(new)))),
        )
        v, note = self.version, self.version.note
        part, _ = self._write(self.members(list(halves)).drop("cell", "cosine"), self.root, cells, note | {"id": "id", "vector": "v"})
        hidden = (*v.hidden, *((p, "cell", c) for p in v.parts for c in halves))
        return self._commit(self.spark, self.root, v, [*v.parts, part], v.schema, hidden, cells, note | {"next": first + len(new)})

    # ---- reading --------------------------------------------------------------------------------------------

    def members(self, cells: list[int] | None = None) -> DataFrame:
        """id, v, metadata, cosine, cell: of these cells, whose folders alone are read; of all without."""
        rows = versions.rows_of(self.spark, self.root, self.version)
        return rows if cells is None else rows.filter(F.col("cell").isin(*cells))

    def search(
        self, queries: DataFrame, k: int = search.NEIGHBOURS, probes: int = search.PROBES, id_name: str = "vec_id",
        vector_name: str = "embedding", probes_only: bool = False, skip_self: bool = True,
    ) -> DataFrame:
        """query_id, neighbour_id, score, rank: the exact neighbours; with ``probes_only`` those of the nearest cells."""
        asked = search.usable_vectors(queries, id_name, vector_name).filter(F.col("d") == self.cells.d)
        return search.search_cells(asked, self.members, self.cells, k, probes, probes_only, skip_self=skip_self)
