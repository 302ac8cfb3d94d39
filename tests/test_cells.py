"""The cell search against the exact one."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import vector_search
from faultline.plans import catalogue

SF = "/root/testdata/sf0.001"


def found(df):
    return sorted((r.query_id, r["rank"], r.neighbour_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_finds_every_neighbour(spark):
    assert found(catalogue.QUERIES["vec_topk_cells"](spark, SF)) == found(catalogue.QUERIES["vec_topk"](spark, SF))


def test_clusters_few_probes_and_zero_vectors(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([c + r.normal(size=(12, 8)) * 0.1 for c in r.normal(size=(20, 8)) * 2] + [np.zeros((2, 8))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id long, embedding array<double>")
    for k in (3, 30):  # more than a cell holds
        cells = vector_search.top_k_cells(df, df, k, cells=20, probes=1, flat_below=0)
        assert found(cells) == found(vector_search.top_k(df, df, k))
    probed = vector_search.top_k_cells(df, df, 30, cells=20, probes=1, flat_below=0, probes_only=True)
    assert probed.agg(F.count(F.lit(1))).first()[0] < len(v) * 30
