"""Every catalogued query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from faultline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "labels", "pages", "conversations", "events", "benchmark")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)

    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(int(v)) if isinstance(v, int) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    mine = catalogue.QUERIES[name](spark, SF)
    theirs = duck.sql(catalogue.SQL[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine.collect(), mine.columns) == plain(theirs.fetchall(), theirs.columns)


def test_cells_recall(spark):
    exact = {(r.query_id, r.neighbour_id) for r in catalogue.QUERIES["vec_topk"](spark, SF).collect()}
    found = {(r.query_id, r.neighbour_id) for r in catalogue.QUERIES["vec_topk_cells"](spark, SF).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_queries_leave_nothing_behind(spark, tmp_path, monkeypatch):
    from faultline.plans import lineage

    monkeypatch.setattr(lineage, "shared_dir", lambda spark: f"file://{tmp_path}")
    for name in ("eval_auc", "taint_callers", "index_append", "vec_topk_cells"):
        with lineage.scratch(spark):
            assert catalogue.QUERIES[name](spark, SF).count() > 0
            assert list(tmp_path.iterdir())
        assert not list(tmp_path.iterdir()), name


def test_scratch_keeps_what_is_asked(spark, tmp_path, monkeypatch):
    from faultline.plans import lineage

    monkeypatch.setattr(lineage, "shared_dir", lambda spark: f"file://{tmp_path}")
    keep = []
    with lineage.scratch(spark):
        with lineage.scratch(spark, keep):
            lineage.cut(spark.range(3), "goes")
            rows, at = lineage.written(spark.range(4), "stays")
            keep.append(at)
        assert rows.count() == 4 and [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["stays"]
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
