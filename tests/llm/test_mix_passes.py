"""Sources that are repeated more than twice, against passes taken word by word."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from faultline.llm import mixing


def test_more_than_two_passes(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3 + i % 5)), "a" if i < 6 else "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, weights=(5, 1), budget=(1, 1), cap=5)
    got = mixed.collect()
    target = {r.source: int(r.target) for r in got}
    size = {r.source: r.source_size for r in got}
    assert target["a"] > 3 * size["a"]
    want = {}
    for source, left in target.items():
        stream = sorted((hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest(), i, len(t.split())) for i, t, s in rows if s == source)
        for _ in range(5):
            for _, i, n in stream:
                if left > 0:
                    want.setdefault(i, []).append(min(n, left))
                    left -= min(n, left)
    assert {r.doc_id: r.taken for r in got if r.taken} == {i: sum(x) for i, x in want.items()}
    for r in got:
        times = [t for t in (r.position, r.repeat_position, *r.later_positions) if t is not None]
        assert len(times) == len(want.get(r.doc_id, [])) and times == sorted(times) and all(0 <= t <= 1 for t in times)
    copies = {}
    for r in mixing.training_rows(mixed, docs.columns).collect():
        copies.setdefault(r.doc_id, []).append(len(r.text.split()))
    assert {i: sorted(x) for i, x in copies.items()} == {i: sorted(x) for i, x in want.items()}
    assert mixing.mix(docs).agg(F.sum("taken")).first()[0] > 0 and "later_positions" not in mixing.mix(docs).columns
