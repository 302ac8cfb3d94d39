"""The pipeline on a small fixture against a plain version of each stage."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from faultline.llm import quality  # noqa: E402

from .test_similar import groups_of  # noqa: E402
from .test_small_tables import brute_mix, brute_repeats, split  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(21)
    plain = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(420):
        words = [r.choice(plain) for _ in range(r.randint(15, 160))]
        kind = (2, 2, 2, 2, 1, 0)[i % 6]
        if kind == 0:
            words.insert(r.randrange(len(words)), "Dreadful,")
        if kind == 1:
            words = [w + "***" for w in words]
        text = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
        if i % 40 == 7:
            text = "again and again this line of nine words comes " * 6
        if i % 10 == 9 and i > 20:
            text = rows[i - 9][1]  # an exact copy
        if i % 50 == 13:
            text = rows[i - 13][1] + " tail" if len(rows[i - 13][1]) > 400 else text
        rows.append((i, text, "en", ["a", "b", "c", "d", None][r.choice([0, 0, 0, 1, 2, 3, 4])], len(text)))
        if i % 3:
            labels.append((i, int(kind != 1), int(kind == 0)))
    rows += [(900, None, None, "a", None), (901, "", "en", None, 0)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages_against_plain_versions(spark, sf_dir):
    from tokenizers import Tokenizer

    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, seen = documents, []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        seen.append(rows)
        docs = spark.createDataFrame(rows, out.schema)
    assert all(spark.createDataFrame(x, documents.schema).columns == documents.columns for x in seen[:-1])

    # quality rules
    def passes(text):
        n, covered, longest = brute_repeats(text)
        return n >= 20 and 100 * covered <= 30 * n and longest <= 250

    kept = {r.doc_id: r for r in documents.collect() if passes(r.text)}
    assert {r.doc_id for r in seen[0]} == set(kept)

    # quality classifier: the same weights, added up one feature at a time
    model = quality.learn_from(spark, sf_dir)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))

    def selected(text):
        words = split(text)
        features = set()
        for w in words:
            core = w.lower().strip(quality.OUTER)
            if core:
                features.add(zlib.crc32(core) % quality.BUCKETS)
        kinds = [
            [not quality.ODD_BYTES.isdisjoint(w) or b"!!" in w for w in words],
            [len(w.lower().strip(quality.OUTER)) > 1 and w.isupper() for w in words],
            [not w.lower().strip(quality.OUTER) for w in words],
            [i > 0 and w == words[i - 1] for i, w in enumerate(words)],
        ]
        for k, hits in enumerate(kinds):
            step = int(min(max(np.ceil(sum(hits) / max(len(words), 1) * quality.STEPS - 0.4), 0), quality.STEPS))
            features.add(quality.BUCKETS + k * (quality.STEPS + 1) + step)
        score = sum(weight.get(f, 0.0) for f in features)
        return 1 / (1 + np.exp(-(score - model.thresholds[1]))) >= 0.5

    assert {r.doc_id for r in seen[1]} == {i for i, r in kept.items() if selected(r.text)}
    assert not any("Dreadful" in r.text or "***" in r.text for r in seen[1]) and len(seen[1]) > 150

    # near duplicates: five-word shingle sets of similarity 0.8 by all pairs
    ids = [r.doc_id for r in seen[1]]
    want = set(groups_of([(r.doc_id, r.text) for r in seen[1]]))
    assert {r.doc_id for r in seen[2]} == want and len(seen[2]) == len(want) < len(ids)

    # mix
    sizes, target = brute_mix([(r.doc_id, r.text, r.source) for r in seen[2]])
    taken = {}
    for source in sizes:
        left = int(target[source])
        stream = sorted((hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest(), r) for r in seen[2] if r.source == source)
        for _ in range(2):
            for _, r in stream:
                n = min(left, len(split(r.text)))
                if n:
                    taken.setdefault(r.doc_id, []).append(n)
                left -= n
    got = {}
    for r in seen[3]:
        got.setdefault(r.doc_id, []).append(len(split(r.text)))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in taken.items()}

    # packing
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {}
    for r in seen[3]:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + len(library.encode(r.text, add_special_tokens=False).ids) + 1
    packed = {}
    for p in seen[4]:
        packed[p.doc_id] = packed.get(p.doc_id, 0) + p.length
    assert packed == tokens


def test_run_equals_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    run = corpus_pipeline.run(spark, sf_dir)
    assert run.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert run.agg({"length": "sum"}).first()[0] == docs.agg({"length": "sum"}).first()[0]
    assert len({key(r) for r in run.collect()}) > 100


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_repeated_ids_and_clashing_columns_through_all_stages(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fresh = " ".join(f"w{i * 7 % 400} w{i}" for i in range(150))
    long = " ".join(f"w{(i * i) % 397} w{i % 400} x{i}" for i in range(40_000))
    more = [(0, fresh, "en", "a", 1), (0, fresh, "en", "a", 1), (None, fresh + " x y", "en", "a", 1), (950, long, "en", "b", 1)]
    names = ("size", "target", "position", "root", "fp", "keeps", "__kept_id", "mix_size", "n", "k")
    wide = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns({x: F.lit("own") for x in names})
    after = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns, name
        rows = out.collect()
        wide = spark.createDataFrame(rows, out.schema)
        after.append([(r.doc_id, r.text) for r in rows])
    own = docs.filter("doc_id = 0").first().text
    assert {t for i, t in after[2] if i == 0} == {own, fresh} and (950, long) in after[2]  # both texts of id 0 stay, once
    assert len([1 for i, _ in after[2] if i in (0, None)]) == 2
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf_dir).count() > 0


def test_run_leaves_nothing_behind(spark, sf_dir, tmp_path, monkeypatch):
    from faultline.plans import lineage

    monkeypatch.setattr(lineage, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    left = [p.name for p in tmp_path.iterdir()]
    assert len(left) == 1 and left[0].startswith("source-mix")  # what the lazy result still reads
