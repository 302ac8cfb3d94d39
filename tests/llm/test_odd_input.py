"""Bytes that are no UTF-8, names with dots, blocks of very many short texts, a model file of another kind."""

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from faultline.llm import common, mixing, packing, simhash, token_counts  # noqa: E402

BROKEN = b"under the \xff\xfe mit license word " * 8


@pytest.fixture(scope="module")
def broken(spark):
    rows = [(1, bytearray(BROKEN)), (2, bytearray(b"plain text here " * 8)), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, raw binary")
    return df.select("doc_id", F.col("raw").cast("string").alias("text"), F.lit("a").alias("source"), F.lit("x").alias("a.b"), F.lit(1).alias("odd name"))


def test_bytes_that_are_no_text_are_replaced(broken):
    pieces = packing.pack(broken, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {x.doc_id for x in pieces} == {1, 2, 3}
    counts = token_counts.token_counts(broken, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model")).collect()
    whole = BROKEN.decode("utf-8", "replace")
    n = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))(whole)
    assert {x.doc_id: x.n_tokens for x in counts}[1] == n
    assert simhash.fingerprints(broken, "doc_id", "text").count() == 3


def test_any_column_name_stays(broken):
    kept = common.text_filter(broken, "text", lambda: lambda texts: [t is not None for t in texts])
    assert kept.columns == broken.columns and {r.doc_id for r in kept.collect()} == {1, 2} and {r["a.b"] for r in kept.collect()} == {"x"}
    prefix = common.fresh_prefix(broken, "mix_", mixing.ADDED)
    mixed = mixing.training_rows(mixing.mix(broken, ordered=False, prefix=prefix), broken.columns, prefix=prefix)
    assert mixed.columns == broken.columns and mixed.count() >= 2
    once = simhash.drop_near_duplicates(broken.union(broken))
    assert once.columns == broken.columns and once.count() == 3


def test_packing_blocks_close_at_documents(spark, monkeypatch):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("").alias("text")).coalesce(1)
    monkeypatch.setattr(packing, "BLOCK_DOCS", 50)
    rows = packing.pack(df, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(rows) == 200 and all(x.length == 1 for x in rows)
    by_sequence = {}
    for x in rows:
        by_sequence.setdefault(x.sequence_id, set()).add(x.offset)
    assert all(offsets == set(range(len(offsets))) for offsets in by_sequence.values())


def test_other_model_files_are_refused(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    real = sentencepiece.SentencePieceProcessor.encode
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "encode", lambda self, text: [0, *real(self, text)])
    token_counts.counter.cache_clear()
    with pytest.raises(ValueError, match="no plain byte-pair"):
        token_counts.counter(path)
    token_counts.counter.cache_clear()
