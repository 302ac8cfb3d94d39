"""From raw documents to packed training sequences, as stages that can each be written and read again.

Quality rules and the quality classifier drop documents, groups by SimHash or five-word shingle similarity 0.8 keep one, the mix
repeats or leaves out documents by source and orders them for training, and packing cuts what is left into sequences. All
stages but the last return the columns of ``documents`` (further columns stay as well); the last returns the pieces of
the sequences.

Defined cases: null and empty texts have no words and go with the quality rules; of a group without any doc_id one row
stays; where a doc_id repeats, its rows are told apart by their texts; a null source is a source of its own; repeated
rows end as one in the near-duplicate stage; an empty table stays empty through all stages; without labels the classifier
keeps everything. The operators' docstrings say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import mixing, packing, quality, repetition, simhash, similar
from faultline.llm.common import fresh_prefix, table
from faultline.plans.lineage import discard, scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_unrepetitive(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_selected(docs, quality.learn_from(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, groups=similar.near_duplicates, printed=similar.text_node)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prefix = fresh_prefix(docs, "mix_", mixing.ADDED)
    return mixing.training_rows(mixing.mix(docs, ordered=False, prefix=prefix), docs.columns, prefix=prefix)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("sequence packing", sequence_packing),
]

#: Suffix arrays, learned weights and token ids are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        keep: list[str] = []
        with scratch(spark, keep):  # what a stage writes for itself goes when its rows are written
            docs, at = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(at)
        if last:
            discard(spark, last)
        last = at
    return STAGES[-1][1](spark, docs, sf_dir)
