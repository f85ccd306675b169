"""A training corpus in stages: toxic documents go, near-duplicates go, secrets are masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealedger.llm.common import documents, materialize, small_batches
from arealedger.llm.config_packing import pack_documents
from arealedger.llm.queries import table, tokenizer
from arealedger.llm.secret_battery import redact
from arealedger.llm.simhash_golay import keep_one_per_group
from arealedger.llm.toxic_crf import drop_toxic

#: Packing meets executors whose heap the earlier stages have filled, so its workers keep fewer pieces and take smaller slices than op9's.
KEPT, SLICE = 100_000, 600_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field of labelled rows doesn't reject.

    Null and empty texts have no sign and stay. Equal rows share their fate; all columns pass through; an empty table stays empty.
    """
    with small_batches(spark):
        return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingle likeness of 0.8 or more.

    The smallest doc_id stays (a null one only where there is no other), then the least text hash. Null and empty texts are
    copies of each other. Of repeated rows one stays; all columns pass through; an empty table stays empty.
    """
    with small_batches(spark):
        return keep_one_per_group(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked.

    Null and empty texts stay as they are, and so do repeated rows; n_chars is counted anew; an empty table stays empty.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: where it stands in which sequence.

    Null and empty texts are a piece of the end id alone; repeated rows are packed each; an empty table gives an empty one.
    """
    with small_batches(spark):
        return pack_documents(docs, tokenizer("byte_bpe_50k.json"), kept=KEPT, most=SLICE)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: The field, the tokenizer and the program can't be said in SQL; tests hold each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each over what the one before wrote."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
