"""The corpus pipeline: five stages over the documents table, each on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows as Parquet in the shared scratch folder and reads them back as the
next stage's input.  All but the last stage return the columns of documents, in any
order and with further columns of any name.  An empty table stays empty in every
stage.  The two stages that number rows read a written table twice, as ``run`` gives it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dishscope.llm import mixing, near_dedup, prefix_bpe, private_data, toxicity
from dishscope.llm.common import Scratch, documents, free_names, numbered, temporary
from dishscope.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the classifier, learnt from ``labels``, gives a score of 0.5 or more.

    A null text is scored as an empty one, equal texts alike, whole texts whatever
    their length; without labels the score is 0.5 and nothing can be told, so all go.
    """
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates on shingles of five words.

    It is the one of least id (rows without an id come last; of equal ids the first row).  Documents
    without text or words are like nothing and all stay, repeated or not.
    """
    (row,) = free_names(docs, "_row")
    stays = near_dedup.near_duplicates(docs, k=5).filter("stays").select(F.col("row").alias(row))
    return numbered(docs, row).join(stays, row).select(*[F.col(f"`{c}`") for c in docs.columns])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; every row stays, null texts stay null, ``n_chars`` is the new length."""
    return private_data.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for, in the shuffled order of the shards.

    Null is a source of its own, the last; documents without words are taken once.
    """
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes the ids: doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; null counts as empty."""
    return prefix_bpe.digests(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_each),
    ("personal data", redact),
    ("mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: Classifier, MinHash and piece encoding have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        with temporary():  # a stage's own tables go once its rows are written
            docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
