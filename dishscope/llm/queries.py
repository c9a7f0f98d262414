"""Queries over the synthetic tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_prefix_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text with the 32k piece vocabulary."""
    from . import prefix_bpe
    from .common import documents

    return prefix_bpe.digests(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


@query
def op2_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every text's ids as patched frame-of-reference files and read them back."""
    from . import packed_ids
    from .common import documents

    return packed_ids.round_trip(spark, documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=2)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to their sources' target weights."""
    from . import mixing
    from .common import documents

    return mixing.mixed_sizes(documents(spark, sf_dir))


@query
def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components on shingles of four words at a similarity of 0.8."""
    from . import near_dedup
    from .common import documents

    return near_dedup.near_duplicates(documents(spark, sf_dir), k=4).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op9_vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors, by integer inner product, of every fiftieth vector."""
    from . import vector_file

    return vector_file.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE["op9_vector_file"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (
  SELECT row_number() OVER () AS number, * FROM v WHERE vec_id % 50 = 0
), s AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i])) AS BIGINT) AS score
  FROM n q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all texts, learnt outside the held-out fifth."""
    from . import toxicity
    from .common import documents

    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts."""
    from . import fingerprints
    from .common import documents

    return fingerprints.edited_pairs(documents(spark, sf_dir))


@query
def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based language-model scores of all texts."""
    from . import brown_lm
    from .common import documents

    return brown_lm.scored(documents(spark, sf_dir))


@query
def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all texts: base spans and those the boosted trees add."""
    from . import private_data
    from .common import documents

    return private_data.found(documents(spark, sf_dir))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, with models learnt from all documents."""
    from . import language_id
    from .common import documents

    return language_id.identify(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))
