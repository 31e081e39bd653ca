"""From raw documents to token shards, in five stages.

Each stage takes (spark, docs, sf_dir), with ``docs`` the rows its predecessor kept, and returns
a DataFrame that is written before the next one reads it.  All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grocerlake.llm.common import materialize, table
from grocerlake.llm.decontamination import drop_contaminated
from grocerlake.llm.language_id import fit_dictionaries, identify_language
from grocerlake.llm.mixing import emit_mix, mix_sources
from grocerlake.llm.ngram_jaccard import jaccard_components
from grocerlake.llm.token_binary import token_binary


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin.

    Dictionaries come from a bounded sample of the rows that have a lang.
    """
    named = identify_language(docs, fit_dictionaries(docs.select("doc_id", "text", "lang")))
    return named.where("not rejected").select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the least id.

    Documents without words stay, and rows without an id, which cannot be named; of rows with equal id and
    text in a component one stays.
    """
    found = materialize(jaccard_components(docs).where("n_shingles > 0 and doc_id is not null"))
    by_id = found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("goes"), F.count(F.lit(1)).alias("rows"))
    by_id = materialize(by_id.where("goes or rows > 1"))
    # those that go are fewer than those that stay
    kept = docs.join(by_id.where("goes").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    return kept if by_id.where("rows > 1 and not goes").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, re-parameterised or not."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target says."""
    return emit_mix(mix_sources(docs), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of the mix, read from its token shards."""
    return token_binary(docs)


STAGES = [
    ("language ID", keep_identified),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]

#: Compression and the tokenizer have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
