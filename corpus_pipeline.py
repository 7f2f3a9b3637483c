"""The corpus pipeline: toxicity, quality, near-dedup, mixing, packing. Each stage gets all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import mixing, near_dup, packing
from sparkloom.llm.queries import byte_bpe, quality_of, toxicity_of
from sparkloom.llm.shared import read, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below its threshold."""
    return toxicity_of(spark, docs, sf_dir).where("predicted = 0").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior reaches its threshold."""
    return quality_of(spark, docs, sf_dir, keep_columns=True).where("keep").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group (five-word shingles, similarity 0.8 or more)."""
    return near_dup.keep_one(docs, near_dup.NearDupParams(words=5)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities that rake sources, languages and topics to their targets.

    Half of the tokens are kept at least: a few words left of a topic would otherwise bound the whole sample.
    """
    return mixing.mix(docs, mixing.MixingParams(least=0.5)).where("sampled").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 1024 ids."""
    return packing.pack(docs, byte_bpe())


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]
#: The stages train models, so DuckDB can't express them; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*[F.col(c) for c in COLUMNS])
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
