"""The operators' queries over the supplied tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, hmm_lm, lang_id, licenses, media, mixing, near_dup, packing, quality, toxicity
from .shared import read, remainder, table


def learns(modulus: int, held: int):
    """Rows whose crc32(id as text) mod modulus is not `held`."""
    return lambda c: F.coalesce(F.crc32(c.cast("string")) % modulus, F.lit(-1)) != held


def byte_bpe() -> packing.Tokenizer:
    import public_tokenizers

    return packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: source/lang/doc_id stands for one."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", "text", path.alias("path")))


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe())


def op3_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = hmm_lm.score(docs, learn_from=learns(7, 2))
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    p = lang_id.LanguageParams()
    found = lang_id.learn(docs, p, learns(3, 1))
    out = lang_id.predict(docs.select("doc_id", "text"), found, p)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op5_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda c: c % 20 == 0)


def quality_of(spark: SparkSession, docs: DataFrame, sf_dir: str, keep_columns: bool = False) -> DataFrame:
    """Posteriors of docs: hosts are sources, paths are languages within them. Features are made once, into a written table; texts go with them if keep_columns."""
    p, labels = quality.QualityParams(), read(spark, sf_dir, "labels")
    model = quality.train(docs, labels, p, learns(4, 2))
    evidence = quality.with_evidence(docs, model)
    evidence = table(evidence if keep_columns else evidence.drop("text"), "evidence")
    rates = quality.sites(evidence.select(F.col("doc_id").alias("id"), F.col("source").alias("host"), F.col("lang").alias("path"), "p_doc"), labels, p, learns(4, 2))
    return quality.posterior(evidence, rates, model, p, "source", "lang")


def op6_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_of(spark, read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), sf_dir)
    return out.select("doc_id", "source", "lang", "p_doc", "host_rate", "path_rate", "posterior", "keep")


def op7_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


def op8_text_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return media.digests(table(stored, "media"))


def toxicity_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = toxicity.ToxicityParams()
    rows = toxicity.training_rows(docs, read(spark, sf_dir, "labels"), "toxic", p, learns(4, 2))
    return toxicity.score(docs, toxicity.train(rows, p), p)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_of(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op10_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(read(spark, sf_dir, "documents").select("doc_id", "text"), near_dup.NearDupParams(words=2))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_pack_sequences, op3_hmm_lm, op4_language_id, op5_one_bit_ann, op6_site_quality, op7_mix_to_targets, op8_text_media, op9_toxicity, op10_setsketch_dedup)}
