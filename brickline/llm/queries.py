"""The registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickline.llm import curriculum, decontaminate, langid, licenses, manifest, ngram_lm, prefixes, quality, ranked, ring, simhash, telephony, tokens
from brickline.llm.common import crc32_of_id, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


ORACLE["op1_license_scan"] = licenses.oracle()


@query
def op3_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = telephony.store_pcm(telephony.store_media(table(spark, sf_dir, "documents")))
    parts = ["codec", "samples", "peak", "energy", "crossings", F.crc32("pcm")]
    return decoded.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).alias("feature"),
    )


@query
def op4_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = curriculum.mix_plan(table(spark, sf_dir, "documents"))
    first = F.get("positions", F.lit(0))
    return plan.select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"),
        F.round(first, 6).alias("first_position"),
    ).orderBy("first_position", "doc_id")


@query
def op7_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.report(decontaminate.phrase_hits(docs, items))


ORACLE["op5_benchmark_decontamination"] = decontaminate.oracle()


@query
def op10_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(spark, tokens.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path())).drop("ids")


@query
def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc32_of_id(F.col("doc_id")) % 5 == 0
    model = quality.learn(docs, labels, ~held_out)
    scored = quality.score_documents(docs, model, F.col("doc_id"), held_out.alias("held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_of_id(F.col("doc_id")) % 5 == 0
    model = langid.learn(docs, ~held_out)
    return langid.identify(docs, model, F.col("doc_id"), held_out.alias("held_out"))


@query
def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_documents(table(spark, sf_dir, "documents"), crc32_of_id(F.col("doc_id")) % 10 != 0)


@query
def op11_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified_documents(table(spark, sf_dir, "documents"))


ORACLE["op12_merkle_manifest"] = manifest.oracle()


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op13_ranked_search"] = ranked.oracle()


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
