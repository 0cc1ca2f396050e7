"""Registered queries of the pipeline operators: each applies its operator to
its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastat.llm import (bpe, chat, decontaminate, jaccard, langid, mixing, repair, secrets,
                           sharding, tokens, topk, urlfilter, whitening)
from terrastat.session import scratch_path
from terrastat.sources.tables import read_table

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(read_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokens.token_index(spark, path)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sample = langid.learn(docs.where(~langid.held_out()))
    return langid.identify(docs, sample).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(read_table(spark, sf_dir, "conversations"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_hits(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op5_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), 24)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read_table(spark, sf_dir, "documents")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page whose id is labelled is bad if toxic or of quality 0."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0))
        .alias("bad"))
    judged = pages.join(labels, F.col("page_id") == F.col("doc_id"), "left")
    return urlfilter.filter_urls(judged, bad=F.col("bad")).select(
        "page_id", "host", "path", "rule", "verdict")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(BYTE_TOKENIZER)
    return bpe.digest(bpe.encode(read_table(spark, sf_dir, "documents"), path), path)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return repair.digest(turns, repair.repair(repair.damaged(turns)))


QUERIES = {f.__name__: f for f in (
    op1_token_orc, op2_language_id, op3_chat_format, op4_decontaminate, op5_kd_shards,
    op6_jaccard_join, op7_secret_scan, op8_url_filter, op9_mix_sources, op10_top_k, op11_whitening,
    op12_bpe, op13_repair)}
