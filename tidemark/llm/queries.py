"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from . import bpe, contamination, conversations, fill_middle, hash_forest, langid, licenses, mix, pages, quality, simhash, token_store, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mix_sources", mix.SQL)
def op1_mix_sources(spark, sf_dir):
    taken = mix.mix(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_simhash_near_dedup")
def op2_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_embedding_near_dedup", vector_dedup.SQL)
def op4_embedding_near_dedup(spark, sf_dir):
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query("op10_hash_forest_search")
def op10_hash_forest_search(spark, sf_dir):
    return hash_forest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def bpe_digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op9_bpe_encode_decode")
def op9_bpe_encode_decode(spark, sf_dir):
    return bpe_digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


@query("op6_quality_attention")
def op6_quality_attention(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_language_cnn")
def op7_language_cnn(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op8_token_blocks")
def op8_token_blocks(spark, sf_dir):
    path = fresh_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), path, end_id=2)
    found = token_store.read_tokens(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_wrapper_extraction")
def op5_wrapper_extraction(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"))


@query("op3_license_scan", licenses.check_sql())
def op3_license_scan(spark, sf_dir):
    return licenses.licenses(table(spark, sf_dir, "documents"))


@query("op12_fill_middle", fill_middle.SQL)
def op12_fill_middle(spark, sf_dir):
    return fill_middle.digests(fill_middle.transform(table(spark, sf_dir, "documents")))


@query("op13_decontaminate", contamination.check_sql())
def op13_decontaminate(spark, sf_dir):
    found = contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return contamination.digests(found)


@query("op11_repair_conversations")
def op11_repair_conversations(spark, sf_dir):
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.digests(conversations.repair(rows))
