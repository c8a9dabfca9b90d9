"""Stages of the corpus pipeline: documents in, documents with the same columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import bpe, langid, quality, simhash
from . import mix as mixing
from .queries import bpe_digests, table, tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is likelier of label 1 than of label 0 stay.

    Learned from the labels of documents that came in; without labels all stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    kept = quality.scored(docs, model, "__score").where(F.col("__score") >= 0.5)
    return kept.select(*docs.columns)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents for which operator 7 names a language stay, however many languages share the score.

    Texts without a letter go.  The documents' own ``lang`` only trains the network; if no
    document has one, all texts are unknown and stay.
    """
    model = langid.fit(docs)
    if not model["names"]:
        return docs
    found = langid.detected(docs, model, "__lang_pred", "__lang_score")
    return found.where(F.col("__lang_pred") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest id, then text hash.

    Rows that repeat both id and text are copies; one of them stays.  A row without an id stays
    only in a group that has no id at all, and then one such row.
    """
    found = cut(simhash.near_duplicates(docs, shingle=3, max_bits=2), "near-duplicates")
    stays = F.col("stands")
    row = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")]
    # Fewer rows go than stay, so the rows that go are looked up.
    gone = cut(found.where(~stays).select(*row).distinct(), "gone")
    again = cut(found.where(stays).groupBy(*row).count().where("count > 1").drop("count"), "again")
    text = F.col("text").cast("string")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    kept = docs.join(gone, same, "left_anti")
    if again.isEmpty():
        return kept
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionByName(once)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 1, 2, 3 in turn; repeated and cut documents take effect."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document that is left."""
    return bpe_digests(bpe.encode_decode(docs, tokenizer_path()))
