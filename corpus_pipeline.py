"""Documents from raw to encoded: language ID, line dedup, near-duplicate removal, mixing, BPE.

Each stage takes all that its predecessor kept and returns the columns of documents; the last returns the encoded
corpus. ``run`` writes each stage to the shared folder and rereads it; a stage's table goes when the next one stands.
Null ids, repeated rows and unlabelled corpora pass through: only what a fitted model rejects goes, and texts without
a letter. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, language, line_dedup, mixing, ngram_join
from tidewatch.llm.queries import vocabulary
from tidewatch.llm.runtime import Stash


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted language is rejected go: those without letters, and those below the calibrated score."""
    said = language.predict(docs, language.fit(docs), lang_out="__lang", score_out="__score", reject_out="__rejected")
    return said.where(~F.col("__rejected")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus go, and documents of which nothing is left."""
    out = line_dedup.dedup(docs).where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"\S"))
    return _sized(out).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least id."""
    groups = ngram_join.groups(docs).where(F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id")))
    kept = groups.select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["__id"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, and those of smaller sources are repeated, none more than twice."""
    return mixing.realise(mixing.mix(docs)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether decoding them gives the text again."""
    out = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary())
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("exact"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_duplicates", dedup_documents), ("mixing", mix_sources), ("bpe", encode)]

#: Neither the language model nor BPE can be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stash, docs, before = Stash(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = stash.keep(stage(spark, docs, sf_dir), name)
        stash.drop(*before)
        before = [name]
    return docs
