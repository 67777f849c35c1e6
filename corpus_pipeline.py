"""A corpus pipeline of training-data operators: five stages, each over all that the one before it kept.

Quality classifier, language identification, one document of each group of near duplicates, removal
of repeated passages, packing. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuskey.llm import langid, quality
from locuskey.llm.jaccard_join import one_of_each
from locuskey.llm.packing import pack
from locuskey.llm.scratch import Tables
from locuskey.llm.substring_dedup import remove_repeated_windows

#: Documents of which the language model is less sure are rejected, and those without letters.
LEAST_SURE = 0.5
#: Words that a packing worker remembers, and bytes of text that it cuts at once: less than where packing is alone, since executors have grown in the stages before.
REMEMBERED, CHUNK_BYTES = 3 << 16, 3 << 18


def _nested(docs: DataFrame) -> DataFrame:
    """Id and text, and the other columns as one, so that none clashes with what an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(None).alias("_none")]).alias("_columns"))


def _as_before(rows: DataFrame, docs: DataFrame, **new) -> DataFrame:
    """The columns of ``docs`` from what an operator made of ``_nested(docs)``."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")} | new
    return rows.select(*[own.get(c, F.col("_columns").getField(c)).alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of good quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(_nested(docs), quality.fit(docs, labels), keep_text=True)
    return _as_before(scored.where("predicted = 1"), docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with some confidence."""
    labelled = langid.label(_nested(docs), langid.fit(docs), keep_text=True)
    return _as_before(labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE)), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; n_chars follows the text."""
    cut = remove_repeated_windows(_nested(docs), keep_spaces=True)
    n_chars = F.when(F.col("n_removed") == 0, F.col("_columns").getField("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return _as_before(cut, docs, text=F.col("kept_text"), n_chars=n_chars)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids, and their places in sequences of 4096 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED, chunk_bytes=CHUNK_BYTES)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: A trained model and a tokenizer are no SQL; a test holds run() against plain code, the models' decisions apart.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Tables(spark)
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
