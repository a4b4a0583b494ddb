"""A corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokeline.llm import bpe, decontaminate, langid, neardup, spans
from strokeline.llm.queries import TOKENIZERS, table
from strokeline.llm.store import new_path
from strokeline.shipping import ship_package

#: A document whose most likely language is less likely than this is rejected.
MIN_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the models are learned from the labelled documents of the input."""
    ship_package(spark)
    vocabulary = langid.sentencepiece_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    return langid.keep_identified(docs, langid.train_languages(docs, vocabulary), min_score=MIN_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 5-word shingle sets of a similarity of 0.8 or more."""
    ship_package(spark)
    return neardup.keep_representatives(docs, shingle=5, percent=80, bands=32, rows=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences of repeated runs; n_chars is counted anew, and a document of which nothing is left goes."""
    ship_package(spark)
    made = spans.remove_repeated_spans(docs, counts=False)
    made = made.where("text is null or text <> ''")
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    ship_package(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their number of tokens and the digests of their ids and of the text decoded from these."""
    ship_package(spark)
    # a column of the documents with the name of a new one gives way to it
    others = [c for c in docs.columns if c not in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")]
    named = {c: f"_{n}" for n, c in enumerate(others)}
    made = bpe.bpe_round_trip(docs.select("doc_id", *[F.col(c).alias(n) for c, n in named.items()]), f"{TOKENIZERS}/byte_bpe_50k.json", text_col=named["text"], carry=tuple(named.values()))
    return made.select("doc_id", *[F.col(n).alias(c) for c, n in named.items()], "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_coding", bpe_coding),
]

#: SQL cannot express the learned, hashed and tokenised stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
