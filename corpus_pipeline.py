"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and works on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import exact_dedup, language_id, mixing, ngram_join, sentencepiece_lattice
from strandline.llm.common import documents, materialise
from strandline.session import ship


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without evidence for any language learnt, go; the latter stay if theirs couldn't be learnt."""
    ship(spark)
    return language_id.keep_known(docs, language_id.learn(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    ship(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shared shingles the smallest doc_id stays."""
    ship(spark)
    return ngram_join.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: up to twice, or not at all."""
    ship(spark)
    return mixing.repeat_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids, their number, and whether they decode to the text."""
    ship(spark)
    return sentencepiece_lattice.encode(docs, sentencepiece_lattice.Pieces.load(), text=False).select("doc_id", "ids", "n_tokens", "exact")


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: Language ID and piece encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
