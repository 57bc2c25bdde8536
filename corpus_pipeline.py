"""Documents to training sequences: five operators in order, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import language, near_copies, packing, quality_rules, repeats
from pagewright.llm.queries import RANKS, VOCABULARY, table
from pagewright.llm.runtime import join_small, materialise


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.passed(docs, table(spark, sf_dir, "labels"))


def known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model learns from those of docs that are not held out."""
    return language.passed(docs, language.train(docs.where(~language.held_out())))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies; documents without an id stay."""
    found = materialise(near_copies.classes(docs))
    chosen = found.where("doc_id = class_id").select("doc_id")
    kept = join_small(docs, chosen.distinct(), "doc_id", "left_semi", near_copies.BROADCAST)
    if not chosen.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur twice or more."""
    return repeats.passed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences."""
    return packing.pack_documents(docs, VOCABULARY, RANKS)


STAGES = [("quality rules", good), ("language", known), ("near copies", single), ("repeats", unrepeated), ("packing", packed)]

#: The stages use models, signatures and a tokenizer that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
