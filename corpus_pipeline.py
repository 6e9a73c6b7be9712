"""From raw documents to packed training sequences: language, toxicity, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes each one and reads it again for the next. All but
the last return the columns they got.

Every stage judges rows, not ids: null and repeated doc_ids are rows like others, and equal rows share a fate but in the
near-duplicate stage, which keeps one. Null texts, and those without a letter, go with the language stage. Very long texts are
read as a whole. Empty tables pass through. Other columns, whatever their names, pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontamination, langid, neardup, packing, queries, toxicity
from tidemill.llm._common import read
from tidemill.shared import cut, paths_made, remove


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the tables are fitted on the documents' own labels."""
    return langid.accepted(docs, langid.fit(docs, F.lit(True)))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    return toxicity.accepted(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.deduplicated(docs, threshold=0.8)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands among sequences of 2048 tokens."""
    return packing.pack_documents(docs, queries.word_bpe(), capacity=2048, end=0)


STAGES = [
    ("language", language),
    ("toxicity", clean),
    ("near-duplicates", distinct),
    ("decontamination", unleaked),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage wrote to the shared folder goes when the next one is done."""
    docs, before = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with paths_made() as made:
            docs = cut(stage(spark, docs, sf_dir))
        remove(spark, [*before, *made[:-1]])
        before = made[-1:]
    return docs


#: Most stages run models and hashes that SQL can't express; the tests compare with brute force.
ORACLE_SQL = None
