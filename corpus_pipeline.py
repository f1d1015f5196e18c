"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes all documents that the one before it kept, as a DataFrame with the columns of `documents`; the last
one returns the packed pieces. Between stages the rows are written to the shared folder and read again.

Cases, in all stages: a null or empty text fails the quality rules, so it goes in the first stage; given to a later one
it has no words, is linked with nothing, loses nothing and is one piece of one token. Rows repeated with their id go or
stay together until near_dup, of whose groups the rows of the smallest id stay; a null id is in no label and no trusted
set, and among near duplicates gives way to any other. Columns besides text and n_chars pass through every stage but
the last; n_chars is counted anew where a passage is removed, and stays null where it was. No documents give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import near_dup, packing, quality_classifier, quality_rules, substring
from orrery.llm.common import table, written
from orrery.llm.queries import held_out, tokenizer_path


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the n-gram ratio keep."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels").filter("quality = 1"))


def by_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; it is fitted on labelled ones of the whole table."""
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    return quality_classifier.kept_documents(docs, table(spark, sf_dir, "documents"), labels)


def by_near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8)."""
    return near_dup.deduplicated(docs, size=5, percent=80)


def by_substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 13 words or more that an earlier one has."""
    other = [c for c in docs.columns if c != "text"]
    cut = substring.deduplicated(docs, keep=other, verbatim=True).select("row.*", F.col("kept_text").alias("text"))
    n_chars = F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def by_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 4096 tokens."""
    parts = packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), keep=["doc_id"])
    return packing.packed(parts).select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", by_quality_rules),
    ("quality_classifier", by_quality_classifier),
    ("near_dup", by_near_dup),
    ("substring", by_substring),
    ("packing", by_packing),
]

#: Stages learn, sign and search; SQL does not express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
