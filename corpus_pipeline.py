"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's rows to
the shared folder and reads them back as the next stage's documents. All stages but the last return
the columns of documents; the last one returns the packed pieces.

Rows that repeat a doc_id are rows of their own in every stage. Rows without doc_id are judged by their
text where a stage looks at texts alone (toxicity, decontamination, packing) and kept as they are where it
compares documents (near_dedup, substring_dedup). Null and empty texts have nothing that is toxic, repeated
or of a benchmark; they are kept, and packed as their end mark. Columns beyond those of documents are
handed through, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dredge.llm import decontamination, near_dedup, packing, substring_dedup, toxicity
from dredge.llm.common import table, written
from dredge.llm.queries import tokenizer_path

#: Words that a passage must have to be cut where it repeats across documents.
PASSAGE = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model, fitted to the labels, doesn't reject.

    Without labels nothing is rejected. A text is judged whole, however long.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays; all rows that repeat it do. Empty texts are like nothing.
    """
    return near_dedup.dedup(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of PASSAGE words or more that an earlier document has.

    Earlier is a smaller doc_id; rows that repeat a doc_id don't take from one another. A text that is all
    passage becomes empty and stays. n_chars is counted anew.
    """
    return substring_dedup.dedup(docs, PASSAGE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark passages are under 5% of the words, without these passages.

    A passage is 13 words of an item, or the whole of a shorter item. n_chars is counted anew where text was cut.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens, every one of them in one place."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("decontamination", decontaminate),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Neither the model of the first stage nor the packing of the last can be put in SQL.
ORACLE_SQL = None
