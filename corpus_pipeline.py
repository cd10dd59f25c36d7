"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage takes documents with doc_id, text and any other columns, whatever their names, and all
but the last return those that stay, with the same columns. A null text counts as empty. Rows
that repeat a doc_id are documents of their own, except in near dedup. An empty table gives an
empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontamination, language_id
from pathloom.llm.columns import small, unpacked
from pathloom.llm.exact_dedup import exact_dedup
from pathloom.llm.packing import pack_documents
from pathloom.llm.simhash import similar_groups
from pathloom.llm.tokens import default_path
from pathloom.shared import save_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the language model does not reject.

    The model learns from the labelled ones outside the held-out fold; without any it knows no
    language and all documents go. Null, empty and letterless texts are rejected. Rows are judged
    by their texts alone, so equal ones stay or go together.
    """
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return unpacked(language_id.identify(docs, model).where(~F.col("rejected")), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text but for ASCII white space, the one that stays.

    That is the longest, then the one with the smallest id; a null id comes last. All empty
    texts are equal. Of rows that repeat an id and a text one stays.
    """
    return unpacked(exact_dedup(docs).where("kept"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with a five-word shingle similarity of 0.8 or more, the one with the smallest id.

    Similarity is the Jaccard index of the sets of shingles and is confirmed for every link, so no
    pair below 0.8 is linked; links make groups. Rows with one id are one document, and rows
    without an id all stay. Documents without words are alike.
    """
    groups = similar_groups(docs, size=5, similarity=0.8)
    dropped = save_table(groups.where("id != component_id").select(F.col("id").alias("doc_id")), "near-duplicates")
    return docs.join(small(dropped, dropped.count()), "doc_id", "left_anti").select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts have none; items without words are never found, and without items all
    documents stay.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in sequences of at most 1024 ids.

    A null or empty text is the end id alone; rows that repeat are packed each.
    """
    packed = pack_documents(docs, default_path(), 1024)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("decontamination", clean), ("packing", pack)]

#: Language models, similarity groups and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
