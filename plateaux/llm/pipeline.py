"""The stages of corpus_pipeline.py; each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of the documents they were given. Rows are told apart by ``doc_id``; a row without
one is kept by every filter, as no decision can name it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import stored, table, without

#: No stage after the learned one has a SQL form, so the whole has none; tests hold each stage against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    from .toxicity import score_documents

    scored = score_documents(docs, table(spark, sf_dir, "labels"))
    return without(docs, stored(scored.where("predicted = 1 and doc_id is not null").select("doc_id").distinct(), "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages go; every document stays, if need be with an empty text."""
    from .line_dedup import dedup_passages

    return dedup_passages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one with the smallest doc_id stays."""
    from .jaccard import link_components

    found = link_components(docs, words=5, similarity=80)
    return without(docs, stored(found.where("component_id < doc_id").select("doc_id").distinct(), "copies"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    from .decontaminate import decontaminate

    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and where they lie in the packed sequences."""
    from .packing import pack

    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
