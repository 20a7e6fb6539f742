"""A corpus from documents to packed sequences: each stage keeps to what its predecessor left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import decontaminate, lines, neardup, packing, toxicity
from specloom.llm._runtime import Workspace
from specloom.llm.queries import table, tokenizer_path

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a classifier of sentences, fitted to the labelled ones, scores 0.5 or more.

    Null and empty texts score 0 and stay; rows with equal texts go or stay together; other columns pass through; an empty table gives an empty one.
    """
    return toxicity.drop(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines and of long lines; n_chars follows.

    Every row stays: null texts as null, with n_chars null, and texts that lose all lines as empty. The first copy is that of the smallest doc_id, null ids first; rows with equal
    doc_id and text are one document. Other columns pass through whatever their names; an empty table gives an empty one.
    """
    out = lines.dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id.

    Null, empty and wordless texts and null doc_ids are near nothing and stay. Rows with equal doc_id are one document and go or stay together. Other columns pass through; an empty table gives an empty one.
    """
    return neardup.dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item.

    Null and empty texts hold none and stay; of rows with equal doc_id all go if any holds an item; rows with null doc_id stay. Other columns pass through; an empty table or benchmark removes nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences. Null and empty texts are one end id; repeated rows are packed each by itself; null doc_ids pass through; an empty table gives none."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near duplicates", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]
#: No SQL: the first stage is a trained classifier. Tested on documents planted for each stage; the operators themselves are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = ws.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        ws.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
