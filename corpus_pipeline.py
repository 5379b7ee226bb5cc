"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next one.

A stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Those before the last
return the columns of documents; the last returns every document's place in the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm.common import drop_folder, stage, table
from tokenloom.llm.jaccard_join import one_of_each
from tokenloom.llm.packing import pack, token_lengths
from tokenloom.llm.quality_classifier import quality_filter
from tokenloom.llm.queries import WORD_BPE
from tokenloom.llm.toxicity import toxicity_filter
from tokenloom.session import ship


#: Folders of working tables that the rows of the last called filter are read from.
_working: set[str] = set()


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def _begin(spark: SparkSession, docs: DataFrame) -> None:
    """Deletes the working tables of the stage before, whose rows have been written if docs does not read them."""
    for folder in _working - _folders(docs):
        drop_folder(spark, folder)
    _working.clear()


def _filtered(docs: DataFrame, kept: DataFrame) -> DataFrame:
    _working.update(_folders(kept) - _folders(docs))
    return kept


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all columns, whatever their names.

    Null and empty texts are scored like others, repeated rows each for itself, ids and labels may be null or
    repeated; an empty table gives an empty table. The rows have to be written before the next stage begins.
    """
    _begin(spark, docs)
    return _filtered(docs, quality_filter(docs, table(spark, sf_dir, "labels")))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier lets pass, with all columns; odd rows as in good_documents()."""
    _begin(spark, docs)
    return _filtered(docs, toxicity_filter(docs, table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

    Null, empty and blank texts have no copies. Of rows with equal doc_id one stays, and rows without doc_id
    stay one for each text that no row with a doc_id has; an empty table gives an empty table.
    """
    _begin(ship(spark), docs)
    return one_of_each(docs, width=5, percent=80)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's length bucket, batch and slot; null and empty texts have no tokens, repeated rows a slot each."""
    _begin(ship(spark), docs)
    return pack(token_lengths(docs, WORD_BPE))


STAGES = [("quality", good_documents), ("toxicity", clean_documents), ("near_copies", distinct_documents), ("packing", packed_documents)]

#: Fitted models, components and dynamic programming aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
