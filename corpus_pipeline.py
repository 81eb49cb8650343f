"""The corpus pipeline: toxic documents go, near copies go, benchmark leaks go, sources are mixed, tokens are written.

Each stage takes (spark, docs, sf_dir) and calls one operator of ``veilstream.llm``; its result is written as
Parquet in the shared folder and read again as the next one's documents.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilstream.llm.common import materialise, spread, table
from veilstream.llm.decontaminate import drop_contaminated
from veilstream.llm.mixing import mixed_documents
from veilstream.llm.simhash import drop_near_duplicates
from veilstream.llm.token_store import store_and_read
from veilstream.llm.toxicity import drop_toxic, train

#: Jaccard similarity from which two documents are near copies.
NEAR = 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar rejects go; it is fitted on labelled rows that are not held out."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays: the one of the smallest doc_id."""
    return drop_near_duplicates(docs, similarity=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as a store and read back: doc_id, start, n_tokens, ids_crc32."""
    return store_and_read(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]

#: SQL cannot express the tokenizer and the learned model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for n, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
