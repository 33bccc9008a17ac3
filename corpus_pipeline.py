"""Five stages from raw documents to token statistics of a cleaned corpus.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept,
and returns a DataFrame; run() writes it as Parquet to the shared folder and hands the
table read back to the next stage; what a stage wrote besides, and the table before it,
is deleted then. All stages but the last return the columns of documents.

Defined results: null and empty texts are rejected by the first stage, as it scores them
0. Repeated rows are copies and leave one. An empty table gives no rows. Of equal texts
the largest doc_id stays, of near copies the smallest. Columns beside doc_id and text
pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glosswright.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from glosswright.llm._common import materialize, table
from glosswright.sources.storage import discard, scratch


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the weakly trained classifier rejects go."""
    return quality.drop_rejected(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles one stays."""
    return ngram_join.drop_near_duplicates(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lie in benchmark windows go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and the text decoded from them."""
    return bpe.report(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]

#: The classifier's training can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = first = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as tables:
            kept = tables.keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}"))
        if docs is not first:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
