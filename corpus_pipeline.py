"""A corpus pipeline in stages: each reads what its predecessor kept, and writes what it keeps.

Defined results, of each stage as its operator defines them: documents that the lexicon rejects go; lines that repeat an earlier one of what is left go, and
with them documents of which no word is left; of near copies the lowest doc_id stays; documents are repeated as their source's budget has it, and those without
tokens (null, empty and blank texts) go; the rest is cut into pieces in bins, with all columns of documents. Rows of null doc_id pass the filters, and are one
document to mixing. Rows that repeat a doc_id are decided together, and stay repeated. Texts of any length pass whole. Other columns, of whatever names, are kept. Ties
are broken by doc_id. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timelineql.llm import line_dedup, mixing, near_dedup, packing, toxicity
from timelineql.llm.common import Scratch, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", line_dedup.stage),
    ("near dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]
#: Lexicon induction, MinHash and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents, each but the last written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"stage{k}")
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs
