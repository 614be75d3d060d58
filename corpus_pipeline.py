"""The corpus pipeline: documents go through STAGES in order, each written as Parquet and read again for the next.

Toxicity (rejected documents go), line dedup (later occurrences of repeated three-line windows go), MinHash near-dedup (one document of
each group stays), mixing (documents repeat at their source's rate) and packing (pieces of sequences).

Needed are doc_id, text, source and, if it is there, n_chars; all other columns, whatever their names, pass through the first four
stages. Null texts are never toxic, have no lines and no shingles, size 0 (so that a mix may leave them out or take them any number of
times up to three) and pack as one separator. Empty texts likewise. Rows that repeat a doc_id: one of them passes MinHash. A null doc_id passes
it unlinked. No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from frameseg.llm import linededup, minhash, mixing, packing, toxicity
from frameseg.llm.common import Scratch, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", linededup.stage),
    ("minhash", minhash.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can neither fit the model nor tokenize; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = tmp.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            tmp.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
