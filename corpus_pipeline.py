"""The corpus pipeline: stages over ``documents``, each reading what its predecessor wrote.

Defined results
---------------
* null or empty text: a score like any other, linked with nothing, nothing to
  remove, no item contained, no ids; such a document stays if its score says so;
* null id: after all other ids, so others of its group stay before it; ids that
  tie are one document to each other where earlier copies are removed;
* repeated rows: one of rows that are equal in id and text stays, as near duplicates;
* very long texts: whole in every stage;
* other columns, whatever their names: kept up to the last stage, which returns ids;
* empty ``documents``: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonecairn.llm.decontaminate import stage_decontaminate
from tonecairn.llm.jaccard_join import stage_near_duplicates
from tonecairn.llm.pieces import stage_encode
from tonecairn.llm.quality import stage_quality
from tonecairn.llm.shared import keep_table, read_table
from tonecairn.llm.substring_dedup import stage_substring_dedup

STAGES = [
    ("quality classifier", stage_quality),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("substring dedup", stage_substring_dedup),
    ("benchmark decontamination", stage_decontaminate),
    ("SentencePiece encoding and decoding", stage_encode),
]

ORACLE_SQL = None  # a learned score and connected components are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each returns is written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep_table(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
