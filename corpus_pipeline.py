"""A pipeline over the documents table: rules, toxicity, near-duplicates, mixing and packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from canopy.llm.mixing import mixing_stage
from canopy.llm.near_dedup import near_dedup_stage
from canopy.llm.packing import packing_stage
from canopy.llm.quality_rules import quality_stage
from canopy.llm.shared import erase, shared_folder
from canopy.llm.toxicity import toxicity_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Models, sketches and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that its predecessor kept, written to the shared folder and read again. A stage's table
    is deleted once the next one stands; that of the stage before the last stays, as the result may read it.

    Defined results: those of the stages: null, empty and short texts fail the quality rules; repeated rows are one
    document after the near-duplicates; ties go by doc_id and then by a hash; very long texts are read whole;
    further columns pass up to the packing; no rows give no rows."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            if before:
                erase(spark, before)
            before = f"{folder}/{k}-{name}"
            docs = spark.read.parquet(before)
    return docs
