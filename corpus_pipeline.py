"""The documents' way to training batches: quality, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Near-duplicates are judged
on shingles of five words here, as stages are unless a contract says otherwise.

Edge cases: rows with null ids pass near-duplicates and decontamination, as these remove rows by their ids; null and empty texts have no
shingles, items or entities and are one token when packed, and the quality stage keeps them if most labelled documents are good; repeated
rows share one id, and so stay or go together, but for near-duplicates, where all rows of the kept id stay; ties go to the least id;
empty tables give no rows; columns besides those of documents pass through all stages but packing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orebody.llm.common import remember, scratch_dir
from orebody.llm.decontaminate_cgk import keep_clean
from orebody.llm.minhash_dedup import keep_one
from orebody.llm.packing import pack
from orebody.llm.pii_surrogates import keep_private
from orebody.llm.quality_qda import keep_good


def into_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document left, in length buckets and token-budget batches."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one),
    ("decontamination", keep_clean),
    ("personal_data", keep_private),
    ("packing", into_batches),
]

#: The classifier, the walks and the bucket search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_dir(spark)}/orebody-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        remember(spark, f"{base}/{name}")  # deleted with the stages' own tables
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
