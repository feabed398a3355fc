"""Corpus preparation as successive stages, each written as Parquet and read again by the next.

Defined results: a null, empty or blank text has no language and goes in the first stage, and
with it its row; rows with a null doc_id are kept by every stage that their text passes.  Repeated
rows count once from the second stage on.  Very long texts go through whole.  Empty documents
or an empty benchmark give an empty result, or nothing to remove.  The result is that of packing():
one row for every piece of every row that is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from postlake.llm.common import remove_folder, shared_folder, table
from postlake.llm.decontaminate import stage_decontaminate
from postlake.llm.language import stage_language
from postlake.llm.neardup import stage_near_duplicates
from postlake.llm.packing import stage_packing
from postlake.llm.substrings import stage_substrings

STAGES = [
    ("language_id", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("substrings", stage_substrings),
    ("decontamination", stage_decontaminate),
    ("packing", stage_packing),
]

#: The stages' searches and models are beyond SQL; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is kept between them lies in the shared folder of spark.checkpoint.dir.

    A stage's rows are deleted when those of the next are written; packing() has written the
    lengths that it packs by itself, so the last ones aren't read again once it has begun.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        here = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            remove_folder(spark, before)
        before = here
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove_folder(spark, folder)
    return out
