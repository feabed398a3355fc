"""The corpus operators' queries and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op1_decontamination
from .fingerprints import OP8_SQL, op8_fingerprints
from .language import op3_language_id
from .neardup import op9_near_duplicates
from .packing import op2_packing
from .quality import op10_quality
from .substrings import op4_repeated_passages
from .suffixes import op6_previous_factors
from .tokenids import op7_token_blocks
from .toxicity import op5_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_packing": op2_packing,
        "op3_language_id": op3_language_id,
        "op4_repeated_passages": op4_repeated_passages,
        "op5_toxicity": op5_toxicity,
        "op6_previous_factors": op6_previous_factors,
        "op7_token_blocks": op7_token_blocks,
        "op8_fingerprints": op8_fingerprints,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_fingerprints": OP8_SQL}
