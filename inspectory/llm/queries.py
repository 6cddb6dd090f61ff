"""Queries of the training-data operators. Where SQL cannot express one at usable cost, tests hold it against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_alignment
from .classifier import op8_classifier
from .decontaminate import op5_decontamination
from .jaccard_join import SQL as JACCARD_JOIN
from .jaccard_join import op11_jaccard_join
from .lexical_search import SQL as LEXICAL_SEARCH
from .lexical_search import op13_lexical_search
from .licenses import op3_licenses
from .near_duplicates import op4_near_duplicates
from .packing import op6_packing
from .quality_rules import op7_quality_rules
from .secrets import op2_secrets
from .sharding import op1_sharding
from .suffix_dedup import op9_suffix_dedup
from .token_output import op10_token_output


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sharding, op2_secrets, op3_licenses, op4_near_duplicates, op5_decontamination, op6_packing, op7_quality_rules, op8_classifier, op9_suffix_dedup, op10_token_output, op11_jaccard_join, op12_alignment, op13_lexical_search)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op11_jaccard_join": JACCARD_JOIN, "op13_lexical_search": LEXICAL_SEARCH}
