"""The operators of this package as queries over the given tables, with SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import statements
from .alignment import op12_tokenizer_alignment
from .contamination import op6_decontamination
from .language import op8_language
from .lines import op10_line_dedup
from .manifest import op13_merkle_manifest
from .minhash import op4_minhash_dedup
from .mixing import op5_mixing
from .quality import op2_quality
from .substring import op1_substring_dedup
from .suffixes import op3_suffix_dedup
from .tokencount import op11_token_counts
from .urls import op7_url_filter
from .vectors import op9_vector_dedup

OPERATORS = (op1_substring_dedup, op2_quality, op3_suffix_dedup, op4_minhash_dedup, op5_mixing, op6_decontamination, op7_url_filter, op8_language,
             op9_vector_dedup, op10_line_dedup, op11_token_counts, op12_tokenizer_alignment, op13_merkle_manifest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return statements.SQL
