"""The library's scalars as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import scalars as S
from .dialect import SPARK as Q

#: Name, type of the result, and the expression over x.
FUNCTIONS = {
    "shannon_entropy": ("DOUBLE", S.entropy(Q, "x")),
    "char_variety": ("INT", S.variety(Q, "x")),
    "token_alphabet": ("STRING", S.alphabet(Q, "x")),
    "context_score": ("INT", S.context_score(Q, "lower(x)")),
    "is_template_value": ("BOOLEAN", S.template_value(Q, "x")),
    "type_of_key": ("STRING", S.key_type(Q, "x")),
}


def register(spark: SparkSession) -> None:
    """Temporary SQL functions, so that statements can use what the detectors use."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
