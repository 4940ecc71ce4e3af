"""The quote checks need no state, so they apply to a stream of raw quotes as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.quotes import validated
from ..schemas import QualityPolicy


def validated_stream(raw: DataFrame, as_of: str, policy: QualityPolicy = QualityPolicy()) -> DataFrame:
    """raw: a streaming or batch frame of quote strings with row_id."""
    return validated(raw, as_of, policy)
