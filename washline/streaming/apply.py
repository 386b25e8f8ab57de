"""A cleaner fitted on a batch is a projection, so it also cleans a streaming table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.steps import Cleaner


def clean_stream(cleaner: Cleaner, stream: DataFrame) -> DataFrame:
    """Apply the fitted steps to a stream; steps that compare rows are refused."""
    if not stream.isStreaming:
        raise ValueError("not a streaming table; use cleaner.apply")
    refused = [s.operation for s in cleaner.steps if not s.row_wise]
    if refused:
        raise ValueError(f"steps that compare rows cannot run on a stream: {refused}")
    return cleaner.apply(stream)
