"""Scoring a stream with trained models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from modelloom.learners.base import Fitted, predict_all


def score_stream(stream: DataFrame, models: Sequence[Fitted], checkpoint: str) -> DataStreamWriter:
    """A writer that appends each arriving row with its predictions.

    Prediction is row by row, so it needs no state and no watermark; the caller
    picks sink and trigger and starts it.
    """
    if not stream.isStreaming:
        raise ValueError("not a stream; use predict_all for tables")
    return predict_all(stream, models).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
