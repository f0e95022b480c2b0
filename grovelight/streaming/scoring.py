"""Scoring a stream of rows with a fixed model: a stateless projection after broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..forest import Forest


def score_stream(rows: DataFrame, forest: Forest) -> DataFrame:
    """(split, client, row_id, pred) of a stream (or table) of rows: weights, votes and means are those of ``Forest.predict``."""
    return forest.predict(rows)
