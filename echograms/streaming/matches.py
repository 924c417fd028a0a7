"""Patterns in a stream of texts: each micro-batch is searched on its own against a fixed pattern table, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame

from echograms.operators.search import pattern_occurrences


def streaming_occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Occurrences (text_id, pattern_id, pos) for a streaming table of texts (text_id, body); append mode."""
    return pattern_occurrences(texts, patterns)
