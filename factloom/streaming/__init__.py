"""Incremental ingest: new certificates are parsed as they come and appended once per work."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import documents


def parsed_stream(texts: DataFrame) -> DataFrame:
    """Typed records of a stream of (pkg, text) with a time ``seen``: the first record of a work in a day wins, later copies are dropped.

    Without ``seen`` there is no bound for what would have to be remembered, so every text gives its record.
    """
    if "seen" in texts.columns:
        texts = texts.withWatermark("seen", "1 day").dropDuplicatesWithinWatermark(["pkg"])
    return documents.parse_certificates(texts).where("pkg is not null")
