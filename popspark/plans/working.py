"""Working tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in ``spark.checkpoint.dir``; where a session leaves that unset, ``df`` as it is."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df
