"""Results as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def envelope(df: DataFrame, freshness_col: str | None = "last_indexed_at", message: str | None = None) -> DataFrame:
    """One row (json): {"meta": {queried_at, index_freshness, result_count}, "results": [...]}; null fields are left out.

    The rows meet in one document, as a reply to a caller does; use it on bounded results.
    """
    rows = [F.count("*").alias("n"), F.collect_list(F.struct("*")).alias("results")]
    if freshness_col in df.columns:
        rows.append(F.coalesce(F.min(F.when(F.col(freshness_col) > 0, F.col(freshness_col))), F.lit(0)).alias("fresh"))
    one = df.agg(*rows)
    meta = F.struct(F.unix_millis(F.current_timestamp()).alias("queried_at"), (F.col("fresh") if freshness_col in df.columns else F.lit(0)).alias("index_freshness"), F.col("n").alias("result_count"))
    note = [F.when(F.col("n") == 0, F.lit(message)).alias("message")] if message else []
    return one.select(F.to_json(F.struct(meta.alias("meta"), "results", *note)).alias("json"))
