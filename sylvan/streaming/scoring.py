"""Scoring a stream: a model is one column, so that streams and tables are scored by the same stateless plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.predict import ensemble_expression


def scored(rows: DataFrame, nodes: DataFrame, out: str = "pred") -> DataFrame:
    """rows, bounded or streaming, with the model's prediction."""
    return rows.withColumn(out, ensemble_expression(nodes))


def score_stream(stream: DataFrame, nodes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows to a Parquet folder; the checkpoint makes restarts exact."""
    return scored(stream, nodes).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
