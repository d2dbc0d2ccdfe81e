"""Streams: rows written as they come, and micro-batches merged into a summary once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.spec import QuerySpec
from ..plans.summary import State, Summary, build
from ..sources.writers import json_rows


def stream_rows(stream: DataFrame, spec: QuerySpec, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A stateless query's rows as JSON arrays, written batch by batch, exactly once, by the file sink."""
    if spec.keys or spec.aggregates or spec.order:
        raise ValueError("a stream of rows has no groups and no order")
    return json_rows(spec.compile(stream), "value").writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_summary(stream: DataFrame, path: str, keys: dict[str, str], states: list[State], checkpoint: str, **trigger) -> StreamingQuery:
    """Every micro-batch is a part with the id batch-<number>, so one that is run again after a failure isn't counted twice."""

    def merge(batch: DataFrame, number: int) -> None:
        part = f"{path}/parts/batch-{number}"
        build(batch, keys, states).write.mode("overwrite").parquet(part)
        Summary(batch.sparkSession, path).merge([f"batch-{number}:{part}"], list(keys), states, delete_inputs=True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
