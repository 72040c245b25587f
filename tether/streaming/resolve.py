"""New records against a fitted model, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tether.plans.resolver import ResolverModel


def resolve_stream(model: ResolverModel, records: DataFrame, output: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Resolves each micro-batch with the model's stored tables and appends it to a Parquet folder.

    A batch that is run again after a failure overwrites its own folder, so results come once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        model.transform(batch).write.mode("overwrite").parquet(f"{output}/batch={epoch}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
