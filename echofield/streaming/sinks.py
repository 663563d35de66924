"""Where streams go: tables, memory, or a consumer that sees the newest rows of each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import newest


def published(stream: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ()) -> StreamingQuery:
    """Appends a stream to Parquet, exactly once, in folders by `by`; runs until nothing is left to read."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.partitionBy(*by) if by else writer).start()


def delivered(stream: DataFrame, consumer: Callable[[DataFrame, int], None], checkpoint: str, queue: int, by: tuple[str, ...] = ("stream",), order: tuple[str, ...] = ("seq",)) -> StreamingQuery:
    """Hands each micro-batch to a consumer as a bounded queue would: of each key the newest `queue` rows. A batch that is
    repeated after a failure has the same number, so a consumer can tell."""
    return stream.writeStream.foreachBatch(lambda batch, number: consumer(newest(batch, queue, by, order), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
