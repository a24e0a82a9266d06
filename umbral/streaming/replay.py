"""Range queries that arrive as a stream, answered from bins that were built before."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.select import response


def answered(queries: DataFrame, df: DataFrame, key: str, bins: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch's padded response to sink(response, batch id); the batch id lets a sink be idempotent."""

    def batch(workload: DataFrame, number: int) -> None:
        sink(response(df, key, bins, workload), number)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
