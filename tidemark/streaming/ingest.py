"""Streaming ingest of JSON events into a table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sessions import parse_events
from ..sources.store import Table

#: Events of a trigger from a broker, and the time between triggers.
MAX_OFFSETS, EVERY = 5000, "30 seconds"


def lines_from_files(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)


def lines_from_kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int = MAX_OFFSETS) -> DataFrame:
    """Needs the broker's connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, max_offsets)).load().select("value")


def kafka_options(servers: str, topic: str, max_offsets: int = MAX_OFFSETS) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(max_offsets), "failOnDataLoss": "false"}


def ingest(lines: DataFrame, table: Table, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append parsed events batch by batch; a batch that is delivered again is known by its id. once: what is there, then stop."""
    events = parse_events(lines)
    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: table.append(batch, n) and None)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=EVERY)).start()


def await_any(queries: list[StreamingQuery], poll_seconds: float = 1.0) -> StreamingQuery:
    """Wait until the first of the queries ends, stop the others, and return it; raise its error if it failed."""
    while True:
        for q in queries:
            if not q.isActive:
                for other in queries:
                    if other is not q and other.isActive:
                        other.stop()
                q.awaitTermination()
                return q
        time.sleep(poll_seconds)
