"""The same deltas through Structured Streaming, for a store on a shared folder.

The log's files are the stream's source, one transaction each, in order; the stream's
checkpoint knows which were taken, so a restarted driver goes on where it stopped. A
delta depends on two bases alone, so a batch that is run again gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from eavspark.plans.parse import parse
from eavspark.streaming.delta import attributes, check, delta
from eavspark.tx.connection import Connection


def log_stream(conn: Connection) -> DataFrame:
    """The log as a stream of JSON lines, a transaction a trigger."""
    return conn.spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(f"{conn.path}/log")


def kafka_stream(conn: Connection, servers: str, topic: str) -> DataFrame:
    """As ``log_stream``, from a topic of one partition; needs Spark's Kafka connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": "1"}
    return conn.spark.readStream.format("kafka").options(**options).load().selectExpr("CAST(value AS STRING) AS value")


def stream(conn: Connection, text: str, sink: Callable[[DataFrame, int], None], checkpoint: str, source: DataFrame | None = None, once: bool = False) -> StreamingQuery:
    """Give ``sink(rows with _w, tx_id)`` for each transaction that changes the query's result.

    Deltas from the first transaction on add up to the result. ``once`` takes what there
    is and ends; the result's ``stop`` ends it otherwise.
    """
    query = parse(text)
    check(query)
    conn.refresh()
    depends = attributes(query, conn.source())

    def batch(records: DataFrame, _: int) -> None:
        for record in sorted((json.loads(r[0]) for r in records.collect()), key=lambda r: r["tx_id"]):
            tx_id = record["tx_id"]
            # another process may have written it, with attributes and retractions that aren't known here yet
            conn.refresh()
            if depends & {*record["touched"]}:
                rows = delta(conn.spark, conn.source(), query, tx_id - 1, tx_id)
                if rows is not None:
                    sink(rows, tx_id)

    writer = (source if source is not None else log_stream(conn)).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
