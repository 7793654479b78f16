"""Outbox: change events published at least once, in order, from a file stream with a checkpoint.

The checkpoint is the lease: a batch whose publisher fails is retried whole, and what was
published before it is not repeated. Events carry an id, so a consumer can drop repeats.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "event_id long, row_id long, action string, payload string, created_at timestamp"


def events(spark: SparkSession, folder: str, schema: str = SCHEMA, *, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def publish(stream: DataFrame, checkpoint: str, send: Callable[[DataFrame, int], None], *, once: bool = True) -> StreamingQuery:
    """Hand each batch, ordered by event id, to ``send(batch, number)``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: send(df.orderBy("event_id"), n))
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_table(path: str, failed: str | None = None) -> Callable[[DataFrame, int], None]:
    """A publisher that writes each batch under its number, so that a retried batch replaces itself."""

    def send(df: DataFrame, n: int) -> None:
        good = df.where(F.try_parse_json("payload").isNotNull())
        good.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if failed:
            df.where(F.try_parse_json("payload").isNull()).withColumn("failed_reason", F.lit("payload is not JSON")).write.mode("overwrite").parquet(f"{failed}/batch={n}")

    return send


def claim(outbox: DataFrame, n: int, now) -> DataFrame:
    """The next ``n`` events that are pending or whose lease has run out, oldest first."""
    free = (F.col("state") == "pending") | ((F.col("state") == "leased") & (F.col("leased_until") < F.lit(now)))
    return outbox.where(free).orderBy("event_id").limit(n)


def recover_stale(outbox: DataFrame, now, max_retries: int = 5) -> DataFrame:
    """The table with expired leases returned to pending, or failed after too many retries."""
    stale = (F.col("state") == "leased") & (F.col("leased_until") < F.lit(now))
    spent = F.col("retry_count") + 1 >= max_retries
    return outbox.withColumns({
        "state": F.when(stale & spent, "failed").when(stale, "pending").otherwise(F.col("state")),
        "retry_count": F.when(stale, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        "leased_until": F.when(stale, None).otherwise(F.col("leased_until")),
    })


def subscribe(spark: SparkSession, folder: str, channel: str, schema: str = "channel string, payload string, at timestamp") -> DataFrame:
    """Notifications of one channel as a stream."""
    return spark.readStream.schema(schema).parquet(folder).where(F.col("channel") == channel)
