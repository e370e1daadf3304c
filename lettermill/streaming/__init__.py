"""Mail operators over streams. Parsing has no state and runs on streams as it does on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lettermill.functions import addresses as A


def host_counts(stream: DataFrame, time: str, host: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Messages by host and window of time; what comes later than `late` is left out, so that the state is bounded."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), F.lower(host).alias("host")).count()


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: messages that are taken in twice pass once."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def parsed_addresses(stream: DataFrame, text: str) -> DataFrame:
    return stream.withColumn("parsed", A.parse_address(F.col(text)))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run once over what is there and write it as Parquet."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
