"""Messages from files and back."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: path, modified_at, raw (bytes)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified_at"), F.col("content").alias("raw"))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """One row for each message of mailboxes: path, pos (from 0 in its file), raw. A file is split at its `From ` lines as it is read, by Spark's own reader.

    Messages are numbered within the blocks in which a file is read, and each block goes on where the last one ended, so
    that a mailbox of any size is numbered in many tasks. Empty files and messages give no row.
    """
    lines = spark.read.option("lineSep", "\nFrom ").text(path, wholetext=False)
    parts = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")
    raw = F.regexp_replace(F.regexp_replace("value", r"^(?:From )?[^\r\n]*\r?\n", ""), r"(?m)^>(>*From )", "$1")
    messages = parts.select("path", "block", "n", raw.alias("raw")).where(F.length("raw") > 0)
    sizes = messages.groupBy("path", "block").agg(F.count("*").alias("size"))
    before = F.sum("size").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("path", "block", F.coalesce(before, F.lit(0)).alias("start"))
    numbered = messages.withColumn("k", F.row_number().over(W.partitionBy("path", "block").orderBy("n")) - 1)
    return numbered.join(starts, ["path", "block"]).select("path", (F.col("start") + F.col("k")).alias("pos"), "raw")


def write_eml(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Write each message to `path`/<key>.eml from the executors; returns key, file, size. `path` is a folder that all executors share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.makedirs(path, exist_ok=True)
        for batch in batches:
            out = []
            for k, body in zip(batch[key], batch[text], strict=True):
                if body is None:
                    continue
                name = os.path.join(path, quote(str(k), safe=" ") + ".eml")  # no two keys have one name
                data = body.encode() if isinstance(body, str) else bytes(body)
                # Written aside and moved, so that a task that runs twice leaves one whole file.
                with open(f"{name}.{os.getpid()}", "wb") as f:
                    f.write(data)
                os.replace(f"{name}.{os.getpid()}", name)
                out.append((k, name, len(data)))
            yield pd.DataFrame(out, columns=[key, "file", "size"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, file string, size bigint")


def write_messages(df: DataFrame, path: str) -> None:
    """Messages as Parquet."""
    df.write.mode("overwrite").parquet(path)
