"""Queries of the core's operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators.nested_records import flatten_records, header_table, part_table
from lettermill.operators.packed_values import explode_packed
from lettermill.operators.timestamps import normalise_timestamps
from lettermill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the To and From fields that hold several."""
    fields = table(spark, sf_dir, "message_headers").where(F.lower("hname").isin("to", "from"))
    return explode_packed(fields, "raw", ["msg_id", "hpos"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and headers of every readable record, with their parents."""
    nodes = flatten_records(table(spark, sf_dir, "mime_records"), "msg_id", "record_json", with_fields=False)
    return nodes.where(F.col("node_kind").isin("part", "header")).select("msg_id", "node_kind", "node_path", "parent_path")


def p4_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of parts with the columns inlined into it."""
    return part_table(flatten_records(table(spark, sf_dir, "mime_records"), "msg_id", "record_json"), "msg_id")


def p4_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of headers, linked to the parts."""
    return header_table(flatten_records(table(spark, sf_dir, "mime_records"), "msg_id", "record_json"), "msg_id")


def dated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each Date field with the zone of its message's account and the time the message was received."""
    dates = (
        table(spark, sf_dir, "message_headers").where(F.lower("hname") == "date").where(F.length(F.trim("raw")) >= 8)
        .select("msg_id", "hpos", "raw", "account_key").dropDuplicates(["msg_id", "hpos", "raw"])
    )
    received = table(spark, sf_dir, "messages").select("msg_id", "received_at", F.col("account_key").alias("owner"))
    received = received.groupBy("msg_id").agg(F.min("received_at").alias("received_at"), F.min("owner").alias("owner"))
    zones = table(spark, sf_dir, "accounts").groupBy(F.col("account_key").alias("owner")).agg(F.max("zone_name").alias("zone_name"))
    joined = dates.join(received, "msg_id", "left").withColumn("owner", F.coalesce("owner", "account_key"))
    return joined.join(zones, "owner", "left")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of each message's Date field; of several fields the one nearest to the receipt holds, then the first."""
    found = normalise_timestamps(dated_messages(spark, sf_dir), "raw", ["msg_id", "hpos"], "zone_name", "received_at")
    first = F.min(F.struct(F.coalesce("_gap", F.lit(0)).alias("gap"), "hpos", "utc"))
    return found.groupBy("msg_id").agg(first["utc"].alias("utc"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_parts": p4_parts, "p4_headers": p4_headers, "p7_found": p7_found}
SQL: dict[str, str] = {}
