"""Sources, sinks and streams."""

from pyspark.sql import functions as F

from lettermill.sources import read_eml, read_mbox, write_eml
from lettermill.streaming import first_seen, host_counts, to_table


def test_eml(spark, tmp_path):
    df = spark.createDataFrame([("a/1", "Subject: x\r\n\r\nhi"), ("b", None), ("c", "x")], "k string, t string")
    assert write_eml(df, "k", "t", str(tmp_path / "out")).count() == 2
    assert sorted(bytes(r.raw) for r in read_eml(spark, str(tmp_path / "out")).collect()) == [b"Subject: x\r\n\r\nhi", b"x"]


def test_mbox(spark, tmp_path):
    (tmp_path / "box").write_text("From a Mon\nSubject: 1\n\n>From x\nbody\n\nFrom b Tue\nSubject: 2\n\nbody 2\n")
    got = [r.raw for r in read_mbox(spark, str(tmp_path / "box")).orderBy("pos").collect()]
    assert len(got) == 2 and got[0].startswith("Subject: 1") and "\nFrom x" in got[0] and got[1].startswith("Subject: 2")


def test_mailboxes_are_numbered(spark, tmp_path):
    """Positions are those in the file, however it is cut into blocks."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for name, n in (("a", 300), ("b", 7)):
            (tmp_path / name).write_text("".join(f"From x{i}\nSubject: {i}\n\nbody {'y' * (i % 50)}\n\n" for i in range(n)))
        for name, n in (("a", 300), ("b", 7)):
            got = [(r.pos, r.raw.split("\n")[0]) for r in read_mbox(spark, str(tmp_path / name)).orderBy("pos").collect()]
            assert got == [(i, f"Subject: {i}") for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_keys_with_one_cleaned_name(spark, tmp_path):
    df = spark.createDataFrame([("a/1", "x"), ("a_1", "y"), ("a:1", "z")], "k string, t string")
    assert len({r.file for r in write_eml(df, "k", "t", str(tmp_path / "out")).collect()}) == 3
    assert sorted(bytes(r.raw) for r in read_eml(spark, str(tmp_path / "out")).collect()) == [b"x", b"y", b"z"]


def test_stream_is_batch(spark, tmp_path):
    rows = [(i % 5, f"h{i % 3}.io", f"2024-01-01 0{i % 8}:30:00") for i in range(40)]
    batch = spark.createDataFrame(rows, "k int, host string, t string").withColumn("t", F.to_timestamp("t"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = to_table(first_seen(stream, "k", "t"), str(tmp_path / "once"), str(tmp_path / "c1"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 5
    q = host_counts(stream, "t", "host").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.host, r.window.start): r["count"] for r in spark.table("counts").collect()}
    want = {(r.host, r.window.start): r["count"] for r in batch.groupBy(F.window("t", "1 hour"), "host").count().collect()}
    assert got == want
