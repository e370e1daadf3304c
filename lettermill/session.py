"""Session helpers: defaults for local work and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Largest table, in bytes on disk, that may be asked for as a broadcast.
BROADCAST_LIMIT = 8 << 20


def local_session(cores: str = "8", app: str = "lettermill") -> SparkSession:
    """A session for tests and benches. On a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, else a folder of our own for tests.

    The own folder is only made where the setting is absent, as in local runs.
    """
    there = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lettermill-")
    spark.conf.set(CHECKPOINT_CONF, f"file://{made}")
    return f"file://{made}"


def _folder(spark: SparkSession) -> str:
    """The folder of this application's written tables."""
    return f"{shared_dir(spark)}/lettermill-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives the loss of any executor.

    The table stays for those who read it; `forget` deletes one that is done with, `clean` all of the application.
    """
    spark = df.sparkSession
    at = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._lettermill_at = at
    return out


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete a table that `materialise` gave, when nothing reads it any more."""
    _delete(df.sparkSession, df._lettermill_at)


def clean(spark: SparkSession) -> None:
    """Delete all written tables of this application, when its results have been written."""
    _delete(spark, _folder(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores before a kernel that costs much a row. Only a table of fewer splits than cores is moved, as one
    of a single small file; a large table has more splits than that and stays where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once for each application: they need not have it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="lettermill-zip-"), "lettermill_package.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("lettermill", os.path.relpath(path, here)))
        spark.sparkContext.addPyFile(out)
        _SHIPPED.add(app)
