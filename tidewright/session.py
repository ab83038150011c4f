"""Session defaults and the shared folder that intermediate tables go to."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a register may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with this engine's defaults, for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tidewright")
    for k, v in (DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | extra).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none and runs in one JVM, a temporary folder is
    set; on a cluster without the setting this fails rather than write to a
    folder that only one machine sees.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    at = tempfile.mkdtemp(prefix="tidewright-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def stage(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage as ``checkpoint()`` does, survives the loss of
    executors, is columnar, and later passes read only the columns they use.
    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewright-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone; the folder belongs to the run
            pass

    atexit.register(drop)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else ``df``.

    The count reads one more row than the bound, never the whole of a large
    table; beyond the bound the join shuffles and AQE splits its hot keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
