"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Settings a session needs for results that do not depend on the host.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "archlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SESSION_CONF; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder; on a
    cluster its absence is an error, since a machine-local folder would be lost
    with the machine.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = getattr(spark, "_archlake_dir", None)
    if known is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-archlake-", dir="/tmp")
        spark._archlake_dir = known
    return known


class Scratch:
    """Tables written to the shared folder in place of long lineages.

    A written table survives the loss of executors, is columnar and compressed,
    and gives the optimizer exact sizes. ``drop`` removes tables that no later
    step reads.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/archlake-{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._archlake_path = path
        return out

    def write_by(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """As ``write``, in one folder per value of ``column``, so that a filter on it reads that folder alone."""
        path = self.folder(name)
        df.write.partitionBy(column).parquet(path)
        rest = [f for f in df.schema if f.name != column]
        out = self.spark.read.schema(StructType([*rest, df.schema[column]])).parquet(path)
        out._archlake_path = path
        return out

    def folder(self, name: str) -> str:
        """A fresh folder for tables that are written otherwise."""
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def write_counting(self, df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
        """As ``write``, with the sums of ``sums`` over the rows, taken while they are written."""
        seen = Observation()
        out = self.write(df.observe(seen, *[F.sum(c.cast("long")).alias(k) for k, c in sums.items()]), name)
        found = seen.get  # without rows there is nothing to observe
        return out, {k: int(found.get(k) or 0) for k in sums}

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_archlake_path", None)
            if path:
                hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
