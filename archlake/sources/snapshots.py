"""A store of labelled snapshots: parquet tables partitioned by encoded label, a baseline, JSON export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archlake.functions.labels import decode_label, encode_label


class SnapshotStore:
    """``save(label, tables)`` overwrites a label's tables; ``load`` reads one back by label, or a JSON folder by path.

    Labels may hold any characters: they are percent-encoded in folder names.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _code(self, label: str) -> str:
        return self.spark.range(1).select(encode_label(F.lit(label)).alias("l")).first()[0]

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def save(self, label: str, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/snapshots/{self._code(label)}/{name}")

    def exists(self, label: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{self.folder}/snapshots/{self._code(label)}"))

    def load(self, label: str, name: str) -> DataFrame | None:
        """The table of a label; None for an unknown label. A label that is an existing ``.json`` path is read from there."""
        fs, path = self._fs()
        if label.endswith(".json") and fs.exists(path(label)):
            return self.spark.read.json(label)
        return self.spark.read.parquet(f"{self.folder}/snapshots/{self._code(label)}/{name}") if self.exists(label) else None

    def list(self) -> DataFrame:
        """label, saved_at; order by saved_at for the oldest first."""
        fs, path = self._fs()
        root = path(f"{self.folder}/snapshots")
        rows = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(root)] if fs.exists(root) else []
        df = self.spark.createDataFrame(rows, "code string, seconds double")
        return df.select(decode_label(F.col("code")).alias("label"), F.timestamp_seconds("seconds").alias("saved_at"))

    def set_baseline(self, label: str) -> None:
        """Makes a stored label the baseline; an unknown one raises."""
        if not self.exists(label):
            raise KeyError(label)
        self.spark.range(1).select(F.lit(label).alias("label"), F.current_timestamp().alias("saved_at")).write.mode("overwrite").parquet(f"{self.folder}/baseline")

    def baseline(self) -> str | None:
        """The baseline's label, else the oldest stored one, else None."""
        fs, path = self._fs()
        if fs.exists(path(f"{self.folder}/baseline")):
            return self.spark.read.parquet(f"{self.folder}/baseline").first()["label"]
        first = self.list().orderBy("saved_at", "label").first()
        return first["label"] if first else None

    def export_json(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").json(path)
