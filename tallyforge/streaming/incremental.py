"""Incremental reconciliation: new inventory files arrive as a stream, each batch is reconciled and upserted.

The engine's semantics are those of full scans; this keeps a table current between them. State is a parquet table of
versioned folders; a batch writes the next version whole and then its marker, so a lost run is repeated without harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tallyforge.operators.reconcile import reconcile


def latest(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last row of each key by ``at``; ties take the greatest row. Combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c != at]
    return rows.groupBy(*key).agg(F.max(F.struct(at, *rest)).alias("r")).select(*key, f"r.{at}", *[f"r.{c}" for c in rest])


def upsert(current: DataFrame | None, batch: DataFrame, key: list[str], at: str) -> DataFrame:
    """Rows of a batch over the current table: the later row of each key holds, so a repeated or late batch changes nothing."""
    return latest(batch if current is None else current.unionByName(batch), key, at)


class InventoryTable:
    """Versioned folders ``v<batch>`` under one path on shared storage."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame | None:
        versions = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}") if versions else None

    def write(self, batch: DataFrame, number: int, key: list[str], at: str) -> None:
        """Version ``number`` from the last one before it; writing it again gives the same."""
        upsert(self.read(number), batch, key, at).write.mode("overwrite").parquet(f"{self.path}/v{number}")


def stream_inventory(source: DataFrame, table: InventoryTable, checkpoint: str, key: list[str], at: str) -> StreamingQuery:
    """Start upserting a streaming inventory, each batch once."""
    return source.writeStream.foreachBatch(lambda batch, number: table.write(batch, number, key, at)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_status(catalog: DataFrame, table: InventoryTable, place: list[str]) -> DataFrame:
    """The catalog against the table as it is now."""
    return reconcile(catalog, table.read(), place)
