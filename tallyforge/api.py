"""The engine's operations over a workspace of parquet tables; ``python -m tallyforge`` is their command line.

A workspace is a folder on shared storage with the tables ``catalog``, ``inventory`` and ``nodes``. Every operation
reads what those before it wrote and writes one table whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators import report, stats
from tallyforge.operators.archives import check_members
from tallyforge.operators.reconcile import reconcile
from tallyforge.operators.rules import header_type
from tallyforge.operators.transforms import set_status
from tallyforge.plans.fixes import plan_actions, plan_fixes
from tallyforge.sources import inventory, readers, writers


class Workspace:
    """Tables of one audit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.read(name)

    def update_catalogs(self, folder: str) -> DataFrame:
        """Read all catalogs below a folder; files take their set's name as place and their status from their marks."""
        nodes = self._write(readers.read_catalogs(self.spark, folder), "catalog_nodes")
        files = nodes.filter("kind = 'file'").select("source", F.element_at("path", -1).alias("place"), "name", F.lit("File").alias("file_type"), F.col("size").cast("bigint").alias("size"), "crc", "sha1", "md5", "merge", "status", "mia", F.lit(None).cast("string").alias("dat_status"), header_type(F.col("header")["header"]).alias("header_type"))
        return self._write(set_status(files), "catalog")

    def scan(self, folder: str, deep: bool = False) -> DataFrame:
        """Archive members below a folder, and loose files under the name of their directory."""
        members = self._write(inventory.scan_archives(self.spark, folder, deep), "members")
        stem = F.regexp_replace(F.regexp_extract("archive", r"([^/]*)$", 1), r"\.[^.]*$", "")
        packed = members.filter("name is not null and not is_dir").select(stem.alias("place"), "name", F.lit("File").alias("file_type"), "size", "crc", "sha1", "md5", "got_status")
        bare = ["header_type", "alt_size", "alt_crc", "alt_sha1", "alt_md5"]
        loose = inventory.scan(self.spark, folder, level=2).filter("file_type = 'File' and not path like '%.gz'").select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("place"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "file_type", "size", "crc", "sha1", "md5", "got_status", *bare)
        return self._write(packed.unionByName(loose, allowMissingColumns=True), "inventory")

    def find_fixes(self) -> DataFrame:
        """Reconcile and plan."""
        r = reconcile(self.read("catalog"), self.read("inventory"), ["place"])
        side = lambda c: F.coalesce(f"found_{c}", f"expected_{c}").alias(c)
        rows = r.select(F.sha2(F.concat_ws("|", "place", "name", "found_sha1", "found_crc", "dat_status", "got_status"), 256).alias("node_id"), F.xxhash64("place", "name").alias("ord"), F.col("place").alias("archive"), F.col("place").alias("game"), "name", side("size"), side("crc"), side("sha1"), side("md5"), "dat_status", "got_status", "file_type", F.lit(True).alias("selected"), F.lit(False).alias("locked"), F.col("found_sha1").isNotNull().alias("deep"), F.concat_ws("/", "place", "name").alias("physical"), *[c for c in r.columns if c.startswith("alt_") or c in ("header_type", "from_header")])
        plan, pairs = plan_fixes(rows.dropDuplicates(["node_id"]))
        self._write(plan_actions(plan, pairs), "actions")
        return self._write(plan, "nodes")

    def report(self) -> DataFrame:
        return stats.summary_lines(stats.stats(self.read("nodes"), status="plan_status"))

    def status(self) -> DataFrame:
        return stats.classify_catalogs(self.read("nodes"), "game", status="plan_status")

    def fix_catalog(self, red_only: bool = False) -> DataFrame:
        return report.fix_catalog_rows(self.read("nodes"), red_only)

    def check_archives(self) -> DataFrame:
        return check_members(self.read("members").filter("name is not null"))

    def export(self, folder: str, dialect: str = "plain") -> None:
        writers.write_lines(writers.xml_lines(self.read("catalog_nodes").filter("kind in ('dir', 'game', 'file')"), dialect), folder)
