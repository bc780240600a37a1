"""State transitions of node tables: what a rescan, a flag on a holding area or a catalog refresh changes, and settings and presets as files."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.rules import canonical_rules

#: A time stamp that no file has, so that the next refresh reads the catalog again.
NEVER = (1 << 63) - 1


def below(path: Column, roots: list[str]) -> Column:
    """Whether a ``/``-joined path is one of the roots or lies below one."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r.rstrip("/") + "/")
    return F.coalesce(out, F.lit(False))


def mark_missing(nodes: DataFrame, roots: list[str]) -> DataFrame:
    """Everything below the roots is no longer found; rows in no catalog then vanish, as nothing tells of them."""
    hit = below(F.col("path"), roots)
    return nodes.withColumn("got_status", F.when(hit, "NotGot").otherwise(F.col("got_status"))).filter(~(hit & F.col("dat_status").isin("NotInDat", "InToSort")))


def holding_area(nodes: DataFrame, roots: list[str]) -> DataFrame:
    """Roots become holding areas: rows below them that are in no catalog wait to be sorted."""
    return nodes.withColumn("dat_status", F.when(below(F.col("path"), roots) & (F.col("dat_status") == "NotInDat"), "InToSort").otherwise(F.col("dat_status")))


def refresh_catalogs(catalogs: DataFrame, root: str) -> DataFrame:
    """Catalogs below a path will be read again."""
    return catalogs.withColumn("date_modified", F.when(below(F.col("path"), [root]), F.lit(NEVER)).otherwise(F.col("date_modified")))


def deep_scanned(members: DataFrame) -> DataFrame:
    """Per archive whether every member has all hashes; archives without members aren't listed."""
    full = F.col("crc").isNotNull() & F.col("sha1").isNotNull() & F.col("md5").isNotNull()
    return members.groupBy("archive").agg(F.min(full.cast("int")).alias("m")).select("archive", (F.col("m") == 1).alias("deep_scanned"))


def needs_rescan(prior: DataFrame, listing: DataFrame, level: int) -> DataFrame:
    """Listed files that must be read: new, of another time or size, or not yet scanned as deep as ``level`` asks. A join on the path alone; content is never touched."""
    p = prior.select("path", F.col("modified").alias("_m"), F.col("size").alias("_s"), F.col("deep").alias("_d"))
    stale = F.col("_m").isNull() | (F.col("_m") != F.col("modified")) | (F.col("_s") != F.col("size")) | F.lit(level == 3) | (F.lit(level >= 2) & ~F.coalesce("_d", F.lit(False)))
    return listing.join(p, "path", "left").filter(stale).select(*listing.columns)


@dataclass
class Settings:
    """Paths, rules by directory and ignore patterns."""

    catalog_root: str = "catalogs"
    file_only: bool = False
    ignore: list[str] = field(default_factory=list)
    rules: list[dict[str, str]] = field(default_factory=list)
    mappings: list[dict[str, str]] = field(default_factory=list)

    def to_xml(self) -> str:
        root = ET.Element("Settings")
        for k, v in asdict(self).items():
            if isinstance(v, list):
                group = ET.SubElement(root, k)
                for x in v:
                    e = ET.SubElement(group, "item")
                    if isinstance(x, dict):
                        e.attrib.update(x)
                    else:
                        e.text = x
            else:
                ET.SubElement(root, k).text = str(v).lower() if isinstance(v, bool) else v
        return ET.tostring(root, encoding="unicode")

    @classmethod
    def from_xml(cls, text: str) -> Settings:
        root, out = ET.fromstring(text), cls()
        for k, v in asdict(out).items():
            e = root.find(k)
            if e is None:
                continue
            if isinstance(v, list):
                setattr(out, k, [dict(x.attrib) or (x.text or "") for x in e])
            else:
                setattr(out, k, (e.text or "").lower() == "true" if isinstance(v, bool) else e.text or "")
        return out

    def rule_table(self, spark: SparkSession) -> DataFrame:
        """One rule per directory, the first of each."""
        names = sorted({k for r in self.rules for k in r} | {"dir_key"})
        rows = [tuple([i, *[r.get(n) for n in names]]) for i, r in enumerate(self.rules)]
        return canonical_rules(spark.createDataFrame(rows, ", ".join(["ord int", *[f"{n} string" for n in names]])))


def preset_xml(entries: list[tuple[str, bool, bool]]) -> str:
    """(path, selected, expanded) entries as a file."""
    root = ET.Element("Preset")
    for path, selected, expanded in entries:
        ET.SubElement(root, "entry", path=path, selected=str(selected).lower(), expanded=str(expanded).lower())
    return ET.tostring(root, encoding="unicode")


def read_preset(spark: SparkSession, text: str) -> DataFrame:
    rows = [(e.get("path"), e.get("selected") == "true", e.get("expanded") == "true") for e in ET.fromstring(text)]
    return spark.createDataFrame(rows, "path string, selected boolean, expanded boolean")
