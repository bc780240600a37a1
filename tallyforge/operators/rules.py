"""Rules by directory, ignore patterns, globs, selections and presets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import dir_key
from tallyforge.schemas import HEADER_FILES
from tallyforge.session import sized_join


def canonical_rules(rules: DataFrame) -> DataFrame:
    """One rule per normalised key, the first in ``ord`` order."""
    keyed = rules.withColumn("dir_key", dir_key(F.col("dir_key")))
    return keyed.groupBy("dir_key").agg(F.min(F.struct("ord", *[c for c in rules.columns if c not in ("dir_key", "ord")])).alias("r")).select("dir_key", "r.*").drop("ord")


def resolve_rules(paths: DataFrame, rules: DataFrame, value: str) -> DataFrame:
    """The rule of the nearest ancestor (or the path itself) of each path; null without one.

    Prefixes are exploded and joined on equality, so no path is compared with all rules.
    """
    parts = F.split(dir_key(F.col("path")), r"\\")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "\\").alias("dir_key")))
    hits = sized_join(paths.select("path", F.explode(prefixes).alias("p")).select("path", "p.*"), rules.select("dir_key", value), ["dir_key"], "inner")
    nearest = hits.groupBy("path").agg(F.max(F.struct("depth", value)).alias("m")).select("path", F.col(f"m.{value}").alias(value))
    return paths.select("path").distinct().join(nearest, "path", "left")


def glob_pattern(pattern: str) -> str:
    """A regular expression for ``*`` and ``?``."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def ignored(name: Column, patterns: list[str], scan: bool = True) -> Column:
    """Whether a name fits an ignore pattern: ``regex:`` or wildcards in any case, else the whole name. Patterns marked ``ignore:`` hold at scan time, the others in the table. Patterns are trimmed; blank ones and those that are no regular expression are passed over."""
    given = [p.strip() for p in patterns]
    chosen = [p[7:].strip() if p.lower().startswith("ignore:") else p for p in given if p.lower().startswith("ignore:") == scan]
    exact = [p.lower() for p in chosen if p and not p.lower().startswith("regex:") and not set(p) & set("*?")]
    shapes = [s for p in chosen if p and (p.lower().startswith("regex:") or set(p) & set("*?")) and _compiles(s := p[6:].strip() if p.lower().startswith("regex:") else glob_pattern(p))]
    out = F.lower(name).isin(exact) if exact else F.lit(False)
    return out | name.rlike("(?i)" + "|".join(f"(?:{s})" for s in shapes)) if shapes else out


def _compiles(pattern: str) -> bool:
    """Whether the JVM, which will match it, takes a pattern."""
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern) if spark else re.compile(pattern)
    except Exception:  # noqa: BLE001 - any refusal counts
        return False
    return True


def header_type(file_name: Column) -> Column:
    """Header type of a rule file's name."""
    table = F.create_map(*[F.lit(x) for k, v in HEADER_FILES.items() for x in (k, v)])
    return F.coalesce(F.element_at(table, F.lower(F.trim(file_name))), F.lit("NOTHING"))


def catalog_directory(header: DataFrame) -> Column:
    """The directory a catalog is placed in: description, id or name, as its rule says."""
    return F.when(F.col("use_description") & (F.coalesce("description", F.lit("")) != ""), F.col("description")).when(F.col("use_id") & (F.coalesce("id", F.lit("")) != ""), F.concat("id", F.lit(" - "), "name")).otherwise(F.col("name"))


def selected(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("tree_checked").isin("Selected", "Locked"))


def branches_with_selection(nodes: DataFrame) -> DataFrame:
    """Every directory path with a selected node in or below it."""
    levels = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.array_join(F.slice("path", 1, n), "/"))
    return selected(nodes).filter(F.size("path") > 0).select(F.explode(levels).alias("directory")).distinct()


def apply_preset(nodes: DataFrame, preset: DataFrame) -> DataFrame:
    """Selection of a saved preset by path; paths it lacks keep theirs."""
    p = preset.select("path", F.col("selected").alias("_selected")).dropDuplicates(["path"])
    return nodes.join(p, "path", "left").withColumn("selected", F.coalesce("_selected", "selected")).drop("_selected")


def file_only(nodes: DataFrame, rules: DataFrame, default: bool = False) -> DataFrame:
    """Whether files of a path are kept loose: the nearest rule's word, else the default."""
    return resolve_rules(nodes, rules, "file_only").withColumn("file_only", F.coalesce("file_only", F.lit(default)))
