"""Reports, fix catalogs, grids and occurrence searches over planned nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import ascii_lower
from tallyforge.schemas import ACTIONS, FIX_REPORT, IN_CATALOG, PARTIAL_LISTING

#: Statuses left out of a fix catalog of what is truly missing.
RED_EXCLUDED = [*ACTIONS, "InToSort"]


def fix_catalog_rows(nodes: DataFrame, red_only: bool = False) -> DataFrame:
    """Rows in the catalog that aren't got; with ``red_only`` without those that can be fixed."""
    rows = nodes.filter(F.col("dat_status").isin(IN_CATALOG) & (F.col("got_status") != "Got"))
    return rows.filter(~F.col("plan_status").isin(RED_EXCLUDED)) if red_only else rows


def fix_entries(nodes: DataFrame) -> DataFrame:
    """Rows of the fix report."""
    return nodes.filter(F.col("plan_status").isin(FIX_REPORT))


def partial_entries(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("plan_status").isin(PARTIAL_LISTING))


def export_included(status: Column, got: bool = True, missing: bool = True, mia: bool = True, merged: bool = False, merged_or_fixable: bool = True, fixable: bool = True) -> Column:
    """Whether a row goes into an exported catalog, by its status."""
    return (
        F.when(status.isin("Correct", "CorrectMIA", "Unknown", "UnScanned"), F.lit(got))
        .when(status.isin("Missing", "Corrupt", "Incomplete"), F.lit(missing))
        .when(status == "MissingMIA", F.lit(mia))
        .when(status == "NotCollected", F.lit(merged))
        .when(status == "UnNeeded", F.lit(merged_or_fixable))
        .when(status.isin([*ACTIONS, "InToSort"]), F.lit(fixable))
        .otherwise(True)
    )


def member_grid(nodes: DataFrame, show_merged: bool = False) -> DataFrame:
    return nodes if show_merged else nodes.filter(~((F.col("dat_status") == "InDatMerged") & (F.col("plan_status") == "NotCollected")))


def grid_order(column: str, descending: bool = False, ties: tuple[str, ...] = ("name",)) -> list[Column]:
    """Sort keys of a grid; reversing reverses the ties too. Nulls come first in ascending order."""
    keys = [ascii_lower(F.col(c)) if c in ("name", "game") else F.col(c) for c in (column, *ties)]
    return [k.desc() if descending else k.asc() for k in keys]


_HASHES = ("crc", "sha1", "md5")
_IDENTITY = ["size", *[f"{p}{h}" for h in _HASHES for p in ("", "alt_")]]


def identity_classes(nodes: DataFrame) -> DataFrame:
    """(class_id, count and the identity itself): files of equal size and hashes, with and without header, count as one class, named by its least node; nulls are equal to each other."""
    for h in _IDENTITY:
        if h not in nodes.columns:
            nodes = nodes.withColumn(h, F.lit(None).cast("bigint" if h == "size" else "string"))
    return nodes.groupBy(*_IDENTITY).agg(F.min("node_id").alias("class_id"), F.count("*").alias("occurrences"))


def occurrences(needles: DataFrame, nodes: DataFrame) -> DataFrame:
    """(needle_id, class_id, occurrences): where a needle's content lies. Every hash the needle knows must be one of the candidate's, whole or without header, and sizes that are both known agree.

    Files come as classes of equal identity with their number (see ``identity_classes``), so a content that lies in most
    places is one row for each needle, not one for each pair. Needles without hashes have none.
    """
    n, c = identity_classes(needles), identity_classes(nodes)
    known = [F.when(F.col(f"{p}{h}").isNotNull(), F.concat(F.lit(f"{h}:"), F.col(f"{p}{h}"))) for h in _HASHES for p in ("", "alt_")]
    asked = n.select(F.col("class_id").alias("_class"), *[F.col(x).alias(f"n_{x}") for x in _IDENTITY], F.coalesce(*known).alias("_k")).filter("_k is not null")
    held = c.withColumn("_k", F.explode(F.array_distinct(F.array_compact(F.array(*known)))))
    ok = F.coalesce(F.col("n_size") == F.col("size"), F.lit(True))
    for h in _HASHES:
        for x in (h, f"alt_{h}"):
            ok = ok & (F.col(f"n_{x}").isNull() | F.coalesce(F.col(f"n_{x}") == F.col(h), F.lit(False)) | F.coalesce(F.col(f"n_{x}") == F.col(f"alt_{h}"), F.lit(False)))
    found = asked.join(held, "_k").filter(ok).select("_class", "class_id", "occurrences").distinct()
    members = needles
    for x in _IDENTITY:
        if x not in members.columns:
            members = members.withColumn(x, F.lit(None).cast("bigint" if x == "size" else "string"))
    same = [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in _IDENTITY]
    of = members.alias("a").join(n.alias("b"), same).select(F.col("a.node_id").alias("needle_id"), F.col("b.class_id").alias("_class"))
    return of.join(found, "_class").select("needle_id", "class_id", "occurrences").distinct()


def boxed_report(entries: DataFrame, by: str) -> DataFrame:
    """A boxed text table per catalog: one row per line, with its place. Widths come from the longest cells of each catalog, by an aggregate rather than a window over a catalog's rows."""
    width = entries.groupBy(by).agg(F.max(F.length("game")).alias("wg"), F.max(F.length("name")).alias("wn"), F.max(F.length("plan_status")).alias("ws"))
    e = entries.join(width, by)
    cell = lambda c, w: F.rpad(F.coalesce(c, F.lit("")), F.col(w), " ")
    line = F.concat(F.lit("| "), cell(F.col("game"), "wg"), F.lit(" | "), cell(F.col("name"), "wn"), F.lit(" | "), cell(F.col("plan_status"), "ws"), F.lit(" |"))
    rule = F.concat(F.lit("+-"), F.repeat(F.lit("-"), F.col("wg")), F.lit("-+-"), F.repeat(F.lit("-"), F.col("wn")), F.lit("-+-"), F.repeat(F.lit("-"), F.col("ws")), F.lit("-+"))
    frame = width.select(by, F.explode(F.array(F.struct(F.lit(0).alias("part"), rule.alias("line")), F.struct(F.lit(2).alias("part"), rule.alias("line")))).alias("x")).select(by, "x.part", F.lit("").alias("k1"), F.lit("").alias("k2"), "x.line")
    return frame.unionByName(e.select(by, F.lit(1).alias("part"), F.col("game").alias("k1"), F.col("name").alias("k2"), line.alias("line")))


def full_report(classes: DataFrame) -> DataFrame:
    """Sections of complete, empty and partial catalogs."""
    return classes.filter("class is not null").select("class", *[c for c in classes.columns if c != "class"])


def status_bucket(status: Column) -> Column:
    """The summary bucket a row's status falls into."""
    return (
        F.when(status.isin("Correct", "DirCorrect", "CorrectMIA"), "correct")
        .when(status.isin("Missing", "DirMissing", "MissingMIA", "Incomplete"), "missing")
        .when(status.isin("Corrupt", "DirCorrupt"), "corrupt")
        .when(status.isin(ACTIONS), "fixes")
        .when(status.isin("NotCollected", "UnNeeded"), "merged")
        .when(status.isin("InToSort", "DirInToSort"), "sorting")
        .when(status.isin("Unknown", "DirUnknown", "UnScanned"), "unknown")
    )
