"""Checks of archive member lists: separators, order, directory markers, repeats, and their preparation for rebuilding.

``members``: archive, idx, name, is_dir, and for structure checks method, dos_packed, flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import ascii_lower, seven_zip_order, zip_order
from tallyforge.schemas import FAULT, FIXED_DOS_PACKED, STRUCTURES


def _compare_next(order: list[Column], w) -> Column:
    """Whether a row's key is greater than that of the next row."""
    here = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    return F.coalesce(here > F.lead(here).over(w), F.lit(False))


def check_members(members: DataFrame, seven_zip: bool = False) -> DataFrame:
    """(archive, fault_bits, is_canonical): bad separators, members out of order, directory markers that have contents, repeated names. Order is judged after separators are mended, markers and repeats after sorting."""
    name = F.translate("name", "\\", "/")
    base = members.withColumn("name", name).withColumn("_bad", F.col("name").contains("\\"))
    base = members.select("*", F.col("name").contains("\\").alias("_bad")).withColumn("name", name)
    order = seven_zip_order(F.col("name")) if seven_zip else zip_order(F.col("name"))
    listed = Window.partitionBy("archive").orderBy("idx")
    by_name = Window.partitionBy("archive").orderBy(*order, "idx")
    rows = base.withColumn("_unsorted", _compare_next(order, listed)).withColumn("_next", F.lead("name").over(by_name)).withColumn("_below", F.lead("name").over(Window.partitionBy("archive").orderBy(F.encode(ascii_lower(F.col("name")), "UTF-8"), "name", "idx")))
    extra = F.col("name").endswith("/") & F.coalesce(F.startswith(F.col("_below"), F.col("name")) & (F.col("_below") != F.col("name")), F.lit(False))
    bits = lambda c, b: F.max(F.when(c, b).otherwise(0))
    out = rows.groupBy("archive").agg(bits(F.col("_bad"), FAULT["separator"]).alias("a"), bits(F.col("_unsorted"), FAULT["unsorted"]).alias("b"), bits(extra, FAULT["extra_dirs"]).alias("c"), bits(F.coalesce(F.col("_next") == F.col("name"), F.lit(False)), FAULT["repeats"]).alias("d"))
    return out.select("archive", (F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("fault_bits")).withColumn("is_canonical", F.col("fault_bits") == 0)


def zip_index(members: DataFrame) -> DataFrame:
    """Rank of members by where they lie in the file; members without an offset have none."""
    w = Window.partitionBy("archive").orderBy("local_header_offset", "name")
    placed = members.filter("local_header_offset is not null").withColumn("zip_index", F.row_number().over(w) - 1)
    return placed.unionByName(members.filter("local_header_offset is null").withColumn("zip_index", F.lit(None).cast("int")))


def prepare_members(members: DataFrame, prune: bool = True) -> DataFrame:
    """Separators mended, markers with contents pruned, order assigned; ``repeated`` tells names that occur twice."""
    m = members.withColumn("name", F.translate("name", "\\", "/"))
    if prune:
        parts = F.split("name", "/")
        above = m.select("archive", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))).alias("prefix")).filter("name <> prefix").select("archive", F.col("prefix").alias("name")).distinct()
        m = m.join(above, ["archive", "name"], "left_anti")
    w = Window.partitionBy("archive").orderBy(*zip_order(F.col("name")), "idx")
    return m.withColumn("position", F.row_number().over(w) - 1).withColumn("repeated", F.count("*").over(Window.partitionBy("archive", "name")) > 1)


def structure_of(members: DataFrame, comments: DataFrame, directory_crc: str = "directory_crc") -> DataFrame:
    """Structure an archive conforms to: the comment's prefix and its CRC of the directory, then each member's method and date, and canonical order; else None."""
    rows = members.groupBy("archive").agg(*[F.min(F.when(F.col("method") == m, 1).otherwise(0)).alias(f"m{m}") for m in (8, 93)], F.min(F.when(F.col("dos_packed") == FIXED_DOS_PACKED, 1).otherwise(0)).alias("fixed"), F.min(F.when(F.col("dos_packed") == 0, 1).otherwise(0)).alias("zero"))
    checked = rows.join(check_members(members).select("archive", "fault_bits"), "archive").join(comments, "archive", "left")
    out = F.lit("None")
    for name in ("ZipZSTD", "ZipTDC", "ZipTrrnt"):
        method, prefix, dates = STRUCTURES[name]
        date_ok = {"fixed": F.col("fixed") == 1, "zero": F.col("zero") == 1, "real": F.lit(True)}[dates]
        fits = F.coalesce(F.col("comment") == F.concat(F.lit(prefix), F.upper(F.col(directory_crc))), F.lit(False)) & (F.col(f"m{method}") == 1) & date_ok & (F.col("fault_bits") == 0)
        out = F.when(fits, name).otherwise(out)
    return checked.select("archive", out.alias("structure"))


def rebuild_plan(targets: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Members to add, keep, rename and drop so that an archive holds what it should: a full outer join by name, then by content."""
    t, e = targets.alias("t"), existing.alias("e")
    j = t.join(e, [F.col(f"t.{c}") == F.col(f"e.{c}") for c in ["archive", "name"]], "full_outer")
    same = F.lit(True)
    for c in key:
        same = same & F.coalesce(F.col(f"t.{c}") == F.col(f"e.{c}"), F.lit(True))
    action = F.when(F.col("e.name").isNull(), "add").when(F.col("t.name").isNull(), "drop").when(same, "keep").otherwise("replace")
    return j.select(F.coalesce("t.archive", "e.archive").alias("archive"), F.coalesce("t.name", "e.name").alias("name"), action.alias("action"))
