"""Catalog against inventory: full outer join by place and name, hash comparison, and what each row becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.stats import base_status
from tallyforge.schemas import ALT_CAPABLE

LANES = ["crc", "sha1", "md5"]


def hashes_agree(a: str, b: str, alt: bool = False) -> Column:
    """Sizes agree if both are known, every hash known on both sides agrees, and at least one was compared; empty content without hashes agrees with empty content."""
    other = lambda c: F.col(f"{b}.alt_{c}") if alt else F.col(f"{b}.{c}")
    pairs = [(F.col(f"{a}.{h}"), other(h)) for h in LANES]
    clash = F.lit(False)
    evidence = F.lit(False)
    for x, y in pairs:
        clash = clash | F.coalesce(x != y, F.lit(False))
        evidence = evidence | (x.isNotNull() & y.isNotNull())
    size_a, size_b = F.col(f"{a}.size"), other("size")
    empty = (size_a == 0) & (F.coalesce(size_b, F.lit(0)) == 0) & ~evidence
    return ~F.coalesce(size_a != size_b, F.lit(False)) & ~clash & (evidence | empty)


def matches(a: str, b: str) -> Column:
    """Agreement on the file itself, or, for equal header types that can have one, on the file without its header."""
    kinds = F.coalesce((F.col(f"{a}.header_type") == F.col(f"{b}.header_type")) & F.col(f"{a}.header_type").isin(ALT_CAPABLE), F.lit(False))
    return hashes_agree(a, b) | (kinds & hashes_agree(a, b, alt=True))


def reconcile(catalog: DataFrame, inventory: DataFrame, place: list[str]) -> DataFrame:
    """Every expected and every found row once, with what was found.

    Both sides: ``place`` columns, name, file_type, size, crc, sha1, md5; the catalog also dat_status, the inventory
    got_status. Rows meet by place and exact name. Of several rows of one name on either side, agreeing pairs come
    first, each row once, in the order of their hashes. Result: place, name, dat_status (NotInDat where nothing was
    expected), got_status (Got, NotGot, Corrupt on a hash clash, FileLocked kept), expected and observed hashes in
    columns of their own, base_status. Null names match nothing and stay as they are.

    A catalog with header_type and an inventory with header_type and alt_size, alt_crc, alt_sha1, alt_md5 (the content
    without its header) also agree where the types are equal and the catalog states the content without header.
    """
    from pyspark.sql import Window

    key = [*place, "name"]
    number = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(h).asc_nulls_last() for h in ("sha1", "md5", "crc", "size")])))
    facts = ["size", *LANES]
    extra = lambda df, c, t="string": df if c in df.columns else df.withColumn(c, F.lit(None).cast(t))
    for c in LANES:
        catalog, inventory = extra(catalog, c), extra(inventory, c)
    headers = "header_type" in catalog.columns and "header_type" in inventory.columns
    if headers:
        for c in facts:
            inventory = extra(inventory, f"alt_{c}", "bigint" if c == "size" else "string")
    # identical identities meet first, then what is left by position
    ident = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in facts])
    left = catalog.withColumn("_id", ident).withColumn("_k", F.row_number().over(Window.partitionBy(*key, "_id").orderBy(F.lit(1))))
    right = inventory.withColumn("_id", ident).withColumn("_k", F.row_number().over(Window.partitionBy(*key, "_id").orderBy(F.lit(1))))
    exact = left.select(*key, "_id", "_k").join(right.select(*key, "_id", "_k"), [*key, "_id", "_k"], "inner").withColumn("_hit", F.lit(True))
    met = lambda df: df.join(exact, [*key, "_id", "_k"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    left, right = met(left), met(right)
    first = F.when(F.col("_hit"), 0).otherwise(2)
    if headers:  # of the rest, those that agree without their header
        bare = F.concat_ws("|", "header_type", *[F.coalesce(F.col(f"alt_{c}").cast("string"), F.lit("")) for c in facts])
        nth = lambda df, alt: df.filter(F.col("header_type").isin(ALT_CAPABLE) & ~F.col("_hit")).select(*key, "_id", "_k", alt.alias("_bare")).withColumn("_m", F.row_number().over(Window.partitionBy(*key, "_bare").orderBy("_id", "_k")))
        l, r = nth(left, F.concat_ws("|", "header_type", "_id")), nth(right, bare)
        join = lambda df, x, y: df.join(x.join(y.select(*key, "_bare", "_m"), [*key, "_bare", "_m"]).withColumnRenamed("_m", "_nth"), [*key, "_id", "_k"], "left")
        left, right = join(left, l, r), join(right, r, l)
        first = F.when(F.col("_hit"), 0).when(F.col("_bare").isNotNull(), 1).otherwise(2)
    order = ["_bare", "_nth"] if headers else []
    rank = F.row_number().over(Window.partitionBy(*key, "_hit").orderBy(*order, "_id", "_k"))
    slot = lambda df: number(df.withColumn("_hit", first)).withColumn("_slot", rank)
    a, b = slot(left).alias("a"), slot(right).alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*key, "_hit", "_slot"]]
    both = a.join(b, on, "full_outer")
    expected, found = F.col("a._slot").isNotNull(), F.col("b._slot").isNotNull()
    locked = F.col("b.got_status") == "FileLocked"
    agree = matches("a", "b") if headers else hashes_agree("a", "b")
    got = F.when(~found, "NotGot").when(locked, "FileLocked").when(~expected, F.col("b.got_status")).when(agree, F.when(F.col("b.got_status") == "Corrupt", "Corrupt").otherwise("Got")).otherwise("Corrupt")
    rows = both.select(
        *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in [*key, "file_type"]],
        F.coalesce(F.col("a.dat_status"), F.lit("NotInDat")).alias("dat_status"),
        got.alias("got_status"),
        *[F.col(f"a.{c}").alias(f"expected_{c}") for c in facts],
        *[F.col(f"b.{c}").alias(f"found_{c}") for c in facts],
        *([*[F.col(f"b.alt_{c}").alias(f"alt_{c}") for c in facts], F.coalesce(F.nullif("b.header_type", F.lit("NOTHING")), "a.header_type").alias("header_type"), F.coalesce(F.col("b.header_type") != "NOTHING", F.lit(False)).alias("from_header")] if headers else []),
    )
    return rows.withColumn("base_status", base_status(F.col("dat_status"), F.col("got_status"), F.col("file_type")))


def carry_over(prior: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """A new catalog over a prior node table: rows of equal key keep their physical state, held rows that are gone from the catalog stay as NotInDat."""
    p, f = prior.alias("p"), fresh.alias("f")
    both = f.join(p, [F.col(f"f.{c}") == F.col(f"p.{c}") for c in key], "full_outer")
    gone = F.col(f"f.{key[-1]}").isNull()
    return both.select(*[F.coalesce(F.col(f"f.{c}"), F.col(f"p.{c}")).alias(c) for c in key], F.when(gone, "NotInDat").otherwise(F.col("f.dat_status")).alias("dat_status"), F.coalesce(F.col("p.got_status"), F.lit("NotGot")).alias("got_status")).filter(~((F.col("dat_status") == "NotInDat") & (F.col("got_status") == "NotGot")))


def renamed(nodes: DataFrame, lane: str = "sha1") -> DataFrame:
    """Missing rows whose content is held under another name, by identity alone: (expected place and name, held place and name)."""
    size = F.coalesce("expected_size", "found_size", F.lit(0))
    missing = nodes.filter("got_status = 'NotGot' and dat_status <> 'NotInDat'").filter(F.col(f"expected_{lane}").isNotNull()).select(size.alias("size"), F.col(f"expected_{lane}").alias("h"), F.col("name").alias("expected_name"))
    held = nodes.filter("got_status = 'Got' and dat_status = 'NotInDat'").filter(F.col(f"found_{lane}").isNotNull()).groupBy(size.alias("size"), F.col(f"found_{lane}").alias("h")).agg(F.min("name").alias("held_name"))
    return missing.join(held, ["size", "h"]).select("expected_name", "held_name")
