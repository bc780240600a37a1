"""What changed between full snapshots.

A signed multiset difference does EXCEPT ALL both ways in one aggregation: rows of a snapshot count +1, rows of the
one before it count -1 under the successor's number, and equal rows cancel. What is left over is full-joined by key
and labelled.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.session import sized_join

#: Seconds from 0001-01-01 and from 1601-01-01 to 1970-01-01.
TICKS_EPOCH_S = 62_135_596_800
FILETIME_EPOCH_S = 11_644_473_600


def epoch_seconds(column: str) -> Column:
    """Whole Unix seconds of a stamp whose magnitude shows its unit and epoch.

    Below 1e11 it counts seconds, below 1e14 milliseconds, below 1e17 microseconds, below 2.5e17 units of 100 ns since
    1601, below 1e18 units of 100 ns since year 1, else nanoseconds. Null and the smallest bigint give null.
    """
    column = f"nullif({column}, -9223372036854775807L - 1)"  # it has no absolute value
    per = lambda k: f"(({column} - pmod({column}, {k}L)) div {k}L)"  # noqa: E731 - floors, also below zero
    return F.expr(
        f"""case when {column} is null then null
        when abs({column}) < 100000000000L then {column}
        when abs({column}) < 100000000000000L then {per(1000)}
        when abs({column}) < 100000000000000000L then {per(10**6)}
        when abs({column}) < 250000000000000000L then {per(10**7)} - {FILETIME_EPOCH_S}L
        when abs({column}) < 1000000000000000000L then {per(10**7)} - {TICKS_EPOCH_S}L
        else {per(10**9)} end"""
    )

#: Code points between two ranges that are still taken as one.
NEAR = 0x60


@cache
def uncomposed_class() -> str:
    """A character class that covers all that can occur in text that isn't NFC: marks, what composes with its predecessor, what NFC replaces.

    Ranges are joined across gaps of less than ``NEAR``: a matcher tries them one by one, so few are better than exact ones.
    """
    second = {ord(d[1]) for c in range(0xA0, sys.maxunicode + 1) if len(d := unicodedata.normalize("NFD", chr(c))) == 2 and unicodedata.normalize("NFC", d) == chr(c)}
    odd = [c for c in range(0xA0, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or c in second or 0x1160 <= c < 0x1200 or not unicodedata.is_normalized("NFC", chr(c)))]
    spans: list[list[int]] = []
    for c in odd:
        if spans and spans[-1][1] >= c - NEAR:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def file_key(name: Column) -> Column:
    """The name under which files are compared: ``/`` as separator, NFC. Only names that may be uncomposed go to Python."""
    slashed = F.translate(name, "\\", "/")
    return F.coalesce(_nfc(F.when(slashed.rlike(uncomposed_class()), slashed)), slashed)


def clean_crc(crc: Column) -> Column:
    """Lower-case hex of eight digits without prefix; blank is null."""
    c = F.regexp_replace(F.lower(F.trim(crc)), "^0x", "")
    return F.when(c == "", None).when(F.length(c) < 8, F.lpad(c, 8, "0")).otherwise(c)


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """Files added, removed or changed between consecutive snapshots of a root.

    ``rows``: source_table, root_id, snapshot_no, name (as delivered), stamp bigint, size bigint, crc string,
    delivered_at; other columns are ignored. Rows without a name (null or empty) take no part, nor do they make a
    snapshot. Of several rows of a file in a snapshot the one delivered last holds; ties take the greatest
    (stamp, size, crc), so the result is defined. A null stamp, size or crc on either side makes no difference.
    Empty input gives an empty result. Result: source_table, root_id, snapshot_no, name, change.
    """
    key = ["source_table", "root_id", "snapshot_no", "name"]
    value = ["at_s", "size", "crc"]
    named = rows.filter(F.col("name").isNotNull() & (F.col("name") != "") & F.col("snapshot_no").isNotNull()).select(
        "source_table", "root_id", F.col("snapshot_no").cast("int").alias("snapshot_no"), file_key(F.col("name")).alias("name"),
        "delivered_at", epoch_seconds("stamp").alias("at_s"), F.col("size").cast("long").alias("size"), clean_crc(F.col("crc")).alias("crc"),
    )
    # last delivered row per file; max of a flat struct combines on the map side
    held = named.groupBy(*key).agg(F.max(F.struct(F.col("delivered_at").alias("d"), *value)).alias("v")).select(*key, *[F.col(f"v.{c}").alias(c) for c in value])
    seen = rows.filter(F.col("name").isNotNull() & (F.col("name") != "") & F.col("snapshot_no").isNotNull()).groupBy("source_table", "root_id", F.col("snapshot_no").cast("int").alias("snapshot_no")).agg(F.lit(1).alias("one"))
    w = Window.partitionBy("source_table", "root_id").orderBy("snapshot_no")
    order = seen.select("source_table", "root_id", "snapshot_no", F.lag("snapshot_no").over(w).alias("before"), F.lead("snapshot_no").over(w).alias("after"))
    placed = sized_join(held.withColumn("root_key", F.coalesce("root_id", F.lit(-1))), order.withColumn("root_key", F.coalesce("root_id", F.lit(-1))).drop("root_id"), ["source_table", "root_key", "snapshot_no"], "inner")
    # each row stands for its own snapshot (+1) and, as what was before, for the next one (-1)
    sides = F.array(F.struct(F.when(F.col("before").isNotNull(), F.col("snapshot_no")).alias("at"), F.lit(1).alias("sign")), F.struct(F.col("after").alias("at"), F.lit(-1).alias("sign")))
    signed = placed.select("source_table", "root_id", "name", *value, F.explode(sides).alias("e")).filter("e.at is not null").select("source_table", "root_id", F.col("e.at").alias("snapshot_no"), "name", *value, F.col("e.sign").alias("sign"))
    residue = signed.groupBy(*key, *value).agg(F.sum("sign").alias("n")).filter("n <> 0")
    new = residue.filter("n > 0").select(*key, F.struct(*value).alias("new"))
    old = residue.filter("n < 0").select(*key, F.struct(*value).alias("old"))
    both = new.alias("n").join(old.alias("o"), [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in key], "full_outer").select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in key], "new", "old")
    differs = [F.coalesce(F.col(f"new.{c}") != F.col(f"old.{c}"), F.lit(False)) for c in value]
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(differs[0] | differs[1] | differs[2], "changed")
    return both.select(*key, change.alias("change")).filter("change is not null")
