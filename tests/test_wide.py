"""Positional stitching against a dictionary, and which values state exactly one value."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.wide import attribute_key, entity_ordinals, filled_cells, to_wide, type_values

ATTRIBUTES = [("Id", "text", 11), ("Year", "integer", 8), ("Score", "decimal", 17), ("IsBios", "boolean", 3), ("Date", "date", 7)]
SCHEMA = "owner bigint, id string, value string, seq int, attr string"


def wide(spark, rows, span=4):
    return {r.entity: r.asDict() for r in to_wide(spark.createDataFrame(rows, SCHEMA), "owner", ATTRIBUTES, span).collect()}


def test_latest_value_by_position(spark):
    rows = [(i, " 8", str(1900 + i), 1, "clash") for i in range(50)] + [(7, "YEAR", " ", 9, None), (7, "08", "n/a", 3, None), (8, "8.0", "1950", 5, None), (8, "8.0", "1950", 5, None), (9, "Colour", "red", 1, None), (99, "nothing", "x", 1, None), (98, None, None, None, None), (None, "8", "1990", 1, None)]
    out = wide(spark, rows)
    assert len(out) == 52
    assert out[7]["Year"] is None and out[8]["Year"] == 1950 and out[9]["Year"] == 1909
    assert out[99]["Year"] is None and out[98]["Id"] is None
    assert all(out[i]["Year"] == 1900 + i for i in range(50) if i not in (7, 8))


def test_types_and_filled(spark):
    rows = [(1, "Id", "x", 1, None), (1, "isbios", " YES ", 1, None), (1, "score", "4,5", 1, None), (1, "7", "Jan 2, 2003", 1, None), (2, "3", "maybe", 1, None)]
    df = to_wide(spark.createDataFrame(rows, SCHEMA), "owner", ATTRIBUTES)
    r = df.filter("entity = 1").first()
    assert (r.Id, r.IsBios, r.Score, r.Date, r.Year) == ("x", True, Decimal("4.5"), dt.date(2003, 1, 2), None)
    assert {tuple(x) for x in filled_cells(df, "k", ATTRIBUTES).collect()} == {("k", 1, "IsBios"), ("k", 1, "Score"), ("k", 1, "Date")}


def test_empty_and_long(spark):
    df = to_wide(spark.createDataFrame([], SCHEMA), "owner", ATTRIBUTES)
    assert df.count() == 0 and df.columns == ["entity", "Id", "Year", "Score", "IsBios", "Date"]
    assert wide(spark, [(1, "11", "x" * 200_000, 1, None), (1, "8", "9" * 50_000, 1, None)])[1]["Year"] is None


def test_ordinals_are_dense(spark):
    got = entity_ordinals(spark.range(1000).select((F.col("id") * 7 % 1000 - 500).alias("entity"))).orderBy("entity").collect()
    assert [r.ordinal for r in got] == list(range(1000))


VALUES = {
    "integer": {"1985": 1985, " 1985": 1985, "+7": 7, "(2009)": 2009, '"44"': 44, "02003": 2003, "2003.0": 2003, "1989年": 1989, "Year 1981": 1981, "8 players": 8, "2P": 2, "#31807": 31807, "1９": 19, "1980s": None, "19??": None, "199x": None, "1981 or 1982": None, "1997-1999": None, "1 to 4": None, "several": None, "-": None, "2003.5": None, "9" * 30: None},
    "decimal": {"9.3": Decimal("9.3"), "2,3": Decimal("2.3"), ".95": Decimal("0.95"), "35e-1": Decimal("3.5"), "56%": Decimal(56), "Score: 4.8": Decimal("4.8"), "9.0/10": Decimal(9), "3.8 pts": Decimal("3.8"), "１８": Decimal(18), "5-6": None, "3.?": None, "NaN": None, "good": None, "--": None, "1.2.3": None},
    "boolean": {"yes": True, "Y": True, "ja": True, "1": True, "on": True, "No": False, "nein": False, "0": False, "off": False, "2": None, "yes/no": None, "?": None, "maybe": None},
    "date": {"2015-02-04": dt.date(2015, 2, 4), "20140630": dt.date(2014, 6, 30), "20140631": None, "2012-07-28T00:00:00Z": dt.date(2012, 7, 28), "2021年4月22日": dt.date(2021, 4, 22), "07-MAY-2011": dt.date(2011, 5, 7), "Wed Dec 21 2016": dt.date(2016, 12, 21), "32 Jul 2019": None, "Spring 2011": None, "2020-09-??": None, "today": None, "13/02/2010": dt.date(2010, 2, 13), "03/02/2010": None, "2013-09": None},
}


@pytest.mark.parametrize("kind", VALUES)
def test_values(spark, kind):
    from tallyforge.operators.wide import stripped

    cases = VALUES[kind]
    df = type_values(spark.createDataFrame([(v,) for v in cases], "raw string").select("raw", stripped(F.col("raw")).alias("value"), F.lit(kind).alias("kind")))
    got = {r.raw: r[{"integer": "i", "decimal": "d", "boolean": "b", "date": "a"}[kind]] for r in df.collect()}
    assert got == cases


def test_attribute_names(spark):
    df = spark.createDataFrame([(x,) for x in ("08", " 8", "8.0", "-1", "Clone Of", None)], "x string")
    assert [r[0] for r in df.select(attribute_key(F.col("x"))).collect()] == ["8", "8", "8", "-1", "cloneof", None]
