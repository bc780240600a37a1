"""Attribute-value rows into wide tables by positional stitching.

Entities get dense global ordinals. Each attribute is then a typed column laid out by ordinal: values are scattered into
arrays that cover one range of ordinals, and the columns of a range are put side by side by position. No pivot runs over
the attributes and no row is looked up by entity after the ordinals are known.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import cut

#: Entities whose columns one task stitches at a time. It bounds a group at RANGE times the number of attributes.
RANGE = 16_384

SPARK_TYPES = {"text": "string", "integer": "bigint", "decimal": "decimal(28,10)", "boolean": "boolean", "date": "date"}
#: White space of all scripts, to be trimmed.
_BLANK = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: Fixed values.
YES, NO = ["yes", "y", "true", "t", "on", "1", "ja", "j", "oui", "si"], ["no", "n", "false", "f", "off", "0", "nein", "non"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WIDE_DIGITS = ("０１２３４５６７８９．，－＋％／：", "0123456789.,-+%/:")


def stripped(value: Column) -> Column:
    """Without white space of any script at either end; blank becomes null. Full-width digits and signs become ASCII."""
    s = F.btrim(F.translate(value, *WIDE_DIGITS), F.lit(_BLANK))
    return F.when(s != "", s)


def bare(value: Column) -> Column:
    """Without quotes or brackets around the whole."""
    return F.regexp_replace(value, r"^[\"'(\[“‘]+\s*|\s*[\"')\]”’]+$", "")


#: A number may carry a label before it and a unit after it; neither may hold a digit or a word that makes it a range.
_LABEL = r"(?:[\p{L}][\p{L} ._]{0,30}[:=]?\s*|[#№$€£~+]\s*)?"
_UNIT = r"\s*(?:年|人|p|pts?\.?|points?|players?|spieler|joueurs?|jugadores|%)?"
INTEGER = rf"(?i)^{_LABEL}([+-]?\d{{1,18}})(?:[.,]0+)?{_UNIT}$"
DECIMAL = rf"(?i)^{_LABEL}([+-]?(?:\d{{1,15}}(?:[.,]\d{{1,10}})?|[.,]\d{{1,10}}))(e[+-]?\d{{1,2}})?(?:\s*/\s*\d{{1,4}}|{_UNIT})$"
_TIME = r"(?:[T ]\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?"
#: Written days, rewritten as year|month|day; a question mark says that month and day may be the other way round.
DAYS = [
    (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_TIME}$", "$1|$3|$4"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1|$2|$3"),
    (r"^(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日$", "$1|$2|$3"),
    (rf"(?i)^(?:[a-z]{{3,9}},? )?(\d{{1,2}})(?:st|nd|rd|th)?[ -]([a-z]{{3}})[a-z]*\.?,?[ -](\d{{4}}){_TIME}$", "$3|$2|$1"),
    (rf"(?i)^(?:[a-z]{{3,9}},? )?([a-z]{{3}})[a-z]*\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_TIME}$", "$3|$1|$2"),
    (r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", "$3|$1|$2|?"),
]


def type_values(df: DataFrame) -> DataFrame:
    """Adds t, i, d, b, a (text, integer, decimal, boolean, date) to rows of value and kind; at most the one of its kind is filled.

    A value is filled if it states exactly one value. Whole numbers: sign, leading zeros, ``.0``, ``#``, quotes,
    brackets, a label or a unit aside. Decimals: point or comma, an exponent, ``/10`` behind it, too. Booleans: the words
    listed. Days: months by name, ideographic marks, a weekday, a time of day aside. Decades, ranges, alternatives,
    masked digits, placeholders, impossible days and days whose order can't be told state none.
    """
    w, kind = F.col("_w"), F.col("kind")
    df = df.withColumn("_w", bare(F.col("value")))
    parts = F.lit(None).cast("string")
    for pattern, form in reversed(DAYS):
        parts = F.when(w.rlike(pattern), F.regexp_replace(w, pattern, form)).otherwise(parts)
    number = F.when(kind == "integer", F.regexp_extract(w, INTEGER, 1)).when(kind == "decimal", F.regexp_replace(F.concat(F.regexp_extract(w, DECIMAL, 1), F.regexp_extract(w, DECIMAL, 2)), ",", "."))
    # the patterns of a kind run on its own rows only
    df = df.withColumn("_n", number).withColumn("_day", F.split(F.when(kind == "date", parts), r"\|"))
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.expr("_day[1]"))).cast("int")
    df = df.withColumn("_m", F.when(F.expr("_day[1]").rlike("[A-Za-z]"), named).otherwise(F.expr("try_cast(_day[1] as int)"))).withColumn("_d", F.expr("try_cast(_day[2] as int)"))
    either = F.size("_day") > 3
    df = df.withColumn("_turn", either & (F.col("_m") > 12))
    known = ~either | (F.col("_m") > 12) | (F.col("_d") > 12) | (F.col("_m") == F.col("_d"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.concat_ws("-", F.expr("_day[0]"), two(F.when(F.col("_turn"), F.col("_d")).otherwise(F.col("_m"))), two(F.when(F.col("_turn"), F.col("_m")).otherwise(F.col("_d"))))
    low = F.lower(w)
    return df.select(
        "*",
        F.when(kind == "text", F.col("value")).alias("t"),
        F.when(kind == "integer", F.col("_n").try_cast("bigint")).alias("i"),
        F.when(kind == "decimal", F.col("_n").try_cast("double").try_cast("decimal(28,10)")).alias("d"),
        F.when(kind == "boolean", F.when(low.isin(YES), True).when(low.isin(NO), False)).alias("b"),
        F.when((kind == "date") & F.col("_day").isNotNull() & known, day.try_cast("date")).alias("a"),
    ).drop("_w", "_n", "_day", "_m", "_d", "_turn")


def attribute_key(name: Column) -> Column:
    """How attribute names are matched: codes as whole numbers (``08``, `` 8``, ``8.0``), names by letters and digits in lower case."""
    s = F.lower(stripped(name))
    number = r"^[+-]?0*(\d+)(?:\.0+)?$"
    return F.when(s.startswith("-"), s).when(s.rlike(number), F.regexp_extract(s, number, 1)).otherwise(F.regexp_replace(s, r"[^\p{L}\p{N}]", ""))


def attribute_list(spark: SparkSession, attributes: DataFrame, owner_kind: str) -> list[tuple[str, str, int]]:
    """(attr_name, value_kind, attr_code) of one kind of owner in order of code: a schema, so it is read on the driver, and refused beyond 2,000 columns."""
    rows = attributes.filter(F.col("owner_kind") == owner_kind).select("attr_name", "value_kind", "attr_code").distinct().orderBy("attr_code", "attr_name").limit(2001).collect()
    if len(rows) > 2000:
        raise ValueError("more attributes than a table may have columns")
    return [(r.attr_name, r.value_kind, r.attr_code) for r in rows]


def held_values(facts: DataFrame, entity: str, attributes: list[tuple[str, str, int]]) -> DataFrame:
    """The value that holds of each (entity, attribute): the non-blank one with the greatest seq.

    Ties on seq take the greatest value. Rows without entity or of an unknown attribute take no part. Repeats and
    re-settings combine before the shuffle, so one entity with most of the rows is no hot task.
    """
    keys = {str(code): name for name, _, code in attributes} | {"".join(c for c in name.lower() if c.isalnum()): name for name, _, _ in attributes}
    lookup = F.create_map(*[F.lit(x) for k, n in keys.items() for x in (k, n)]) if keys else F.create_map().cast("map<string,string>")
    # most names are written as listed and need no cleaning; only the others are put into their key
    plain = {raw: keys[k] for name, _, code in attributes for raw, k in ((name, "".join(c for c in name.lower() if c.isalnum())), (str(code), str(code)))}
    listed = F.create_map(*[F.lit(x) for k, n in plain.items() for x in (k, n)]) if plain else lookup
    attr = F.coalesce(F.element_at(listed, F.col("id")), F.element_at(lookup, attribute_key(F.col("id"))))
    value = stripped(F.col("value"))
    known = facts.select(F.col(entity).alias("entity"), attr.alias("attr"), F.coalesce(F.col("seq"), F.lit(-(2**31))).alias("seq"), value.alias("value")).filter("entity is not null and attr is not null and value is not null")
    return known.groupBy("entity", "attr").agg(F.max(F.struct("seq", "value")).alias("m")).select("entity", "attr", F.col("m.value").alias("value"))


def entity_ordinals(entities: DataFrame) -> DataFrame:
    """Dense global ordinals in order of entity: sorted ranges, then each range starts where those before it end.

    Only one count a range comes to the driver.
    """
    spark = entities.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(entities.select("entity").distinct().repartitionByRange(n, "entity").sortWithinPartitions("entity").withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    counts = ranged.groupBy(part.alias("part")).count().collect()
    starts, total = {}, 0
    for r in sorted(counts, key=lambda r: r["part"]):
        starts[r["part"]], total = total, total + r["count"]
    start = F.element_at(F.create_map(*[F.lit(x) for k, v in starts.items() for x in (k, v)]), part) if starts else F.lit(0)
    return ranged.select("entity", (start + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint").alias("ordinal"))


def _stitcher(attributes: list[tuple[str, str, int]], entity_type: str, span: int):
    """One ordinal range: scatter each attribute into its aligned array, then lay the arrays side by side."""
    arrow = {"text": pa.string(), "integer": pa.int64(), "decimal": pa.decimal128(28, 10), "boolean": pa.bool_(), "date": pa.date32()}
    field = {"text": "t", "integer": "i", "decimal": "d", "boolean": "b", "date": "a"}
    kind = {name: k for name, k, _ in attributes}

    def stitch(block: pa.Table) -> pa.Table:
        ordinal = block["ordinal"].to_numpy()
        first = int(ordinal.min()) // span * span
        position = ordinal - first
        width = int(position.max()) + 1
        attr = block["attr"].combine_chunks().dictionary_encode()
        codes, names = attr.indices.to_numpy(zero_copy_only=False), attr.dictionary.to_pylist()
        marker = {n: i for i, n in enumerate(names)}
        at = np.full(width, -1, dtype=np.int64)  # the entity's own row is the one with no attribute
        own = np.flatnonzero(codes == marker[""])
        at[position[own]] = own
        columns = {"entity": block["entity"].take(pa.array(at))}
        for name in kind:
            at = np.full(width, -1, dtype=np.int64)
            if name in marker:
                rows = np.flatnonzero(codes == marker[name])
                at[position[rows]] = rows
            take = pa.array(at, mask=at < 0)
            columns[name] = block[field[kind[name]]].take(take).cast(arrow[kind[name]])
        return pa.table(columns)

    return stitch


def to_wide(facts: DataFrame, entity: str, attributes: list[tuple[str, str, int]], span: int = RANGE) -> DataFrame:
    """One row per entity with a typed column per attribute, in order of attribute code.

    ``facts``: the entity column, id, value, seq; others are ignored. An entity with no known attribute still has its
    row. A cell is null if no value holds or the value that holds doesn't state exactly one value of the kind. Rows with
    a null entity take no part. Attribute names that differ only in case keep the first one's spelling. An empty input
    gives an empty table with all columns.
    """
    kinds = {name: kind for name, kind, _ in attributes}
    ordinals = entity_ordinals(facts.filter(F.col(entity).isNotNull()).select(F.col(entity).alias("entity")))
    held = held_values(facts, entity, attributes).join(ordinals, "entity")
    kind = F.element_at(F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v)]), F.col("attr")) if kinds else F.lit("text")
    typed = type_values(held.withColumn("kind", kind)).select("ordinal", "entity", "attr", "t", "i", "d", "b", "a")
    own = ordinals.select("ordinal", "entity", F.lit("").alias("attr"), *[F.lit(None).cast(t).alias(c) for c, t in (("t", "string"), ("i", "bigint"), ("d", "decimal(28,10)"), ("b", "boolean"), ("a", "date"))])
    entity_type = dict(facts.dtypes)[entity]
    schema = ", ".join([f"entity {entity_type}", *[f"`{n}` {SPARK_TYPES[k]}" for n, k in kinds.items()]])
    block = typed.unionByName(own).withColumn("block", F.expr(f"ordinal div {span}"))
    return block.groupBy("block").applyInArrow(_stitcher(attributes, entity_type, span), schema)


def filled_cells(wide: DataFrame, owner_kind: str, attributes: list[tuple[str, str, int]]) -> DataFrame:
    """(owner_kind, owner_id, attr_name) of the filled cells whose attribute isn't text."""
    names = [n for n, k, _ in attributes if k != "text"]
    cells = F.array_compact(F.array(*[F.when(F.col(f"`{n}`").isNotNull(), F.lit(n)) for n in names])) if names else F.array().cast("array<string>")
    return wide.select(F.lit(owner_kind).alias("owner_kind"), F.col("entity").cast("bigint").alias("owner_id"), F.explode(cells).alias("attr_name"))
