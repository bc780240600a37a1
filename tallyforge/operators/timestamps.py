"""Mixed timestamp formats and zones, normalised through a dictionary of distinct raw values.

Raw values repeat far more often than they differ, so each distinct (kind, raw, zone) is parsed once, by one chain that
tries every form; the dictionary is a set of parquet batches in a folder that outlives the run, and only values it lacks
are parsed and appended. Rows then take their instants from the dictionary by one equi-join.

Instants are bigints counting 100 ns since 0001-01-01T00:00Z, fine enough for every form and wide enough for every year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import cut, shared_dir, shuffled, sized_join, split_join

TICKS_PER_S = 10_000_000
TICKS_EPOCH_S = 62_135_596_800
FILETIME_EPOCH_S = 11_644_473_600

#: Name of the dictionary's folder; it changes with the forms that are parsed, as the values kept depend on them.
FOLDER = "stamps-2"
#: A form is taken for coarser than it is written only if at least so many distinct values bear it out.
EVIDENCE = 9

#: Hours and minutes east of UTC of zone abbreviations, in minutes.
ABBREVIATIONS = {"UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600}
#: Texts that say a stamp is absent.
ABSENT = ["", "0", "n/a", "na", "null", "none", "-", "-9223372036854775808"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"\s*([A-Za-z]{1,5}|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|\[[^\]]+\])?"
#: Every written form, rewritten as year|month|day|hour|minute|second|fraction|zone|am or pm.
FORMS = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})[T ]{_CLOCK}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|"),
    (r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})" + _ZONE + "$", "$1|$2|$3|$4|$5|$6||$7|"),
    (rf"^(?:[A-Za-z]{{3}},? )?(\d{{1,2}})[ -]([A-Za-z]{{3}})[ -](\d{{4}}) {_CLOCK}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|"),
    (rf"^([A-Za-z]{{3}}) (\d{{1,2}}),? (\d{{4}}) {_CLOCK} ?([AaPp][Mm])?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$9|$8"),
    (rf"^(?:[A-Za-z]{{3}} )([A-Za-z]{{3}}) +(\d{{1,2}}) {_CLOCK} (\d{{4}})$", "$7|$1|$2|$3|$4|$5|$6||"),
]


def _civil_seconds(y: Column, m: Column, d: Column, hh: Column, mi: Column, s: Column) -> Column:
    """Seconds from 1970 of a wall time by calendar arithmetic alone; the caller has checked the fields."""
    a = F.when(m <= 2, y - 1).otherwise(y)
    shifted = F.pmod(m + 9, F.lit(12))
    days = a * 365 + F.floor(a / 4) - F.floor(a / 100) + F.floor(a / 400) + F.floor((shifted * 153 + 2) / 5) + d - 1 - 719468
    return (days * 86400 + hh * 3600 + mi * 60 + s).cast("long")


def _month_days(y: Column, m: Column) -> Column:
    leap = ((F.pmod(y, F.lit(4)) == 0) & (F.pmod(y, F.lit(100)) != 0)) | (F.pmod(y, F.lit(400)) == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def zone_name(zone: Column) -> Column:
    """The zone if it looks like a region id, else null: a zone that can't be read is an unknown zone."""
    return F.when(zone.rlike(r"^(UTC|GMT|Z|[A-Za-z]+(/[A-Za-z0-9_+-]+){1,2})$"), zone)


def _offset_at(seconds: Column, zone: Column) -> Column:
    """Offset in seconds that ``zone`` has at an instant."""
    at = F.timestamp_seconds(seconds)
    return F.unix_timestamp(F.from_utc_timestamp(at, zone)) - seconds


def wall_instants(wall_s: Column, zone: Column) -> Column:
    """All instants (Unix seconds) at which clocks in ``zone`` show ``wall_s``: none in a gap, two in an overlap.

    Offsets differ only across a change, so the offsets a day before and a day after are the only candidates.
    """
    first, last = wall_s - _offset_at(wall_s - 86400, zone), wall_s - _offset_at(wall_s + 86400, zone)
    shows = lambda c: (c + _offset_at(c, zone)) == wall_s
    return F.array_distinct(F.array_compact(F.array(F.when(shows(first), first), F.when(shows(last), last))))


def parse_stamps(values: DataFrame) -> DataFrame:
    """Distinct (kind, raw, zone) to instants.

    kind ``packed``: a number where positive values below 2^32 are a packed DOS date and time; ``text``: a written stamp
    or a number; ``dos``: ``date:time`` of two DOS fields. ``zone`` holds for stamps that name none of their own.
    Adds ``state``: absent, unreadable, unzoned (wall time with no zone), or ok; ``instants``: array<bigint> of ticks
    (empty for an impossible date or a wall time that no clock shows); ``precision``: ticks of the last stated digit;
    ``form``: how the value is written, for numbers by magnitude, for text by its last digit.
    Null raw is absent. Text of no known form is unreadable and has no instants.
    """
    raw = F.trim(F.col("raw"))
    df = values.select("kind", "raw", "zone", raw.alias("_r"), zone_name(F.col("zone")).alias("_given"))
    number = F.when(F.col("kind") != "dos", F.expr("try_cast(_r as bigint)"))
    digits14 = F.col("_r").rlike(r"^\d{14}$")
    packed = (F.col("kind") == "packed") & (number > 0) & (number < 2**32)
    df = df.withColumn("_n", F.when(~digits14, F.nullif(number, F.lit(-(2**63)).cast("long"))))  # the smallest bigint has no absolute value
    half = lambda i: F.expr(f"try_cast(split(_r, ':')[{i}] as bigint)")
    df = df.withColumn("_dos", F.when(F.col("kind") == "dos", F.struct(half(0).alias("d"), half(1).alias("t"))).when(packed, F.expr("struct(shiftright(_n, 16) as d, _n & 65535 as t)")))
    text = F.when((F.col("kind") != "dos") & F.col("_n").isNull(), F.col("_r"))
    rewritten = F.lit(None).cast("string")
    for pattern, form in reversed(FORMS):
        rewritten = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, form)).otherwise(rewritten)
    df = df.withColumn("_p", F.split(rewritten, r"\|"))
    part = lambda i: F.expr(f"try_cast(_p[{i}] as int)")
    month = F.when(F.expr("_p[1]").rlike("[A-Za-z]"), F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.expr("_p[1]"))).cast("int")).otherwise(part(1))
    half_day = F.lower(F.expr("_p[8]"))
    hour = F.when((half_day != "") & ((part(3) < 1) | (part(3) > 12)), 99).when(half_day == "pm", F.pmod(part(3), F.lit(12)) + 12).when(half_day == "am", F.pmod(part(3), F.lit(12))).otherwise(part(3))
    bits = lambda f, shift, mask: F.expr(f"cast(shiftright(_dos.{f}, {shift}) & {mask} as int)")
    pick = lambda a, b: F.when(F.col("_dos").isNotNull(), a).otherwise(b)
    df = df.select(
        "*",
        pick(bits("d", 9, 127) + 1980, part(0)).alias("_y"),
        pick(bits("d", 5, 15), month).alias("_m"),
        pick(bits("d", 0, 31), part(2)).alias("_d"),
        pick(bits("t", 11, 31), hour).alias("_h"),
        pick(bits("t", 5, 63), part(4)).alias("_mi"),
        pick(bits("t", 0, 31) * 2, F.coalesce(part(5), F.lit(0))).alias("_s"),
        F.expr("case when _p[6] <> '' then cast(rpad(_p[6], 9, '0') as bigint) div 100 else 0L end").alias("_f"),
        F.when(F.col("_p").isNotNull(), F.when(F.expr("_p[6]") != "", F.lit(10).cast("long") ** F.greatest(F.lit(0), 7 - F.length(F.expr("_p[6]")))).when(F.expr("_p[5]") == "", 60 * TICKS_PER_S).otherwise(TICKS_PER_S)).cast("long").alias("_prec"),
        F.regexp_replace(F.expr("_p[7]"), r"[\[\]]", "").alias("_own"),
    )
    fields = F.col("_dos").isNotNull() | F.col("_p").isNotNull()
    possible = (F.col("_y") >= 1) & F.col("_m").between(1, 12) & (F.col("_d") >= 1) & (F.col("_d") <= _month_days(F.col("_y"), F.col("_m"))) & (F.col("_h") < 24) & (F.col("_mi") < 60) & (F.col("_s") < 60)
    own = F.upper(F.col("_own"))
    abbreviation = F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])
    hhmm = F.regexp_extract("_own", r"([+-])(\d{2}):?(\d{2})$", 2).cast("int") * 60 + F.regexp_extract("_own", r"([+-])(\d{2}):?(\d{2})$", 3).cast("int")
    fixed = F.when(F.col("_own").rlike(r"[+-]\d{2}:?\d{2}$"), F.when(F.col("_own").contains("-"), -hhmm).otherwise(hhmm)).otherwise(F.element_at(abbreviation, own))
    df = df.select("*", F.when(fields & possible, _civil_seconds(*[F.col(c) for c in ("_y", "_m", "_d", "_h", "_mi", "_s")])).alias("_wall"), F.when(F.coalesce(F.col("_own"), F.lit("")) != "", fixed).alias("_fixed"), F.when(F.col("_own").contains("/"), zone_name(F.col("_own"))).otherwise(F.when(F.coalesce(F.col("_own"), F.lit("")) == "", F.col("_given"))).alias("_zone"))
    ticks = lambda s: (s + TICKS_EPOCH_S) * TICKS_PER_S + F.coalesce(F.col("_f"), F.lit(0))
    from_number = F.expr(
        f"""case when abs(_n) < 100000000000L then (_n + {TICKS_EPOCH_S}L) * {TICKS_PER_S}L
        when abs(_n) < 100000000000000L then _n * 10000L + {TICKS_EPOCH_S * TICKS_PER_S}L
        when abs(_n) < 100000000000000000L then _n * 10L + {TICKS_EPOCH_S * TICKS_PER_S}L
        when abs(_n) < 250000000000000000L then _n + {(TICKS_EPOCH_S - FILETIME_EPOCH_S) * TICKS_PER_S}L
        when abs(_n) < 1000000000000000000L then _n
        else (_n - pmod(_n, 100L)) div 100L + {TICKS_EPOCH_S * TICKS_PER_S}L end"""
    )
    number_precision = F.expr("case when abs(_n) < 100000000000L then 10000000L when abs(_n) < 100000000000000L then 10000L when abs(_n) < 100000000000000000L then 10L else 1L end")
    absent = F.col("raw").isNull() | F.lower(F.col("_r")).isin(ABSENT) | ((F.col("kind") == "dos") & (F.col("_dos.d").isNull() | F.col("_dos.t").isNull() | ((F.col("_dos.d") == 0) & (F.col("_dos.t") == 0))))
    counted = F.col("_n").isNotNull() & F.col("_dos").isNull()
    unread = ~counted & (~fields | ((F.coalesce(F.col("_own"), F.lit("")) != "") & F.col("_fixed").isNull() & F.col("_zone").isNull()))
    unzoned = ~counted & F.col("_fixed").isNull() & F.col("_zone").isNull()
    state = F.when(absent, "absent").when(unread, "unreadable").when(unzoned, "unzoned").otherwise("ok")
    none = F.array().cast("array<bigint>")
    instants = (
        F.when(F.col("state") != "ok", none)
        .when(counted, F.array(from_number))
        .when(F.col("_wall").isNull(), none)
        .when(F.col("_fixed").isNotNull(), F.array(ticks(F.col("_wall") - F.col("_fixed") * 60)))
        .otherwise(F.transform(wall_instants(F.col("_wall"), F.col("_zone")), ticks))
    )
    precision = F.when(F.col("_dos").isNotNull(), F.lit(2 * TICKS_PER_S).cast("long")).when(counted, number_precision).otherwise(F.col("_prec"))
    size = F.abs(F.col("_n"))
    form = F.when(F.col("_dos").isNotNull(), "dos").when(counted, F.when(size < 10**11, "s").when(size < 10**14, "ms").when(size < 10**17, "us").when(size < 25 * 10**16, "filetime").when(size < 10**18, "ticks").otherwise("ns")).otherwise(F.concat(F.lit("text"), F.col("_prec").cast("string")))
    return df.withColumn("state", state).select("kind", "raw", "zone", "state", instants.alias("instants"), precision.alias("precision"), form.alias("form"))


class StampDictionary:
    """Distinct raw stamps with their instants, kept as parquet batches under one folder on storage that all executors share.

    The folder is a named one below the shared folder unless given, so a later run finds what earlier ones parsed.
    ``extend`` parses only values the dictionary lacks and appends them as a batch of its own; a stopped run leaves
    at most an unfinished batch, which readers skip, and runs side by side at most repeat a value.
    """

    SCHEMA = "kind string, raw string, zone string, state string, instants array<bigint>, precision bigint, form string"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark).rstrip('/')}/{FOLDER}"

    def _batches(self) -> list[str]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return []
        found = [s.getPath().toString() for s in fs.listStatus(root)]
        return sorted(p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p + "/_SUCCESS")))

    def read(self) -> DataFrame:
        batches = self._batches()
        return self.spark.read.schema(self.SCHEMA).parquet(*batches) if batches else self.spark.createDataFrame([], self.SCHEMA)

    def extend(self, stamps: DataFrame) -> int:
        """How many values were new. ``stamps``: kind, raw, zone in any number of repeats; distinct combines before the shuffle, so hot values cost nothing."""
        key = ["kind", "raw", "zone"]
        new = stamps.select(*key).filter("raw is not null").distinct()
        if self._batches():
            new = new.alias("n").join(shuffled(self.read().select(*key).alias("k")), [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in key], "left_anti")
        batch = scratch_under(self.path)
        parse_stamps(new).write.parquet(batch)
        return self.spark.read.schema(self.SCHEMA).parquet(batch).count()


def scratch_under(path: str) -> str:
    import uuid

    return f"{path.rstrip('/')}/batch-{uuid.uuid4().hex}"


def share_instant(a: str, b: str) -> Column:
    """Whether two stamps (structs of state, instants, precision) share an instant after both are cut to the coarser precision."""
    grain = F.greatest(F.col(f"{a}.precision"), F.col(f"{b}.precision"))
    floor = lambda s: F.transform(F.col(f"{s}.instants"), lambda x: x - F.pmod(x, grain))
    return F.arrays_overlap(floor(a), floor(b))


def true_precision(stamps: DataFrame) -> DataFrame:
    """(kind, form, coarser): by how much the stamps of a form are coarser than written.

    Writers that keep microseconds still fill the seventh digit of a count of 100 ns, with 0. So the precision of a form
    below a second is measured: it is the largest power of ten of which all its instants are multiples, if ``EVIDENCE``
    distinct values at least say so (by chance one in 10^9). Forms are a fixed set, so this is a table of some ten rows,
    from maxima that combine before the shuffle.
    """
    powers = [10**j for j in range(1, 8)]
    odd = lambda p: F.exists("instants", lambda x: F.pmod(x, F.lit(p).cast("bigint")) != 0)
    seen = stamps.filter(F.size("instants") > 0).groupBy("kind", "form").agg(F.approx_count_distinct("raw").alias("values"), F.first("precision").alias("precision"), *[F.max(odd(p)).alias(f"odd{p}") for p in powers])
    coarser = F.greatest(*[F.when(~F.col(f"odd{p}") & (F.col("precision") < p), p).otherwise(1) for p in powers]).cast("bigint")
    return seen.select("kind", "form", F.when((F.col("values") >= EVIDENCE) & (F.col("precision") < TICKS_PER_S), coarser).otherwise(F.lit(1).cast("bigint")).alias("coarser"))


def normalised(stamps: DataFrame, path: str | None = None) -> DataFrame:
    """Stamps with their instants: all columns of ``stamps`` (kind, raw, zone and others) and state, instants, precision, form.

    Values are parsed once, through the dictionary under ``path``; a null raw is absent. Rows meet the dictionary in one
    join, broadcast while it is small; beyond that values in a large share of the rows are split off, so they are no hot task. ``precision``
    is the one measured (see ``true_precision``).
    """
    known = StampDictionary(stamps.sparkSession, path)
    known.extend(stamps)
    key = ["kind", "raw", "_zone"]
    values = known.read().withColumn("_zone", F.coalesce("zone", F.lit(""))).drop("zone").dropDuplicates(key)
    zoned = stamps.withColumn("_zone", F.coalesce("zone", F.lit("")))
    forms = true_precision(values.join(shuffled(zoned.select(*key).distinct()), key, "left_semi"))
    out = split_join(zoned, values, key).drop("_zone")
    out = sized_join(out, forms, ["kind", "form"], "left").withColumn("precision", F.greatest("precision", F.coalesce("coarser", F.lit(1).cast("bigint")))).drop("coarser")
    return out.withColumn("state", F.coalesce("state", F.lit("absent")))


def _own(kind: str, raw: str) -> Column:
    """One stamp to be looked up; the zone of its archive is part of the key only if the stamp names none."""
    return F.struct(F.lit(kind).alias("kind"), F.col(raw).alias("raw"), F.when(own_zone(kind, raw), None).otherwise(F.col("zone")).alias("zone"))


def _zoned(rows: DataFrame, archives: DataFrame) -> DataFrame:
    """Rows with the zone of their archive; of archives given twice the greatest zone holds."""
    zones = archives.filter("archive_id is not null").groupBy("archive_id").agg(F.max("zone_name").alias("zone"))
    return sized_join(rows, zones, ["archive_id"], "left")


def disagreeing_stamps(headers: DataFrame, archives: DataFrame, entries: DataFrame, path: str | None = None) -> DataFrame:
    """Entries whose header stamp shares no instant with another stamp of the entry.

    ``headers``: header_id, archive_id, entry_index, header_last_modified, modified_time; ``archives``: archive_id,
    zone_name; ``entries``: archive_id, entry_index, dos_date, dos_time. Other columns are ignored, repeated rows count
    once. Absent, unreadable and unzoned stamps aren't compared; an impossible date shares nothing. Of archives given
    twice the greatest zone holds. Result: distinct (header_id, versus).
    """
    key = ["archive_id", "entry_index"]
    h = headers.select("header_id", *key, F.col("header_last_modified").cast("string").alias("packed"), F.col("modified_time").alias("text")).distinct()
    h = _zoned(h, archives)
    dos = entries.filter("archive_id is not null and entry_index is not null and dos_date is not null and dos_time is not null").select(*key, F.concat_ws(":", "dos_date", "dos_time").alias("dos")).distinct()
    rows = h.filter(~F.lower(F.trim("packed")).isin(ABSENT)).join(shuffled(dos), key, "left").filter(F.col("text").isNotNull() | F.col("dos").isNotNull())
    kinds = ["packed", "text", "dos"]
    rows = cut(rows.select(F.monotonically_increasing_id().alias("_row"), "header_id", *[_own(k, k).alias(k) for k in kinds]))
    stamps = normalised(rows.select("_row", "header_id", F.explode(F.array(*kinds)).alias("e")).select("_row", "header_id", "e.*").filter("raw is not null"), path)
    value = F.struct("instants", "precision")
    sides = stamps.filter("state = 'ok'").groupBy("_row", "header_id").agg(*[F.first(F.when(F.col("kind") == k, value), ignorenulls=True).alias(k) for k in kinds])
    apart = lambda k: F.col("packed").isNotNull() & F.col(k).isNotNull() & ~share_instant("packed", k)
    versus = F.array_compact(F.array(F.when(apart("text"), "modified_time"), F.when(apart("dos"), "dos")))
    return sides.select("header_id", F.explode(versus).alias("versus")).distinct()


def entry_instants(headers: DataFrame, archives: DataFrame, entries: DataFrame, path: str | None = None) -> DataFrame:
    """Every stamp of an entry as instants: source_table, row_id, stamp, instant (ticks), precision, of_so_many.

    A wall time that clocks showed twice gives two rows, one that none showed, an impossible date, and a stamp that is
    absent, unreadable or without a zone give none. ``entries`` also needs entry_id. Repeated rows come once.
    """
    h = headers.select(F.lit("file_header").alias("source_table"), F.col("header_id").alias("row_id"), "archive_id", F.col("header_last_modified").cast("string").alias("packed"), F.col("modified_time").alias("text"), F.lit(None).cast("string").alias("dos"))
    none = F.lit(None).cast("string")
    e = entries.filter("dos_date is not null and dos_time is not null").select(F.lit("central_entry").alias("source_table"), F.col("entry_id").alias("row_id"), "archive_id", none.alias("packed"), none.alias("text"), F.concat_ws(":", "dos_date", "dos_time").alias("dos"))
    rows = cut(_zoned(h.unionByName(e).distinct(), archives))
    names = {"packed": "header_last_modified", "text": "modified_time", "dos": "dos"}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("stamp"), _own(k, k).alias("e")) for k, n in names.items()])).alias("x")
    stamps = rows.select("source_table", "row_id", each).select("source_table", "row_id", "x.stamp", "x.e.*").filter("raw is not null").distinct()
    return normalised(stamps, path).filter("state = 'ok'").select("source_table", "row_id", "stamp", F.size("instants").alias("of_so_many"), "precision", F.explode("instants").alias("instant")).distinct()


def own_zone(kind: str, raw: str) -> Column:
    """Whether a raw stamp needs no zone from outside; its dictionary key then has none, which keeps the dictionary small."""
    if kind == "dos":
        return F.lit(False)
    n = F.expr(f"try_cast({raw} as bigint)")
    count = n.isNotNull() & ~F.col(raw).rlike(r"^\s*\d{14}\s*$")
    return count & ((n <= 0) | (n >= 2**32)) if kind == "packed" else count | F.col(raw).rlike(r"(Z|[A-Z]{3,4}|[+-]\d{2}:?\d{2}|\])\s*$") & ~F.col(raw).rlike(r"[AP]M\s*$")
