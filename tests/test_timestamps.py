"""Stamp dictionary: every written form, gaps and overlaps of zones, precision, absent and impossible stamps."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from tallyforge.operators.timestamps import StampDictionary, disagreeing_stamps, entry_instants, normalised, parse_stamps

EPOCH = 62135596800


def ticks(*a, zone=None, fold=0, fraction=0):
    t = dt.datetime(*a, tzinfo=ZoneInfo(zone) if zone else dt.timezone.utc, fold=fold)
    return (int(t.timestamp()) + EPOCH) * 10**7 + fraction


def parse(spark, kind, raw, zone=None):
    r = parse_stamps(spark.createDataFrame([(kind, raw, zone)], "kind string, raw string, zone string")).first()
    return r.state, sorted(r.instants), r.precision


CASES = [
    ("2020-07-24T17:04:56+02:00", [ticks(2020, 7, 24, 15, 4, 56)], 10**7),
    ("2016/05/31 10:13:24", [ticks(2016, 5, 31, 8, 13, 24)], 10**7),
    ("Sat, 29 Mar 2014 23:56:24 +0100", [ticks(2014, 3, 29, 22, 56, 24)], 10**7),
    ("28-Oct-2019 00:08:06", [ticks(2019, 10, 27, 23, 8, 6)], 10**7),
    ("20140727T200140Z", [ticks(2014, 7, 27, 20, 1, 40)], 10**7),
    ("20140727200140", [ticks(2014, 7, 27, 18, 1, 40)], 10**7),
    ("2022-10-26 12:56:20,415", [ticks(2022, 10, 26, 10, 56, 20, fraction=4150000)], 10**4),
    ("2013-09-30T12:44:04.2656730Z", [ticks(2013, 9, 30, 12, 44, 4, fraction=2656730)], 1),
    ("2011-06-03 12:27", [ticks(2011, 6, 3, 10, 27)], 60 * 10**7),
    ("Oct 25, 2020 2:56:41 PM", [ticks(2020, 10, 25, 13, 56, 41)], 10**7),
    ("Oct 5, 2020 12:15:01 AM", [ticks(2020, 10, 4, 22, 15, 1)], 10**7),
    ("2015-11-01 01:14:27 EDT", [ticks(2015, 11, 1, 5, 14, 27)], 10**7),
    ("2019-05-01T08:03:44[America/New_York]", [ticks(2019, 5, 1, 12, 3, 44)], 10**7),
    ("1412307190", [(1412307190 + EPOCH) * 10**7], 10**7),
    ("1544805483241", [1544805483241 * 10**4 + EPOCH * 10**7], 10**4),
    ("637986537770427810", [637986537770427810], 1),
    ("2021-03-28 02:30:00", [], 10**7),
    ("2021-10-31 02:30:00", [ticks(2021, 10, 31, 0, 30), ticks(2021, 10, 31, 1, 30)], 10**7),
    ("2021-02-30 02:30:00", [], 10**7),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([("text", c[0], "Europe/Berlin") for c in CASES], "kind string, raw string, zone string")
    return {r.raw: r for r in parse_stamps(df).collect()}


@pytest.mark.parametrize("raw,instants,precision", CASES)
def test_forms(parsed, raw, instants, precision):
    r = parsed[raw]
    assert (r.state, sorted(r.instants), r.precision) == ("ok", instants, precision)


def test_states(spark):
    assert [parse(spark, "text", x)[0] for x in (None, "", " ", "n/a", "0", "-9223372036854775808")] == ["absent"] * 6
    assert parse(spark, "text", "2020-01-01 00:00:00")[0] == "unzoned"
    assert parse(spark, "text", "yesterday", "UTC")[0] == "unreadable"
    assert parse(spark, "text", "2020-01-01 00:00:00", "Nowhere")[0] == "unzoned"
    assert parse(spark, "text", "x" * 100_000, "UTC")[0] == "unreadable"
    assert parse(spark, "dos", "0:0", "UTC")[0] == "absent"
    assert parse(spark, "dos", "0:5", "UTC")[:2] == ("ok", [])
    assert parse(spark, "dos", f"{(2020 - 1980) << 9 | 2 << 5 | 3}:{4 << 11 | 5 << 5 | 3}", "UTC") == ("ok", [ticks(2020, 2, 3, 4, 5, 6)], 2 * 10**7)
    assert parse(spark, "packed", "5", "UTC")[:2] == ("ok", [])
    assert parse(spark, "packed", "1544805483241")[:2] == ("ok", [1544805483241 * 10**4 + EPOCH * 10**7])


def test_lord_howe_half_hour(spark):
    zone = "Australia/Lord_Howe"
    assert len(parse(spark, "text", "2021-04-04 01:45:00", zone)[1]) == 2
    assert parse(spark, "text", "2021-10-03 02:15:00", zone)[1] == []


def test_dictionary_grows_by_what_it_lacks(spark, tmp_path):
    d = StampDictionary(spark, f"file://{tmp_path}/stamps")
    rows = lambda *x: spark.createDataFrame([("text", r, "UTC") for r in x], "kind string, raw string, zone string")
    assert d.read().count() == 0
    assert d.extend(rows("1", "1", "2")) == 2
    assert d.extend(rows("2", "3")) == 1
    assert StampDictionary(spark, d.path).extend(rows("3", "2", "1")) == 0  # another run parses nothing again
    assert sorted(r.raw for r in d.read().collect()) == ["1", "2", "3"]


HEADERS = "header_id bigint, archive_id bigint, entry_index int, header_last_modified bigint, modified_time string, zone_name string"
ENTRIES = "archive_id bigint, entry_index int, dos_date int, dos_time int, zone_name string"
DOS = ((2020 - 1980) << 9 | 2 << 5 | 3, 4 << 11 | 5 << 5 | 3)


def found(spark, headers, archives, entries):
    got = disagreeing_stamps(spark.createDataFrame(headers, HEADERS), spark.createDataFrame(archives, "archive_id bigint, zone_name string"), spark.createDataFrame(entries, ENTRIES))
    return {tuple(r) for r in got.collect()}


def test_comparison(spark):
    zone = [(1, "UTC"), (2, None)]
    s = int(dt.datetime(2020, 2, 3, 4, 5, 7, tzinfo=dt.timezone.utc).timestamp())
    packed = DOS[0] << 16 | DOS[1]
    headers = [
        (1, 1, 0, s * 1000, "2020-02-03 04:05:07", "clash"),  # agrees with both, DOS to two seconds
        (2, 1, 0, s * 1000 + 3000, "2020-02-03T04:05:07Z", None),  # with neither
        (3, 2, 0, packed, "2020-02-03 09:05:07", None),  # wall time without a zone isn't compared
        (4, 1, 0, packed, None, None),
        (5, 1, 1, 0, "2020-02-03 04:05:07", None),
        (6, 1, 2, 33 << 16, "2020-02-03T04:05:07Z", None),  # no such day
        (7, None, None, s * 1000, "n/a", None),
        (8, None, None, s * 1000, str(s + 1), None),
    ]
    assert found(spark, headers * 2, zone, [(1, 0, *DOS, "x"), (1, 0, *DOS, "x"), (1, 2, 0, 0, None), (None, None, None, None, None)]) == {(2, "modified_time"), (2, "dos"), (6, "modified_time"), (8, "modified_time")}


def test_empty(spark):
    assert found(spark, [], [], []) == set()


def test_a_named_folder_outlives_the_query(spark, tmp_path):
    path = f"file://{tmp_path}/stamps"
    headers = spark.createDataFrame([(1, 1, 0, 1_600_000_000_000, "2020-09-13 12:26:41", None)], HEADERS)
    archives, entries = spark.createDataFrame([(1, "UTC")], "archive_id bigint, zone_name string"), spark.createDataFrame([], ENTRIES)
    for _ in range(2):
        assert {tuple(r) for r in disagreeing_stamps(headers, archives, entries, path).collect()} == {(1, "modified_time")}
    batches = [spark.read.parquet(b).count() for b in StampDictionary(spark, path)._batches()]
    assert sorted(batches) == [0, 2]
    assert StampDictionary(spark).path == StampDictionary(spark).path


def test_precision_is_measured_over_a_form(spark):
    rows = lambda n, last: [("text", f"{636762946512373000 + i * 7919 * 10 + last}", None) for i in range(n)]
    grain = lambda data: {r.precision for r in normalised(spark.createDataFrame(data, "kind string, raw string, zone string")).collect()}
    assert grain(rows(40, 0)) == {10}  # the seventh digit is never used
    assert grain(rows(40, 0) + rows(1, 3)) == {1}
    assert grain(rows(4, 0)) == {1}  # too few to tell


def test_instants_of_rows(spark):
    headers = [(1, 1, 0, 1_600_000_000_000, "2021-10-31 02:30:00", "clash"), (1, 1, 0, 1_600_000_000_000, "2021-10-31 02:30:00", None), (2, 2, 0, None, "2021-10-31 02:30:00", None), (3, 1, 0, 0, "2021-03-28 02:30:00", None)]
    entries = spark.createDataFrame([(9, 1, 0, *DOS), (8, 1, 1, 0, 0), (7, 1, 2, None, 5)], "entry_id bigint, archive_id bigint, entry_index int, dos_date int, dos_time int")
    got = entry_instants(spark.createDataFrame(headers, HEADERS), spark.createDataFrame([(1, "Europe/Berlin"), (2, None)], "archive_id bigint, zone_name string"), entries)
    assert sorted((r.source_table, r.row_id, r.stamp, r.of_so_many, r.instant // 10**7 - 62_135_596_800) for r in got.collect()) == [
        ("central_entry", 9, "dos", 1, int(dt.datetime(2020, 2, 3, 3, 5, 6, tzinfo=dt.timezone.utc).timestamp())),
        ("file_header", 1, "header_last_modified", 1, 1_600_000_000),
        ("file_header", 1, "modified_time", 2, 1_635_640_200),
        ("file_header", 1, "modified_time", 2, 1_635_643_800),
    ]


def test_zones_are_never_broadcast_by_estimate(spark, monkeypatch):
    import tallyforge.session as session
    from tallyforge.operators.timestamps import _zoned

    rows = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 9)], "row_id bigint, archive_id bigint")
    zones = spark.createDataFrame([(1, "UTC"), (1, "CET"), (2, None)], "archive_id bigint, zone_name string")
    want = {(1, "UTC"), (2, None), (3, None), (4, None)}
    assert {(r.row_id, r.zone) for r in _zoned(rows, zones).collect()} == want
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)  # too many to be broadcast
    out = _zoned(rows, zones)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and {(r.row_id, r.zone) for r in out.collect()} == want
