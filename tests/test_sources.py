"""Readers, writers, scans and archive checks on literal inputs."""

import gzip
import io
import json
import struct
import tracemalloc
import xml.etree.ElementTree as ET
import zipfile
from functools import cmp_to_key
from itertools import islice

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as tx
from tallyforge.operators import archives, reconcile, rules, transforms
from tallyforge.sources import inventory, readers, writers
from tallyforge.sources.readers import rows_of

XML = """<?xml version="1.0"?><!DOCTYPE datafile PUBLIC "x" "y" [<!ELEMENT a (b)>]>
<datafile><header><name>Näme</name><version>1</version><clrmamepro header="nes.xml" forcepacking="zip"/></header>
<dir name="D"><game name="TestGame" cloneof="P" isbios="no"><description>A &amp; B</description><category>one</category><rom name="test.bin" size="1024" crc="12345678" status="good"/><disk name="d.chd" sha1="ABC"/><device_ref name="dev"/></game></dir></datafile>"""
SOFT = """<softwarelist name="s" description="d"><software name="g"><description>x</description><part name="p"><dataarea name="r"><rom name="a" size="1024" crc="1" sha1="987654"/><rom size="0x400" loadflag="continue"/></dataarea><diskarea name="k"><disk name="h" sha1="1"/></diskarea></part></software><software name="empty"/></softwarelist>"""
CMP = 'clrmamepro ( name "N" version 2 ) // c\ngame ( name "G 1" description "x" rom ( name "a (b).bin" size 12 crc 0xAB ) disk ( name d sha1 1 ) sample x ) unknown ( a ( b c ) )'
DOS = 'DOSCenter (\n\tName: N\n)\ngame (\n\tname "G.zip"\n\tfile ( name A B.EXE size 10 date 1990/01/02 00:00:00 crc 00ff )\n)\n'
ROMC = "[CREDITS]\nauthor=me\n[GAMES]\n¬p¬pd¬g¬G d¬r 1.bin¬1234abcd¬10¬bios¬m¬\n¬g¬x¬g¬d¬s.bin¬1¬2¬¬¬\n"


def parsed(text):
    return readers.rows_of("f.dat", text.encode())


def test_xml():
    rows = parsed(XML)
    assert [(r["kind"], r["name"], r["depth"], r["path"]) for r in rows] == [("dir", "D", 1, []), ("game", "TestGame", 2, ["D"]), ("file", "test.bin", 3, ["D", "TestGame"]), ("file", "d", 3, ["D", "TestGame"])]
    assert rows[2]["crc"] == "12345678" and rows[2]["size"] == 1024 and rows[3]["sha1"] == "abc".rjust(40, "0") and rows[3]["is_disk"]
    assert rows[1]["fields"]["cloneof"] == "P" and rows[1]["category"] == ["one"] and rows[1]["device_ref"] == ["dev"] and rows[0]["header"]["name"] == "Näme" and rows[0]["header"]["header"] == "nes.xml"


def test_other_formats():
    soft = parsed(SOFT)
    assert [(r["name"], r["size"]) for r in soft] == [("g", None), ("a", 2048), ("h", None)] and soft[1]["sha1"] == "987654".rjust(40, "0")
    text = parsed(CMP)
    assert [(r["kind"], r["name"]) for r in text] == [("game", "G 1"), ("file", "a (b).bin"), ("file", "d")] and text[1]["crc"] == "000000ab" and text[0]["header"] == {"name": "N", "version": "2"}
    dos = parsed(DOS)
    assert [(r["kind"], r["name"], r["size"], r["crc"]) for r in dos] == [("game", "G", None, None), ("file", "A B.EXE", 10, "000000ff")]
    romc = parsed(ROMC)
    assert [(r["kind"], r["name"], r["crc"]) for r in romc] == [("game", "g", None), ("file", "r 1.bin", "1234abcd"), ("file", "s.bin", "00000001")] and romc[0]["fields"]["cloneof"] == "p"
    assert parsed("<datafile/>")[0]["kind"] == "error" and parsed("")[0]["kind"] in ("error", "empty")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, text in (("a.dat", XML), ("sub/b.xml", SOFT), ("sub/c.dat", CMP), ("broken.xml", "<datafile")):
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    return tmp_path


def test_read_and_write_round_trip(spark, folder):
    nodes = readers.read_catalogs(spark, str(folder / "in"))
    assert nodes.filter("kind = 'error'").count() == 1 and nodes.filter("kind = 'file'").count() == 6
    assert {r[0] for r in nodes.filter("source like '%b.xml'").select("virtual_dir").distinct().collect()} == {"sub"}
    text = lambda lines: "\n".join(r.line for r in lines.orderBy("place").collect())
    plain = text(writers.xml_lines(nodes.filter("source like '%a.dat'")))
    facts = lambda rows: [(r["kind"], r["name"], r["crc"], r["sha1"], r["path"]) for r in rows]
    assert facts(parsed(plain)) == facts(parsed(XML))
    assert 'status="good"' not in plain and 'isbios="no"' not in plain and "A &amp; B" in plain and "<romvault" in plain
    mame = text(writers.xml_lines(nodes.filter("source like '%a.dat'"), "mame"))
    root = ET.fromstring(mame)  # a root that names the build, and no header
    assert root.tag == "mame" and root.get("build") is not None and root.find("header") is None and "<!DOCTYPE mame [" in mame
    assert [g.get("name") for g in root.iter("machine")] == [r["name"] for r in parsed(XML) if r["kind"] == "game"]
    dos = text(writers.dos_lines(nodes.filter("source like '%c.dat'")))
    assert dos.startswith("DOSCenter (") and '"G 1.zip"' in dos and "crc 000000ab" in dos and "crc 00000000" not in dos
    assert [(r["kind"], r["name"], r["size"], r["crc"]) for r in rows_of("x", dos.encode())] == [(r["kind"], r["name"], r["size"], r["crc"]) for r in nodes.filter("source like '%c.dat' and (kind = 'game' or size is not null)").orderBy("node_id").collect()]
    document = json.loads(text(writers.json_lines(nodes.filter("source like '%a.dat'"))))
    assert list(document) == ["Header", "root"] and document["Header"]["forcepacking"] is not None
    flat = lambda entries: [x for e in entries for x in (e["name"], *flat(e.get("objects", [])))]
    assert sorted(flat(document["root"])) == sorted(r["name"] for r in parsed(XML))
    writers.write_lines(writers.xml_lines(nodes.filter("kind <> 'error'")), f"file://{folder}/out")


def test_scan_and_headers(spark, tmp_path):
    body = b"content"
    (tmp_path / "x.nes").write_bytes(b"NES\x1a" + b"\0" * 12 + body)
    (tmp_path / "e.bin").write_bytes(b"")
    rows = {r.path.rsplit("/", 1)[1]: r for r in inventory.scan(spark, str(tmp_path), level=2).collect()}
    import hashlib

    assert rows["x.nes"].header_type == "NES" and rows["x.nes"].alt_md5 == hashlib.md5(body).hexdigest() and rows["x.nes"].alt_size == 7
    assert rows["e.bin"].crc == "00000000" and rows["e.bin"].md5 == "d41d8cd98f00b204e9800998ecf8427e" and rows["e.bin"].alt_md5 is None
    (tmp_path / "deep/er").mkdir(parents=True)
    big = b"x" * (inventory.BLOCK + 5)
    (tmp_path / "deep/er/ü b.nes").write_bytes(b"NES\x1a" + b"\0" * 12 + big)
    (tmp_path / "deep/er/c.txt").write_bytes(b"t")
    found = {r.path.rsplit("/", 1)[1]: r for r in inventory.scan(spark, f"file://{tmp_path}", level=2, glob="*.nes").collect()}
    assert set(found) == {"x.nes", "ü b.nes"} and found["ü b.nes"].alt_sha1 == hashlib.sha1(big).hexdigest() and found["ü b.nes"].alt_size == len(big)
    assert inventory.scan(spark, str(tmp_path / "deep/er"), glob="no*").count() == 0 and inventory.scan(spark, str(tmp_path)).count() == 4
    assert inventory.scan(spark, str(tmp_path)).columns == ["path", "size", "modified", "file_type"]
    assert [inventory.header_length(k) for k in ("NES", "PSID", "A7800", "X")] == [16, 124, 128, 0]


def test_disk_image():
    v5 = b"MComprHD" + struct.pack(">II", 124, 5) + b"\0" * 48 + b"\1" * 20 + b"\2" * 20 + b"\0" * 20
    assert inventory.disk_image(v5) == {"version": 5, "md5": None, "sha1": "02" * 20, "has_parent": False}
    assert inventory.disk_image(v5[:50]) is None and inventory.disk_image(b"x" * 200) is None


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b/", b"")
        z.writestr("b/x.bin", b"hello")
        z.writestr("A.bin", b"1")
    (tmp_path / "g.gz").write_bytes(gzip.compress(b"hello"))
    (tmp_path / "bad.zip").write_bytes(b"PK nothing")
    rows = inventory.scan_archives(spark, str(tmp_path), deep=True)
    by = {(r.archive.rsplit("/", 1)[1], r.name): r for r in rows.collect()}
    assert by[("a.zip", "b/x.bin")].crc == by[("g.gz", None)].crc == "3610a686" and by[("bad.zip", None)].got_status == "Corrupt" and by[("a.zip", "b/")].crc == "00000000"
    good = rows.filter("archive like '%a.zip'").withColumn("archive", F.lit("a"))
    assert archives.check_members(good).first().fault_bits == 16 + 32
    prepared = archives.prepare_members(good).orderBy("position").collect()
    assert [r.name for r in prepared] == ["A.bin", "b/x.bin"]
    io.BytesIO().close()


def test_member_checks(spark):
    m = lambda *names: spark.createDataFrame([("z", i, n, False) for i, n in enumerate(names)], "archive string, idx int, name string, is_dir boolean")
    bits = lambda *names, **kw: archives.check_members(m(*names), **kw).first().fault_bits
    assert bits("a", "B", "c") == 0 and bits("b", "a") == 16 and bits("a", "a") == 64 and bits("a\\b") == 8 and bits("d/", "d/x") == 32 and bits("d/") == 0
    assert bits("a.b", "a.a", seven_zip=True) == 16 and bits("x.a", "a.b", seven_zip=True) == 0
    assert archives.check_members(m().limit(0)).count() == 0


def test_expressions(spark):
    df = spark.createDataFrame([(" 0xAB ", "dir\\X.Tar.GZ", "7"), (None, ".hidden", "0x10"), ("xyz", "noext", "-"), ("", "a./b", "99999999999999999999")], "h string, n string, s string")
    r = df.select(tx.clean_hash(F.col("h"), 8), tx.extension(F.col("n")), tx.stem(F.col("n")), tx.parse_u64(F.col("s"))).collect()
    assert [tuple(x) for x in r] == [("000000ab", "gz", "X.Tar", 7), (None, None, ".hidden", 16), (None, None, "noext", None), (None, None, "b", 99999999999999999999)]


def test_names_and_ids(spark):
    df = spark.createDataFrame([("g", 1, "a.bin"), ("g", 2, "A.bin"), ("g", 3, "a.bin"), ("g", 4, "b")], "game string, ord int, name string")
    assert [r.name for r in transforms.fix_duplicate_names(df).orderBy("ord").collect()] == ["a_0.bin", "A.bin", "a_1.bin", "b"]
    compare = transforms.alphanumeric
    assert compare("a10", "a9") == 1 and compare("ab", "abc") == -1 and compare("a", "a1") == 1 and compare("", "x") == 0 and compare("x\\b", "a") == -1 and compare("a01", "a1") == 1
    names = ["a10", "a9", "ab", "abc", "a", "a1", "x\\b", "A2b", "a01", "é", "Zz"]
    keyed = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(transforms.natural_key(F.col("n"))).collect()]
    assert keyed == sorted(names, key=cmp_to_key(compare))


def test_dedupe_with_unknown_hashes(spark):
    rows = [("g", 1, "b", 1, "aa", None, None, None), ("g", 2, "a", 1, "aa", "s1", None, None), ("g", 3, "d/c", 1, "aa", "s1", None, "m"), ("g", 4, "e", 1, None, None, None, None), ("g", 5, "f", 1, "bb", "s", None, "m2"), ("g", 6, "f", 1, "bb", "s", None, "m2"), ("h", 7, "f", 1, "bb", "s", None, "m2")]
    df = spark.createDataFrame(rows, "game string, ord bigint, name string, size bigint, crc string, sha1 string, sha256 string, md5 string")
    assert {r.ord for r in transforms.remove_duplicates(df).collect()} == {1, 2, 4, 5, 7}  # files of other names stay, a file in a directory goes
    assert transforms.remove_duplicates(df.limit(0)).count() == 0


def test_reconcile_groups_of_equal_names(spark):
    c = "place string, name string, file_type string, size bigint, sha1 string, md5 string"
    expected = spark.createDataFrame([("p", "a", "File", 1, "x", None, "InDatCollect"), ("p", "a", "File", 2, "y", None, "InDatCollect"), ("p", "b", "File", 1, "z", None, "InDatMIA"), (None, None, None, None, None, None, None)], c + ", dat_status string")
    found = spark.createDataFrame([("p", "a", "File", 2, "y", None, "Got"), ("p", "a", "File", 3, "q", None, "Got"), ("p", "c", "File", 1, "z", None, "Got")], c + ", got_status string")
    got = sorted((r.name or "", r.dat_status, r.got_status) for r in reconcile.reconcile(expected, found, ["place"]).collect())
    assert got == [("", "NotInDat", "NotGot"), ("a", "InDatCollect", "Corrupt"), ("a", "InDatCollect", "Got"), ("b", "InDatMIA", "NotGot"), ("c", "NotInDat", "Got")]


def test_rules(spark):
    paths = spark.createDataFrame([("a/b/c",), ("ab",), ("a",), (None,)], "path string").select(tx.dir_key(F.col("path")).alias("path"))
    table = spark.createDataFrame([("a", "one"), ("a\\b", "two")], "dir_key string, rule string")
    assert {tuple(r) for r in rules.resolve_rules(paths, table, "rule").collect()} >= {("a\\b\\c", "two"), ("ab", None), ("a", "one")}
    names = spark.createDataFrame([("Thumbs.DB",), ("x.tmp",), ("keep.bin",)], "n string")
    assert [r[0] for r in names.select(rules.ignored(F.col("n"), ["ignore:thumbs.db", "ignore:*.TMP", "keep*"])).collect()] == [True, True, False]


def test_json_of_an_archive(spark):
    """One document: the set's type by its structure, its files with their type and hashes."""
    rows = spark.createDataFrame([("c", {"name": "TestDat"}, 1, 0, 1, 0, "game", "Game1", None, None, None, "ZipTrrnt"), ("c", {"name": "TestDat"}, 2, 1, 2, 0, "file", "a.bin", 4, "12345678", "0011", None)], "source string, header map<string,string>, node_id int, parent_id int, depth int, ord int, kind string, name string, size bigint, crc string, sha1 string, zip_struct string")
    for c, t in (("md5", "string"), ("status", "string"), ("mia", "string"), ("is_disk", "boolean"), ("fields", "map<string,string>")):
        rows = rows.withColumn(c, F.lit(None).cast(t))
    doc = json.loads("".join(r.line for r in writers.json_lines(rows).orderBy("place").collect()))
    assert doc["Header"]["name"] == "TestDat" and [(g["name"], g["type"]) for g in doc["root"]] == [("Game1", "trrntzip")]
    assert doc["root"][0]["objects"] == [{"name": "a.bin", "type": "filetrrntzip", "size": 4, "crc": "12345678", "sha1": "0011"}]


def test_sections_of_an_ini_catalog():
    line = lambda *x: "¬" + "¬".join(x) + "¬"
    text = "[CREDITS]\nauthor=A\n[DAT]\nsplit=1\n[EMULATOR]\nrefname=N\n[GAMES]\n" + line("g", "G", "g", "G", "a.bin", "12", "5", "g", "") + "\n[RESOURCES]\n" + line("r", "R", "r", "R", "b.bin", "13", "6", "", "") + "\n[DISKS]\n" + line("p", "P", "g", "G", "d.chd", "987654", "0", "", "m.chd")
    rows = rows_of("x", text.encode())
    assert rows[0]["header"] == {"author": "A", "split": "1", "name": "N"}
    assert [(r["kind"], r["name"], r["crc"], r["sha1"], r["merge"], r["is_disk"]) for r in rows if r["kind"] == "file"] == [("file", "b.bin", "00000013", None, None, False), ("file", "a.bin", "00000012", None, None, False), ("file", "d", None, "987654".rjust(40, "0"), "m", True)]
    assert rows_of("x", (text + "\n[ODD]\n").encode())[0]["kind"] == "error"


def test_patterns_that_are_none_are_passed_over(spark):
    df = spark.createDataFrame([("a.tmp",), ("b.txt",)], "n string")
    assert [r[0] for r in df.select(rules.ignored(F.col("n"), ["ignore: *.tmp ", "ignore:regex:([", "ignore: ", ""])).collect()] == [True, False]


def test_names_of_files(spark):
    df = spark.createDataFrame([("  a:b. .",), ("x/y",), ("",)], "n string")
    assert [r[0] for r in df.select(tx.clean_file_name(F.col("n"), "_")).collect()] == ["a_b", "x_y", ""]
    t = spark.createDataFrame([(" .a. ", "File"), (" a. ", "Zip"), (" a. ", "FileZip"), ("...", "Dir"), (" ", "FileZip")], "n string, t string")
    assert [r[0] for r in t.select(transforms.clean_name_full(F.col("n"), F.col("t"))).collect()] == [".a", "a.", " a. ", "_", "_"]


SETS_TEXT = {
    "cmp": ('clrmamepro ( name "N" )\n', 'game ( name "g{}" rom ( name "r{}.bin" size 1 ) )\n', ""),
    "xml": ("<datafile><header><name>N</name></header>", '<game name="g{}"><rom name="r{}.bin" size="1"/></game>\n', "</datafile>"),
    "dos": ("DOSCenter (\n\tName: N\n)\n", "game (\n\tname g{}.zip\n\tfile ( name r{}.bin size 1 )\n)\n", ""),
}


@pytest.mark.parametrize("kind", SETS_TEXT)
def test_a_file_is_read_by_blocks(kind):
    head, each, tail = SETS_TEXT[kind]
    text, most = (head + "".join(each.format(i, i) for i in range(60_000)) + tail).encode(), []

    class Watched(io.BytesIO):
        def read(self, n=-1):
            most.append(n)
            return super().read(n)

    opened = []
    rows = readers.node_rows("x", lambda: opened.append(Watched(text)) or opened[-1])
    first = [next(rows) for _ in range(2)]
    assert opened[-1].tell() <= readers.BLOCK < len(text) and max(most) <= readers.BLOCK and min(most) > 0  # rows come before the rest is read
    assert [(r["kind"], r["name"], r["node_id"], r["parent_id"], r["path"], r["header"]["name"]) for r in first] == [("game", "g0", 1, 0, [], "N"), ("file", "r0.bin", 2, 1, ["g0"], "N")]
    rest = list(rows)
    assert len(rest) == 2 * 60_000 - 2 and rest[-1]["name"] == "r59999.bin" and rest[-2]["ord"] == 59_999


@pytest.mark.parametrize("block", [1, 3, 16])
def test_blocks_end_anywhere(monkeypatch, block):
    cmp = 'dir ( game ( name b rom ( name "c é" ) ) name "D" dir ( name E game ( name f rom ( name g ) ) ) ) game ( name h )'
    deep = XML.replace("</dir>", '<dir name="E"><machine name="m"><rom name="z"/></machine></dir></dir><rom name="top"/>')
    texts = [XML, SOFT, CMP, DOS, ROMC, cmp, deep, "<datafile/>", DOS.replace("\n", "\r\n"), "﻿" + XML]
    whole = [parsed(t) for t in texts]
    assert [(r["name"], r["path"]) for r in whole[5]] == [("D", []), ("h", []), ("b", ["D"]), ("E", ["D"]), ("f", ["D", "E"]), ("g", ["D", "E", "f"]), ("c é", ["D", "b"])]
    monkeypatch.setattr(readers, "BLOCK", block)
    assert [parsed(t) for t in texts] == whole


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _set_nodes(spark):
    """A set of two members as literal nodes, the second with a name that needs references."""
    columns = "source string, node_id int, parent_id int, depth int, ord int, kind string, name string, header map<string,string>, fields map<string,string>, category array<string>, device_ref array<string>, size bigint, crc string, sha1 string, md5 string, sha256 string, merge string, status string, region string, mia string, is_disk boolean"
    row = lambda i, parent, depth, kind, name: ("s", i, parent, depth, 0, kind, name, {"name": "N"}, {}, [], [], 7 if kind == "file" else None, *[None] * 8, False)
    return spark.createDataFrame([row(1, 0, 1, "game", "g"), row(2, 1, 2, "file", "a.bin"), row(3, 1, 2, "file", "b & <'\"\t\r\n>.bin")], columns)


def test_lines_of_two_levels_take_no_join(spark):
    nodes = _set_nodes(spark)
    lines = writers.xml_lines(nodes, headers=nodes.filter("kind = 'game'"))
    assert "Join" not in _plan(lines)
    rows = rows_of("x", "\n".join(r.line for r in lines.orderBy("place").collect()).encode())
    assert [(r["kind"], r["name"], r["size"]) for r in rows] == [("game", "g", None), ("file", "a.bin", 7), ("file", "b & <'\"\t\r\n>.bin", 7)]


def test_lines_of_many_levels_keep_their_order(spark, tmp_path):
    deep = '<datafile><header><name>N</name></header><dir name="A"><dir name="B"><dir name="C"><game name="g"><description>x</description><rom name="r" size="1"/></game></dir></dir><game name="h"><description>x</description><rom name="s" size="2"/></game></dir><game name="i"><description>x</description><rom name="t" size="3"/></game></datafile>'
    (tmp_path / "deep.dat").write_text(deep)
    nodes = readers.read_catalogs(spark, str(tmp_path))
    back = rows_of("x", "\n".join(r.line for r in writers.xml_lines(nodes).orderBy("place").collect()).encode())
    facts = lambda rows: sorted((r["kind"], r["name"], r["path"], r["depth"], r["ord"]) for r in rows)
    assert facts(back) == facts(rows_of("x", deep.encode())) and len(back) == 9


def test_a_map_that_rows_share_is_converted_once(monkeypatch):
    import pyarrow as pa

    shared, kind = {"a": "1", "b": "2"}, pa.map_(pa.string(), pa.string())
    pairs = list(shared.items())
    assert readers._column((shared,) * 3, kind).to_pylist() == [pairs] * 3 and readers._column((None, None), kind).to_pylist() == [None, None]
    assert readers._column((shared, None, {}), kind).to_pylist() == [pairs, None, []]


def test_sets_of_catalogs_are_told_without_members(spark, data):
    from tallyforge.queries import files

    sets = files.catalogs(spark, data).filter("kind = 'game'").select("source", "node_id", "name", "header")
    scans = sets._jdf.queryExecution().executedPlan().toString()  # of a relation, the optimized plan lists all columns
    assert "l_partkey" in scans and "l_suppkey" not in scans


def test_blocks_of_two_levels_take_no_join(spark):
    nodes = _set_nodes(spark)
    lines = writers.dos_lines(nodes, nodes.filter("kind = 'game'"))
    assert "Join" not in _plan(lines)
    rows = rows_of("x", "\n".join(r.line for r in lines.filter("not contains(line, '&')").orderBy("place").collect()).encode())
    assert [(r["kind"], r["name"], r["size"]) for r in rows] == [("game", "g", None), ("file", "a.bin", 7)]


def test_what_a_reader_of_blocks_holds_does_not_follow_the_file(monkeypatch):
    monkeypatch.setattr(readers, "BLOCK", 1 << 16)
    head, each, _ = SETS_TEXT["dos"]

    def peak(sets):
        text = (head + "".join(each.format(i, i) for i in range(sets))).encode()
        tracemalloc.start()
        rows, n = readers.node_rows("x", lambda: io.BytesIO(text)), 0
        while held := list(islice(rows, 1000)):
            n += len(held)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == 2 * sets
        return most

    assert peak(20_000) < 1.3 * peak(5_000)
