"""Files with a header against catalogs that state their content without it."""

import hashlib
import zlib

from tallyforge.__main__ import main
from tallyforge.api import Workspace
from tallyforge.operators.reconcile import reconcile

CATALOG = "place string, name string, file_type string, size bigint, sha1 string, dat_status string, header_type string"
FOUND = "place string, name string, file_type string, size bigint, sha1 string, got_status string, header_type string, alt_size bigint, alt_sha1 string"


def test_content_without_header_agrees(spark):
    want = lambda n, sha1, kind: ("p", n, "File", 10, sha1, "InDatCollect", kind)
    held = lambda n, sha1, kind, alt: ("p", n, "File", 26, sha1, "Got", kind, 10 if alt else None, alt)
    catalog = [want("alt", "a", "NES"), want("other type", "a", "NES"), want("clash", "a", "NES"), want("not capable", "a", "NOTHING"), want("twice", "a", "NES"), want("twice", "b", "NES"), want("gone", "a", "NES"), want("plain", "a", None)]
    found = [held("alt", "x", "NES", "a"), held("other type", "x", "SNES", "a"), held("clash", "x", "NES", "z"), held("not capable", "x", "NOTHING", "a"), held("twice", "x", "NES", "b"), held("twice", "y", "NES", "a"), held("stray", "x", "NES", "a"), ("p", "plain", "File", 10, "a", "Got", None, None, None)]
    got = sorted((r.name, r.got_status) for r in reconcile(spark.createDataFrame(catalog, CATALOG), spark.createDataFrame(found, FOUND), ["place"]).collect())
    assert got == [("alt", "Got"), ("clash", "Corrupt"), ("gone", "NotGot"), ("not capable", "Corrupt"), ("other type", "Corrupt"), ("plain", "Got"), ("stray", "Got"), ("twice", "Got"), ("twice", "Got")]


def test_workspace_carries_headers(spark, tmp_path):
    body = bytes(range(200))
    (tmp_path / "dats").mkdir()
    (tmp_path / "files/one").mkdir(parents=True)
    (tmp_path / "dats/x.dat").write_text(f'<datafile><header><name>x</name><clrmamepro header="No-Intro_NES.xml"/></header><game name="one"><rom name="a.nes" size="200" crc="{zlib.crc32(body):08x}" sha1="{hashlib.sha1(body).hexdigest()}"/></game></datafile>')
    (tmp_path / "files/one/a.nes").write_bytes(b"NES\x1a" + bytes(12) + body)
    w = f"file://{tmp_path}/work"
    for args in (["update_catalogs", str(tmp_path / "dats")], ["scan", str(tmp_path / "files")], ["find_fixes"]):
        main([w, *args], spark)
    assert [(r.name, r.plan_status) for r in Workspace(spark, w).read("nodes").collect()] == [("a.nes", "Correct")]
