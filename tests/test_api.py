"""The whole way from files to a plan, through the command line."""

import hashlib
import zipfile
import zlib

from tallyforge.__main__ import main
from tallyforge.api import Workspace


def rom(name, body):
    return f'<rom name="{name}" size="{len(body)}" crc="{zlib.crc32(body):08x}" sha1="{hashlib.sha1(body).hexdigest()}"/>'


def test_audit(spark, tmp_path, capsys):
    (tmp_path / "dats").mkdir()
    (tmp_path / "files/loose").mkdir(parents=True)
    games = {"one": {"a.bin": b"alpha", "b.bin": b"beta"}, "two": {"c.bin": b"gamma"}}
    body = "".join(f'<game name="{g}">{"".join(rom(n, b) for n, b in m.items())}</game>' for g, m in games.items())
    (tmp_path / "dats/x.dat").write_text(f"<datafile><header><name>x</name></header>{body}</datafile>")
    with zipfile.ZipFile(tmp_path / "files/one.zip", "w") as z:
        z.writestr("a.bin", b"alpha")
    (tmp_path / "files/loose/stray.bin").write_bytes(b"gamma")
    w = f"file://{tmp_path}/work"
    for args in (["update_catalogs", str(tmp_path / "dats")], ["scan_deep", str(tmp_path / "files")], ["find_fixes"], ["report"], ["check_archives"], ["export", f"file://{tmp_path}/out"]):
        main([w, *args], spark)
    assert "Total" in capsys.readouterr().out
    ws = Workspace(spark, w)
    assert {(r.game, r.name, r.plan_status) for r in ws.read("nodes").collect()} == {("one", "a.bin", "Correct"), ("one", "b.bin", "Missing"), ("two", "c.bin", "CanBeFixed"), ("loose", "stray.bin", "NeededForFix")}
    assert [r.name for r in ws.fix_catalog(red_only=True).collect()] == ["b.bin"] and ws.fix_catalog().count() == 2
    assert {(r.game, r["class"]) for r in ws.status().collect()} >= {("one", "partial")}
    assert ws.read("actions").count() == 2
