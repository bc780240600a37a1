"""Archive rebuilding over all entry names, against a walk in plain Python."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tallyforge.functions.text import entry_name
from tallyforge.queries.reference import rebuild_plan


def read(raw, flags):
    return raw.decode("utf-8", "replace") if (flags or 0) & 2048 else raw.decode("cp437")


def test_entry_names_are_read_like_python_does(spark):
    raws = [bytes(range(256)), "Klaßord/ラサ.bin".encode(), "Drñb".encode("cp437"), b"", b"a\xe3\x83", b"\xf0\x9f\x98x\xc0\xaf\xed\xa0\x80\xff", "Тев".encode("cp1251")]
    rows = [(i, bytearray(b), f) for i, b in enumerate(raws) for f in (0, 2048, 2056, None)] + [(99, None, 0)]
    got = spark.createDataFrame(rows, "i int, raw binary, flags int").select("raw", "flags", entry_name(F.col("raw"), F.col("flags")).alias("name")).collect()
    assert all(r.name == (None if r.raw is None else read(bytes(r.raw), r.flags)) for r in got)


def test_every_entry_takes_part(spark, data):
    members = spark.read.parquet(f"{data}/file_header.parquet").selectExpr("cast(archive_id as string)", "entry_index", "filename", "uncompressed_size", "crc", "is_directory").distinct().collect()
    entries = {(str(r.archive_id), read(bytes(r.filename_bytes), r.flags), r.uncompressed_size) for r in spark.read.parquet(f"{data}/central_entry.parquet").collect()}
    assert any(not n.isascii() for _, n, _ in entries)
    sizes, expected, met = defaultdict(list), Counter(), set()
    for a, n, s in entries:
        sizes[a, n].append(s)
    for m in members:
        key = (m[0], m[2])
        met.add(key)
        expected.update([(*key, "keep" if None in (s, m[3]) or s == m[3] else "replace") for s in sizes[key]] if key in sizes else [(*key, "add")])
    expected.update((*key, "drop") for key, held in sizes.items() if key not in met for _ in held)
    assert Counter(map(tuple, rebuild_plan(spark, data).collect())) == expected
