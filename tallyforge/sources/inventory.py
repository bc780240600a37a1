"""Physical files into inventory rows: listing, hashing, header and disk-image detection, archive members."""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import extension
from tallyforge.schemas import ALT_CAPABLE, EMPTY, MAGICS
from tallyforge.session import cut


def classify(path: Column) -> Column:
    """Zip and 7z archives by extension, all else files."""
    e = extension(path)
    return F.when(e == "zip", "Zip").when(e == "7z", "SevenZip").otherwise("File")


#: Bytes of a file read at once; a header's magic lies within the first block.
BLOCK = 1 << 20
LISTED = "path string, size bigint, modified timestamp, is_dir boolean"
HASHED = "path string, header_type string, crc string, md5 string, sha1 string, sha256 string, alt_size bigint, alt_crc string, alt_md5 string, alt_sha1 string, alt_sha256 string, got_status string"


def open_storage(path: str):
    """(file system, path in it) of a path with or without a scheme."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for b in batches:
        for folder in b["path"]:
            store, inner = open_storage(folder)
            prefix = folder.removesuffix(inner)
            found = store.get_file_info(fs.FileSelector(inner, recursive=False))
            for i in range(0, len(found), 10_000):
                rows = [(prefix + f.path, f.size if f.is_file else None, f.mtime, not f.is_file) for f in found[i : i + 10_000]]
                yield pd.DataFrame(rows, columns=["path", "size", "modified", "is_dir"]).astype({"size": "Int64"})


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below ``path`` whose names fit ``glob``: path, size, modified. Directories are listed by tasks, level by level; no list of files comes to the driver."""
    import fnmatch

    frontier = spark.createDataFrame([(path.rstrip("/") or "/",)], "path string")
    out = None
    while True:
        found = cut(frontier.repartition("path").mapInPandas(_list, LISTED))
        out = found if out is None else out.unionByName(found)
        frontier = found.filter("is_dir").select("path")
        if frontier.isEmpty():
            break
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return out.filter(~F.col("is_dir") & name.rlike(fnmatch.translate(glob).replace("\\Z", "$").replace("\\z", "$"))).drop("is_dir")


def scan(spark: SparkSession, path: str, level: int = 1, glob: str = "*") -> DataFrame:
    """Files below ``path``. Level 1 lists only, so no content is read; levels 2 and 3 hash it, whole and, for types that can have one, without its header. A file is read once, in blocks, whatever its size; one that can't be read is FileLocked."""
    listed = listing(spark, path, glob).select("path", "size", "modified", classify(F.col("path")).alias("file_type"))
    if level == 1:
        return listed
    spread = listed.select("path").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("path"))
    return listed.join(spread.mapInPandas(_hash, HASHED), "path").withColumn("deep", F.col("got_status") == "Got")


class _Hashes:
    """Running hashes of a content."""

    def __init__(self):
        self.size, self.crc, self.digests = 0, 0, [hashlib.new(k) for k in ("md5", "sha1", "sha256")]

    def update(self, block: bytes) -> None:
        self.size, self.crc = self.size + len(block), zlib.crc32(block, self.crc)
        for x in self.digests:
            x.update(block)

    def values(self) -> list[str]:
        return [f"{self.crc:08x}", *[x.hexdigest() for x in self.digests]]


def hash_file(path: str) -> tuple:
    """One file by blocks: its header type, its hashes, and size and hashes of what follows a header."""
    store, inner = open_storage(path)
    whole, rest, kind, skip = _Hashes(), None, "NOTHING", 0
    try:
        with store.open_input_stream(inner) as f:
            while block := f.read(BLOCK):
                if not whole.size:
                    kind, skip = header_of(block)
                    rest = _Hashes() if skip and kind in ALT_CAPABLE else None
                if rest:
                    rest.update(block[max(0, skip - whole.size) :])
                whole.update(block)
    except OSError:
        return (path, kind, *[None] * 9, "FileLocked")
    rest = rest if rest and whole.size > skip else None
    return (path, kind, *whole.values(), *((rest.size, *rest.values()) if rest else [None] * 5), "Got")


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split(" ")[0] for x in HASHED.split(", ")]
    order = ["path", "header_type", "crc", "md5", "sha1", "sha256", "alt_size", "alt_crc", "alt_md5", "alt_sha1", "alt_sha256", "got_status"]
    for b in batches:
        yield pd.DataFrame([hash_file(p) for p in b["path"]], columns=order)[names].astype({"alt_size": "Int64"})


def header_of(start: bytes) -> tuple[str, int]:
    """(type, bytes to skip) of a content by its first bytes: the first magic that fits, in the table's order."""
    return next(((name, n) for name, at, magic, n in MAGICS if start[at : at + len(magic) // 2] == bytes.fromhex(magic)), ("NOTHING", 0))


def detect_header(content: Column) -> tuple[Column, Column]:
    """The same for a binary column."""
    kind, skip = F.lit("NOTHING"), F.lit(0)
    for name, at, magic, n in reversed(MAGICS):
        hit = F.hex(F.substring(content, at + 1, len(magic) // 2)) == magic
        kind, skip = F.when(hit, name).otherwise(kind), F.when(hit, n).otherwise(skip)
    return kind, skip


def header_length(name: str) -> int:
    """Bytes that the first magic of a type skips."""
    return next((n for k, _, _, n in MAGICS if k == name), 0)


def disk_image(raw: bytes) -> dict | None:
    """Version, sha1, md5 and parent mark of a compressed disk image's header; null if it is malformed."""
    if len(raw) < 16 or raw[:8] != b"MComprHD":
        return None
    size, version = struct.unpack(">II", raw[8:16])
    # fixed values: header size and places of md5, parent md5, sha1, parent sha1, raw sha1 by version
    layout = {1: (76, 44, 60, None, None, None), 2: (80, 44, 60, None, None, None), 3: (120, 44, 60, 80, 100, None), 4: (108, None, None, 48, 68, 88), 5: (124, None, None, 84, 104, 64)}
    if version not in layout or size != layout[version][0] or len(raw) < size:
        return None
    _, md5, parent_md5, sha1, parent_sha1, raw_sha1 = layout[version]
    cut = lambda at, n: raw[at : at + n].hex() if at is not None and any(raw[at : at + n]) else None
    return {"version": version, "md5": cut(md5, 16), "sha1": cut(sha1, 20) or cut(raw_sha1, 20), "has_parent": bool(cut(parent_md5, 16) or cut(parent_sha1, 20))}


MEMBER_SCHEMA = "archive string, idx int, name string, is_dir boolean, size bigint, compressed_size bigint, crc string, md5 string, sha1 string, sha256 string, method int, flags int, dos_packed bigint, local_header_offset bigint, got_status string, comment string"
_MEMBER = [x.split(" ")[0] for x in MEMBER_SCHEMA.split(", ")]


def zip_members(archive: str, content: bytes, deep: bool) -> list[dict]:
    """Members of a zip archive. Directories have the hashes of nothing; a stored CRC that isn't the content's makes a member Corrupt; an unreadable archive is one Corrupt row."""
    blank = dict.fromkeys(_MEMBER) | {"archive": archive}
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        return [blank | {"idx": -1, "got_status": "Corrupt"}]
    rows = []
    for i, m in enumerate(z.infolist()):
        name = m.orig_filename
        y, mo, d, h, mi, s = m.date_time
        row = blank | {"idx": i, "name": name, "is_dir": name.endswith("/"), "size": m.file_size, "compressed_size": m.compress_size, "crc": f"{m.CRC:08x}", "method": m.compress_type, "flags": m.flag_bits, "dos_packed": (((y - 1980) << 9 | mo << 5 | d) << 16) | (h << 11 | mi << 5 | s // 2), "local_header_offset": m.header_offset, "got_status": "Got", "comment": z.comment.decode("cp437")}
        if row["is_dir"]:
            row |= EMPTY
        elif deep:
            row |= _stream(z, m)
        rows.append(row)
    return rows


def _stream(z: zipfile.ZipFile, m: zipfile.ZipInfo) -> dict:
    crc, digests = 0, {k: hashlib.new(k) for k in ("md5", "sha1", "sha256")}
    try:
        with z.open(m) as f:
            while block := f.read(1 << 16):
                crc = zlib.crc32(block, crc)
                for x in digests.values():
                    x.update(block)
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
        return {"got_status": "Corrupt"}
    return {k: x.hexdigest() for k, x in digests.items()} | ({} if crc == m.CRC else {"got_status": "Corrupt"})


def gzip_member(archive: str, content: bytes) -> list[dict]:
    blank = dict.fromkeys(_MEMBER) | {"archive": archive, "idx": 0, "is_dir": False}
    try:
        body = gzip.decompress(content)
    except (OSError, EOFError, zlib.error):
        return [blank | {"got_status": "Corrupt"}]
    return [blank | {"size": len(body), "crc": f"{zlib.crc32(body):08x}", "got_status": "Got"} | {k: hashlib.new(k, body).hexdigest() for k in ("md5", "sha1", "sha256")}]


def scan_archives(spark: SparkSession, path: str, deep: bool = False) -> DataFrame:
    """Members of all zip and gzip archives below ``path``; 7z archives need a library that may be absent and are listed by ``scan`` only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{zip,ZIP,gz}").load(path).select("path", "content")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                rows = gzip_member(p, bytes(c)) if p.lower().endswith(".gz") else zip_members(p, bytes(c), deep)
                yield pd.DataFrame(rows, columns=_MEMBER)

    return files.mapInPandas(members, MEMBER_SCHEMA)
