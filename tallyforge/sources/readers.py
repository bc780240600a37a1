"""Catalog files into flat catalog nodes: format by first line, one file per task record.

Listing and distribution are those of Spark's binaryFile source. A file is one task's, as nesting has no line structure,
but it goes through the task by blocks: a reader is a generator of events, and no more is held than the set that is being
read (all sets only where rows of a set may lie anywhere, in the ``¬`` format). What can fail is gone through once before
the first node is given, so an unreadable file yields one row with ``error`` set.
"""

from __future__ import annotations

import codecs
import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from operator import itemgetter
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HASH_WIDTH = {"crc": 8, "sha1": 40, "md5": 32, "sha256": 64}
GAME_TEXT = ["id", "romof", "cloneof", "cloneofid", "sampleof", "sourcefile", "isbios", "isdevice", "board", "runnable"]
EMU_TEXT = ["titleid", "publisher", "developer", "year", "genre", "subgenre", "ratings", "score", "players", "enabled", "crc", "source", "cloneof", "relatedto"]
SCHEMA = "source string, format string, header map<string,string>, node_id int, parent_id int, depth int, ord int, kind string, name string, path array<string>, size decimal(20,0), crc string, sha1 string, md5 string, sha256 string, merge string, status string, region string, mia string, is_disk boolean, fields map<string,string>, category array<string>, device_ref array<string>, error string"
COLUMNS = [re.split(r" ", x)[0] for x in re.split(r", (?=\w+ \w)", SCHEMA)]
#: Bytes of a file read at once, rows handed over at once, and characters that tell a format at most.
BLOCK, ROWS, TELLING = 1 << 20, 10_000, 1 << 20
#: Events of readers: the header, a node with all it holds, a directory whose nodes follow, and its end.
HEADER, NODE, OPEN, CLOSE = range(4)
Events = Iterator[tuple[int, object]]
Opener = Callable[[], BinaryIO]


_HEX = re.compile(r"[0-9a-f]+").fullmatch


def clean_hash(value: str | None, kind: str) -> str | None:
    """Lower-case hex padded to its width; blank, odd or non-hex text is null."""
    if not value:
        return None
    v = value.strip().lower().removeprefix("0x")
    if not v or v == "-":
        return None
    v = v.rjust(HASH_WIDTH[kind], "0")
    return v if _HEX(v) and len(v) % 2 == 0 else None


def parse_size(value: str | None) -> int | None:
    """Decimal, or hexadecimal after ``0x``, below 2^64; else null."""
    v = (value or "").strip().lower()
    try:
        n = int(v, 16) if v.startswith("0x") else int(v) if v.isdigit() else None
    except ValueError:
        return None
    return n if n is not None and n < 1 << 64 else None


class Node:
    """A node while it is being read."""

    def __init__(self, kind: str, name: str, **more):
        self.kind, self.name, self.more, self.children = kind, name, more, []

    def add(self, child: Node) -> Node:
        self.children.append(child)
        return child


def file_node(get, disk: bool = False, name: str | None = None) -> Node:
    """A rom or disk from a getter of attributes."""
    n = name if name is not None else (get("name") or "")
    if disk:
        n = re.sub(r"(?i)\.chd$", "", n.strip())
    merge = get("merge")
    return Node("file", n, size=None if disk else parse_size(get("size")), crc=clean_hash(get("crc"), "crc"), sha1=clean_hash(get("sha1"), "sha1"), md5=clean_hash(get("md5"), "md5"), sha256=clean_hash(get("sha256"), "sha256"), merge=re.sub(r"(?i)\.chd$", "", merge.strip()) if disk and merge else merge, status=(get("status") or "").lower() or None, region=get("region"), mia=get("mia"), is_disk=disk)


def texts_of(opened: Opener) -> Iterator[str]:
    """The text of a file by blocks; what is no UTF-8 is replaced."""
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    with opened() as f:
        while block := f.read(BLOCK):
            yield decode(block)
    yield decode(b"", True)


def lines_of(texts: Iterable[str]) -> Iterator[str]:
    """Lines, with their ends, as ``splitlines`` parts them."""
    rest = ""
    for t in texts:
        lines = (rest + t).splitlines(True)
        rest = lines.pop() if lines else ""  # it may go on, as may a line end of two characters
        yield from lines
    if rest:
        yield rest


def beginning(texts: Iterable[str]) -> str:
    """So much of a text that its first line that isn't blank is whole, or ``TELLING`` characters of it."""
    text = ""
    for t in texts:
        text += t
        if len(body := text.lstrip()) > TELLING or len(body.splitlines()) > 1:
            break
    return text


def sniff(text: str) -> str:
    """The format by the first line that isn't blank: xml, cmp, dos, romcenter, or unknown."""
    first = next((x.strip().lower() for x in text.splitlines() if x.strip()), "").lstrip("﻿")
    if re.match(r"<\?xml|<!doctype|<datafile|<softwarelist|<mame|<!--", first):
        return "xml"
    if first.startswith("doscenter"):
        return "dos"
    if re.match(r"[a-z]+\s*\($", first) or re.match(r"[a-z]+\s*\(\s", first) or re.match(r"(?:game|machine)\b", first):
        return "cmp"
    return "romcenter" if first.startswith("[credits]") else "unknown"


_DOCTYPE = r"<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>"
_PROLOG = re.compile(rf"\ufeff*(?:\s+|<\?.*?\?>|<!--.*?-->|{_DOCTYPE})*", re.S)


def _xml_texts(opened: Opener) -> Iterator[str]:
    """XML by blocks, without document type and declaration: what comes before the root element is taken together."""
    texts, head = texts_of(opened), ""
    for t in texts:
        head += t
        rest = head[_PROLOG.match(head).end() :]
        if rest[:1] not in ("", "<") or len(rest) > 1 and rest[1] not in "!?":
            break
    yield re.sub(r"^\s*<\?xml[^>]*\?>", "", re.sub(_DOCTYPE, "", head.lstrip("\ufeff"), count=1, flags=re.S))
    yield from texts


class _Root:
    """A parser's target that keeps the root's tag and attributes and its first header only."""

    def __init__(self):
        self.depth, self.tag, self.attributes, self.header, self.builder = 0, "", {}, None, None

    def start(self, tag: str, attributes: dict) -> None:
        if not self.depth:
            self.tag, self.attributes = tag, attributes
        elif self.depth == 1 and tag == "header" and self.header is None:
            self.builder = ET.TreeBuilder()
        if self.builder:
            self.builder.start(tag, attributes)
        self.depth += 1

    def data(self, text: str) -> None:
        if self.builder:
            self.builder.data(text)

    def end(self, tag: str) -> None:
        self.depth -= 1
        if self.builder:
            self.builder.end(tag)
            if self.depth == 1:
                self.header, self.builder = self.builder.close(), None

    def close(self) -> _Root:
        return self


def read_xml(opened: Opener) -> Events:
    """A catalog or a software list, read twice: for errors and the header, then for the nodes. The document type is dropped; names come as written."""
    parser = ET.XMLParser(target=_Root())
    for t in _xml_texts(opened):
        parser.feed(t)
    root = parser.close()
    if listed := root.tag == "softwarelist":
        yield HEADER, ("softwarelist", {k: v for k, v in (("name", root.attributes.get("name")), ("description", root.attributes.get("description"))) if v})
    else:
        if root.header is None:
            raise ValueError("a catalog needs a header")
        # text elements are fields; elements with attributes hold packing and merging settings of some program
        fields = {c.tag: (c.text or "").strip() for c in root.header if not c.attrib}
        for c in root.header:
            fields |= dict(c.attrib)
        yield HEADER, ("xml", fields)
    pull, stack, holders = ET.XMLPullParser(("start", "end")), [], 0  # elements that are open; the first so many are the root and directories
    for t in chain(_xml_texts(opened), [None]):
        pull.close() if t is None else pull.feed(t)
        for what, e in pull.read_events():
            if what == "start":
                if len(stack) == holders and (not stack or e.tag == "dir" and not listed):
                    holders += 1
                    if stack:
                        yield OPEN, Node("dir", e.get("name") or "")
                stack.append(e)
                continue
            stack.pop()
            if len(stack) > holders:
                continue
            if len(stack) < holders:
                holders -= 1
                if stack:
                    yield CLOSE, None
            else:
                top = Node("dir", "")
                (_software if listed else _xml_children)([e], top)
                for node in top.children:
                    yield NODE, node
            if stack:
                stack[-1].remove(e)


def _xml_children(elements: Iterable[ET.Element], into: Node) -> None:
    for c in elements:
        if c.tag == "dir":
            _xml_children(c, into.add(Node("dir", c.get("name") or "")))
        elif c.tag in ("game", "machine"):
            fields = {k: c.get(k) for k in GAME_TEXT if c.get(k)} | {k: t for k in ("description", "year", "manufacturer") if (t := (c.findtext(k) or "").strip())}
            if (emu := c.find("EmuArc")) is None:
                emu = c.find("trurip")
            if emu is not None:
                fields |= {"emuarc": "yes"} | {k: t for k in EMU_TEXT if (t := (emu.findtext(k) or "").strip())}
            g = into.add(Node("game", c.get("name") or "", fields=fields, category=[t for x in c.findall("category") if (t := (x.text or "").strip())], device_ref=[x.get("name") for x in c.findall("device_ref") if x.get("name")]))
            _xml_children(c, g)
        elif c.tag in ("rom", "disk") and c.get("name"):
            into.add(file_node(c.get, c.tag == "disk"))


def _software(elements: Iterable[ET.Element], into: Node) -> None:
    """Nameless parts with loadflag continue or ignore add their size to the rom before them in the same part; software without files is dropped."""
    for s in elements:
        if s.tag != "software":
            continue
        fields = {k: s.get(k) for k in GAME_TEXT if s.get(k)} | {k: t for k in ("description", "year", "publisher") if (t := (s.findtext(k) or "").strip())}
        g = Node("game", s.get("name") or "", fields=fields)
        for part in s.findall("part"):
            last = None
            for area in part:
                if area.tag == "dataarea":
                    for rom in area.findall("rom"):
                        if rom.get("name"):
                            last = g.add(file_node(rom.get))
                        elif last is not None and rom.get("loadflag") in ("continue", "ignore") and (more := parse_size(rom.get("size"))):
                            last.more["size"] = (last.more["size"] or 0) + more
                elif area.tag == "diskarea":
                    for disk in area.findall("disk"):
                        g.add(file_node(disk.get, True))
        if g.children:
            into.add(g)


_TOKEN = re.compile(r'//[^\n]*|"([^"\n]*)"?|([()])|([^\s()"]+)')


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(token, whether it was quoted) of a text catalog; comments and empty quotes yield none."""
    for m in _TOKEN.finditer(text):
        if m[1]:
            yield m[1], True
        elif m[2] or m[3]:
            yield m[2] or m[3], False


def _stream(texts: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """Tokens by blocks of whole lines: no token goes on in the next line."""
    rest = ""
    for t in texts:
        whole, end, rest = (rest + t).rpartition("\n")
        yield from tokens(whole + end)
    yield from tokens(rest)


def _pairs(stream: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, str | None]]:
    """Pairs of a block up to its closing bracket; null stands for a block, which the caller takes from the stream."""
    for key, _ in stream:
        if key == ")":
            return
        value = next(stream, (")", False))
        if value == (")", False):
            return
        yield key.lower(), None if value == ("(", False) else value[0]


def _block(stream: Iterator[tuple[str, bool]]) -> list[tuple[str, object]]:
    """All pairs of a block; a value is text or a block."""
    return [(k, _block(stream) if v is None else v) for k, v in _pairs(stream)]


_SETS = ("game", "machine", "resource")


def read_cmp(opened: Opener) -> Events:
    """Blocks of key, value pairs; blocks it doesn't know are skipped whole."""
    stream, header, begun = _stream(texts_of(opened)), {}, False
    for word, _ in stream:
        kind = word.lower()
        if next(stream, ("", False)) != ("(", False):
            continue
        if kind == "dir" or kind in _SETS:
            if not begun:
                yield HEADER, ("cmp", header)
            begun = True
            if kind == "dir":
                yield from _cmp_dir(stream)
            else:
                yield NODE, _cmp_game(_block(stream))
            continue
        block = _block(stream)
        if not header and not begun:  # the first block of a program's own name is the header
            header = {k: v for k, v in block if isinstance(v, str)}
    if not begun:
        yield HEADER, ("cmp", header)


def _cmp_dir(stream: Iterator[tuple[str, bool]]) -> Events:
    """A directory; what comes before its name waits for it."""
    name, early = None, []

    def opening(name: str) -> Events:
        yield OPEN, Node("dir", name)
        top = Node("dir", "")
        _cmp_children(early, top)
        for node in top.children:
            yield NODE, node

    for k, v in _pairs(stream):
        if v is not None:
            if k == "name" and name is None:
                name = v
                yield from opening(name)
        elif name is None:
            early.append((k, _block(stream)))
        elif k == "dir":
            yield from _cmp_dir(stream)
        else:
            block = _block(stream)
            if k in _SETS:
                yield NODE, _cmp_game(block)
    if name is None:
        yield from opening("")
    yield CLOSE, None


def _first(block: list, key: str) -> str:
    return next((v for k, v in block if k == key and isinstance(v, str)), "")


def _cmp_children(block: list, into: Node) -> None:
    for k, v in block:
        if isinstance(v, list):
            if k == "dir":
                _cmp_children(v, into.add(Node("dir", _first(v, "name"))))
            elif k in _SETS:
                into.add(_cmp_game(v))


def _cmp_game(block: list) -> Node:
    text = {k: v for k, v in reversed(block) if isinstance(v, str)}
    g = Node("game", text.pop("name", ""), fields={k: v for k, v in text.items() if k not in ("rom", "disk")}, category=[v for k, v in block if k == "category" and isinstance(v, str)])
    for k, v in block:
        if isinstance(v, list) and k in ("rom", "disk"):
            d = {a: b for a, b in reversed(v) if isinstance(b, str)}
            if d.get("name"):
                g.add(file_node(d.get, k == "disk"))
    return g


_DOS_BLOCK = re.compile(r"(?i)(doscenter|game)\s*\($")


def _dos_header(lines: Iterable[str]) -> dict[str, str]:
    header, inside = {"forcepacking": "tdc"}, False
    for raw in lines:
        line = raw.strip()
        if line.endswith("(") and (m := _DOS_BLOCK.match(line)):
            inside = m[1].lower() == "doscenter"
        elif line == ")":
            inside = False
        elif inside and (m := re.match(r"([A-Za-z]+)\s*:?\s+(.*)$", line)):
            header[m[1].lower()] = m[2].strip().strip('"')
    return header


def read_dos(opened: Opener) -> Events:
    """Line blocks, read twice: for the header, which may stand anywhere, then for the nodes; file names may hold blanks and run up to ``size``; ``.zip`` goes from set names."""
    yield HEADER, ("dos", _dos_header(lines_of(texts_of(opened))))
    game, inside = None, False
    for raw in lines_of(texts_of(opened)):
        line = raw.strip()
        if line.endswith("(") and (m := _DOS_BLOCK.match(line)):
            if game:
                yield NODE, game
            inside = m[1].lower() == "game"
            game = Node("game", "", fields={}) if inside else None
        elif line == ")":
            inside = False
        elif inside and (m := re.match(r'(?i)name\s+"?(.*?)"?$', line)):
            game.name = re.sub(r"(?i)\.zip$", "", m[1])
        elif inside and (m := re.match(r"(?i)(?:file|rom)\s*\(\s*name\s+(.*?)\s+size\s+(\S+)(.*)\)\s*$", line)):
            rest = dict(re.findall(r"(\w+)\s+(\S+)", re.sub(r"(?i)date\s+\S+\s+\S+", "", m[3])))
            game.add(file_node({**{k.lower(): v for k, v in rest.items()}, "size": m[2]}.get, name=m[1].strip('"')))
    if game:
        yield NODE, game


# --- fixed values: sections, and the fields of each that become the header's ---
ROMCENTER = {
    "credits": {"author": "author", "email": "email", "homepage": "url", "url": "url", "version": "version", "date": "date", "comment": "comment"},
    "dat": {"split": "split", "merge": "merge"},
    "emulator": {"refname": "name", "version": "description", "category": "category"},
}


def read_romcenter(opened: Opener) -> Events:
    """Sections of an INI file; rows of games, resources and disks are parted by ``¬`` (or what an ill-decoded one becomes) and grouped by game name; parent is null if it is the game itself. An unknown section is an error."""
    header, top, games, section = {}, Node("dir", ""), {}, ""
    for line in lines_of(texts_of(opened)):
        s = line.strip()
        if s.startswith("["):
            section = s[1:].rstrip("]").lower()
            if section not in ROMCENTER and section not in ("games", "resources", "disks"):
                raise ValueError(f"unknown section [{section}]")
        elif section in ROMCENTER:
            k, sep, v = s.partition("=")
            if sep and (name := ROMCENTER[section].get(k.strip().lower())):
                header[name] = v.strip()
        elif section:
            p = re.split("[¬\ufffd]", s)
            if len(p) < 10:
                continue
            parent, game, description, rom, check, size, rom_of, merge = p[1], p[3], p[4], p[5], p[6], p[7], p[8], p[9]
            if game not in games:
                fields = {"description": description} | ({"cloneof": parent} if parent and parent != game else {}) | ({"romof": rom_of} if rom_of and rom_of != game and section != "disks" else {})
                games[game] = top.add(Node("game", game, fields={k: v for k, v in fields.items() if v}))
            disk = section == "disks"
            games[game].add(file_node({"name": rom, "sha1" if disk else "crc": check, "size": size, "merge": merge or None}.get, disk))
    yield HEADER, ("romcenter", header)
    for node in top.children:
        yield NODE, node


def events_of(opened: Opener) -> Events:
    """Any format; what can't be told is tried as XML, then as text blocks. Errors come before the first event."""
    readers = {"xml": [read_xml], "cmp": [read_cmp], "dos": [read_dos], "romcenter": [read_romcenter]}.get(sniff(beginning(texts_of(opened))), [read_xml, read_cmp])
    for reader in readers[:-1]:
        events = reader(opened)
        try:
            first = next(events)
        except (ET.ParseError, ValueError):
            continue
        return chain([first], events)
    events = readers[-1](opened)
    return chain([next(events)], events)


def node_rows(source: str, opened: Opener) -> Iterator[dict]:
    """All nodes of one file in order of reading, the root's children at depth 1; a file without nodes has one row of its header."""
    blank = dict.fromkeys(COLUMNS) | {"source": source}
    try:
        events = events_of(opened)
    except (ET.ParseError, ValueError) as e:
        yield blank | {"error": str(e)[:200], "kind": "error"}
        return
    above, n = [[0, 0, []]], 0  # ids, children so far and paths of open directories

    def row(node: Node, node_id: int, parent: list, depth: int) -> dict:
        parent[1] += 1
        return {**blank, "node_id": node_id, "parent_id": parent[0], "depth": depth, "ord": parent[1] - 1, "kind": node.kind, "name": node.name, "path": parent[2], **node.more}

    def rows(node: Node, parent: list, depth: int) -> Iterator[dict]:
        nonlocal n
        n += 1
        own = [n, 0, [*parent[2], node.name] if node.children else None]
        yield row(node, n, parent, depth)
        for child in node.children:
            if child.children:
                yield from rows(child, own, depth + 1)
            else:
                n += 1
                yield row(child, n, own, depth + 1)

    for what, x in events:
        if what == HEADER:
            blank["format"], blank["header"] = x
        elif what == CLOSE:
            above.pop()
        else:
            yield from rows(x, above[-1], len(above))
            if what == OPEN:
                above.append([n, 0, [*above[-1][2], x.name]])
    if not n:
        yield blank | {"kind": "empty"}


def rows_of(source: str, content: bytes) -> list[dict]:
    """The nodes of one file that is held, those of one parent together and parents from the last on; ids follow."""
    rows, of = list(node_rows(source, lambda: io.BytesIO(content))), {}
    if rows[0]["node_id"] is None:
        return rows
    for r in rows:
        of.setdefault(r["parent_id"], []).append(r)
    out, todo = [], [(0, 0)]
    while todo:
        at, node_id = todo.pop()
        for r in of[at]:
            out.append(r | {"node_id": len(out) + 1, "parent_id": node_id})
            if r["node_id"] in of:
                todo.append((r["node_id"], len(out)))
    return out


def read_catalogs(spark: SparkSession, path: str, glob: str = "*.{dat,xml,datz,txt}") -> DataFrame:
    """Catalog nodes of all files below ``path``; ``virtual_dir`` is the folder of a file relative to it. Files of other names are pruned by the listing. Files of a mounted file system are opened by the tasks, of others the content comes from Spark."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    mounted = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", *([] if mounted else ["content"]))
    layout = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, p in enumerate(b.column("path").to_pylist()):
                rows = node_rows(p, (lambda p=p: open(p.removeprefix("file:"), "rb")) if mounted else lambda b=b, i=i: io.BytesIO(b.column("content")[i].as_py()))
                while held := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([_column(values, f.type) for values, f in zip(zip(*map(itemgetter(*COLUMNS), held), strict=True), layout, strict=True)], schema=layout)

    nodes = files.mapInArrow(parse, SCHEMA)
    inner = F.regexp_replace("source", r"^(?:file:)?/*", "/")
    base = path.rstrip("/")
    return nodes.withColumn("virtual_dir", F.regexp_replace(F.substring(inner, len(base) + 2, 1 << 20), r"/?[^/]*$", ""))


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Maps as pairs; one that all rows share, as the header, is converted once."""
    if not pa.types.is_map(kind):
        return pa.array(values, kind)
    if values and all(v is values[0] for v in values):
        return pa.array([None if v is None else list(v.items()) for v in values[:1]], kind).take(pa.array([0] * len(values), pa.int32()))
    return pa.array([None if v is None else list(v.items()) for v in values], kind)
