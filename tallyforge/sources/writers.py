"""Catalog nodes into files: XML in three dialects, JSON, and plain blocks; and the inventory itself as a catalog.

Lines are expressions over rows; only the lines of one catalog are brought together, ordered by their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import shuffled

def escape(c: Column) -> Column:
    """Markup and control characters as references; a text without any, as most are, is looked through once."""
    out = c
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(c.rlike("[&\"'<>\t\n\r]"), out).otherwise(c)


def attributes(pairs: list[tuple[str, Column]]) -> Column:
    """`` name="value"`` for each value that isn't null or blank, in the given order."""
    return F.concat(*[F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f' {k}="'), escape(v.cast("string")), F.lit('"'))).otherwise("") for k, v in pairs])


def file_line(mame: bool = False) -> Column:
    """A rom or disk element; a good status is left out."""
    disk = F.coalesce("is_disk", F.lit(False))
    status = F.when(F.lower("status") != "good", F.col("status"))
    rom = attributes([("name", F.col("name")), *([("merge", F.col("merge"))] if mame else []), ("size", F.col("size")), ("crc", F.col("crc")), ("sha1", F.col("sha1")), ("md5", F.col("md5")), ("sha256", F.col("sha256")), *([] if mame else [("merge", F.col("merge"))]), ("status", status), ("region", F.col("region")), ("mia", F.col("mia"))])
    dsk = attributes([("name", F.col("name")), ("sha1", F.col("sha1")), ("md5", F.col("md5")), ("merge", F.col("merge")), ("status", status)])
    return F.when(disk, F.concat(F.lit("<disk"), dsk, F.lit("/>"))).otherwise(F.concat(F.lit("<rom"), rom, F.lit("/>")))


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _elements(pad: Column, pairs: list[tuple[str, Column]]) -> Column:
    """A line for each element that has text, each led by a line end."""
    return F.concat(*[F.coalesce(F.concat(F.lit("\n"), pad, F.lit(f"<{k}>"), escape(_filled(v)), F.lit(f"</{k}>")), F.lit("")) for k, v in pairs])


def _game_open(tag: str) -> Column:
    """A set's opening: attributes, categories, description, and the block of its own that some sets have."""
    f = lambda k: F.element_at("fields", k)
    emu = F.coalesce(f("emuarc") == "yes", F.lit(False))
    bare = lambda k: (k, F.when(~emu, _filled(f(k))))
    unless = lambda k, word: (k, F.when(F.lower(f(k)) != word, _filled(f(k))))
    head = attributes([("name", F.col("name")), *[bare(k) for k in ("id", "cloneof", "cloneofid", "romof")], unless("isbios", "no"), unless("isdevice", "no"), unless("runnable", "yes")])
    pad = F.repeat(F.lit("\t"), F.col("depth") + 1)
    categories = F.array_join(F.transform(F.filter(F.coalesce("category", F.array().cast("array<string>")), lambda c: F.trim(c) != ""), lambda c: F.concat(F.lit("\n"), pad, F.lit("<category>"), escape(F.trim(c)), F.lit("</category>"))), "")
    block = F.concat(F.lit("\n"), pad, F.lit("<trurip>"), _elements(F.concat(pad, F.lit("\t")), [(k, f(k)) for k in ("titleid", "source", "publisher", "developer", "year", "genre", "subgenre", "ratings", "score", "players", "enabled", "crc", "cloneof", "relatedto")]), F.lit("\n"), pad, F.lit("</trurip>"))
    return F.concat(F.lit(f"<{tag}"), head, F.lit(">"), categories, _elements(pad, [("description", f("description"))]), F.when(emu, block).otherwise(_elements(pad, [(k, f(k)) for k in ("year", "manufacturer")])))


# --- fixed values: the header's elements in order ---
HEADER_FIELDS = ["id", "name", "type", "rootdir", "description", "category", "version", "date", "author", "email", "homepage", "url", "comment"]
# --- fixed values: what the machine dialect's document type declares: content, then attributes ---
MACHINE_TYPES = {
    "mame": ("(machine+)", ["build CDATA #IMPLIED"]),
    "machine": ("(description, year?, manufacturer?, rom*, disk*, device_ref*)", ["name CDATA #REQUIRED", "isbios (yes|no) \"no\"", "isdevice (yes|no) \"no\"", "runnable (yes|no) \"yes\"", "cloneof CDATA #IMPLIED", "romof CDATA #IMPLIED"]),
    "description": ("(#PCDATA)", []), "year": ("(#PCDATA)", []), "manufacturer": ("(#PCDATA)", []),
    "rom": ("EMPTY", ["name CDATA #REQUIRED", "size CDATA #REQUIRED", "crc CDATA #IMPLIED", "sha1 CDATA #IMPLIED", "merge CDATA #IMPLIED", "status (baddump|nodump|good) \"good\""]),
    "disk": ("EMPTY", ["name CDATA #REQUIRED", "sha1 CDATA #IMPLIED", "merge CDATA #IMPLIED", "status (baddump|nodump|good) \"good\""]),
    "device_ref": ("EMPTY", ["name CDATA #REQUIRED"]),
}


def xml_lines(nodes: DataFrame, dialect: str = "plain", headers: DataFrame | None = None) -> DataFrame:
    """(source, place, line): ``plain`` has game elements, ``sets`` the typed root with set elements, both a header; ``mame`` has machine elements under a root that names the build, and no header. Rows come from read_catalogs or have its columns. ``headers``: fewer nodes, if it is known that each catalog is among them."""
    tag = {"plain": "game", "mame": "machine", "sets": "set"}[dialect]
    # fixed values: root elements
    root = {"plain": "datafile", "mame": "mame", "sets": "RVDatFile"}[dialect]
    keyed = _keyed(nodes)
    indent = F.repeat(F.lit("\t"), F.col("depth"))
    games = keyed.filter("kind = 'game'").select("source", F.col("key").alias("place"), F.concat(indent, _game_open(tag)).alias("line"))
    devices = F.array_join(F.transform(F.filter(F.coalesce("device_ref", F.array().cast("array<string>")), lambda c: F.trim(c) != ""), lambda c: F.concat(indent, F.lit('\t<device_ref name="'), escape(F.trim(c)), F.lit('"/>\n'))), "")
    ends = keyed.filter("kind in ('game', 'dir')").select("source", F.concat("key", F.lit("/~")).alias("place"), F.when(F.col("kind") == "game", F.concat(devices, indent, F.lit(f"</{tag}>"))).otherwise(F.concat(indent, F.lit("</dir>"))).alias("line"))
    dirs = keyed.filter("kind = 'dir'").select("source", F.col("key").alias("place"), F.concat(indent, F.lit("<dir"), attributes([("name", F.col("name"))]), F.lit(">")).alias("line"))
    files = keyed.filter("kind = 'file'").select("source", F.col("key").alias("place"), F.concat(indent, file_line(dialect == "mame")).alias("line"))
    head = _headers(_nodes(nodes if headers is None else headers))
    h = lambda k: F.element_at("h", k)
    if dialect == "mame":
        types = "".join(f"\n<!ELEMENT {e} {content}>" + "".join(f"\n\t<!ATTLIST {e} {x}>" for x in more) for e, (content, more) in MACHINE_TYPES.items())
        body = F.concat(F.lit(f'<?xml version="1.0"?>\n<!DOCTYPE mame [{types}\n]>\n'), F.lit('<mame build="'), escape(F.coalesce(h("name"), F.lit(""))), F.lit('">'))
    else:
        own = attributes([("header", _filled(h("header"))), ("forcepacking", _filled(h("forcepacking")))])
        body = F.concat(F.lit(f'<?xml version="1.0"?>\n<{root}>\n\t<header>'), _elements(F.lit("\t\t"), [(k, h(k)) for k in HEADER_FIELDS]), F.lit("\n\t\t<romvault"), own, F.lit("/>\n\t</header>"))
    opening = head.select("source", F.lit("").alias("place"), body.alias("line"))
    closing = head.select("source", F.lit("~").alias("place"), F.lit(f"</{root}>").alias("line"))
    return opening.unionByName(games).unionByName(dirs).unionByName(files).unionByName(ends).unionByName(closing)


def _headers(nodes: DataFrame) -> DataFrame:
    """The header of each catalog, once."""
    return nodes.groupBy("source").agg(F.first("header", ignorenulls=True).alias("h")).withColumn("h", F.coalesce("h", F.create_map().cast("map<string,string>")))


def _nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind in ('dir', 'game', 'file')")


def _keyed(nodes: DataFrame) -> DataFrame:
    """Adds a sort key that puts a node after its parent's opening and before its end: ids are given in order of reading, so the key is the chain of zero-padded ids.

    A node states its parent's id, so two levels need no join; of deeper nodes only directories and sets are looked up.
    """
    n = _nodes(nodes)
    padded = lambda c: F.format_string("%010d", F.col(c))
    above = n.filter("kind <> 'file'").select("source", F.col("node_id").alias("_up"), F.col("parent_id").alias("_pp"))
    stated = n.withColumn("key", F.concat_ws("/", F.when(F.col("parent_id") != 0, padded("parent_id")), padded("node_id")))
    deepest = n.filter("depth > 2").agg(F.max("depth")).first()[0] or 2
    if deepest == 2:
        return stated
    out = stated.filter("depth > 2").withColumn("_up", F.col("parent_id"))
    for _ in range(deepest - 2):  # as many steps as the deepest catalog has levels above a node's parent
        out = out.join(shuffled(above), ["source", "_up"], "left").withColumn("key", F.concat_ws("/", F.when(F.col("_pp") != 0, padded("_pp")), "key")).withColumn("_up", F.coalesce("_pp", F.lit(0))).drop("_pp")
    return stated.filter("depth <= 2").unionByName(out.drop("_up"))


# --- fixed values: types of sets by structure, and the header's fields in order ---
JSON_TYPES = {"ZipTrrnt": "trrntzip", "ZipZSTD": "rvzip", "ZipTDC": "rvzip", "SevenZipTrrnt": "7zip", "SevenZipSLZMA": "7zip", "SevenZipNLZMA": "7zip", "SevenZipSZSTD": "7zip", "SevenZipNZSTD": "7zip"}
JSON_HEADER = ["name", "rootdir", "header", "type", "description", "category", "version", "date", "author", "email", "homepage", "url", "comment", "forcepacking"]


def json_lines(nodes: DataFrame) -> DataFrame:
    """(source, place, line) of one JSON document for each catalog: ``Header``, and under ``root`` the sets and directories with their ``objects``. ``zip_struct``, if there, tells the type of a set and is inherited by none."""
    k = _keyed(nodes)
    k = k if "zip_struct" in k.columns else k.withColumn("zip_struct", F.lit(None).cast("string"))
    comma = F.when(F.col("ord") > 0, ",").otherwise("")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in JSON_TYPES.items() for x in p]), F.col("zip_struct")), F.lit("dir"))
    f = lambda n: F.element_at("fields", n)
    opened = lambda c: F.concat(comma, F.expr(f"left({c}, length({c}) - 1)"), F.lit(',"objects":['))
    emu = F.coalesce(f("emuarc") == "yes", F.lit(False))
    tea = F.when(emu, F.struct(*[f(n).alias(n) for n in ("titleid", "source", "publisher", "developer", "year", "genre", "subgenre", "ratings", "score", "players", "enabled", "crc", "cloneof", "relatedto")]))
    game = F.to_json(F.struct("name", kind.alias("type"), F.coalesce(f("description"), F.lit("")).alias("description"), tea.alias("tea"), *[F.when(~emu, f(n)).alias(n) for n in ("year", "manufacturer")]))
    games = k.filter("kind = 'game'").withColumn("_j", game).select("source", F.col("key").alias("place"), opened("_j").alias("line"))
    dirs = k.filter("kind = 'dir'").withColumn("_j", F.to_json(F.struct("name", F.lit("dir").alias("type")))).select("source", F.col("key").alias("place"), opened("_j").alias("line"))
    ends = k.filter("kind in ('game', 'dir')").select("source", F.concat("key", F.lit("/~")).alias("place"), F.lit("]}").alias("line"))
    parents = k.filter("kind = 'game'").select("source", F.col("node_id").alias("parent_id"), F.when(F.col("zip_struct") == "ZipTrrnt", "filetrrntzip").alias("_type"))
    entry = F.struct("name", F.col("_type").alias("type"), "size", F.coalesce("crc", F.lit("")).alias("crc"), F.coalesce("sha1", F.lit("")).alias("sha1"), "md5", F.when(F.lower("status") != "good", F.col("status")).alias("status"), F.when(F.col("mia") == "yes", "yes").alias("mia"), F.when(F.col("is_disk"), True).alias("is_disk"))
    files = k.filter("kind = 'file'").join(parents, ["source", "parent_id"], "left").select("source", F.col("key").alias("place"), F.concat(comma, F.to_json(entry)).alias("line"))
    head = _headers(_nodes(nodes))
    fields = F.to_json(F.struct(*[F.coalesce(F.element_at("h", n), F.lit("")).alias(n) for n in JSON_HEADER]))
    opening = head.select("source", F.lit("").alias("place"), F.concat(F.lit('{"Header":'), fields, F.lit(',"root":[')).alias("line"))
    return opening.unionByName(games).unionByName(dirs).unionByName(files).unionByName(ends).unionByName(head.select("source", F.lit("~").alias("place"), F.lit("]}").alias("line")))


def dos_lines(nodes: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(source, place, line) of plain blocks: the header, then each set, whose name gets ``.zip``, with its files and the hashes they have. ``headers``: as for xml_lines."""
    k = _keyed(nodes)
    head = _headers(_nodes(nodes if headers is None else headers))
    body = F.concat(F.lit("DOSCenter ("), *[F.coalesce(F.concat(F.lit(f"\n\t{n}: "), F.element_at("h", n)), F.lit("")) for n in ("name", "description", "version", "date", "author", "homepage", "comment")], F.lit("\n)"))
    games = k.filter("kind = 'game'")
    opening = games.select("source", F.col("key").alias("place"), F.concat(F.lit('\ngame (\n\tname "'), "name", F.lit('.zip"')).alias("line"))
    facts = [F.coalesce(F.concat(F.lit(f" {n} "), F.col(n).cast("string")), F.lit("")) for n in ("size", "crc", "sha1", "sha256", "md5")]
    files = k.filter("kind = 'file'").select("source", F.col("key").alias("place"), F.concat(F.lit("\tfile ( name "), "name", *facts, F.lit(" )")).alias("line"))
    ends = games.select("source", F.concat("key", F.lit("/~")).alias("place"), F.lit(")").alias("line"))
    return head.select("source", F.lit("").alias("place"), body.alias("line")).unionByName(opening).unionByName(files).unionByName(ends)


def write_lines(lines: DataFrame, path: str, whole: bool = False) -> None:
    """One folder per catalog, its lines in order. Sorting is by range, so no catalog is one task's memory and a large one is several files, to be read in order of their names; with ``whole`` each catalog is one file, sorted by one task outside its memory."""
    dealt = lines.repartition("source") if whole else lines.repartitionByRange("source", "place")
    dealt.sortWithinPartitions("source", "place").select("source", "line").write.partitionBy("source").mode("overwrite").text(path)


def inventory_catalog(members: DataFrame) -> DataFrame:
    """An inventory as catalog nodes: one game per archive or file, ready for the writers."""
    game = F.regexp_replace(F.regexp_extract("archive", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return members.filter("not is_dir").select(game.alias("game"), "name", "size", "crc", "sha1", "md5", "sha256")
