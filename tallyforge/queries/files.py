"""Queries of readers, writers and scans over files written from the test tables into the shared folder, and of row-wise operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import fixtures as fx
from tallyforge.functions import text as tx
from tallyforge.operators import report, rules, stats, transforms
from tallyforge.queries.reference import STATED, stated
from tallyforge.session import scratch, shuffled
from tallyforge.sources import inventory, readers, writers

Q: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name with its SQL."""

    def keep(f):
        Q[f.__name__] = (f, sql)
        return f

    return keep


#: Sets and members as catalogs, one for each brand; names need escapes here and there.
CATALOG = f"""{fx.SETS}, c AS (SELECT replace(brand, '#', '-') AS source, g.game, g.ord AS game_ord, clone_of, rom_of, description, r.ord, name || CASE WHEN r.ord % 9 = 0 THEN ' & <é>' ELSE '' END AS name, size, crc, sha1, md5, merge, status, mia, is_disk FROM games g JOIN roms r USING (game))"""


def catalogs(spark: SparkSession, d: str, escaped: bool = True) -> DataFrame:
    """The nodes of all catalogs, with the columns that readers give."""
    nul = F.lit(None).cast("string")
    g = fx.games(spark, d).select("game", F.col("ord").alias("g"), F.translate("brand", "#", "-").alias("source"), "clone_of", "rom_of", "description")
    m = fx.roms(spark, d).join(shuffled(g.select("game", "g", "source")), "game")
    held = fx.table(spark, d, "lineitem", ["l_partkey"]).distinct().select(F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("game"))
    used = g.join(shuffled(held), "game", "left_semi")
    first = used.groupBy("source").agg(F.min("g").alias("_first"))
    header = F.create_map(F.lit("name"), F.col("source"), F.lit("version"), F.lit("1"), F.lit("forcepacking"), F.lit("zip"))
    hashes = ["crc", "sha1", "md5", "sha256", "merge", "status", "region", "mia"]
    sets = used.join(first, "source", "left").select(
        "source", F.lit("xml").alias("format"), header.alias("header"), ((F.col("g") + 1) * 1000).cast("int").alias("node_id"), F.lit(0).alias("parent_id"), F.lit(1).alias("depth"), F.when(F.col("g") == F.col("_first"), 0).otherwise(1).alias("ord"), F.lit("game").alias("kind"), F.col("game").alias("name"), F.array().cast("array<string>").alias("path"),
        F.lit(None).cast("decimal(20,0)").alias("size"), *[nul.alias(h) for h in hashes], F.lit(None).cast("boolean").alias("is_disk"), F.create_map(F.lit("cloneof"), "clone_of", F.lit("romof"), "rom_of", F.lit("description"), "description").alias("fields"), F.array().cast("array<string>").alias("category"), F.array().cast("array<string>").alias("device_ref"),
    )
    name = F.when(F.lit(escaped) & (F.col("ord") % 9 == 0), F.concat("name", F.lit(" & <é>"))).otherwise(F.col("name"))
    files = m.select(
        "source", F.lit("xml").alias("format"), header.alias("header"), ((F.col("g") + 1) * 1000 + F.col("ord")).cast("int").alias("node_id"), ((F.col("g") + 1) * 1000).cast("int").alias("parent_id"), F.lit(2).alias("depth"), (F.col("ord") - 1).cast("int").alias("ord"), F.lit("file").alias("kind"), name.alias("name"), F.array("game").alias("path"),
        F.col("size").cast("decimal(20,0)").alias("size"), *[F.col(h) if h in m.columns else nul.alias(h) for h in hashes], "is_disk", F.create_map().cast("map<string,string>").alias("fields"), F.array().cast("array<string>").alias("category"), F.array().cast("array<string>").alias("device_ref"),
    )
    return sets.unionByName(files)


def _written(spark: SparkSession, lines: DataFrame) -> str:
    path = scratch(spark, "catalogs")
    writers.write_lines(lines, path, whole=True)
    return path


def _read_back(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """What the readers make of written lines; the catalog is told by the folder of its file."""
    nodes = readers.read_catalogs(spark, _written(spark, lines))
    return nodes.withColumn("source", F.regexp_extract("source", "source=([^/]+)", 1))


def _members(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'file'").withColumn("game", F.try_element_at("path", F.lit(-1))).withColumn("size", F.coalesce(F.col("size").cast("bigint"), F.lit(-1)))


@query(f"WITH {CATALOG} SELECT source, game, name, CASE WHEN is_disk THEN -1 ELSE coalesce(size, -1) END AS size, CASE WHEN NOT is_disk THEN crc END AS crc, sha1, md5, merge, status, CASE WHEN NOT is_disk THEN mia END AS mia, is_disk FROM c")
def xml_round_trip(spark, d):
    nodes = catalogs(spark, d)
    back = _members(_read_back(spark, writers.xml_lines(nodes, headers=nodes.filter("kind = 'game'"))))
    return back.select("source", "game", "name", "size", "crc", "sha1", "md5", "merge", "status", "mia", "is_disk")


@query(f"WITH {CATALOG} SELECT DISTINCT source, game AS name, clone_of, rom_of, description, source AS catalog, 'zip' AS packing FROM c")
def xml_sets(spark, d):
    nodes = catalogs(spark, d)
    back = _read_back(spark, writers.xml_lines(nodes, headers=nodes.filter("kind = 'game'"))).filter("kind = 'game'")
    f = lambda k: F.element_at("fields", k)
    return back.select("source", "name", f("cloneof").alias("clone_of"), f("romof").alias("rom_of"), f("description").alias("description"), F.element_at("header", "name").alias("catalog"), F.element_at("header", "forcepacking").alias("packing"))


@query(f"WITH {CATALOG} SELECT source, game, regexp_replace(name, ' & <é>$', '') AS name, coalesce(size, -1) AS size, crc, sha1, md5 FROM c WHERE size IS NOT NULL")
def dos_round_trip(spark, d):
    nodes = catalogs(spark, d, escaped=False).filter("kind <> 'file' or size is not null")
    return _members(_read_back(spark, writers.dos_lines(nodes, nodes.filter("kind = 'game'")))).select("source", "game", "name", "size", "crc", "sha1", "md5")


@query(f"WITH {CATALOG} SELECT source, game, name, coalesce(size, -1) AS size, coalesce(crc, '') AS crc, coalesce(sha1, '') AS sha1, md5, status, mia FROM c")
def json_documents(spark, d):
    texts = spark.read.text(_written(spark, writers.json_lines(catalogs(spark, d))), wholetext=True)
    schema = "Header struct<name:string>, root array<struct<name:string, type:string, objects:array<struct<name:string, size:bigint, crc:string, sha1:string, md5:string, status:string, mia:string>>>>"
    games = texts.select(F.from_json("value", schema).alias("j")).select(F.col("j.Header.name").alias("source"), F.explode("j.root").alias("g"))
    return games.select("source", F.col("g.name").alias("game"), F.explode("g.objects").alias("o")).select("source", "game", "o.name", F.coalesce("o.size", F.lit(-1)).alias("size"), "o.crc", "o.sha1", "o.md5", "o.status", "o.mia")


@query(f"WITH {CATALOG} SELECT source, 'cmp' AS format, game, name, sha1 FROM c WHERE NOT is_disk AND NOT contains(name, '&')")
def cmp_read(spark, d):
    m = _members(catalogs(spark, d)).filter("not is_disk and not contains(name, '&')")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    line = F.concat(F.lit("game ( name "), quoted("game"), F.lit(" rom ( name "), quoted("name"), F.coalesce(F.concat(F.lit(" sha1 "), F.col("sha1")), F.lit("")), F.lit(" ) )"))
    lines = m.select("source", F.format_string("1%010d", F.col("node_id")).alias("place"), line.alias("line"))
    head = m.select("source").distinct().select("source", F.lit("0").alias("place"), F.concat(F.lit('clrmamepro ( name "'), "source", F.lit('" )')).alias("line"))
    return _read_back(spark, head.unionByName(lines)).filter("kind = 'file'").select("source", "format", F.try_element_at("path", F.lit(-1)).alias("game"), "name", "sha1")


@query(f"WITH {CATALOG} SELECT source, game, name, lpad(lower(crc), 8, '0') AS crc, coalesce(size, -1) AS size FROM c WHERE crc IS NOT NULL AND NOT contains(name, '&')")
def romcenter_read(spark, d):
    m = _members(catalogs(spark, d)).filter("crc is not null and not contains(name, '&')")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    size = F.when(F.col("size") >= 0, F.col("size").cast("string")).otherwise("")
    line = F.concat_ws("¬", F.lit(""), F.lit(""), F.lit(""), text("game"), F.lit(""), text("name"), text("crc"), size, F.lit(""), F.lit(""), F.lit(""))
    lines = m.select("source", F.format_string("1%010d", F.col("node_id")).alias("place"), line.alias("line"))
    head = m.select("source").distinct().select("source", F.lit("0").alias("place"), F.lit("[CREDITS]\nauthor=x\n[GAMES]").alias("line"))
    return _members(_read_back(spark, head.unionByName(lines))).select("source", "game", "name", "crc", "size")


@query("SELECT source, CAST(count(*) AS BIGINT) AS lines, CAST(sum(strlen(coalesce(path, '')) + 1) AS BIGINT) AS bytes, 'File' AS file_type, TRUE AS hashed FROM documents GROUP BY source")
def scanned_folder(spark, d):
    """A folder of one file for each source, that lists its paths; its sizes and lines are known from the table, and its own hash from its lines."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("source", F.col("doc_id").alias("place"), F.coalesce("path", F.lit("")).alias("line"))
    path = _written(spark, docs.withColumn("place", F.format_string("%020d", "place")))
    of = F.regexp_extract("path", "source=([^/]+)", 1)
    scanned = inventory.scan(spark, path, level=2, glob="*.txt")
    lines = spark.read.text(path).groupBy("source").agg(F.count("*").alias("lines"))
    whole = spark.read.text(path, wholetext=True).select("source", F.sha1("value").alias("expected"))
    return scanned.withColumn("source", of).join(lines, "source").join(whole, "source").select("source", "lines", F.col("size").alias("bytes"), "file_type", (F.col("sha1") == F.col("expected")).alias("hashed"))


# --- row-wise operators ---
@query(f"WITH {fx.SETS} SELECT game, CASE WHEN ord % 3 = 0 THEN '¤' ELSE description END AS description FROM games")
def clear_description(spark, d):
    g = fx.games(spark, d).withColumn("description", F.when(F.col("ord") % 3 == 0, F.col("game")).otherwise(F.col("description")))
    return transforms.clear_description(g).select("game", "description")


@query(f"WITH {fx.SETS} SELECT game, ord, size, CAST(NULL AS VARCHAR) AS md5, crc FROM roms")
def strip_fields(spark, d):
    return transforms.strip_fields(fx.roms(spark, d), "md5", "sha256", "absent").select("game", "ord", "size", "md5", "crc")


_FIXED = 8600 * 65536 + 48128


def _dated(spark, d):
    fixed = F.when((F.col("ord") % 5 == 0) | (F.length("game") == 2), F.lit(_FIXED)).otherwise(F.col("ord")).cast("bigint")
    return fx.roms(spark, d).withColumn("date_modified", fixed).withColumn("zip_struct", F.when(F.col("ord") % 2 == 0, "ZipTDC").otherwise("ZipTrrnt"))


@query(f"WITH {fx.SETS} SELECT game, ord, CASE WHEN ord % 2 = 0 THEN CASE WHEN ord % 5 = 0 OR length(game) = 2 THEN {_FIXED} ELSE ord END END AS date_modified FROM roms")
def strip_dates(spark, d):
    return transforms.strip_dates(_dated(spark, d)).select("game", "ord", "date_modified")


@query(f"WITH {fx.SETS}, s AS (SELECT game, bool_and(ord % 5 = 0 OR length(game) = 2) AS fixed FROM roms GROUP BY game) SELECT game, ord, 'FileZip' AS file_type, CASE WHEN fixed THEN 'ZipTrrnt' ELSE 'ZipTDC' END AS zip_struct FROM roms JOIN s USING (game)")
def set_compression(spark, d):
    return transforms.set_compression(_dated(spark, d), "ZipTDC").select("game", "ord", "file_type", "zip_struct")


_TYPES = ["UnSet", "Dir", "Zip", "SevenZip", "File", "FileZip"]
_NAMED = f"names AS (SELECT doc_id, repeat(' ', CAST(doc_id % 3 AS INT)) || path || CASE doc_id % 4 WHEN 1 THEN '. ' WHEN 2 THEN '  ' WHEN 3 THEN '...' ELSE '' END AS name, [{', '.join(repr(t) for t in _TYPES)}][1 + doc_id % 6] AS kind FROM documents)"


@query(f"WITH {_NAMED} SELECT doc_id, CASE WHEN kind IN ('UnSet', 'File', 'Dir') THEN rtrim(ltrim(name, ' '), '. ') WHEN kind IN ('Zip', 'SevenZip') THEN trim(name, ' ') ELSE name END AS name FROM names")
def clean_names_full(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "path")
    tail = F.when(F.col("doc_id") % 4 == 1, ". ").when(F.col("doc_id") % 4 == 2, "  ").when(F.col("doc_id") % 4 == 3, "...").otherwise("")
    name = F.concat(F.repeat(F.lit(" "), (F.col("doc_id") % 3).cast("int")), "path", tail)
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.select("doc_id", transforms.clean_name_full(name, kind).alias("name"))


@query(f"WITH {_NAMED} SELECT doc_id, regexp_replace(rtrim(ltrim(name, ' '), '. '), '[:*?<>|\"/' || chr(92) || chr(92) || ']', '_', 'g') AS name FROM names")
def clean_file_names(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "path")
    tail = F.when(F.col("doc_id") % 4 == 1, ". ").when(F.col("doc_id") % 4 == 2, "  ").when(F.col("doc_id") % 4 == 3, "...").otherwise("")
    return t.select("doc_id", tx.clean_file_name(F.concat(F.repeat(F.lit(" "), (F.col("doc_id") % 3).cast("int")), "path", tail), "_").alias("name"))


@query(f"WITH {fx.SETS} SELECT game FROM games WHERE NOT (is_device IS NOT DISTINCT FROM 'yes' AND runnable IS NOT DISTINCT FROM 'no')")
def remove_devices(spark, d):
    return transforms.remove_devices(fx.games(spark, d)).select("game")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 <> 0")
def remove_loose_files(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("doc_id") % 3 == 0).alias("is_dir"), (F.col("doc_id") % 5 != 0).alias("in_game"))
    return transforms.remove_files_not_in_games(t).select("doc_id")


@query(f"WITH {fx.MEMBERS}, m AS (SELECT archive, name, coalesce(size, 0) AS size FROM members) SELECT DISTINCT archive, name FROM m a WHERE NOT (suffix(name, '/') AND size = 0 AND EXISTS (SELECT 1 FROM m b WHERE b.archive = a.archive AND b.name <> a.name AND starts_with(b.name, a.name)))")
def directory_markers(spark, d):
    m = fx.members(spark, d).select(F.col("archive").alias("game"), "name", "size")
    return transforms.remove_unneeded_markers(m).select(F.col("game").alias("archive"), "name").distinct()


@query(f"WITH {fx.SETS} SELECT game, ord, CASE WHEN is_disk THEN 'a/' || game ELSE 'a/b/' || game || '.zip' END AS place FROM roms")
def disks_moved_up(spark, d):
    m = fx.roms(spark, d).withColumn("path", F.array(F.lit("a"), F.lit("b"), F.concat("game", F.lit(".zip"))))
    return transforms.move_up_disks(m).select("game", "ord", F.array_join("path", "/").alias("place"))


_RULE_FILES = ["nes.xml", " NES0.xml", "A7800.xml", "lynx.xml", "other.xml", "fds.xml", ""]


@query(f"SELECT doc_id, ['NES', 'NES', 'A7800', 'LYNX', 'NOTHING', 'FDS', 'NOTHING'][1 + doc_id % {len(_RULE_FILES)}] AS header_type FROM documents")
def header_rules(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    return t.select("doc_id", rules.header_type(F.element_at(F.array(*map(F.lit, _RULE_FILES)), (F.col("doc_id") % len(_RULE_FILES) + 1).cast("int"))).alias("header_type"))


@query(f"WITH {fx.SETS} SELECT ord, CASE WHEN ord % 2 = 0 AND coalesce(description, '') <> '' THEN description WHEN ord % 3 = 0 AND coalesce(id, '') <> '' THEN id || ' - ' || game ELSE game END AS directory FROM games")
def catalog_directories(spark, d):
    g = fx.games(spark, d).withColumn("name", F.col("game")).withColumn("use_description", F.col("ord") % 2 == 0).withColumn("use_id", F.col("ord") % 3 == 0)
    return g.select("ord", rules.catalog_directory(g).alias("directory"))


@query(f"""WITH RECURSIVE p AS (SELECT DISTINCT replace(path, '/', chr(92)) AS path FROM documents), x AS (SELECT path, path AS k FROM p UNION SELECT path, regexp_replace(k, '\\\\[^\\\\]*$', '') FROM x WHERE contains(k, chr(92))), h AS (SELECT path, arg_max(v, length(k)) AS v FROM x JOIN (VALUES ('src', TRUE), ('src\\lib', FALSE), ('tests', TRUE)) r(k, v) USING (k) GROUP BY path) SELECT p.path, coalesce(v, FALSE) AS file_only FROM p LEFT JOIN h USING (path)""")
def file_only_rules(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.translate("path", "/", "\\").alias("path")).distinct()
    return rules.file_only(t, spark.createDataFrame([("src", True), ("src\\lib", False), ("tests", True)], "dir_key string, file_only boolean")).select("path", "file_only")


@query("""WITH RECURSIVE s AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS directory FROM documents WHERE contains(path, '/') AND doc_id % 4 IN (1, 2) UNION SELECT regexp_replace(directory, '/[^/]*$', '') FROM s WHERE contains(directory, '/')) SELECT directory FROM s""")
def selected_branches(spark, d):
    parts = F.split("path", "/")
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.slice(parts, 1, F.size(parts) - 1).alias("path"), F.when(F.col("doc_id") % 4 == 1, "Selected").when(F.col("doc_id") % 4 == 2, "Locked").otherwise("UnSelected").alias("tree_checked"))
    return rules.branches_with_selection(t)


_CLASSES = f"""WITH {STATED}, c AS (SELECT dat || '/' || game AS dat, CAST(count(*) FILTER (WHERE status IN ('Correct', 'CorrectMIA')) AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE status IN ('Missing', 'MissingMIA', 'Corrupt', 'Incomplete', 'UnScanned', 'Unknown')) AS BIGINT) AS missing,
 CAST(count(*) FILTER (WHERE status IN ('UnNeeded', 'NotCollected', 'InToSort', 'Deleted')) AS BIGINT) AS fixes FROM stated GROUP BY dat || '/' || game)"""


@query(f"{_CLASSES} SELECT * FROM (SELECT CASE WHEN correct > 0 AND missing = 0 AND fixes = 0 THEN 'complete' WHEN correct = 0 AND missing > 0 AND fixes = 0 THEN 'empty' WHEN (correct > 0 AND missing > 0) OR fixes > 0 THEN 'partial' END AS class, * FROM c) WHERE class IS NOT NULL")
def full_report(spark, d):
    return report.full_report(stats.classify_catalogs(stated(spark, d).withColumn("dat", F.concat_ws("/", "dat", "game")), "dat"))


@query(f"WITH {fx.MEMBERS} SELECT 'arc' || archive AS game, name, size, crc FROM members WHERE NOT is_dir")
def inventory_as_catalog(spark, d):
    nul = F.lit(None).cast("string")
    m = fx.members(spark, d).withColumn("archive", F.concat(F.lit("disk/arc"), "archive", F.lit(".zip"))).withColumns({"sha1": nul, "md5": nul, "sha256": nul})
    return writers.inventory_catalog(m).select("game", "name", "size", "crc")


@query("SELECT doc_id, row_number() OVER (PARTITION BY repo ORDER BY translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), path, doc_id) AS place FROM documents")
def directory_sorted(spark, d):
    from pyspark.sql import Window

    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "repo", "path")
    order = tx.directory_order(F.col("path"), F.lit("File"))
    return t.select("doc_id", F.row_number().over(Window.partitionBy("repo").orderBy(*order, "doc_id")).cast("bigint").alias("place"))


@query(f"""WITH {fx.SETS} SELECT game, ord, lower(trim(CASE ord % 3 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'TRUE' ELSE mia END)) IN ('yes', 'true') IS TRUE AS flag, name AS disk,
 CASE ord % 4 WHEN 0 THEN 255 WHEN 1 THEN 12 ELSE NULL END AS number, (ord | 4) AS added, ord & ~2 AS removed, (ord & 4) = 4 AS tested, format('{{:,}}', coalesce(size, 0) * 100) AS shown FROM roms""")
def scalar_functions(spark, d):
    m = fx.roms(spark, d)
    word = F.when(F.col("ord") % 3 == 0, " Yes ").when(F.col("ord") % 3 == 1, "TRUE").otherwise(F.col("mia"))
    disk = F.concat("name", F.when(F.col("is_disk") & (F.col("ord") % 2 == 0), ".CHD").otherwise(""))
    number = F.when(F.col("ord") % 4 == 0, "0xFF").when(F.col("ord") % 4 == 1, " 12 ").when(F.col("ord") % 4 == 2, "-").otherwise("1x")
    return m.select("game", "ord", tx.yes_no(word).alias("flag"), tx.clean_chd(disk).alias("disk"), tx.parse_u64(number).cast("bigint").alias("number"), tx.flag_set(F.col("ord"), 4).alias("added"), tx.flag_clear(F.col("ord"), 2).alias("removed"), tx.flag_test(F.col("ord"), 4).alias("tested"), tx.thousands(F.coalesce("size", F.lit(0)) * 100).alias("shown"))


def queries() -> dict:
    return {name: f for name, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.items() if sql}
