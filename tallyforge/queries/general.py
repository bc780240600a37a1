"""Queries of the general problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.nested import BODY, ELEMENT, GAME, catalog_nodes, linked_tables
from tallyforge.operators.snapshots import snapshot_changes
from tallyforge.operators.timestamps import ABBREVIATIONS, TICKS_EPOCH_S, TICKS_PER_S, disagreeing_stamps, entry_instants
from tallyforge.operators.wide import attribute_list, filled_cells, to_wide
from tallyforge.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Files added, removed or changed between consecutive snapshots of both snapshot tables."""
    common = ["root_id", "size", "crc", "delivered_at"]
    scanned = table(spark, d, "scanned_file").select(F.lit("scanned_file").alias("source_table"), "snapshot_no", "name", F.col("file_mod_time_stamp").alias("stamp"), *common)
    exported = table(spark, d, "rv_file").select(F.lit("rv_file").alias("source_table"), F.col("export_no").alias("snapshot_no"), F.col("file_name").alias("name"), F.col("file_mod_time_stamp").alias("stamp"), *common)
    return snapshot_changes(scanned.unionByName(exported))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose header stamp shares no instant with their modified_time or their DOS stamp."""
    headers = table(spark, d, "file_header", ["header_id", "archive_id", "entry_index", "header_last_modified", "modified_time"])
    return disagreeing_stamps(headers, table(spark, d, "archive_file", ["archive_id", "zone_name"]), table(spark, d, "central_entry", ["archive_id", "entry_index", "dos_date", "dos_time"]))


def p2_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every stamp of headers and entries as instants, in whole seconds from 1970; times that clocks showed twice have two."""
    headers = table(spark, d, "file_header", ["header_id", "archive_id", "header_last_modified", "modified_time"])
    found = entry_instants(headers, table(spark, d, "archive_file", ["archive_id", "zone_name"]), table(spark, d, "central_entry", ["entry_id", "archive_id", "dos_date", "dos_time"]))
    return found.select("source_table", "row_id", "stamp", F.expr(f"cast(floor(instant / {TICKS_PER_S}D) - {TICKS_EPOCH_S} as bigint)").alias("seconds")).distinct()


def p5_wide(spark: SparkSession, d: str, owner_kind: str) -> tuple[DataFrame, list]:
    """The wide table of one kind of owner, and its attributes."""
    name, entity = {"game": ("game_meta_data", "game_id"), "dat": ("dat_meta_data", "dat_id")}[owner_kind]
    attributes = attribute_list(spark, table(spark, d, "meta_attribute"), owner_kind)
    return to_wide(table(spark, d, name, [entity, "id", "value", "seq"]), entity, attributes), attributes


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Filled cells of both wide tables whose attribute isn't text."""
    games, dats = [filled_cells(wide, kind, attributes) for kind in ("game", "dat") for wide, attributes in [p5_wide(spark, d, kind)]]
    return games.unionByName(dats).distinct()


def p5_games(spark: SparkSession, d: str) -> DataFrame:
    """One row per game with a typed column per attribute."""
    return p5_wide(spark, d, "game")[0]


def p5_dats(spark: SparkSession, d: str) -> DataFrame:
    """One row per catalog with a typed column per attribute."""
    return p5_wide(spark, d, "dat")[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every node below the root of a catalog with its parent's path."""
    return catalog_nodes(table(spark, d, "dat_node", ["dat_id", "node", "loaded_at"]), [])


def _linked(name: str):
    def linked(spark: SparkSession, d: str) -> DataFrame:
        rows = linked_tables(catalog_nodes(table(spark, d, "dat_node", ["dat_id", "node", "loaded_at"])))[name]
        return rows.withColumns({c: F.array_join(c, "|") for c in ("category", "device_ref") if c in rows.columns})

    linked.__doc__ = f"The flat table of {name}, each row with its parent's path."
    return linked


p3_directories, p3_games, p3_files = (_linked(n) for n in ("directories", "games", "files"))


def queries() -> dict:
    """The general problems' queries by name."""
    return {"p2_found": p2_found, "p2_instants": p2_instants, "p3_found": p3_found, "p3_directories": p3_directories, "p3_games": p3_games, "p3_files": p3_files, "p4_found": p4_found, "p5_found": p5_found, "p5_games": p5_games, "p5_dats": p5_dats}


_SECONDS = """CASE WHEN {0} < 100000000000 THEN {0} WHEN {0} < 100000000000000 THEN {0} // 1000 WHEN {0} < 100000000000000000 THEN {0} // 1000000
 WHEN {0} < 250000000000000000 THEN {0} // 10000000 - 11644473600 WHEN {0} < 1000000000000000000 THEN {0} // 10000000 - 62135596800 ELSE {0} // 1000000000 END""".format("file_mod_time_stamp")
_P4 = f"""WITH rows AS (SELECT 'scanned_file' AS source_table, root_id, snapshot_no, nfc_normalize(replace(name, chr(92), '/')) AS name, {_SECONDS} AS s, size, lower(crc) AS crc, delivered_at FROM scanned_file WHERE name <> ''
 UNION ALL SELECT 'rv_file', root_id, export_no, nfc_normalize(replace(file_name, chr(92), '/')), {_SECONDS}, size, lower(crc), delivered_at FROM rv_file WHERE file_name <> ''),
held AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY source_table, root_id, snapshot_no, name ORDER BY delivered_at DESC, s DESC, size DESC NULLS LAST, crc DESC NULLS LAST) = 1),
snaps AS (SELECT *, lag(snapshot_no) OVER (PARTITION BY source_table, root_id ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT source_table, root_id, snapshot_no FROM rows))
SELECT c.source_table, c.root_id, c.snapshot_no, c.name, CASE WHEN p.name IS NULL THEN 'added' ELSE 'changed' END AS change FROM held c JOIN snaps o USING (source_table, root_id, snapshot_no)
 LEFT JOIN held p ON p.source_table = c.source_table AND p.root_id = c.root_id AND p.snapshot_no = o.before AND p.name = c.name WHERE before IS NOT NULL AND (p.name IS NULL OR p.s <> c.s OR p.size <> c.size OR p.crc <> c.crc)
UNION ALL SELECT p.source_table, p.root_id, o.snapshot_no, p.name, 'removed' FROM held p JOIN snaps o ON o.source_table = p.source_table AND o.root_id = p.root_id AND o.before = p.snapshot_no
 LEFT JOIN held c ON c.source_table = p.source_table AND c.root_id = p.root_id AND c.snapshot_no = o.snapshot_no AND c.name = p.name WHERE c.name IS NULL"""
_TREE = """WITH RECURSIVE held AS (SELECT dat_id, node FROM dat_node QUALIFY row_number() OVER (PARTITION BY dat_id ORDER BY loaded_at DESC, node DESC) = 1),
tree(dat_id, parent_path, node_path, place, e, body) AS (
 SELECT dat_id, CAST(NULL AS VARCHAR), 'r', CAST(NULL AS BIGINT), CAST(NULL AS JSON), json_extract(node, '$.Dir.children') FROM held WHERE json_valid(node)
 UNION ALL SELECT dat_id, node_path, node_path || '/' || i, i, e, json_extract(e, '$.node.Dir.children') FROM (
  SELECT dat_id, node_path, i, json_extract(l, '$[' || i || ']') AS e FROM (
   SELECT dat_id, node_path, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS i FROM (
    SELECT dat_id, node_path, CASE json_type(c) WHEN 'OBJECT' THEN json_array(c) ELSE c END AS l FROM (
     SELECT dat_id, node_path, CASE json_type(body) WHEN 'VARCHAR' THEN CAST(json_extract_string(body, '$') AS JSON) ELSE body END AS c FROM tree) WHERE json_type(c) IN ('ARRAY', 'OBJECT')))) WHERE json_type(e) = 'OBJECT'),
nodes AS (SELECT *, coalesce(json_type(e, '$.node.Dir') = 'OBJECT', FALSE) AS is_dir, coalesce(json_type(e, '$.node.File') = 'OBJECT', FALSE) AS is_file, coalesce(json_type(e, '$.node.Dir.d_game') = 'OBJECT', FALSE) AS is_game FROM tree WHERE parent_path IS NOT NULL)"""
_P3 = f"{_TREE} SELECT dat_id, parent_path, node_path FROM nodes"


def _field(path: str, name: str) -> str:
    """A field as text; lists are joined."""
    if name in ("category", "device_ref"):
        return f"CASE json_type(e, '{path}.{name}') WHEN 'ARRAY' THEN array_to_string(json_extract_string(e, '{path}.{name}[*]'), '|') ELSE json_extract_string(e, '{path}.{name}') END AS {name}"
    return f"json_extract_string(e, '{path}.{name}') AS {name}"


_LINK = "dat_id, node_path, parent_path, CAST(place AS INT) AS place, " + ", ".join(_field("$", f) for f in ELEMENT)
_P3_DIRECTORIES = f"{_TREE} SELECT {_LINK} FROM nodes WHERE NOT is_game AND (is_dir OR NOT is_file)"
_P3_GAMES = f"{_TREE} SELECT {_LINK}, {', '.join(_field('$.node.Dir.d_game', f) for f in GAME)} FROM nodes WHERE is_game"
_P3_FILES = f"{_TREE} SELECT {_LINK}, try_cast(json_extract_string(e, '$.node.File.size') AS BIGINT) AS size, {', '.join(_field('$.node.File', f) for f in BODY[1:])} FROM nodes WHERE is_file AND NOT is_dir"


_FORMATS = ["%Y-%m-%dT%H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%a, %d %b %Y %H:%M:%S", "%d-%b-%Y %H:%M:%S", "%Y%m%dT%H%M%S", "%Y-%m-%d %H:%M", "%b %d, %Y %I:%M:%S %p", "%Y%m%d%H%M%S"]
_DOS = "CASE WHEN (t & 31) < 30 THEN try_strptime(printf('%d-%02d-%02d %02d:%02d:%02d', (d >> 9) + 1980, (d >> 5) & 15, d & 31, t >> 11, (t >> 5) & 63, (t & 31) * 2), '%Y-%m-%d %H:%M:%S') END"
_OFFSET = "CAST(epoch(timezone(zone, to_timestamp({0}))) AS BIGINT) - ({0})"
_COARSER = "CASE WHEN count(DISTINCT r) < 9 OR max(precision) >= 10000000 THEN 1 ELSE greatest(" + ", ".join(f"CASE WHEN bool_and(list_bool_and(list_transform(ts, lambda x: x % {10**k} = 0))) THEN {10**k} ELSE 1 END" for k in range(8)) + ") END"
#: stamps(stamp, r, z, ticks from 1970, precision): what each distinct stamp stands for; no ticks for a day or a time that never was.
_STAMPS = f"""WITH abbr(a, minutes) AS (VALUES {", ".join(f"('{a}', {m})" for a, m in ABBREVIATIONS.items())}), zones AS (SELECT archive_id, max(zone_name) AS z FROM archive_file GROUP BY archive_id),
headers AS (SELECT DISTINCT header_id, archive_id, entry_index, CAST(header_last_modified AS VARCHAR) AS packed, trim(modified_time) AS text, z FROM file_header LEFT JOIN zones USING (archive_id)),
entries AS (SELECT DISTINCT entry_id, archive_id, entry_index, dos_date || ':' || dos_time AS dos, z FROM central_entry LEFT JOIN zones USING (archive_id)),
raw AS (SELECT 'header_last_modified' AS stamp, packed AS r, z FROM headers UNION SELECT 'modified_time', text, z FROM headers UNION SELECT 'dos', dos, z FROM entries),
told AS (SELECT *, CASE WHEN stamp <> 'dos' AND NOT regexp_full_match(r, '[0-9]{{14}}') THEN try_cast(r AS BIGINT) END AS n FROM raw WHERE r IS NOT NULL AND lower(r) NOT IN ('', '0', 'n/a', '0:0', '-9223372036854775808')),
counts AS (SELECT stamp, r, z, CASE WHEN n < 100000000000 THEN n * 10000000 WHEN n < 100000000000000 THEN n * 10000 WHEN n < 100000000000000000 THEN n * 10 WHEN n < 250000000000000000 THEN n - 116444736000000000 WHEN n < 1000000000000000000 THEN n - 621355968000000000 ELSE n // 100 END AS ticks,
 CASE WHEN n < 100000000000 THEN 's' WHEN n < 100000000000000 THEN 'ms' WHEN n < 100000000000000000 THEN 'us' WHEN n < 250000000000000000 THEN 'filetime' WHEN n < 1000000000000000000 THEN 'ticks' ELSE 'ns' END AS form FROM told WHERE n IS NOT NULL AND NOT (stamp = 'header_last_modified' AND n BETWEEN 1 AND 4294967295)),
packed AS (SELECT stamp, r, z, CASE WHEN stamp = 'dos' THEN CAST(split_part(r, ':', 1) AS BIGINT) ELSE n >> 16 END AS d, CASE WHEN stamp = 'dos' THEN CAST(split_part(r, ':', 2) AS BIGINT) ELSE n & 65535 END AS t FROM told WHERE stamp = 'dos' OR (stamp = 'header_last_modified' AND n BETWEEN 1 AND 4294967295)),
written AS (SELECT stamp, r, z, CASE WHEN regexp_matches(r, '[AP]M$') THEN '' ELSE trim(regexp_extract(r, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}}|\\[[^\\]]+\\]| [A-Z]{{3,4}})$')) END AS own FROM told WHERE n IS NULL AND stamp <> 'dos'),
bare AS (SELECT *, trim(r[: length(r) - length(own)]) AS b FROM written),
walls AS (SELECT stamp, r, z, CAST(epoch({_DOS}) AS BIGINT) AS wall, NULL AS fixed, z AS zone, 0 AS fraction, 20000000 AS precision, 'dos' AS form FROM packed UNION ALL
 SELECT stamp, r, z, CAST(epoch(try_strptime(regexp_replace(b, '[.,][0-9]+$', ''), {_FORMATS})) AS BIGINT), CASE WHEN own SIMILAR TO '[+-].*' THEN CAST(own[1] || '1' AS INT) * (CAST(own[2:3] AS INT) * 60 + CAST(right(own, 2) AS INT)) ELSE minutes END,
  CASE WHEN own LIKE '[%' THEN own[2:-2] WHEN own = '' THEN z END, coalesce(try_cast(rpad(regexp_extract(b, '[.,]([0-9]+)$', 1), 7, '0') AS BIGINT), 0), CASE WHEN regexp_matches(b, '[.,][0-9]+$') THEN CAST(pow(10, 7 - length(regexp_extract(b, '[.,]([0-9]+)$', 1))) AS BIGINT) WHEN regexp_matches(b, ' [0-9]+:[0-9]+$') THEN 600000000 ELSE 10000000 END,
  'text' || length(regexp_extract(b, '[.,]([0-9]+)$', 1)) FROM bare LEFT JOIN abbr ON a = CASE WHEN own LIKE '[%' THEN own[2:-2] ELSE own END),
seen AS (SELECT *, list_filter([wall - ({_OFFSET.format("wall - 86400")}), wall - ({_OFFSET.format("wall + 86400")})], lambda c: c + {_OFFSET.format("c")} = wall) AS cs FROM walls WHERE fixed IS NULL AND zone IS NOT NULL),
known AS (SELECT stamp, r, z, [ticks] AS ts, CASE form WHEN 's' THEN 10000000 WHEN 'ms' THEN 10000 WHEN 'us' THEN 10 ELSE 1 END AS precision, form FROM counts
 UNION ALL SELECT stamp, r, z, CASE WHEN wall IS NULL THEN [] ELSE [(wall - fixed * 60) * 10000000 + fraction] END, precision, form FROM walls WHERE fixed IS NOT NULL
 UNION ALL SELECT stamp, r, z, CASE WHEN wall IS NULL THEN [] ELSE list_transform(list_distinct(cs), lambda c: c * 10000000 + fraction) END, precision, form FROM seen),
-- a form below a second is as coarse as all its instants are, if nine values say so
forms AS (SELECT stamp, form, {_COARSER} AS coarser FROM known WHERE len(ts) > 0 GROUP BY stamp, form),
stamps AS (SELECT stamp, r, z, ts, greatest(precision, coalesce(coarser, 1)) AS precision FROM known LEFT JOIN forms USING (stamp, form))"""
_P2_INSTANTS = f"""{_STAMPS} SELECT DISTINCT source_table, row_id, stamp, CAST(floor(t / 10000000.0) AS BIGINT) AS seconds FROM (
 SELECT 'file_header' AS source_table, header_id AS row_id, stamp, unnest(ts) AS t FROM headers h JOIN stamps s ON s.stamp IN ('header_last_modified', 'modified_time') AND s.r = CASE stamp WHEN 'modified_time' THEN text ELSE packed END AND s.z IS NOT DISTINCT FROM h.z
 UNION ALL SELECT 'central_entry', entry_id, 'dos', unnest(ts) FROM entries e JOIN stamps s ON s.stamp = 'dos' AND s.r = dos AND s.z IS NOT DISTINCT FROM e.z)"""
_APART = "NOT list_has_any(list_transform(a.ts, lambda x: x - x % greatest(a.precision, b.precision)), list_transform(b.ts, lambda x: x - x % greatest(a.precision, b.precision)))"
_P2_FOUND = f"""{_STAMPS} SELECT DISTINCT header_id, 'modified_time' AS versus FROM headers h JOIN stamps a ON a.stamp = 'header_last_modified' AND a.r = packed AND a.z IS NOT DISTINCT FROM h.z JOIN stamps b ON b.stamp = 'modified_time' AND b.r = text AND b.z IS NOT DISTINCT FROM h.z WHERE {_APART}
 UNION SELECT header_id, 'dos' FROM headers h JOIN entries e ON e.archive_id = h.archive_id AND e.entry_index = h.entry_index JOIN stamps a ON a.stamp = 'header_last_modified' AND a.r = packed AND a.z IS NOT DISTINCT FROM h.z JOIN stamps b ON b.stamp = 'dos' AND b.r = dos AND b.z IS NOT DISTINCT FROM h.z WHERE {_APART}"""


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables for those that SQL can express."""
    return {"p2_found": _P2_FOUND, "p2_instants": _P2_INSTANTS, "p3_found": _P3, "p3_directories": _P3_DIRECTORIES, "p3_games": _P3_GAMES, "p3_files": _P3_FILES, "p4_found": _P4}
