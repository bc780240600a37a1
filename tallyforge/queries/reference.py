"""Queries of the engine's own operators over the derived relations, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import fixtures as fx
from tallyforge.functions import text as tx
from tallyforge.operators import archives, reconcile, report, rules, stats, transforms
from tallyforge.plans import fixes
from tallyforge.schemas import ACTIONABLE, ACTIONS, DOMINANCE, FILE_COUNTERS, FIX_REPORT, PARTIAL_LISTING, STATUS_MATRIX

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Register a query under its function's name with its SQL."""

    def keep(f):
        Q[f.__name__] = (f, sql)
        return f

    return keep


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_MATRIX = ", ".join(f"('{d}', '{f}', '{g}', '{s}')" for (d, f), row in STATUS_MATRIX.items() for g, s in zip(("Got", "NotGot", "Corrupt"), row, strict=True))
STATED = f"""{fx.NODES}, matrix(d, f, g, s) AS (VALUES {_MATRIX}),
stated AS (SELECT n.*, coalesce(s, 'UnScanned') AS status FROM nodes n LEFT JOIN matrix ON d = dat_status AND f = 'leaf' AND g = got_status)"""
_COUNT = "CAST(count(*) AS BIGINT) AS total, " + ", ".join(f"CAST(count(*) FILTER (WHERE status IN {_in(m)}) AS BIGINT) AS {n}" for n, m in FILE_COUNTERS.items())


def stated(spark: SparkSession, d: str) -> DataFrame:
    n = fx.nodes(spark, d)
    return n.withColumn("status", stats.base_status(F.col("dat_status"), F.col("got_status"), F.col("file_type")))


# --- status and statistics ---
@query(f"WITH {STATED} SELECT node_id, status FROM stated")
def status_matrix(spark, d):
    return stated(spark, d).select("node_id", "status")


@query(f"WITH {STATED} SELECT {_COUNT} FROM stated")
def stats_global(spark, d):
    return stats.stats(stated(spark, d))


@query(f"WITH {STATED} SELECT dat, {_COUNT} FROM stated GROUP BY dat")
def stats_by_catalog(spark, d):
    return stats.stats(stated(spark, d), ["dat"])


_DIRS = f"""{STATED}, placed AS (SELECT dat AS directory, status FROM stated UNION ALL SELECT dat || '/' || split_part(game, '/', 1), status FROM stated UNION ALL SELECT dat || '/' || game, status FROM stated WHERE game LIKE '%/%'),
counted AS (SELECT directory, {_COUNT} FROM placed GROUP BY directory)"""


def _dirs(spark, d):
    return stats.stats_by_directory(stated(spark, d).withColumn("path", F.split(F.concat_ws("/", "dat", "game"), "/")))


@query(f"WITH {_DIRS} SELECT * FROM counted")
def stats_by_directory(spark, d):
    return _dirs(spark, d)


@query(f"""WITH {_DIRS} SELECT directory, CASE WHEN total = 0 OR unknown = total THEN 'Unknown'
 WHEN corrupt = total OR (corrupt > 0 AND missing - corrupt = 0 AND correct + not_collected + unneeded + corrupt + fixes = total) THEN 'Corrupt'
 WHEN not_collected + unneeded = total THEN CASE WHEN unneeded > 0 AND not_collected = 0 THEN 'UnNeeded' ELSE 'NotCollected' END
 WHEN in_to_sort = total OR fixes = total THEN 'InToSort' WHEN correct = total THEN 'Correct' WHEN missing > 0 THEN 'Missing' WHEN fixes > 0 OR in_to_sort > 0 THEN 'InToSort' ELSE 'Unknown' END AS status FROM counted""")
def dir_status(spark, d):
    return _dirs(spark, d).select("directory", stats.directory_status().alias("status"))


@query(f"WITH {STATED} SELECT dat, {_COUNT.replace('count(*)', '2 * count(*)')} FROM stated GROUP BY dat")
def stats_added(spark, d):
    s = stats.stats(stated(spark, d), ["dat"])
    return stats.add_stats(s, s, ["dat"])


_DOM = ", ".join(f"('{s}', {i})" for i, s in enumerate(DOMINANCE))


@query(f"WITH {STATED}, dom(s, p) AS (VALUES {_DOM}) SELECT game, coalesce(arg_min(s, p), 'UnScanned') AS dominant FROM stated LEFT JOIN dom ON s = status GROUP BY game")
def dominant_status(spark, d):
    return stats.dominant_status(stated(spark, d), ["game"])


_CLASS = f"""{STATED}, c AS (SELECT dat, CAST(count(*) FILTER (WHERE status IN ('Correct', 'CorrectMIA')) AS BIGINT) AS correct,
 CAST(count(*) FILTER (WHERE status IN ('Missing', 'MissingMIA', 'Corrupt', 'Incomplete', 'UnScanned', 'Unknown')) AS BIGINT) AS missing,
 CAST(count(*) FILTER (WHERE status IN {_in([*ACTIONS, 'UnNeeded', 'NotCollected', 'InToSort'])}) AS BIGINT) AS fixes FROM stated GROUP BY dat)"""


@query(f"WITH {_CLASS} SELECT *, CASE WHEN correct > 0 AND missing = 0 AND fixes = 0 THEN 'complete' WHEN correct = 0 AND missing > 0 AND fixes = 0 THEN 'empty' WHEN (correct > 0 AND missing > 0) OR fixes > 0 THEN 'partial' END AS class FROM c")
def catalog_classification(spark, d):
    return stats.classify_catalogs(stated(spark, d), "dat")


@query(f"WITH {STATED} SELECT CAST(count(*) FILTER (WHERE selected AND status IN {_in(ACTIONABLE)}) AS BIGINT) AS actionable FROM stated")
def actionable_count(spark, d):
    return stats.actionable(stated(spark, d))


@query(f"""WITH {STATED}, t AS (SELECT {_COUNT} FROM stated) SELECT '1 Total' AS line, total AS count FROM t UNION ALL SELECT '2 Correct', correct FROM t UNION ALL SELECT '3 Missing', missing + fixes FROM t
 UNION ALL SELECT '4 Can Fix', fixes + unknown + unneeded FROM t UNION ALL SELECT '5 Corrupt', corrupt FROM t UNION ALL SELECT '6 In ToSort', in_to_sort FROM t UNION ALL SELECT '7 Not Collected', not_collected FROM t""")
def summary_lines(spark, d):
    return stats.summary_lines(stats.stats(stated(spark, d)))


@query(f"""WITH {STATED}, c AS (SELECT game, {_COUNT} FROM stated GROUP BY game), v AS (SELECT game AS name, total > 0 AND correct = total AS show_correct, missing > 0 OR missing_mia > 0 AS show_missing, fixes > 0 OR unneeded > 0 AS show_fixes,
 missing_mia > 0 OR correct_mia > 0 OR (total > 0 AND fixes = total) AS show_mia, total > 0 AND not_collected + unneeded = total AS show_merged, unknown > 0 AS show_unknown FROM c)
 SELECT *, ((show_correct AND NOT show_missing AND NOT show_fixes) OR (show_correct AND show_missing) OR show_mia OR show_merged OR NOT (show_correct OR show_missing OR show_fixes OR show_mia OR show_merged OR show_unknown)) AND contains(lower(name), 'a') AS shown FROM v""")
def game_grid(spark, d):
    c = stats.stats(stated(spark, d), ["game"])
    v = c.select(F.col("game").alias("name"), *stats.visibility())
    return v.withColumn("shown", stats.visible(empty=False, fixes=False, unknown=False, needle="a"))


# --- reconciliation ---
REC = f"""{fx.SIDES}, rec AS (SELECT coalesce(e.place, f.place) AS place, coalesce(e.name, f.name) AS name, coalesce(e.dat_status, 'NotInDat') AS dat_status,
 CASE WHEN f.name IS NULL THEN 'NotGot' WHEN f.got_status = 'FileLocked' THEN 'FileLocked' WHEN e.name IS NULL THEN f.got_status WHEN e.size = f.size AND e.sha1 = f.sha1 AND e.md5 = f.md5 THEN 'Got' ELSE 'Corrupt' END AS got_status,
 e.sha1 AS expected_sha1, f.sha1 AS found_sha1, coalesce(e.size, f.size, 0) AS size FROM expected e FULL JOIN found f ON e.place = f.place AND e.name = f.name),
 matrix(d, f, g, s) AS (VALUES {_MATRIX})"""


def _reconciled(spark, d):
    return reconcile.reconcile(fx.expected(spark, d), fx.found(spark, d), ["place"])


@query(f"WITH {REC} SELECT place, name, dat_status, got_status, expected_sha1, found_sha1, coalesce(s, 'UnScanned') AS base_status FROM rec LEFT JOIN matrix ON d = dat_status AND f = 'leaf' AND g = got_status")
def reconciled(spark, d):
    return _reconciled(spark, d).select("place", "name", "dat_status", "got_status", "expected_sha1", "found_sha1", "base_status")


@query(f"WITH {REC} SELECT place, name FROM rec WHERE got_status = 'Corrupt'")
def corrupt_found(spark, d):
    return _reconciled(spark, d).filter("got_status = 'Corrupt'").select("place", "name")


@query(f"WITH {REC}, h AS (SELECT size, found_sha1, min(name) AS held_name FROM rec WHERE got_status = 'Got' AND dat_status = 'NotInDat' GROUP BY ALL) SELECT r.name AS expected_name, held_name FROM rec r JOIN h ON r.size = h.size AND r.expected_sha1 = h.found_sha1 WHERE r.got_status = 'NotGot' AND r.dat_status <> 'NotInDat'")
def rename_recovery(spark, d):
    return reconcile.renamed(_reconciled(spark, d))


@query(f"WITH {REC} SELECT coalesce(e.place, r.place) AS place, coalesce(e.name, r.name) AS name, CASE WHEN e.name IS NULL THEN 'NotInDat' ELSE e.dat_status END AS dat_status, coalesce(r.got_status, 'NotGot') AS got_status FROM expected e FULL JOIN rec r ON e.place = r.place AND e.name = r.name WHERE NOT (e.name IS NULL AND coalesce(r.got_status, 'NotGot') = 'NotGot')")
def snapshot_carry_over(spark, d):
    return reconcile.carry_over(_reconciled(spark, d), fx.expected(spark, d), ["place", "name"])


# --- planning ---
_HELD = "got_status IN ('Got', 'Corrupt') AND (selected OR dat_status = 'InToSort')"
_LISTED = "('InDatCollect', 'InDatMerged', 'InDatNoDump', 'InDatMIA')"


def _keys(columns: list[tuple[str, str]]) -> str:
    """Rows (node_id, lane, key) of nodes, one for each (size, hash)."""
    return " UNION ".join(f"SELECT node_id, {i} AS lane, '{h}:' || coalesce({n}, 0) || ':' || {p}{h} AS key FROM nodes WHERE {p}{h} IS NOT NULL" for i, h in enumerate(("crc", "sha1", "md5")) for n, p in columns)


_AGREE = " AND ".join(f"(w.{p}{h} IS NULL OR h.{h} IS NULL OR w.{p}{h} = h.{h} OR w.{p}{h} IS NOT DISTINCT FROM h.alt_{h})" for h in ("sha1", "md5") for p in ("", "alt_"))
_FITS = f"(w.header_type IS NULL OR h.header_type IS NULL OR w.header_type = h.header_type) AND (NOT w.header_required OR (h.header_type IS NOT NULL AND h.from_header)) AND (NOT h.deep OR ({_AGREE}))"
#: Targets one after the other; each takes the best source of the first lane that has one left.
ASSIGNED = f"""RECURSIVE {fx.NODES}, asks AS ({_keys([("size", ""), ("coalesce(alt_size, size)", ""), ("coalesce(alt_size, size)", "alt_")])}), has AS ({_keys([("size", ""), ("coalesce(alt_size, size)", "alt_")])}),
 backing AS (SELECT physical, count(*) AS k FROM nodes WHERE {_HELD} AND got_status = 'Got' AND dat_status IN ('InDatCollect', 'InDatMIA') GROUP BY physical),
 held AS (SELECT n.*, CASE dat_status WHEN 'InDatCollect' THEN 0 WHEN 'InDatMIA' THEN 1 WHEN 'InDatMerged' THEN 2 WHEN 'InDatNoDump' THEN 2 WHEN 'InToSort' THEN 3 ELSE 4 END AS p, coalesce(k, 0) > CAST(got_status = 'Got' AND dat_status IN ('InDatCollect', 'InDatMIA') AS INT) AS backed, NOT locked AND dat_status NOT IN ('InDatCollect', 'InDatMIA') AS once FROM nodes n LEFT JOIN backing USING (physical) WHERE {_HELD}),
 wanted AS (SELECT * FROM nodes WHERE got_status = 'NotGot' AND selected AND dat_status IN ('InDatCollect', 'InDatMIA')),
 pairs AS (SELECT DISTINCT w.node_id AS target, w.ord, lane, h.node_id AS source, once, struct_pack(lane := lane, p := p, b := backed, c := got_status = 'Corrupt', m := NOT once, o := hord, id := h.node_id) AS pref FROM (SELECT node_id, ord FROM wanted) w JOIN asks a ON a.node_id = w.node_id JOIN has k USING (lane, key) JOIN (SELECT *, ord AS hord FROM held) h ON h.node_id = k.node_id),
 fitting AS (SELECT pairs.* FROM pairs JOIN wanted w ON w.node_id = target JOIN held h ON h.node_id = source WHERE {_FITS}),
 queue AS (SELECT target, row_number() OVER (ORDER BY ord, target) AS i FROM (SELECT DISTINCT target, ord FROM fitting)),
 step AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS spent, NULL::VARCHAR AS missing_id, NULL::VARCHAR AS source_id UNION ALL
  SELECT q.i, CASE WHEN arg_min(f.once, f.pref) THEN list_append(s.spent, arg_min(f.source, f.pref)) ELSE s.spent END, q.target, arg_min(f.source, f.pref) FROM step s JOIN queue q ON q.i = s.i + 1 LEFT JOIN fitting f ON f.target = q.target AND NOT list_contains(s.spent, f.source) GROUP BY q.i, q.target, s.spent),
 assigned AS (SELECT missing_id, source_id FROM step WHERE source_id IS NOT NULL)"""
_EMPTY = "(coalesce({0}.size, 0) = 0 AND ({0}.crc IS NULL OR {0}.crc = '00000000') AND ({0}.sha1 IS NULL OR {0}.sha1 = 'da39a3ee5e6b4b0d3255bfef95601890afd80709') AND ({0}.md5 IS NULL OR {0}.md5 = 'd41d8cd98f00b204e9800998ecf8427e'))"
_ALIKE = " AND ".join(f"(coalesce(a.{h}, a.alt_{h}) IS NULL OR coalesce(b.{h}, b.alt_{h}) IS NULL OR list_has_any([a.{h}, a.alt_{h}], list_filter([b.{h}, b.alt_{h}], lambda x: x IS NOT NULL)))" for h in ("sha1", "md5"))
_SAME = f"(({_EMPTY.format('a')} AND {_EMPTY.format('b')}) OR NOT (a.deep AND b.deep) OR ({_ALIKE}))"
_EQUAL = f"FROM {{0}} a JOIN asks ON asks.node_id = a.node_id JOIN has USING (lane, key) JOIN {{1}} b ON b.node_id = has.node_id AND b.node_id <> a.node_id AND {_SAME}"
PLANNED = f"""{ASSIGNED}, matrix(d, f, g, s) AS (VALUES {_MATRIX}), made AS (SELECT missing_id, min(CAST(h.got_status = 'Corrupt' AS INT)) AS bad FROM assigned JOIN nodes h ON h.node_id = source_id GROUP BY missing_id), used AS (SELECT DISTINCT source_id FROM assigned),
 twice AS (SELECT DISTINCT a.node_id {_EQUAL.format('held', 'nodes')} WHERE a.got_status = 'Got' AND ((a.dat_status = 'NotInDat' AND b.dat_status = 'InDatCollect' AND b.got_status = 'Got') OR (a.dat_status = 'InToSort' AND ((b.dat_status IN {_LISTED} AND b.got_status = 'Got') OR b.node_id IN (SELECT missing_id FROM made WHERE bad = 0))))),
 settled AS (SELECT n.*, coalesce(h.backed, FALSE) AS backed, CASE WHEN n.got_status = 'NotGot' AND n.selected AND n.dat_status IN ('InDatMerged', 'InDatNoDump') THEN 'NotCollected'
  WHEN n.got_status = 'NotGot' AND n.selected AND n.dat_status IN {_LISTED} THEN CASE WHEN bad = 1 THEN 'CorruptCanBeFixed' WHEN bad = 0 AND n.dat_status = 'InDatMIA' THEN 'CanBeFixedMIA' WHEN bad = 0 THEN 'CanBeFixed' WHEN n.dat_status = 'InDatMIA' THEN 'MissingMIA' ELSE 'Missing' END
  WHEN h.node_id IS NULL THEN coalesce(s, 'UnScanned')
  WHEN n.got_status = 'Got' AND source_id IS NOT NULL AND n.dat_status NOT IN ('InDatCollect', 'InDatMIA') THEN 'NeededForFix'
  WHEN n.dat_status IN ('InDatMerged', 'InDatNoDump') THEN CASE WHEN h.backed THEN 'NotCollected' ELSE 'UnNeeded' END
  WHEN n.got_status = 'Corrupt' THEN CASE WHEN n.dat_status = 'InDatCollect' THEN 'MoveToCorrupt' ELSE 'Delete' END
  WHEN n.dat_status = 'InDatCollect' THEN 'Correct' WHEN n.dat_status = 'InDatMIA' THEN 'CorrectMIA' WHEN t.node_id IS NOT NULL THEN 'Delete' WHEN n.dat_status = 'InToSort' THEN 'InToSort' ELSE 'MoveToSort' END AS first_status
  FROM nodes n LEFT JOIN held h ON h.node_id = n.node_id LEFT JOIN made ON missing_id = n.node_id LEFT JOIN used ON source_id = n.node_id LEFT JOIN twice t ON t.node_id = n.node_id LEFT JOIN matrix ON d = n.dat_status AND f = 'leaf' AND g = n.got_status),
 moved AS (SELECT h.node_id FROM settled h WHERE first_status = 'NeededForFix' AND EXISTS (SELECT 1 FROM settled w WHERE w.first_status IN ('CanBeFixed', 'CanBeFixedMIA') AND (w.game = h.game OR (w.archive = h.archive AND w.file_type = 'FileZip' AND h.file_type = 'FileZip')) AND {_FITS})),
 planned AS (SELECT *, CASE WHEN node_id IN (SELECT node_id FROM moved) THEN 'Rename' ELSE first_status END AS plan_status FROM settled)"""


def planned(spark, d):
    return fixes.plan_fixes(fx.nodes(spark, d))


@query(f"WITH {ASSIGNED} SELECT missing_id, source_id FROM assigned")
def fix_assignment(spark, d):
    held, missing = fixes.partitions(fx.nodes(spark, d))
    return fixes.assign_sources(missing.filter(~F.col("dat_status").isin("InDatMerged", "InDatNoDump")), held)


@query(f"WITH {PLANNED} SELECT node_id, plan_status FROM planned")
def fix_plan(spark, d):
    return planned(spark, d)[0].select("node_id", "plan_status")


@query()
def two_pass_plan(spark, d):
    """Both passes of the planner; tested against cases, as SQL would state all of the plan twice."""
    return fixes.two_pass_plan(fx.nodes(spark, d)).select("node_id", "plan_status")


@query(f"""WITH {PLANNED} SELECT missing_id AS node_id, 'copy' AS action, source_id FROM assigned UNION ALL SELECT node_id, CASE plan_status WHEN 'Delete' THEN 'delete' WHEN 'MoveToSort' THEN 'move_to_sort' ELSE 'move_to_corrupt' END, NULL FROM planned WHERE plan_status IN ('Delete', 'MoveToSort', 'MoveToCorrupt')
 UNION ALL SELECT node_id, 'delete_after_copy', NULL FROM planned WHERE plan_status = 'NeededForFix' AND NOT locked""")
def plan_actions(spark, d):
    return fixes.plan_actions(*planned(spark, d))


@query(f"WITH {ASSIGNED} SELECT DISTINCT a.node_id {_EQUAL.format('nodes', 'nodes')} WHERE a.got_status = 'Got' AND b.got_status = 'Got' AND a.dat_status = 'NotInDat' AND b.dat_status = 'InDatCollect'")
def redundancy_notindat(spark, d):
    good = fx.nodes(spark, d).filter("got_status = 'Got'")
    return fixes.redundant(good.filter("dat_status = 'NotInDat'"), good.filter("dat_status = 'InDatCollect'"))


@query(f"WITH {ASSIGNED} SELECT DISTINCT a.node_id {_EQUAL.format('nodes', 'nodes')} WHERE a.got_status = 'Got' AND b.got_status = 'Got' AND a.dat_status = 'InToSort' AND b.dat_status IN {_LISTED}")
def redundancy_tosort(spark, d):
    good = fx.nodes(spark, d).filter("got_status = 'Got'")
    return fixes.redundant(good.filter("dat_status = 'InToSort'"), good.filter("dat_status like 'InDat%'"))


@query(f"WITH {PLANNED} SELECT node_id, coalesce(sum(CAST(plan_status NOT IN ('Delete', 'UnNeeded', 'MoveToSort') AS INT)) OVER (PARTITION BY physical) - CAST(plan_status NOT IN ('Delete', 'UnNeeded', 'MoveToSort') AS INT), 0) > 0 AS shared FROM planned")
def shared_identity(spark, d):
    return fixes.shared_identity(planned(spark, d)[0]).select("node_id", "shared")


@query(f"WITH {PLANNED} SELECT physical, CAST(count(*) AS BIGINT) AS retained FROM planned WHERE plan_status NOT IN ('Delete', 'UnNeeded', 'MoveToSort') GROUP BY physical")
def retained_paths(spark, d):
    return fixes.retained_paths(planned(spark, d)[0])


@query(f"WITH {PLANNED} SELECT node_id FROM moved")
def rename_promotion(spark, d):
    plan = planned(spark, d)[0]
    return fixes.rename_promotion(plan.withColumn("plan_status", F.when(F.col("plan_status") == "Rename", "NeededForFix").otherwise(F.col("plan_status"))))


@query(f"WITH {PLANNED}, gap AS (SELECT game, max(CAST(plan_status IN ('Missing', 'MissingMIA') AS INT)) AS x FROM planned GROUP BY game) SELECT node_id, CASE WHEN x = 1 AND plan_status IN ('Correct', 'CorrectMIA') THEN 'IncompleteRemove' WHEN x = 1 AND plan_status IN ('CanBeFixed', 'CanBeFixedMIA') THEN 'Incomplete' ELSE plan_status END AS plan_status FROM planned LEFT JOIN gap USING (game)")
def complete_only(spark, d):
    return fixes.complete_only(planned(spark, d)[0]).select("node_id", "plan_status")


@query(f"WITH {PLANNED} SELECT DISTINCT a.node_id {_EQUAL.format('planned', 'planned')} WHERE a.plan_status = 'Delete' AND b.got_status = 'Got' AND b.plan_status NOT IN ('Delete', 'Deleted')")
def delete_check(spark, d):
    plan = planned(spark, d)[0]
    return fixes.delete_checked(plan.filter("plan_status = 'Delete'"), plan)


@query(f"WITH {fx.NODES} SELECT DISTINCT name, size, crc FROM nodes WHERE dat_status = 'InDatMIA' AND got_status = 'Got'")
def mia_found(spark, d):
    return fixes.found_mia(fx.nodes(spark, d))


@query(f"WITH {ASSIGNED} SELECT node_id, row_number() OVER (PARTITION BY size, crc ORDER BY p, backed, got_status = 'Corrupt', NOT once, ord) AS preference FROM held")
def source_priority(spark, d):
    held, _ = fixes.partitions(fx.nodes(spark, d))
    return fixes.source_rank(held, ["size", "crc"]).select("node_id", F.col("preference").cast("bigint").alias("preference"))


@query(f"""WITH {ASSIGNED}, p AS (SELECT m.archive AS target, s.archive AS source FROM assigned JOIN nodes m ON m.node_id = missing_id JOIN nodes s ON s.node_id = source_id), one AS (SELECT target, min(source) AS source, count(*) AS n FROM p GROUP BY target HAVING min(source) = max(source)),
 content AS (SELECT archive, count(*) AS c, list_sort(list(name || '|' || size || '|' || crc)) AS l FROM nodes GROUP BY archive) SELECT target, source FROM one JOIN content t ON t.archive = target JOIN content s ON s.archive = source WHERE n = t.c AND t.l = s.l""")
def archive_move(spark, d):
    plan, pairs = planned(spark, d)
    return fixes.whole_archive_moves(pairs, plan)


# --- reports ---
_CAT = "dat_status IN ('InDatCollect', 'InDatMerged', 'InDatNoDump', 'InDatMIA')"


@query(f"WITH {PLANNED} SELECT node_id FROM planned WHERE {_CAT} AND got_status <> 'Got'")
def fixdat_rows(spark, d):
    return report.fix_catalog_rows(planned(spark, d)[0]).select("node_id")


@query(f"WITH {PLANNED} SELECT node_id FROM planned WHERE {_CAT} AND got_status <> 'Got' AND plan_status NOT IN {_in([*ACTIONS, 'InToSort'])}")
def fixdat_red_only(spark, d):
    return report.fix_catalog_rows(planned(spark, d)[0], red_only=True).select("node_id")


@query(f"WITH {PLANNED} SELECT dat, game, name, plan_status FROM planned WHERE plan_status IN {_in(FIX_REPORT)}")
def fix_entries(spark, d):
    return report.fix_entries(planned(spark, d)[0]).select("dat", "game", "name", "plan_status")


@query(f"WITH {PLANNED} SELECT node_id FROM planned WHERE plan_status IN {_in(PARTIAL_LISTING)}")
def partial_entries(spark, d):
    return report.partial_entries(planned(spark, d)[0]).select("node_id")


@query(f"""WITH {PLANNED}, e AS (SELECT dat, coalesce(game, '') AS game, name, plan_status FROM planned WHERE plan_status IN {_in(FIX_REPORT)}), w AS (SELECT dat, max(length(game)) AS wg, max(length(name)) AS wn, max(length(plan_status)) AS ws FROM e GROUP BY dat),
 r AS (SELECT dat, '+-' || repeat('-', wg) || '-+-' || repeat('-', wn) || '-+-' || repeat('-', ws) || '-+' AS line FROM w)
 SELECT dat, 0 AS part, line FROM r UNION ALL SELECT dat, 2, line FROM r UNION ALL SELECT dat, 1, '| ' || rpad(game, CAST(wg AS INT), ' ') || ' | ' || rpad(name, CAST(wn AS INT), ' ') || ' | ' || rpad(plan_status, CAST(ws AS INT), ' ') || ' |' FROM e JOIN w USING (dat)""")
def fix_report(spark, d):
    return report.boxed_report(report.fix_entries(planned(spark, d)[0]), "dat").select("dat", "part", "line")


@query(f"WITH {PLANNED} SELECT node_id, CASE WHEN plan_status = 'NotCollected' THEN FALSE ELSE TRUE END AS included FROM planned")
def export_filter(spark, d):
    return planned(spark, d)[0].select("node_id", report.export_included(F.col("plan_status")).alias("included"))


@query(f"WITH {PLANNED} SELECT node_id FROM planned WHERE NOT (dat_status = 'InDatMerged' AND plan_status = 'NotCollected')")
def member_grid(spark, d):
    return report.member_grid(planned(spark, d)[0]).select("node_id")


@query(f"WITH {fx.NODES} SELECT node_id, row_number() OVER (PARTITION BY dat ORDER BY size DESC, lower(name) DESC, node_id DESC) AS place FROM nodes")
def rom_grid_sorted(spark, d):
    n = fx.nodes(spark, d)
    w = Window.partitionBy("dat").orderBy(*report.grid_order("size", descending=True, ties=("name", "node_id")))
    return n.select("node_id", F.row_number().over(w).cast("bigint").alias("place"))


_HAS = " AND ".join(f"(a.{p}{h} IS NULL OR a.{p}{h} = c.{h} OR coalesce(a.{p}{h} = c.alt_{h}, FALSE))" for h in ("crc", "sha1", "md5") for p in ("", "alt_"))


@query(f"WITH {fx.NODES}, c AS (SELECT min(node_id) AS class_id, count(*) AS occurrences, size, crc, sha1, md5, alt_crc, alt_sha1, alt_md5 FROM nodes GROUP BY ALL) SELECT a.node_id AS needle_id, class_id, occurrences FROM nodes a JOIN c ON c.size = a.size AND {_HAS} WHERE a.got_status = 'NotGot' AND coalesce(a.crc, a.sha1, a.md5) IS NOT NULL")
def occurrences(spark, d):
    n = fx.nodes(spark, d)
    return report.occurrences(n.filter("got_status = 'NotGot'"), n)


@query(f"WITH {STATED} SELECT status, CASE WHEN status IN ('Correct', 'CorrectMIA') THEN 'correct' WHEN status IN ('Missing', 'MissingMIA') THEN 'missing' WHEN status = 'Corrupt' THEN 'corrupt' WHEN status IN ('Deleted') THEN 'fixes' WHEN status IN ('NotCollected', 'UnNeeded') THEN 'merged' WHEN status = 'InToSort' THEN 'sorting' WHEN status IN ('Unknown', 'UnScanned') THEN 'unknown' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM stated GROUP BY ALL")
def status_buckets(spark, d):
    return stated(spark, d).groupBy("status", report.status_bucket(F.col("status")).alias("bucket")).agg(F.count("*").alias("n"))


# --- catalog transforms ---
@query(f"WITH {fx.SETS} SELECT game, ord, CASE WHEN merge IS NOT NULL THEN '(No-Merge) ' || merge END AS merge, CASE WHEN status = 'nodump' THEN 'InDatNoDump' WHEN mia = 'yes' AND size <> 0 THEN 'InDatMIA' ELSE 'InDatCollect' END AS dat_status FROM roms")
def set_status(spark, d):
    return transforms.set_status(fx.roms(spark, d)).select("game", "ord", "merge", "dat_status")


@query(f"WITH {fx.SETS} SELECT game, ord FROM roms WHERE status IS NULL OR status <> 'nodump'")
def remove_nodump(spark, d):
    return transforms.remove_no_dumps(fx.roms(spark, d)).select("game", "ord")


@query(f"WITH {fx.SETS} SELECT game, ord FROM roms WHERE NOT (status IS DISTINCT FROM 'nodump' AND mia IS NOT DISTINCT FROM 'yes' AND coalesce(size, 0) <> 0)")
def remove_not_collected(spark, d):
    return transforms.remove_not_collected(transforms.set_status(fx.roms(spark, d))).select("game", "ord")


@query(f"WITH {fx.SETS} SELECT game, ord, is_disk FROM roms WHERE is_disk")
def keep_disks(spark, d):
    return transforms.remove_disks(fx.roms(spark, d), keep=True).select("game", "ord", "is_disk")


@query(f"WITH {fx.SETS} SELECT game FROM games WHERE game IN (SELECT game FROM roms)")
def remove_empty_sets(spark, d):
    return transforms.remove_empty_sets(fx.games(spark, d), fx.roms(spark, d)).select("game")


@query(f"WITH {fx.SETS}, f AS (SELECT id AS clone_of_id, arg_min(game, ord) AS o FROM games WHERE id IS NOT NULL GROUP BY id) SELECT game, coalesce(o, clone_of) AS clone_of FROM games LEFT JOIN f USING (clone_of_id)")
def match_clone_ids(spark, d):
    return transforms.match_clone_ids(fx.games(spark, d)).select("game", "clone_of")


_CARRIED = "coalesce(last_value(id IGNORE NULLS) OVER (PARTITION BY brand ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') || ' - '"


@query(f"WITH {fx.SETS}, c AS (SELECT game, {_CARRIED} AS p FROM games) SELECT p || game AS game, '' AS name FROM c UNION ALL SELECT p || game, p || name FROM c JOIN roms USING (game)")
def add_id_numbers(spark, d):
    sets, inside = transforms.add_id_numbers(fx.games(spark, d), ["brand"], fx.roms(spark, d))
    return sets.select("game", F.lit("").alias("name")).unionByName(inside.select("game", "name"))


_ORDER = ["Tin", "BRUSHED", "copper", "Steel", "plated"]


@query(f"""WITH {fx.SETS}, o(i, c) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(_ORDER))}), l AS (SELECT ord, game, CASE ord % 5 WHEN 0 THEN [] WHEN 1 THEN [' ' || split_part(kind, ' ', 3) || ' '] WHEN 2 THEN [' '] WHEN 3 THEN ['', split_part(kind, ' ', 2)] ELSE string_split(kind, ' ') END AS cs FROM games),
 b AS (SELECT ord, arg_min(c, i) AS c FROM (SELECT ord, trim(unnest(cs)) AS x FROM l WHERE len(cs) > 1) JOIN o ON lower(x) = lower(c) GROUP BY ord) SELECT l.ord, CASE WHEN len(cs) = 1 AND trim(cs[1]) <> '' THEN trim(cs[1]) || '/' WHEN c IS NOT NULL THEN c || '/' ELSE '' END || game AS game FROM l LEFT JOIN b ON b.ord = l.ord""")
def categories(spark, d):
    word = lambda i: F.split_part("kind", F.lit(" "), F.lit(i))
    n = F.col("ord") % 5
    cs = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.concat(F.lit(" "), word(3), F.lit(" ")))).when(n == 2, F.array(F.lit(" "))).when(n == 3, F.array(F.lit(""), word(2))).otherwise(F.split("kind", " "))
    return transforms.add_category(fx.games(spark, d).withColumn("category", cs), _ORDER).select("ord", "game")


@query(f"WITH {fx.SETS} SELECT game, ord, CASE WHEN status = 'deduped' THEN 'InDatMerged' END AS dat_status FROM roms")
def check_deduped(spark, d):
    return transforms.check_deduped(fx.roms(spark, d)).select("game", "ord", "dat_status")


@query(f"WITH {fx.SETS} SELECT game, ord, CASE WHEN is_disk THEN name || '.chd' ELSE name END AS name, CASE WHEN is_disk THEN merge || '.chd' ELSE merge END AS merge FROM roms")
def set_ext(spark, d):
    return transforms.set_ext(fx.roms(spark, d)).select("game", "ord", "name", "merge")


_EQUIVALENT = " AND ".join(f"(p.{c} IS NULL OR m.{c} IS NULL OR p.{c} = m.{c})" for c in ("size", "crc", "sha1", "md5")) + " AND p.is_disk = m.is_disk"
CHAIN = f"""RECURSIVE {fx.SETS}, up AS (SELECT game, CASE WHEN rom_of IS NULL OR rom_of = game THEN clone_of ELSE rom_of END AS first, coalesce(rom_of, clone_of) AS later FROM games),
 chain AS (SELECT game, first AS ancestor, 1 AS depth, [first] AS seen FROM up WHERE first IS NOT NULL AND first <> game AND first IN (SELECT game FROM games)
  UNION ALL SELECT c.game, u.later, depth + 1, list_append(seen, u.later) FROM chain c JOIN up u ON u.game = c.ancestor WHERE u.later <> u.game AND u.later IN (SELECT game FROM games) AND NOT list_contains(seen, u.later)),
 held AS (SELECT m.game, m.ord FROM roms m WHERE m.status IS DISTINCT FROM 'nodump' AND EXISTS (SELECT 1 FROM chain c JOIN roms p ON p.game = c.ancestor WHERE c.game = m.game AND {_EQUIVALENT}))"""


@query(f"WITH {CHAIN} SELECT game, ancestor, depth FROM chain")
def parent_chain(spark, d):
    return transforms.parent_chain(fx.games(spark, d)).select("game", "ancestor", "depth")


@query(f"WITH {CHAIN}, stop AS (SELECT game, min(depth) AS d FROM chain JOIN (SELECT game AS ancestor FROM games WHERE is_bios = 'yes') USING (ancestor) GROUP BY game) SELECT game, ancestor, depth FROM chain LEFT JOIN stop USING (game) WHERE d IS NULL OR depth < d")
def parent_chain_to_bios(spark, d):
    return transforms.parent_chain(fx.games(spark, d), include_bios=False).select("game", "ancestor", "depth")


@query(f"WITH {CHAIN} SELECT r.game, r.ord, CASE WHEN h.game IS NOT NULL THEN 'InDatMerged' END AS dat_status, CASE WHEN h.game IS NOT NULL AND merge IS NULL THEN '(Auto Merged)' ELSE merge END AS merge FROM roms r LEFT JOIN held h USING (game, ord)")
def split_set(spark, d):
    return transforms.split_set(fx.games(spark, d), fx.roms(spark, d)).select("game", "ord", "dat_status", "merge")


_MERGED = f"""WITH {CHAIN}, bios AS (SELECT game FROM games WHERE is_bios = 'yes'), dropped AS (SELECT m.game, m.ord FROM roms m WHERE m.status IS DISTINCT FROM 'nodump' AND EXISTS (SELECT 1 FROM chain c JOIN bios b ON b.game = c.ancestor JOIN roms p ON p.game = c.ancestor WHERE c.game = m.game AND {_EQUIVALENT})),
 top AS (SELECT game, arg_max(ancestor, depth) AS top FROM chain WHERE ancestor NOT IN (SELECT game FROM bios) GROUP BY game),
 kept AS (SELECT r.*, top FROM roms r LEFT JOIN top USING (game) WHERE NOT EXISTS (SELECT 1 FROM dropped x WHERE x.game = r.game AND x.ord = r.ord))"""


@query(f"{_MERGED} SELECT coalesce(top, game) AS game, ord, name, coalesce(size, -1) AS size, sha1 FROM kept")
def merge_set(spark, d):
    return transforms.merge_set(fx.games(spark, d), fx.roms(spark, d)).select("game", "ord", "name", F.coalesce("size", F.lit(-1)).alias("size"), "sha1")


@query(f"{_MERGED} SELECT coalesce(top, game) AS game, ord, CASE WHEN top IS NOT NULL AND NOT is_disk THEN game || '/' ELSE '' END || name AS name FROM kept")
def merge_set_named(spark, d):
    return transforms.merge_set(fx.games(spark, d), fx.roms(spark, d), with_game_name=True).select("game", "ord", "name")


_DEVICES = f"""WITH RECURSIVE {fx.SETS}, refs AS (SELECT game, CASE WHEN ord % 10 <> 0 THEN 'g' || (ord - ord % 10) WHEN ord % 100 <> 0 THEN 'g' || (ord + 1) END AS device FROM games UNION SELECT game, 'g' || (ord + 3) FROM games WHERE ord % 9 = 0),
 known AS (SELECT * FROM refs WHERE device IN (SELECT game FROM games)), closure AS (SELECT * FROM known UNION SELECT c.game, k.device FROM closure c JOIN known k ON k.game = c.device)"""


def _with_devices(spark, d):
    n, g = F.col("ord"), lambda x: F.concat(F.lit("g"), x.cast("string"))
    refs = F.array_compact(F.array(F.when(n % 10 != 0, g(n - n % 10)).when(n % 100 != 0, g(n + 1)), F.when(n % 9 == 0, g(n + 3))))
    return fx.games(spark, d).withColumn("device_ref", refs)


@query(f"{_DEVICES} SELECT game, device FROM closure")
def device_closure(spark, d):
    return transforms.device_closure(_with_devices(spark, d))


@query(f"""{_DEVICES} SELECT game, name, sha1 FROM roms UNION ALL SELECT c.game, m.name, m.sha1 FROM closure c JOIN roms m ON m.game = c.device WHERE NOT EXISTS (SELECT 1 FROM roms o WHERE o.game = c.game AND o.name = m.name AND o.sha1 = m.sha1)""")
def non_merge_set(spark, d):
    return transforms.non_merge_set(_with_devices(spark, d), fx.roms(spark, d)).select("game", "name", "sha1")


#: Names of this table have digits of one place only, so that the order of text is the alphanumeric one.
_SURVIVORS = f"""WITH {fx.COPIES}, k AS (SELECT game, sha1, min(CAST(contains(name, '/') AS INT)) AS deep, list({{'n': name, 'o': ord}} ORDER BY ord) AS l FROM copies GROUP BY game, sha1),
 f AS (SELECT game, list_reduce(l, lambda a, b: CASE WHEN split_part(a.n, '/', 1) = split_part(b.n, '/', 1) AND a.n >= b.n THEN b ELSE a END).o AS ord FROM k WHERE deep = 1),
 s AS (SELECT game, ord FROM f UNION ALL SELECT game, min(ord) FROM copies JOIN k USING (game, sha1) WHERE deep = 0 AND NOT contains(name, '/') GROUP BY game, sha1, name)"""


@query(f"{_SURVIVORS} SELECT game, ord, name FROM s JOIN copies USING (game, ord)")
def dedupe_set(spark, d):
    return transforms.remove_duplicates(fx.copies(spark, d)).select("game", "ord", "name")


@query(f"WITH {fx.COPIES} SELECT game, CASE WHEN contains(name, '/') THEN max(ord) ELSE min(ord) END AS ord, name FROM copies GROUP BY game, sha1, name")
def dedupe_set_by_name(spark, d):
    return transforms.remove_duplicates(fx.copies(spark, d), test_name=True).select("game", "ord", "name")


#: The walk of a content's files in order: a file stays unless one that stayed before it has its name or its merge name.
_BY_MERGE = f"""WITH RECURSIVE {fx.COPIES}, a AS (SELECT *, row_number() OVER (PARTITION BY game, sha1 ORDER BY ord) AS i FROM copies WHERE NOT contains(name, '/')),
 w AS (SELECT game, sha1, i, name, ord, [name] AS names, TRUE AS stays FROM a WHERE i = 1 UNION ALL SELECT a.game, a.sha1, a.i, a.name, a.ord, CASE WHEN list_contains(names, a.name) OR list_contains(names, a.merge) THEN names ELSE list_append(names, a.name) END, NOT (list_contains(names, a.name) OR list_contains(names, a.merge)) FROM w JOIN a ON a.game = w.game AND a.sha1 = w.sha1 AND a.i = w.i + 1),
 k AS (SELECT game, sha1, list({{'n': name, 'o': ord}} ORDER BY ord) AS l FROM copies GROUP BY game, sha1 HAVING min(CAST(contains(name, '/') AS INT)) = 1),
 f AS (SELECT game, list_reduce(l, lambda a, b: CASE WHEN split_part(a.n, '/', 1) = split_part(b.n, '/', 1) AND a.n >= b.n THEN b ELSE a END).o AS ord FROM k)"""


@query(f"{_BY_MERGE} SELECT game, ord FROM w WHERE stays UNION ALL SELECT game, ord FROM f")
def dedupe_set_by_merge(spark, d):
    return transforms.remove_duplicates(fx.copies(spark, d), test_with_merge_name=True).select("game", "ord")


_FOLD = "translate(n, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
STEMS = """st AS (SELECT *, regexp_extract(name, '([^/]*)$', 1) AS b FROM nodes), stems AS (SELECT *, CASE WHEN regexp_matches(b, '^.+\\.[^.]*$') THEN regexp_extract(b, '^(.+)\\.[^.]*$', 1) ELSE b END AS n FROM st)"""


@query(f"WITH {fx.NODES}, {STEMS}, k AS (SELECT dat, {_FOLD} AS key, arg_min(n, ord) AS set_name FROM stems GROUP BY ALL) SELECT node_id, set_name FROM stems s JOIN k ON k.dat = s.dat AND k.key = {_FOLD.replace('n,', 's.n,')}")
def files_as_games(spark, d):
    return transforms.files_as_games(fx.nodes(spark, d), ["dat"]).select("node_id", "set_name")


@query(f"WITH {fx.NODES}, {STEMS} SELECT node_id, n AS stem, CASE WHEN regexp_matches(b, '^.+\\.[^.]*$') THEN translate(regexp_extract(b, '^.+\\.([^.]*)$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS extension FROM stems")
def path_parts(spark, d):
    return fx.nodes(spark, d).select("node_id", tx.stem(F.col("name")).alias("stem"), tx.extension(F.col("name")).alias("extension"))


@query(f"WITH {fx.NODES} SELECT node_id, replace(dat || '/' || game, '/', chr(92)) AS game FROM nodes")
def dir_flatten(spark, d):
    n = fx.nodes(spark, d).select("node_id", F.split(F.concat_ws("/", "dat", F.substring_index("game", "/", 1)), "/").alias("path"), F.substring_index("game", "/", -1).alias("game"))
    return transforms.directory_flatten(n).select("node_id", "game")


EXPAND = f"""RECURSIVE {fx.NODES}, up AS (SELECT DISTINCT game, regexp_replace(name, '/[^/]*$', '') AS p FROM nodes WHERE contains(name, '/') UNION SELECT game, regexp_replace(p, '/[^/]*$', '') FROM up WHERE contains(p, '/'))"""


@query(f"WITH {EXPAND} SELECT game, p AS node_path, TRUE AS is_dir, NULL AS size FROM up UNION ALL SELECT game, name, FALSE, size FROM nodes")
def dir_expand(spark, d):
    return transforms.directory_expand(fx.nodes(spark, d))


@query(f"WITH {EXPAND} SELECT game, p || '/' AS name, CAST(0 AS BIGINT) AS size, '00000000' AS crc FROM up UNION ALL SELECT game, name, size, crc FROM nodes")
def archive_flatten(spark, d):
    parts = F.split("name", "/")
    n = fx.nodes(spark, d).select("game", "size", "crc", F.slice(parts, 1, F.size(parts) - 1).alias("path"), F.element_at(parts, -1).alias("name"))
    return transforms.archive_flatten(n)


@query(f"WITH {fx.NODES}, k AS (SELECT dat, lower(name) AS l, count(*) AS c FROM nodes GROUP BY ALL), t AS (SELECT dat, max(c) > 1 AS own_dir FROM k GROUP BY dat) SELECT node_id, own_dir FROM nodes JOIN t USING (dat)")
def single_level(spark, d):
    return transforms.single_level(fx.nodes(spark, d), ["dat"]).select("node_id", "own_dir")


_TYPED = "CASE ord % 5 WHEN 0 THEN 'Dir' WHEN 1 THEN 'Zip' ELSE 'File' END"


@query(f"""WITH {fx.NODES}, t AS (SELECT node_id, name, dat, ord, {_TYPED} AS kind FROM nodes), k AS (SELECT *, row_number() OVER (PARTITION BY dat, kind, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ORDER BY name, ord) - 2 AS i, regexp_extract(name, '[^/]*$') AS last FROM t)
 SELECT node_id, CASE WHEN i < 0 THEN name WHEN kind <> 'File' OR strpos(last[2:], '.') = 0 THEN name || '_' || i ELSE name[: length(name) - length(regexp_extract(last, '[^.]*$')) - 1] || '_' || i || '.' || regexp_extract(last, '[^.]*$') END AS name FROM k""")
def fix_dupe_names(spark, d):
    n = fx.nodes(spark, d).withColumn("game", F.col("dat")).withColumn("file_type", F.when(F.col("ord") % 5 == 0, "Dir").when(F.col("ord") % 5 == 1, "Zip").otherwise("File"))
    return transforms.fix_duplicate_names(n).select("node_id", "name")


@query(f"WITH {fx.MEMBERS} SELECT DISTINCT name, regexp_replace(replace(replace(replace(name, chr(92), '/'), './', '/'), './', '/'), '[\\x00-\\x1f<>:\"|?*]', '-', 'g') AS clean FROM members")
def clean_names(spark, d):
    return fx.members(spark, d).select("name", transforms.clean_name(F.col("name")).alias("clean")).distinct()


@query("""WITH t AS (SELECT DISTINCT crc AS raw FROM scanned_file UNION SELECT DISTINCT sha1 FROM scanned_file) , c AS (SELECT raw, regexp_replace(lower(trim(raw)), '^0x', '') AS x FROM t)
 SELECT raw, CASE WHEN x = '' OR x = '-' OR NOT regexp_full_match(CASE WHEN length(x) < 8 THEN lpad(x, 8, '0') ELSE x END, '[0-9a-f]+') OR length(CASE WHEN length(x) < 8 THEN lpad(x, 8, '0') ELSE x END) % 2 = 1 THEN NULL WHEN length(x) < 8 THEN lpad(x, 8, '0') ELSE x END AS clean FROM c""")
def clean_hash(spark, d):
    t = spark.read.parquet(f"{d}/scanned_file.parquet")
    raw = t.select(F.col("crc").alias("raw")).union(t.select("sha1")).distinct()
    return raw.select("raw", tx.clean_hash(F.col("raw"), 8).alias("clean"))


# --- archives ---
_BYTES = "encode(translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
CHECKED = f"""{fx.MEMBERS}, m AS (SELECT archive, idx, replace(name, chr(92), '/') AS name, contains(name, chr(92)) AS bad FROM members), k AS (SELECT *, {_BYTES} AS f, length(name) AS n FROM m),
 o AS (SELECT *, lead(struct_pack(a := f, b := n, c := name)) OVER (PARTITION BY archive ORDER BY idx) < struct_pack(a := f, b := n, c := name) AS uns, lead(name) OVER (PARTITION BY archive ORDER BY f, n, name, idx) AS nx, lead(name) OVER (PARTITION BY archive ORDER BY f, name, idx) AS bl FROM k)"""


@query(f"WITH {CHECKED} SELECT archive, CAST(max(CASE WHEN bad THEN 8 ELSE 0 END) + max(CASE WHEN uns THEN 16 ELSE 0 END) + max(CASE WHEN suffix(name, '/') AND starts_with(bl, name) AND bl <> name THEN 32 ELSE 0 END) + max(CASE WHEN nx = name THEN 64 ELSE 0 END) AS INT) AS fault_bits FROM o GROUP BY archive")
def zip_check(spark, d):
    return archives.check_members(fx.members(spark, d)).select("archive", "fault_bits")


@query(f"WITH {fx.MEMBERS} SELECT archive, idx, CAST(row_number() OVER (PARTITION BY archive ORDER BY size, name) - 1 AS INT) AS zip_index FROM members")
def zip_index(spark, d):
    return archives.zip_index(fx.members(spark, d).withColumn("local_header_offset", F.col("size"))).select("archive", "idx", F.col("zip_index").cast("int").alias("zip_index"))


@query(f"""WITH {fx.MEMBERS}, m AS (SELECT archive, idx, replace(name, chr(92), '/') AS name FROM members), x AS (SELECT * FROM m a WHERE NOT (suffix(name, '/') AND EXISTS (SELECT 1 FROM m b WHERE b.archive = a.archive AND b.name <> a.name AND starts_with(b.name, a.name))))
 SELECT archive, idx, CAST(row_number() OVER (PARTITION BY archive ORDER BY {_BYTES}, length(name), name, idx) - 1 AS INT) AS position, count(*) OVER (PARTITION BY archive, name) > 1 AS repeated FROM x""")
def prepare_members(spark, d):
    return archives.prepare_members(fx.members(spark, d)).select("archive", "idx", F.col("position").cast("int").alias("position"), "repeated")


_CP437 = bytes(range(128, 256)).decode("cp437")
_NEXT, _WELL = "[89AB].", "[0-7]."
#: UTF-8 by pairs of hex digits: whole sequences, then the longest beginnings of one, then any other byte.
_WHOLE = f"(?:C[2-9A-F]|D.){_NEXT}|E0[AB].{_NEXT}|E[1-9A-CEF]{_NEXT}{_NEXT}|ED[89].{_NEXT}|F0[9AB].{_NEXT}{_NEXT}|F[1-3]{_NEXT}{_NEXT}{_NEXT}|F48.{_NEXT}{_NEXT}"
_BEGUN = f"E0[AB].|E[1-9A-CEF]{_NEXT}|ED[89].|F0[9AB].(?:{_NEXT})?|F[1-3]{_NEXT}(?:{_NEXT})?|F48.(?:{_NEXT})?"
_ENTRY_NAME = f"""CASE WHEN coalesce(flags, 0) & 2048 > 0 THEN array_to_string(list_transform(regexp_extract_all(hex(filename_bytes), '{_WELL}|{_WHOLE}|{_BEGUN}|..'), lambda t: CASE WHEN regexp_full_match(t, '{_WELL}|{_WHOLE}') THEN TRY(decode(unhex(t))) ELSE chr(65533) END), '')
 ELSE array_to_string(list_transform(regexp_extract_all(hex(filename_bytes), '..'), lambda t: CASE WHEN t < '80' THEN chr(CAST('0x' || t AS INT)) ELSE '{_CP437}'[CAST('0x' || t AS INT) - 127] END), '') END"""


@query(f"WITH {fx.MEMBERS}, c AS (SELECT DISTINCT CAST(archive_id AS VARCHAR) AS archive, {_ENTRY_NAME} AS name, uncompressed_size AS size FROM central_entry) SELECT coalesce(m.archive, c.archive) AS archive, coalesce(m.name, c.name) AS name, CASE WHEN c.name IS NULL THEN 'add' WHEN m.name IS NULL THEN 'drop' WHEN m.size = c.size THEN 'keep' ELSE 'replace' END AS action FROM members m FULL JOIN c ON c.archive = m.archive AND c.name = m.name")
def rebuild_plan(spark, d):
    c = spark.read.parquet(f"{d}/central_entry.parquet").select(F.col("archive_id").cast("string").alias("archive"), tx.entry_name(F.col("filename_bytes"), F.col("flags")).alias("name"), F.col("uncompressed_size").alias("size")).distinct()
    return archives.rebuild_plan(fx.members(spark, d), c, ["size"])


@query("SELECT DISTINCT entry_id, printf('%04d-%02d-%02d %02d:%02d:%02d', (dos_date >> 9) + 1980, (dos_date >> 5) & 15, dos_date & 31, dos_time >> 11, (dos_time >> 5) & 63, (dos_time & 31) * 2) AS stamp FROM central_entry")
def dos_date_codec(spark, d):
    t = spark.read.parquet(f"{d}/central_entry.parquet")
    return t.select("entry_id", tx.dos_text(F.shiftleft(F.col("dos_date").cast("bigint"), 16).bitwiseOR(F.col("dos_time").cast("bigint"))).alias("stamp")).distinct()


# --- rules ---
_RULES = [("src", "compress"), ("src\\lib", "loose"), ("vendor", "skip"), ("tests", "compress"), ("node_modules", "skip"), ("pkg", "loose")]


@query(f"""WITH RECURSIVE r(k, v) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _RULES)}), p AS (SELECT DISTINCT replace(path, '/', chr(92)) AS path FROM documents), x AS (SELECT path, path AS k FROM p UNION SELECT path, regexp_replace(k, '\\\\[^\\\\]*$', '') FROM x WHERE contains(k, chr(92))),
 h AS (SELECT x.path, arg_max(v, length(r.k)) AS rule FROM x JOIN r USING (k) GROUP BY x.path) SELECT p.path, rule FROM p LEFT JOIN h USING (path)""")
def rule_resolution(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.translate("path", "/", "\\").alias("path")).distinct()
    rows = spark.createDataFrame(_RULES, "dir_key string, rule string")
    return rules.resolve_rules(t, rows, "rule")


@query("SELECT doc_id, (regexp_matches(path, '(?i)^.*\\.min\\.js$') OR regexp_matches(path, '(?i)license') OR lower(path) = 'readme.md') AS ignored FROM documents")
def ignore_patterns(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet")
    return t.select("doc_id", rules.ignored(F.col("path"), ["ignore:*.min.js", "ignore:regex:license", "ignore:README.md", "*.txt"]).alias("ignored"))


def queries() -> dict:
    return {name: f for name, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in Q.items() if sql}
