"""Repair planning: which missing files can be made from what is held, and what becomes of everything held.

``nodes``: node_id, ord (order of visit), archive, game, name, size, crc, sha1, md5, dat_status, got_status, selected,
locked, deep (whether hashes were computed from content), physical (where the content lies); and, if known, alt_size,
alt_crc, alt_sha1, alt_md5 (of the content without its header), header_type, header_required (the catalog demands the
header) and from_header (the type was read from content). The result keeps base_status and plan_status apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.stats import base_status
from tallyforge.schemas import EMPTY, IN_CATALOG
from tallyforge.session import by_group, components, cut, spread_rank

LANES = ["crc", "sha1", "md5"]
WIDTH = {"crc": 8, "sha1": 40, "md5": 32}
ALT = ["alt_crc", "alt_sha1", "alt_md5"]
#: Columns that may be absent, with their types.
OPTIONAL = {"alt_size": "bigint", "alt_crc": "string", "alt_sha1": "string", "alt_md5": "string", "header_type": "string", "header_required": "boolean", "from_header": "boolean", "physical": "string"}


def completed(nodes: DataFrame) -> DataFrame:
    """Nodes with all optional columns; a node without a path of its own has its id for one."""
    out = nodes
    for c, t in OPTIONAL.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out.withColumn("header_type", F.nullif("header_type", F.lit("NOTHING"))).withColumn("physical", F.coalesce("physical", F.concat(F.lit("node:"), "node_id")))


def partitions(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held, missing): held rows are Got or Corrupt and selected or to be sorted; missing rows are selected, in the catalog and not got."""
    got = nodes.filter(F.col("got_status").isin("Got", "Corrupt") & (F.col("selected") | (F.col("dat_status") == "InToSort")))
    return got, nodes.filter((F.col("got_status") == "NotGot") & F.col("selected") & F.col("dat_status").isin(IN_CATALOG))


def zero_length() -> Column:
    """Every known hash and the size are those of empty content; with nothing known the name must end in ``/``."""
    known = [(F.col(c), EMPTY[c]) for c in LANES]
    ok, some = F.coalesce(F.col("size") == 0, F.lit(True)), F.col("size").isNotNull()
    for c, v in known:
        ok, some = ok & F.coalesce(c == v, F.lit(True)), some | c.isNotNull()
    return F.when(some, ok).otherwise(F.col("name").endswith("/"))


def _lanes(stated: bool) -> Column:
    """Identity keys of a row, with and without its header: (lane, key). Only hashes of exact width are keys; a missing size counts as 0. With ``stated`` the catalog's whole hashes also ask for the size without header."""
    size, alt_size = F.coalesce("size", F.lit(0)), F.coalesce("alt_size", "size", F.lit(0))
    one = lambda i, n, h, lane: F.when(F.length(h) == WIDTH[lane], F.struct(F.lit(i).alias("lane"), F.concat_ws(":", F.lit(lane), n.cast("string"), F.col(h)).alias("key")))
    keys = [k for i, lane in enumerate(LANES) for k in (one(i, size, lane, lane), one(i, alt_size, f"alt_{lane}", lane), *([one(i, alt_size, lane, lane)] if stated else []))]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def hash_index(rows: DataFrame, stated: bool = False) -> DataFrame:
    """One row per (lane, key) of each node."""
    return rows.withColumn("_e", F.explode(_lanes(stated))).select("*", "_e.*").drop("_e")


def location() -> Column:
    """How good a place is to take content from."""
    return F.when(F.col("dat_status") == "InDatCollect", 0).when(F.col("dat_status") == "InDatMIA", 1).when(F.col("dat_status").isin("InDatMerged", "InDatNoDump"), 2).when(F.col("dat_status") == "InToSort", 3).otherwise(4)


def consumable() -> Column:
    """A source that serves one target only: neither locked nor wanted where it is."""
    return ~F.coalesce("locked", F.lit(False)) & ~F.col("dat_status").isin("InDatCollect", "InDatMIA")


def compatible(m: str, g: str) -> Column:
    """Whether content ``g`` may stand for what the catalog states in ``m``: header types that are both known agree, a demanded header was read from the content, and hashes computed from content, whole or without header, don't contradict those stated. A stated size of 0 without hashes takes empty content."""
    c = lambda p, n: F.col(f"{p}.{n}")
    kinds = F.coalesce(c(m, "header_type") == c(g, "header_type"), F.lit(True))
    demanded = ~F.coalesce(c(m, "header_required"), F.lit(False)) | (c(g, "header_type").isNotNull() & F.coalesce(c(g, "from_header"), F.lit(False)))
    hashes = F.lit(True)
    for h in ("sha1", "md5"):
        for stated in (c(m, h), c(m, f"alt_{h}")):
            hashes = hashes & (F.coalesce(stated == c(g, h), F.lit(True)) | F.coalesce(stated == c(g, f"alt_{h}"), F.lit(False)))
    bare = c(m, "size").isNotNull() & (c(m, "size") == 0)
    for h in [*LANES, *ALT]:
        bare = bare & c(m, h).isNull()
    return F.when(bare, F.coalesce(c(g, "size") == 0, F.lit(False))).otherwise(kinds & demanded & (~F.coalesce(c(g, "deep"), F.lit(False)) | hashes))


_STATED = ["sha1", "md5", "alt_sha1", "alt_md5", "header_type", "header_required"]


def with_preference(held: DataFrame) -> DataFrame:
    """Adds how good a source is: its place, whether its content backs another row that stays, whether it is corrupt, whether it serves more than once, its order."""
    stays = (F.col("got_status") == "Got") & F.col("dat_status").isin("InDatCollect", "InDatMIA")
    backing = held.filter(stays).groupBy("physical").agg(F.count("*").alias("_backs"))
    out = held.join(backing, "physical", "left")
    shared = F.coalesce(F.col("_backs"), F.lit(0)) > F.when(stays, 1).otherwise(0)
    return out.withColumn("_once", consumable()).withColumn("_pref", F.struct(location().alias("place"), shared.alias("shared"), (F.col("got_status") == "Corrupt").alias("corrupt"), (~F.col("_once")).alias("many"), F.col("ord"), F.col("node_id"))).drop("_backs")


def assign_sources(missing: DataFrame, held: DataFrame) -> DataFrame:
    """(missing_id, source_id): the source each missing row is made from.

    Targets in order of visit take the best compatible source of the first of CRC, SHA-1 and MD5, whole or without
    header, that has one left; sources wanted nowhere else serve once. Only keys that both sides have count. Where all
    rows of all keys of a row have the same keys, and the targets state the same, the choice is closed: sources better
    than the best that serves many are dealt by rank, k-th target to k-th source, and the rest share that one; so one
    content with most of the rows is ranked over many tasks. Rows whose keys clash (equal CRC, other content) are
    replayed target by target, component by component.
    """
    columns = ["node_id", "ord", "size", *LANES, "alt_size", *ALT, "header_type", "header_required", "from_header", "deep"]
    targets = completed(missing).select(*columns, F.lit(0).alias("_side"), F.lit(False).alias("_once"))
    sources = with_preference(completed(held)).select(*columns, F.lit(1).alias("_side"), "_once", "_pref")
    rows = cut(targets.withColumn("_pref", F.lit(None).cast(dict(sources.dtypes)["_pref"])).unionByName(sources))
    keys = rows.filter("_side = 0").select("node_id", "_side", F.explode(_lanes(True)).alias("e")).unionByName(rows.filter("_side = 1").select("node_id", "_side", F.explode(_lanes(False)).alias("e"))).select("node_id", "_side", "e.key")
    both = keys.groupBy("key").agg(F.min("_side").alias("a"), F.max("_side").alias("b")).filter("a = 0 and b = 1").select("key")
    live = cut(keys.join(both, "key").select("node_id", "key"))
    sets = live.groupBy("node_id").agg(F.xxhash64(F.sort_array(F.collect_list("key"))).alias("_set"))
    pure = live.join(sets, "node_id").groupBy("key").agg((F.min("_set") == F.max("_set")).alias("pure"))
    kinds = cut(live.join(pure, "key").groupBy("node_id").agg(F.min("pure").alias("pure")).join(sets, "node_id"))
    rows = cut(rows.join(kinds, "node_id"))
    stated = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _STATED])
    first = F.struct(*dict.fromkeys([*_STATED, "size", *LANES, *ALT]))
    classes = rows.filter("pure and _side = 0").groupBy("_set").agg((F.min(stated) == F.max(stated)).alias("even"), F.first(first).alias("m"))
    even = rows.filter("pure").join(classes.filter("even"), "_set")
    fit = even.filter("_side = 1").alias("g").withColumn("_fits", compatible("m", "g")).filter("_fits")
    wanted = even.filter("_side = 0")
    best = fit.filter("not _once").groupBy("_set").agg(F.min("_pref").alias("s"))
    served = wanted.join(best, "_set", "left")
    # what serves many and lies in its place outranks all that serve once
    direct = served.filter("s is not null and s.place <= 1").select("node_id", F.col("s.node_id").alias("source_id"))
    rest = served.filter("s is null or s.place > 1")
    ranked_t = spread_rank(rest.select("_set", "node_id", "ord", F.col("s.node_id").alias("many")), ["_set"], ["ord", "node_id"])
    once = fit.filter("_once").select("_set", "_pref").join(rest.select("_set").distinct(), "_set", "left_semi").join(best, "_set", "left").filter("s is null or _pref < s")
    ranked_s = spread_rank(once.select("_set", "_pref"), ["_set"], ["_pref"]).select("_set", "rank", F.col("_pref.node_id").alias("source_id"))
    dealt = ranked_t.join(ranked_s, ["_set", "rank"], "left").select("node_id", F.coalesce("source_id", "many").alias("source_id")).filter("source_id is not null")
    out = direct.unionByName(dealt)
    uneven = rows.join(classes.filter("even").select("_set"), "_set", "left_anti")
    uneven = cut(uneven)
    if not uneven.isEmpty():
        part = components(live.join(uneven.select("node_id"), "node_id", "left_semi"), "node_id", "key")
        fields = ["component", "_side", "ord", "node_id", "_once", "deep", "from_header", "size", "alt_size", *LANES, *ALT, "header_type", "header_required", "rank"]
        flat = uneven.join(part, "node_id").withColumn("rank", F.format_string("%d%d%d%d", F.col("_pref.place"), F.col("_pref.shared").cast("int"), F.col("_pref.corrupt").cast("int"), F.col("_pref.many").cast("int")))
        out = out.unionByName(by_group(flat.select(*fields), ["component"], ["_side", "ord", "node_id"], _replay(fields), "node_id string, source_id string"))
    return out.select(F.col("node_id").alias("missing_id"), "source_id")


def _replay(fields: list[str]):
    """One component: targets in order of visit; the first lane with a compatible source that isn't spent decides."""

    def fits(t: dict, g: dict) -> bool:
        if t["size"] == 0 and all(t[h] is None for h in [*LANES, *ALT]):
            return g["size"] == 0
        if t["header_type"] and g["header_type"] and t["header_type"] != g["header_type"] or t["header_required"] and not (g["header_type"] and g["from_header"]):
            return False
        stated = [(t[x], g[h], g[f"alt_{h}"]) for h in ("sha1", "md5") for x in (h, f"alt_{h}")]
        return not g["deep"] or all(a is None or b is None or a in (b, c) for a, b, c in stated)

    def replay(group: list[tuple]) -> list[tuple]:
        rows = [dict(zip(fields, r, strict=True)) for r in group]
        held: dict[tuple, list[dict]] = {}
        for g in sorted((r for r in rows if r["_side"] == 1), key=lambda r: (r["rank"], r["ord"], r["node_id"])):
            size = g["size"] or 0
            alt_size = size if g["alt_size"] is None else g["alt_size"]
            for h in LANES:
                for k in {(h, size, g[h]), (h, alt_size, g[f"alt_{h}"])}:
                    if k[2] and len(k[2]) == WIDTH[h]:
                        held.setdefault(k, []).append(g)
        spent, out = set(), []
        for t in (r for r in rows if r["_side"] == 0):
            size = t["size"] or 0
            alt_size = size if t["alt_size"] is None else t["alt_size"]
            for h in LANES:
                found = [g for k in {(h, size, t[h]), (h, alt_size, t[h]), (h, alt_size, t[f"alt_{h}"])} for g in held.get(k, ()) if g["node_id"] not in spent and fits(t, g)]
                if found:
                    g = min(found, key=lambda r: (r["rank"], r["ord"], r["node_id"]))
                    out.append((t["node_id"], g["node_id"]))
                    if g["_once"]:
                        spent.add(g["node_id"])
                    break
        return out

    return replay


def shared_identity(held: DataFrame, path: str = "physical", status: str = "plan_status") -> DataFrame:
    """Rows whose physical path another retained row has too. Counts combine before the shuffle."""
    retains = (~F.col(status).isin("Delete", "UnNeeded", "MoveToSort")).cast("int")
    counts = held.groupBy(path).agg(F.sum(retains).alias("_kept"))
    return held.join(counts, path, "left").withColumn("shared", F.coalesce(F.col("_kept") - retains > 0, F.lit(False))).drop("_kept")


def redundant(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of which another has equal content: a semi-join on identity keys, with and without header. Both being empty, or one not read from content, the key is enough; else every further hash that both know agrees, whole or without header."""
    columns = ["node_id", "name", "size", *LANES, *ALT, "deep"]
    side = lambda df, stated: hash_index(completed(df), stated).withColumn("_empty", zero_length()).select(*columns, "_empty", "lane", "key")
    a, b = side(rows, True).alias("a"), side(others, False).alias("b")
    agree = F.lit(True)
    for h in ("sha1", "md5"):
        pair = [[F.col(f"{p}.{c}") for c in (h, f"alt_{h}")] for p in "ab"]
        known = F.coalesce(*pair[0]).isNotNull() & F.coalesce(*pair[1]).isNotNull()
        agree = agree & (~known | F.arrays_overlap(F.array_compact(F.array(*pair[0])), F.array_compact(F.array(*pair[1]))))
    read = F.coalesce("a.deep", F.lit(False)) & F.coalesce("b.deep", F.lit(False))
    same = (F.col("a._empty") & F.col("b._empty")) | ~read | agree
    return a.join(b, [F.col("a.key") == F.col("b.key"), F.col("a.node_id") != F.col("b.node_id"), same], "left_semi").select("node_id").distinct()


def rename_promotion(plan: DataFrame, by_game: bool = True) -> DataFrame:
    """Sources needed for a fix that lie where something they may stand for is to be fixed, in the same archive or, with ``by_game``, set: they are renamed there."""
    n = completed(plan)
    facts = ["header_type", "header_required", "size", *LANES, *ALT]
    place = F.array_compact(F.array(F.when(F.col("file_type").isin("FileZip", "FileSevenZip"), F.concat(F.lit("a:"), "archive")), *([F.concat(F.lit("g:"), "game")] if by_game else [])))
    m = n.filter(F.col("plan_status").isin("CanBeFixed", "CanBeFixedMIA")).select(F.explode(place).alias("at"), *facts).distinct().alias("m")
    g = n.filter("plan_status = 'NeededForFix'").withColumn("at", F.explode(place)).alias("g")
    return g.join(m, [F.col("g.at") == F.col("m.at"), compatible("m", "g")], "left_semi").select("node_id").distinct()


def complete_only(plan: DataFrame, within: str = "game", status: str = "plan_status") -> DataFrame:
    """Sets that stay incomplete lose what they hold: Correct becomes IncompleteRemove, fixable Incomplete."""
    per = plan.groupBy(within).agg(F.max(F.col(status).isin("Missing", "MissingMIA").cast("int")).alias("_gap"))
    gap = F.coalesce((F.col("_gap") == 1) & F.col(within).isNotNull(), F.lit(False))
    changed = F.when(gap & F.col(status).isin("Correct", "CorrectMIA"), "IncompleteRemove").when(gap & F.col(status).isin("CanBeFixed", "CanBeFixedMIA"), "Incomplete").otherwise(F.col(status))
    return plan.join(per, within, "left").withColumn(status, changed).drop("_gap")


def plan_fixes(nodes: DataFrame, again: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes with plan_status, assignments): targets that can be made, sources needed or to be renamed, redundant files to delete, strays to move.

    ``again`` plans as the second run does: strays aren't held against the catalog, and only a common archive makes a rename.
    """
    nodes = completed(nodes)
    nodes = nodes if "file_type" in nodes.columns else nodes.withColumn("file_type", F.lit("File"))
    held, missing = partitions(nodes)
    wanted = missing.filter(~F.col("dat_status").isin("InDatMerged", "InDatNoDump"))
    pairs = cut(assign_sources(wanted, held))
    base = base_status(F.col("dat_status"), F.col("got_status"), F.lit("File"))
    source_state = nodes.select(F.col("node_id").alias("source_id"), (F.col("got_status") == "Corrupt").alias("from_corrupt"))
    made = pairs.join(source_state, "source_id").groupBy(F.col("missing_id").alias("node_id")).agg(F.min("from_corrupt").alias("_corrupt"), F.lit(True).alias("_made"))
    made = cut(made)
    used = pairs.select(F.col("source_id").alias("node_id")).distinct().withColumn("_used", F.lit(True))
    whole = nodes.filter("got_status = 'Got'")
    good = held.filter("got_status = 'Got'")
    sorts = good.filter("dat_status = 'InToSort'")
    pending = wanted.join(made.filter("not _corrupt"), "node_id", "left_semi")
    twice = redundant(sorts, whole.filter(F.col("dat_status").isin(IN_CATALOG)).unionByName(pending))
    if not again:
        twice = twice.unionByName(redundant(good.filter("dat_status = 'NotInDat'"), whole.filter("dat_status = 'InDatCollect'")))
    twice = twice.distinct().withColumn("_twice", F.lit(True))
    backs = with_preference(held).select("node_id", F.col("_pref.shared").alias("_backed"))
    rows = nodes.withColumn("base_status", base).join(made, "node_id", "left").join(used, "node_id", "left").join(twice, "node_id", "left").join(backs, "node_id", "left")
    d, g = F.col("dat_status"), F.col("got_status")
    is_missing = (g == "NotGot") & F.col("selected") & d.isin(IN_CATALOG)
    is_held = g.isin("Got", "Corrupt") & (F.col("selected") | (d == "InToSort"))
    merged = d.isin("InDatMerged", "InDatNoDump")
    clean = F.when(F.col("_backed"), "NotCollected").otherwise("UnNeeded")
    target = F.when(merged, "NotCollected").when(F.col("_made"), F.when(F.col("_corrupt"), "CorruptCanBeFixed").when(d == "InDatMIA", "CanBeFixedMIA").otherwise("CanBeFixed")).when(d == "InDatMIA", "MissingMIA").otherwise("Missing")
    corrupt = F.when(d == "InDatCollect", "MoveToCorrupt").when(merged, clean).otherwise("Delete")
    needed = F.col("_used") & (g != "Corrupt") & ~d.isin("InDatCollect", "InDatMIA")
    sound = F.when(d == "InDatCollect", "Correct").when(d == "InDatMIA", "CorrectMIA").when(merged, clean).when(F.col("_twice"), "Delete").when(d == "InToSort", "InToSort").otherwise("MoveToSort")
    status = F.when(is_missing, target).when(is_held & needed, "NeededForFix").when(is_held & (g == "Corrupt"), corrupt).when(is_held, sound).otherwise(F.col("base_status"))
    plan = cut(rows.withColumn("plan_status", status).drop("_made", "_corrupt", "_used", "_twice", "_backed"))
    renamed = rename_promotion(plan, by_game=not again).withColumn("_rename", F.lit(True))
    return plan.join(renamed, "node_id", "left").withColumn("plan_status", F.when(F.col("_rename"), "Rename").otherwise(F.col("plan_status"))).drop("_rename"), pairs


def second_pass(plan: DataFrame) -> DataFrame:
    """The planner's second run over its own result after complete-only: missing rows are matched anew and held rows settled again, those already needed, renamed or to be moved aside as corrupt or deleted excepted."""
    carried = plan.drop("base_status").withColumnRenamed("plan_status", "_first")
    again, _ = plan_fixes(carried, again=True)
    held = F.col("got_status").isin("Got", "Corrupt") & (F.col("selected") | (F.col("dat_status") == "InToSort"))
    keep = held & F.col("_first").isin("NeededForFix", "Rename", "Delete", "MoveToCorrupt", "Correct")
    return again.withColumn("plan_status", F.when(keep & (F.col("plan_status") != "Rename"), F.col("_first")).otherwise(F.col("plan_status"))).drop("_first")


def two_pass_plan(nodes: DataFrame) -> DataFrame:
    """Both passes: plan, complete-only, plan again."""
    return second_pass(cut(complete_only(plan_fixes(nodes)[0])))


def plan_actions(plan: DataFrame, pairs: DataFrame) -> DataFrame:
    """The plan as actions; nothing touches files: (node_id, action, source_id)."""
    copies = pairs.select(F.col("missing_id").alias("node_id"), F.lit("copy").alias("action"), "source_id")
    none = F.lit(None).cast("string").alias("source_id")
    moves = plan.filter(F.col("plan_status").isin("Delete", "MoveToSort", "MoveToCorrupt")).select("node_id", F.when(F.col("plan_status") == "Delete", "delete").when(F.col("plan_status") == "MoveToSort", "move_to_sort").otherwise("move_to_corrupt").alias("action"), none)
    clean = plan.filter((F.col("plan_status") == "NeededForFix") & ~F.coalesce("locked", F.lit(False))).select("node_id", F.lit("delete_after_copy").alias("action"), none)
    return copies.unionByName(moves).unionByName(clean)


def whole_archive_moves(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target archive, source archive) where every fixable member of the target comes from that one archive and the member names and identities are the same multiset."""
    at = lambda side, name: nodes.select(F.col("node_id").alias(side), F.col("archive").alias(name))
    p = pairs.join(at("missing_id", "target"), "missing_id").join(at("source_id", "source"), "source_id")
    one = p.groupBy("target").agg(F.min("source").alias("source"), F.max("source").alias("s2"), F.count("*").alias("n")).filter("source = s2")
    size = nodes.groupBy("archive").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("name", F.coalesce("size", F.lit(0)), F.coalesce("crc", "sha1", "md5"))).alias("print"))
    t = size.select(F.col("archive").alias("target"), F.col("members").alias("tm"), F.col("print").alias("tp"))
    s = size.select(F.col("archive").alias("source"), F.col("members").alias("sm"), F.col("print").alias("sp"))
    return one.join(t, "target").join(s, "source").filter("n = tm and tm = sm and tp = sp").select("target", "source")


def delete_checked(deleting: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows to delete of which another held row that isn't deleted has the same size and all hashes that are known."""
    kept = nodes.filter((F.col("got_status") == "Got") & ~F.col("plan_status").isin("Delete", "Deleted"))
    return redundant(deleting, kept)


def retained_paths(nodes: DataFrame, path: str = "physical") -> DataFrame:
    """How many retained rows have each physical path."""
    return nodes.filter(~F.col("plan_status").isin("Delete", "UnNeeded", "MoveToSort")).groupBy(path).agg(F.count("*").alias("retained"))


def found_mia(nodes: DataFrame) -> DataFrame:
    """Files thought lost that turned up, once per (path, size, crc)."""
    return nodes.filter((F.col("dat_status") == "InDatMIA") & (F.col("got_status") == "Got")).select("name", "size", "crc").distinct()


def source_rank(sources: DataFrame, by: list[str]) -> DataFrame:
    """Candidates of each key in order of preference."""
    return spread_rank(with_preference(completed(sources)), by, ["_pref"], "preference").drop("_pref", "_once")
