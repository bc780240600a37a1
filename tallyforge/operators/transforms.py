"""Catalog transforms as composable operators over two flat relations.

``games``: game, ord, id, clone_of, clone_of_id, rom_of, is_bios, is_device, runnable, description, category (array),
device_ref (array). ``members``: game, ord, name, size, crc, sha1, md5, sha256, merge, status, mia, is_disk, dat_status.
Columns an operator doesn't need may be absent; columns it doesn't know pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import ascii_lower, compared, equal_or_null, stem
from tallyforge.operators import ways as ways_
from tallyforge.operators.ways import ASKS, DISK, FACTS
from tallyforge.schemas import FIXED_DOS_PACKED
from tallyforge.session import by_group, carry_last, components, cut, shuffled, sized_join, spread_rank

HASHES = ["crc", "sha1", "sha256", "md5"]
#: Members of a set whose ords agree but for so many bits are packed together (64, as a number has bits), and packs with their number likewise.
PACK_BITS, BOOK_BITS = 6, 9
#: Sets that share a way up the clone graph and are compared in one task.
WAY_SETS = 20_000


# --- row-wise ---
def set_status(members: DataFrame) -> DataFrame:
    """Catalog status from the dump status and the mia mark; a merge name that isn't blank is marked unless the row is merged already."""
    merged = F.coalesce(F.col("dat_status") == "InDatMerged", F.lit(False))
    status = F.when(F.lower("status") == "nodump", "InDatNoDump").when((F.lower("mia") == "yes") & (F.coalesce("size", F.lit(0)) != 0), "InDatMIA").otherwise("InDatCollect")
    return members.withColumn("merge", F.when(~merged & (F.coalesce("merge", F.lit("")) != ""), F.concat(F.lit("(No-Merge) "), "merge")).otherwise(F.col("merge"))).withColumn("dat_status", F.when(merged, F.col("dat_status")).otherwise(status))


def clear_description(games: DataFrame) -> DataFrame:
    """A description equal to the name's stem becomes a placeholder."""
    return games.withColumn("description", F.when(F.col("description") == stem(F.col("game")), "¤").otherwise(F.col("description")))


def expand_description(description: Column, name: Column) -> Column:
    return F.when(description == "¤", stem(name)).otherwise(description)


def add_id_numbers(games: DataFrame, within: list[str], members: DataFrame | None = None, start: str = "") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Names become ``id - name`` for every node: a set without an id takes that of the last sibling before it that has one, else ``start``; members take the id of their set.

    An empty id counts as one. With ``members`` both tables come back, else the sets alone.
    """
    carried = carry_last(games, within, ["ord"], "id", "_id").withColumn("_id", F.coalesce("_id", F.lit(start)))
    prefixed = lambda c: F.concat("_id", F.lit(" - "), c)
    named = carried.withColumn("_name", prefixed("game"))
    out = named.withColumn("game", F.col("_name")).select(*games.columns)
    if members is None:
        return out
    of = named.select(F.col("game").alias("_game"), "_id", "_name").dropDuplicates(["_game"])
    inside = members.join(of, F.col("game") == F.col("_game")).withColumn("game", F.col("_name")).withColumn("name", prefixed("name")).select(*members.columns)
    return out, inside


def match_clone_ids(games: DataFrame) -> DataFrame:
    """clone_of becomes the name of the first game whose id is clone_of_id."""
    first = games.filter(F.col("id").isNotNull() & (F.col("id") != "")).groupBy(F.col("id").alias("clone_of_id")).agg(F.min(F.struct("ord", "game")).alias("f")).select("clone_of_id", F.col("f.game").alias("_of"))
    return games.join(first, "clone_of_id", "left").withColumn("clone_of", F.coalesce("_of", "clone_of")).drop("_of").select(*games.columns)


def strip_fields(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast(dict(df.dtypes)[n]) for n in names if n in df.columns})


def strip_dates(members: DataFrame) -> DataFrame:
    """Dates go, except inside sets of the dated zip structure."""
    return members.withColumn("date_modified", F.when(F.col("zip_struct") == "ZipTDC", F.col("date_modified")))


def check_deduped(members: DataFrame) -> DataFrame:
    return members.withColumn("dat_status", F.when(F.lower("status") == "deduped", "InDatMerged").otherwise(F.col("dat_status")))


def set_ext(members: DataFrame) -> DataFrame:
    """Disks get ``.chd`` on name and merge."""
    disk = F.coalesce(F.col("is_disk"), F.lit(False))
    chd = lambda c: F.when(disk & F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.col(c), F.lit(".chd"))).otherwise(F.col(c))
    return members.withColumn("name", chd("name")).withColumn("merge", chd("merge"))


def set_compression(members: DataFrame, structure: str, archive: str = "Zip") -> DataFrame:
    """File type and structure for all members of sets; a dated set whose members all carry the fixed stamp becomes a plain one."""
    fixed = F.min((F.coalesce("date_modified", F.lit(-1)) == FIXED_DOS_PACKED).cast("int")).over(Window.partitionBy("game"))
    kind = {"Zip": "FileZip", "SevenZip": "FileSevenZip", "Dir": "File"}[archive]
    return members.withColumn("file_type", F.lit(kind)).withColumn("zip_struct", F.when((F.lit(structure) == "ZipTDC") & (fixed == 1), "ZipTrrnt").otherwise(structure))


def clean_name(c: Column) -> Column:
    """``\\`` to ``/``, ``./`` to ``/`` twice, what file systems refuse to ``-``."""
    slashed = F.replace(F.replace(F.translate(c, "\\", "/"), F.lit("./"), F.lit("/")), F.lit("./"), F.lit("/"))
    return F.regexp_replace(slashed, r'[\x00-\x1f<>:"|?*]', "-")


def clean_name_full(c: Column, file_type: Column) -> Column:
    """Blanks before the name go; after it blanks, and dots of files and directories, too; members of archives stay. What is blank then is ``_``."""
    left = F.regexp_replace(c, "^ +", "")
    t = F.when(file_type.isin("UnSet", "File", "Dir"), F.regexp_replace(left, "[. ]+$", "")).when(file_type.isin("Zip", "SevenZip"), F.regexp_replace(left, " +$", "")).otherwise(c)
    return F.when(F.trim(t) == "", "_").otherwise(t)


def add_category(games: DataFrame, order: list[str]) -> DataFrame:
    """Names become ``category/name``: a set's only category, or of several the one that comes first in ``order``, spelled as there. Blank ones are none, but count."""
    lowered = F.transform("category", lambda x: ascii_lower(F.trim(x)))
    listed = F.array(*[F.struct(ascii_lower(F.lit(o)).alias("key"), F.lit(o).alias("name")) for o in order]) if order else F.array().cast("array<struct<key:string,name:string>>")
    first = F.try_element_at(F.filter(listed, lambda o: (o["key"] != "") & F.array_contains(lowered, o["key"])), F.lit(1))["name"]
    only = F.trim(F.try_element_at("category", F.lit(1)))
    chosen = F.when(F.size("category") == 1, F.when(only != "", only)).when(F.size("category") > 1, first)
    return games.withColumn("game", F.when(chosen.isNotNull(), F.concat(chosen, F.lit("/"), F.col("game"))).otherwise(F.col("game")))


# --- filters ---
def remove_no_dumps(members: DataFrame) -> DataFrame:
    return members.filter(F.coalesce(F.lower("status") != "nodump", F.lit(True)))


def remove_disks(members: DataFrame, keep: bool = False) -> DataFrame:
    """Without disks, or with ``keep`` nothing but disks."""
    disk = F.coalesce(F.col("is_disk"), F.lit(False))
    return members.filter(disk if keep else ~disk)


def remove_not_collected(members: DataFrame) -> DataFrame:
    return members.filter(F.col("dat_status").isin("InDatCollect", "InDatNoDump"))


def remove_empty_sets(games: DataFrame, members: DataFrame) -> DataFrame:
    return games.join(members.select("game").distinct(), "game", "left_semi")


def remove_files_not_in_games(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("is_dir") | F.col("in_game"))


def remove_devices(games: DataFrame) -> DataFrame:
    """Devices that can't run alone go; the words are compared as they are. Loose files (``is_file``, if there) go, too."""
    kept = games.filter(~((F.coalesce("is_device", F.lit("")) == "yes") & (F.coalesce("runnable", F.lit("")) == "no")))
    return kept.filter(~F.coalesce("is_file", F.lit(False))) if "is_file" in games.columns else kept


def remove_unneeded_markers(members: DataFrame) -> DataFrame:
    """Zero-size names that end in ``/`` go if another name of the set lies below them. Proper prefixes are exploded and joined on equality; dated sets are exempt if ``zip_struct`` is there."""
    parts = F.split("name", "/")
    above = members.select("game", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))).alias("prefix")).filter("prefix <> name")
    exempt = F.col("zip_struct") == "ZipTDC" if "zip_struct" in members.columns else F.lit(False)
    flagged = members.join(above.select("game", F.col("prefix").alias("name"), F.lit(True).alias("_has")).distinct(), ["game", "name"], "left")
    return flagged.filter(~(F.coalesce("_has", F.lit(False)) & F.col("name").endswith("/") & (F.coalesce("size", F.lit(0)) == 0) & ~F.coalesce(exempt, F.lit(False)))).select(*members.columns)


# --- structure ---
def files_as_games(files: DataFrame, within: list[str]) -> DataFrame:
    """Loose files become members of sets by stem, whatever its ASCII case; the first file's spelling names the set."""
    key = ascii_lower(stem(F.col("name")))
    keyed = files.withColumn("_key", key)
    names = keyed.groupBy(*within, "_key").agg(F.min(F.struct("ord", stem(F.col("name")).alias("game"))).alias("f")).select(*within, "_key", F.col("f.game").alias("set_name"))
    return keyed.join(names, [*within, "_key"]).drop("_key")


def directory_flatten(games: DataFrame) -> DataFrame:
    """Sets move to the top under their joined path (array column ``path``)."""
    return games.withColumn("game", F.array_join(F.concat("path", F.array("game")), "\\")).withColumn("path", F.array().cast("array<string>"))


def archive_flatten(members: DataFrame) -> DataFrame:
    """Inside a set, names take their path and directories become zero-size rows with the CRC of nothing. ``path``: array of directories inside the set."""
    flat = members.select(F.col("game"), F.array_join(F.concat("path", F.array("name")), "/").alias("name"), "size", "crc")
    dirs = members.filter(F.size("path") > 0).select("game", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.concat(F.array_join(F.slice("path", 1, n), "/"), F.lit("/")))).alias("name")).distinct()
    return flat.unionByName(dirs.select("game", "name", F.lit(0).cast("bigint").alias("size"), F.lit("00000000").alias("crc")))


def directory_expand(files: DataFrame) -> DataFrame:
    """Names with ``/`` become nested directories: game, path (of the node), is_dir, size."""
    parts = F.split("name", "/")
    leaves = files.filter(~F.col("name").endswith("/")).select("game", F.col("name").alias("node_path"), F.lit(False).alias("is_dir"), "size")
    dirs = files.select("game", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))).alias("node_path")).distinct()
    return leaves.unionByName(dirs.select("game", "node_path", F.lit(True).alias("is_dir"), F.lit(None).cast("bigint").alias("size")))


def single_level(members: DataFrame, within: list[str], mode: str = "RemoveAllIfNoConflicts") -> DataFrame:
    """Which sets keep a directory of their own (``own_dir``).

    KeepAllSubDirs keeps all, RemoveAllSubDirs none; RemoveAllIfNoConflicts removes all unless two members of a catalog
    have one name whatever its case; RemoveSubIfSingleFiles and RemoveSubIfNameMatches remove those of sets with one
    member, the latter only if it is named as the set.
    """
    if mode in ("KeepAllSubDirs", "RemoveAllSubDirs"):
        return members.withColumn("own_dir", F.lit(mode == "KeepAllSubDirs"))
    if mode == "RemoveAllIfNoConflicts":
        twice = members.groupBy(*within, F.lower("name").alias("_n")).count().groupBy(*within).agg((F.max("count") > 1).alias("own_dir"))
        return members.join(twice, within)
    size = members.groupBy(*within, "game").agg(F.count("*").alias("_n"))
    one = F.col("_n") == 1
    match = one & (stem(F.col("name")) == F.col("game")) if mode == "RemoveSubIfNameMatches" else one
    return members.join(size, [*within, "game"]).withColumn("own_dir", ~match).drop("_n")


def move_up_disks(members: DataFrame) -> DataFrame:
    """Disks leave their archive for a directory of the set's name two levels up. ``path``: array that ends in the archive."""
    disk = F.coalesce(F.col("is_disk"), F.lit(False)) & (F.size("path") >= 1)
    up = F.concat(F.slice("path", 1, F.greatest(F.size("path") - 2, F.lit(0))), F.array(F.regexp_replace(F.element_at("path", -1), r"(?i)\.(zip|7z)$", "")))
    return members.withColumn("path", F.when(disk, up).otherwise(F.col("path")))


def fix_duplicate_names(members: DataFrame) -> DataFrame:
    """The second and later of equal names (whatever the ASCII case) of one file type in a set get ``_0``, ``_1``, ..., in order of name and ord: files before the extension, directories and archives at the end. Without file_type all are files."""
    columns = members.columns
    members = members if "file_type" in members.columns else members.withColumn("file_type", F.lit("File"))
    ranked = spread_rank(members.withColumn("_fold", ascii_lower(F.col("name"))), ["game", "file_type", "_fold"], ["name", "ord"], "_rank")
    n = (F.col("_rank") - 2).cast("string")
    dotted = r"^((?:.*/)?[^/]+)(\.[^./]*)$"
    whole = F.col("file_type").isin("Dir", "Zip", "SevenZip") | ~F.col("name").rlike(dotted)
    named = F.when(whole, F.concat("name", F.lit("_"), n)).otherwise(F.concat(F.regexp_extract("name", dotted, 1), F.lit("_"), n, F.regexp_extract("name", dotted, 2)))
    return ranked.withColumn("name", F.when(F.col("_rank") < 2, F.col("name")).otherwise(named)).select(*columns)


# --- clone graph ---
def _by_name(games: DataFrame) -> DataFrame:
    """The first set of each name, and of each type if there is one."""
    keys = ["game", *(["file_type"] if "file_type" in games.columns else [])]
    rest = [c for c in games.columns if c not in keys]
    return games.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*keys, "r.*") if "ord" in rest else games.dropDuplicates(keys)


def _ways(games: DataFrame, include_bios: bool = True) -> tuple[DataFrame, DataFrame]:
    """What a set names first, (game, first), and the ways up from there, (first, ancestor, depth, bios), each with file_type if there is one.

    A way depends on its first ancestor only, so sets that name the same one share it, and only sets that are named by
    another are looked up. Each step is an equi-join on the frontier; as many steps as the graph is deep.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in games.columns else F.lit("")
    typed = ["file_type"] if "file_type" in games.columns else []
    sets = _by_name(games.select("game", *typed, *(["ord"] if "ord" in games.columns else []), text("rom_of").alias("rom"), F.col("rom_of").isNotNull().alias("stated") if "rom_of" in games.columns else F.lit(False).alias("stated"), text("clone_of").alias("clone"), (text("is_bios") == "yes").alias("bios")))
    other = lambda c: F.when((c != "") & (c != F.col("game")), c)
    first = F.when(other(F.col("rom")).isNull(), F.col("clone")).otherwise(F.col("rom"))
    sets = cut(sets.select("game", *typed, other(first).alias("first"), other(F.when(F.col("stated"), F.col("rom")).otherwise(F.col("clone"))).alias("later"), "bios"))
    begin = sets.filter("first is not null").select("game", *typed, "first")
    named = begin.select(F.col("first").alias("game"), *typed).unionByName(sets.filter("later is not null").select(F.col("later").alias("game"), *typed)).distinct()
    known = cut(sets.join(shuffled(named), ["game", *typed], "left_semi").select(F.col("game").alias("ancestor"), *typed, "later", "bios"))
    stop = lambda df: df if include_bios else df.filter(~F.col("bios"))
    frontier = cut(stop(known.join(shuffled(begin.select(F.col("first").alias("ancestor"), *typed).distinct()), ["ancestor", *typed], "left_semi").select(F.col("ancestor").alias("first"), *typed, "ancestor", F.lit(1).alias("depth"), F.array("ancestor").alias("seen"), "later", "bios")))
    out = frontier
    while not frontier.isEmpty():
        step = sized_join(frontier.filter("later is not null").select("first", *typed, F.col("later").alias("ancestor"), "depth", "seen"), known, ["ancestor", *typed], "inner")
        step = step.filter(~F.array_contains("seen", F.col("ancestor"))).select("first", *typed, "ancestor", (F.col("depth") + 1).alias("depth"), F.concat("seen", F.array("ancestor")).alias("seen"), "later", "bios")
        frontier = cut(stop(step))
        out = out.unionByName(frontier)
    return begin, out.select("first", *typed, "ancestor", "depth", "bios")


def parent_chain(games: DataFrame, include_bios: bool = True) -> DataFrame:
    """(game, ancestor, depth, bios): rom_of, unless it is missing or the set itself, else clone_of, followed by name among sets of the same type until it is missing, a set names itself, or a set comes again; without ``include_bios`` it stops before a BIOS.

    Behind the first step rom_of holds wherever it is stated. A set that comes round to itself is its own ancestor.
    """
    begin, ways = _ways(games, include_bios)
    return begin.join(shuffled(ways), [c for c in begin.columns if c != "game"]).select("game", "ancestor", "depth", "bios")


def file_equivalent(a: str, b: str) -> Column:
    """Size, every hash and the disk mark equal, or null on a side: rows without hashes match all of their size."""
    return F.reduce(F.array(*[equal_or_null(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in ["size", *HASHES]], F.coalesce(F.col(f"{a}.is_disk"), F.lit(False)) == F.coalesce(F.col(f"{b}.is_disk"), F.lit(False))), F.lit(True), lambda x, y: x & y)


def _known(prefix: str = "") -> Column:
    """Which of size and hashes a row knows, as bits."""
    return F.reduce(F.array(*[F.when(F.col(f"{prefix}{c}").isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(["size", *HASHES])]), F.lit(0), lambda x, y: x + y)


def held_above(members: DataFrame, above: DataFrame, chain: DataFrame) -> DataFrame:
    """(game, ord) of members to which an ancestor's member is equivalent (see ``file_equivalent``).

    Nulls match, so no one hash can be a key; but two rows that know given facts are equivalent if and only if they
    agree on the facts both know. There are 32 such patterns at most: rows get one key (a hash of 96 bits) for each
    pattern that the other side has, and meet by equality of (ancestor, key) in a semi-join. No pairs are formed, and a BIOS under most sets is
    spread by its members' hashes.
    """
    facts = ["size", *HASHES]
    disk = F.coalesce("is_disk", F.lit(False)).cast("int")
    child, parent = members.withColumn("_p", _known()), above.withColumn("_p", _known())
    mine = sorted(r[0] for r in child.select("_p").distinct().limit(32).collect())

    def key(mine_: Column, theirs: Column) -> list[Column]:
        """A key of 96 bits of two patterns and the facts that both know."""
        both = mine_.bitwiseAND(theirs)
        parts = [mine_, theirs, disk, *[F.when(both.bitwiseAND(F.lit(1 << i)) > 0, F.col(c).cast("string")).otherwise("") for i, c in enumerate(facts)]]
        return [F.xxhash64(*parts).alias("k1"), F.hash(*parts).alias("k2")]

    # an ancestor's patterns, so that a member asks for those only
    theirs = parent.select(F.col("game").alias("ancestor"), F.col("_p").alias("_q")).distinct()
    links = chain.select("game", "ancestor").join(shuffled(theirs), "ancestor")
    asked = child.select("game", "ord", "_p", "is_disk", *facts).join(shuffled(links), "game").select("game", "ord", "ancestor", *key(F.col("_p"), F.col("_q")))
    held = parent.withColumn("_q", F.explode(F.array(*map(F.lit, mine)) if mine else F.array().cast("array<int>"))).select(F.col("game").alias("ancestor"), *key(F.col("_q"), F.col("_p")))
    return asked.join(shuffled(held), ["ancestor", "k1", "k2"], "left_semi").select("game", "ord").distinct()


def _is_dumped(members: DataFrame) -> Column:
    return F.coalesce(F.col("status") != "nodump", F.lit(True)) if "status" in members.columns else F.lit(True)


def _dumped(members: DataFrame) -> DataFrame:
    return members.filter(_is_dumped(members)) if "status" in members.columns else members


def held_on_ways(games: DataFrame, members: DataFrame) -> DataFrame:
    """(game, book, found) of dumped members to which a member of any ancestor is equivalent (see ``file_equivalent``): their ords as bits, see ``_is_found``; laid out by game.

    Members move once, packed by set with 64-bit hashes of what they know, to the way of their set, and those of
    ancestors to each way they lie on; what ``held_above`` writes a key for, each ancestor and pattern of known facts, is
    compared in memory. A way of more than ``WAY_SETS`` sets is spread, its ancestors repeated.
    """
    begin, ways = _ways(games)
    way = [c for c in begin.columns if c != "game"]
    spread = begin.groupBy(*way).agg(F.ceil(F.count("*") / WAY_SETS).cast("int").alias("parts")).join(shuffled(ways.filter("depth = 1").select(*way)), way, "left_semi")
    named = lambda part: F.xxhash64(*way, part).alias("way")
    asking = begin.join(shuffled(spread), way).select("game", named(F.pmod(F.hash("game"), "parts")), F.lit(True).alias("asks"))
    giving = ways.join(shuffled(spread), way).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("ancestor").alias("game"), named(F.col("part")), F.lit(False).alias("asks"))
    asks = _is_dumped(members) & F.col("ord").isNotNull()
    mask = _known() + F.when(F.coalesce("is_disk", F.lit(False)), DISK).otherwise(0) + F.when(asks, ASKS).otherwise(0)
    known = [F.col("size").cast("bigint"), *[F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in FACTS[1:]]]
    ord_ = F.coalesce(F.col("ord").cast("bigint"), F.lit(0))
    rows = members.select("game", F.shiftright(ord_, PACK_BITS).alias("pack"), ord_.bitwiseAND(F.lit(63)).cast("tinyint").alias("places"), mask.cast("tinyint").alias("mask"), *[v.alias(c) for c, v in zip(FACTS, known, strict=True)])
    packs = rows.groupBy("game", "pack").agg(*[F.collect_list(c).alias(c) for c in ["places", "mask", *FACTS]])
    # packs without a way stay, emptied: an inner join would filter the members that are read here, and they would be shuffled once more than those that are marked
    placed = packs.join(shuffled(asking.unionByName(giving)), "game", "left")
    asked = F.coalesce("asks", F.lit(True))
    filled = lambda c, when: F.when(when, F.col(c)).otherwise(F.array().cast(dict(packs.dtypes)[c])).alias(c)
    placed = placed.select(F.coalesce("way", F.xxhash64("game")).alias("way"), asked.alias("asks"), F.when(asked, F.col("game")).alias("game"), "pack", filled("places", F.col("asks")), *[filled(c, F.col("way").isNotNull()) for c in ("mask", *FACTS)])
    found = placed.repartition("way").sortWithinPartitions("way", "asks").mapInArrow(ways_.held_above, f"game {dict(members.dtypes)['game']}, pack bigint, bits bigint")
    found = found.repartition("game").groupBy("game", "pack").agg(F.bit_or("bits").alias("bits"))
    return found.groupBy("game", F.shiftright("pack", BOOK_BITS).alias("book")).agg(F.map_from_entries(F.collect_list(F.struct("pack", "bits"))).alias("found"))


def _is_found(members: DataFrame, held: DataFrame) -> DataFrame:
    """``members`` with ``_in``, true for those of ``held_on_ways``. They meet by game alone, so that members that lie by game stay where they are."""
    ord_ = F.col("ord").cast("bigint")
    # not book = ..., which would be a key
    same = (F.col("game") == F.col("_game")) & (F.shiftright(ord_, PACK_BITS + BOOK_BITS) - F.col("book") == 0)
    bits = F.try_element_at("found", F.shiftright(ord_, PACK_BITS))
    out = members.join(shuffled(held.withColumnRenamed("game", "_game")), same, "left")
    return out.select(*members.columns, (F.getbit(bits, ord_.bitwiseAND(F.lit(63)).cast("int")) == 1).alias("_in"))


def split_set(games: DataFrame, members: DataFrame) -> DataFrame:
    """Members that an ancestor, BIOS included, also holds are merged, those never dumped excepted."""
    out = _is_found(members, held_on_ways(games, members))
    return out.withColumn("dat_status", F.when(F.col("_in"), "InDatMerged").otherwise(F.col("dat_status"))).withColumn("merge", F.when(F.col("_in") & (F.coalesce("merge", F.lit("")) == ""), "(Auto Merged)").otherwise(F.col("merge"))).select(*members.columns)


def merge_set(games: DataFrame, members: DataFrame, with_game_name: bool = False) -> DataFrame:
    """Members held by a BIOS ancestor are dropped, those never dumped excepted; the rest move to the topmost ancestor that is no BIOS, equal ones too; optionally under ``game/`` unless a disk."""
    chain = parent_chain(games)
    known = games.select(F.col("game").alias("ancestor"), (F.lower(F.coalesce("is_bios", F.lit(""))) == "yes").alias("bios")).dropDuplicates(["ancestor"])
    marked = cut(chain.drop("bios").join(shuffled(known), "ancestor"))
    bios = marked.filter("bios")
    in_bios = held_above(_dumped(members), members.join(shuffled(bios.select(F.col("ancestor").alias("game")).distinct()), "game", "left_semi"), bios)
    top = marked.filter("not bios").groupBy("game").agg(F.max(F.struct("depth", "ancestor")).alias("t")).select("game", F.col("t.ancestor").alias("top"))
    kept = members.join(shuffled(in_bios), ["game", "ord"], "left_anti").join(shuffled(top), "game", "left")
    name = F.when(F.col("top").isNotNull() & F.lit(with_game_name) & ~F.coalesce("is_disk", F.lit(False)), F.concat("game", F.lit("/"), "name")).otherwise(F.col("name"))
    return kept.withColumn("name", name).withColumn("game", F.coalesce("top", "game")).select(*members.columns)


def device_closure(games: DataFrame) -> DataFrame:
    """(game, device) over device references of devices, each once; a device that leads back to a set has that set as a device."""
    sets = games.select("game").distinct()
    edges = cut(games.select("game", F.explode("device_ref").alias("device")).distinct().join(shuffled(sets.withColumnRenamed("game", "device")), "device", "left_semi").select("game", "device"))
    frontier = out = edges
    while not frontier.isEmpty():
        step = sized_join(frontier.select("game", F.col("device").alias("at")), edges.select(F.col("game").alias("at"), "device"), ["at"], "inner").select("game", "device").distinct()
        frontier = cut(step.join(shuffled(out), ["game", "device"], "left_anti"))
        out = cut(out.unionByName(frontier))
    return out


def non_merge_set(games: DataFrame, members: DataFrame) -> DataFrame:
    """Members of all devices a set refers to are added, once per device, unless the set itself has one of the same name and SHA-1; an unknown SHA-1 equals none."""
    wanted = device_closure(games).join(shuffled(members.withColumnRenamed("game", "device")), "device").drop("device")
    there = members.filter("sha1 is not null").select("game", "name", "sha1").distinct()
    return members.unionByName(wanted.join(shuffled(there), ["game", "name", "sha1"], "left_anti").select(*members.columns))


# --- order ---
_RUNS = re.compile(r"([0-9]+)|([^0-9]+)")


def alphanumeric(a: str, b: str) -> int:
    """Compare run by run: digit runs by value, then the shorter first; other runs in ASCII lower case. If all runs that both have are equal the longer text comes first.

    Names with a backslash come before those without; of two with one the parts before it decide, or those behind it. An
    empty side compares equal to all, so this is no total order and never a key of a distributed sort.
    """
    if not a or not b:
        return 0
    if ("\\" in a) != ("\\" in b):
        return -1 if "\\" in a else 1
    if "\\" in a:
        (a, x), (b, y) = a.split("\\", 1), b.split("\\", 1)
        if a == b:
            a, b = x, y
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    for x, y in zip(_RUNS.finditer(a), _RUNS.finditer(b), strict=False):
        p, q = ((int(x[0]), len(x[0])), (int(y[0]), len(y[0]))) if x[1] and y[1] else (fold(x[0]), fold(y[0]))
        if p != q:
            return -1 if p < q else 1
    return len(b) - len(a)


def natural_key(name: Column) -> Column:
    """A sort key of the alphanumeric order: backslash first, digit runs by value and width, other runs folded, the longer first if all common runs are equal."""
    runs = F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    padded = F.transform(runs, lambda x: F.when(x.rlike(r"^[0-9]"), F.concat(F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), F.greatest(F.lit(20), F.length(x)), "0"), F.format_string("%06d", F.length(x)))).otherwise(ascii_lower(x)))
    return F.concat(F.when(name.contains("\\"), "0").otherwise("1"), F.array_join(padded, "\x01"), F.lit("\x01\uffff"))


def remove_duplicates(members: DataFrame, test_name: bool = False, test_with_merge_name: bool = False) -> DataFrame:
    """Within a set, of two members whose comparable hashes agree (one of crc, sha1, md5 at least) one goes.

    A name without ``/`` outlives one with it. Of two without, the later goes only if the names are equal, or, on
    request, if the earlier's name is the later's merge name; files of other names both stay. Of two with ``/`` the later
    goes if the first parts differ, else the greater in the alphanumeric order, of equals the earlier. With ``test_name``
    only equal names are compared. Size isn't compared. Members without hashes stay.

    Equality of known hashes is transitive only among members that know the same: those are settled by aggregates that
    combine before the shuffle. What shares a hash with members that know others is walked in order, component by
    component; of each name in it only the first and last member can matter.
    """
    ident = [f"_{h}" for h in HASHES]
    lanes = ["crc", "sha1", "md5"]
    rows = members.select("game", "ord", "name", *([F.coalesce("merge", F.lit("")).alias("merge")] if test_with_merge_name else []), *HASHES, *[F.coalesce(h, F.lit("")).alias(f"_{h}") for h in HASHES])
    bare = F.coalesce(*lanes).isNull()
    each = [*ident, "name", *(["merge"] if test_with_merge_name else [])]
    names = cut(rows.filter(~bare).groupBy("game", *each).agg(F.min("ord").alias("first"), F.max("ord").alias("last"), *[F.first(h).alias(h) for h in HASHES]).withColumn("slash", F.col("name").contains("/")).withColumn("id", F.xxhash64("game", *ident)))
    # classes of other knowledge, or on request of other merge names, that share a hash
    keys = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat_ws(":", "game", F.lit(c), F.col(c))) for c in lanes])))
    links = names.select("id", keys.alias("hash")).distinct()
    shared = links.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    touched = links.join(shared, "hash", "left_semi").select("id").distinct()
    if test_with_merge_name:
        touched = touched.union(names.filter("not slash and merge <> ''").select("id")).distinct()
    touched = cut(touched)
    even = names.join(touched, "id", "left_anti")
    kept = [members.filter(bare).select("game", "ord"), _settled(even, ident, test_name)]
    if not touched.isEmpty():
        uneven = names.join(touched, "id", "left_semi")
        part = components(uneven.select("id", keys.alias("hash")), "id", "hash")
        ends = F.explode(F.array_distinct(F.array("first", "last"))).alias("ord")
        walked = uneven.join(part, "id").select("game", "component", ends, "name", *(["merge"] if test_with_merge_name else [F.lit(None).cast("string").alias("merge")]), *HASHES)
        kept.append(by_group(walked, ["game", "component"], ["ord"], _walk(test_name, test_with_merge_name), "game string, ord bigint"))
    ords = kept[0].unionByName(kept[1])
    for k in kept[2:]:
        ords = ords.unionByName(k)
    return members.join(ords, ["game", "ord"], "left_semi")


def _settled(names: DataFrame, ident: list[str], test_name: bool) -> DataFrame:
    """Survivors of classes whose members all know the same hashes."""
    if test_name:
        return names.select("game", F.when(F.col("slash"), F.col("last")).otherwise(F.col("first")).cast("bigint").alias("ord"))
    head = F.substring_index("name", "/", 1)
    classes = names.groupBy("game", *ident).agg(F.min("slash").alias("_all"), F.min_by(head, F.when(F.col("slash"), F.col("first"))).alias("_head"))
    n = names.join(classes, ["game", *ident])
    plain = n.filter("not slash").select("game", F.col("first").alias("ord"))
    deep = n.filter(F.col("_all") & (head == F.col("_head"))).groupBy("game", *ident).agg(F.min(F.struct(natural_key(F.col("name")).alias("k"), (-F.col("last")).alias("o"))).alias("m"))
    return plain.unionByName(deep.select("game", (-F.col("m.o")).alias("ord"))).select("game", F.col("ord").cast("bigint").alias("ord"))


def _walk(test_name: bool, test_with_merge_name: bool):
    """One component in order: pairs that agree are settled one after the other, from the front, until none is left."""

    def loser(a: tuple, b: tuple) -> int | None:
        """0 or 1 for the one that goes, null if both stay."""
        x, y = a[1] or "", b[1] or ""
        if test_name and x != y:
            return None
        pairs = [(p, q) for p, q in zip(a[3:], b[3:], strict=True)]
        known = [p is not None and q is not None for p, q in pairs]
        if any(k and p != q for k, (p, q) in zip(known, pairs, strict=True)) or not (known[0] or known[1] or known[3]):
            return None
        if ("/" in x) != ("/" in y):
            return 0 if "/" in x else 1
        if "/" not in x:
            return 1 if x == y or test_with_merge_name and x == (b[2] or "") else None
        return 1 if x.split("/")[0] != y.split("/")[0] else 0 if alphanumeric(x, y) >= 0 else 1

    def walk(group: list[tuple]) -> list[tuple]:
        # a row is game, component, ord, name, merge and the hashes
        game, out, alive = group[0][0], [], [r[2:] for r in group]
        while alive:  # the front row meets each later one; it leaves when it loses, or stays when it has met all
            front, rest = alive[0], alive[1:]
            for i, other in enumerate(rest):
                gone = loser(front, other)
                if gone == 1:
                    rest[i] = None
                elif gone == 0:
                    break
            else:
                out.append((game, int(front[0])))
            alive = [r for r in rest if r is not None]
        return out

    return walk
