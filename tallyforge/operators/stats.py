"""Base status, repair counters, and what directories and catalogs derive from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.schemas import ACTIONABLE, ARCHIVE_TYPES, DOMINANCE, FILE_COUNTERS, GAME_COUNTERS, LEAF_TYPES, STATUS_MATRIX


def form(file_type: Column) -> Column:
    return F.when(file_type.isin(LEAF_TYPES), "leaf").when(file_type.isin(ARCHIVE_TYPES), "archive").when(file_type == "Dir", "dir")


def base_status(dat_status: Column, got_status: Column, file_type: Column, ignored: Column | None = None) -> Column:
    """Status by (catalog status, found status, form) from the matrix; what it lacks is UnScanned. An ignored loose file that is held but in no catalog is Ignore."""
    key = F.concat_ws("|", dat_status, form(file_type), got_status)
    cells = [F.lit(x) for (d, f), row in STATUS_MATRIX.items() for g, s in zip(("Got", "NotGot", "Corrupt"), row, strict=True) for x in (f"{d}|{f}|{g}", s)]
    plain = F.coalesce(F.element_at(F.create_map(*cells), key), F.lit("UnScanned"))
    if ignored is None:
        return plain
    return F.when((file_type == "File") & (dat_status == "NotInDat") & (got_status == "Got") & ignored, "Ignore").otherwise(plain)


def counters(status: str = "status") -> list[Column]:
    """Aggregates over leaves: total and one counter per group of statuses."""
    count = lambda members: F.coalesce(F.sum(F.when(F.col(status).isin(members), 1).otherwise(0)), F.lit(0)).cast("bigint")
    return [F.count(F.lit(1)).cast("bigint").alias("total"), *[count(m).alias(n) for n, m in FILE_COUNTERS.items()]]


def game_counters(status: str = "status") -> list[Column]:
    return [F.count(F.lit(1)).cast("bigint").alias("games_total"), *[F.sum(F.when(F.col(status).isin(m), 1).otherwise(0)).cast("bigint").alias(f"games_{n}") for n, m in GAME_COUNTERS.items()]]


def derived() -> list[Column]:
    """Report figures from counters: what is needed counts fixes, unknown and unneeded rows too."""
    return [(F.col("missing") + F.col("fixes")).alias("report_missing"), (F.col("fixes") + F.col("unknown") + F.col("unneeded")).alias("fixes_needed")]


def stats(nodes: DataFrame, by: list[str] | None = None, status: str = "status") -> DataFrame:
    """Repair counters in total or by columns. Empty input: one row of zeros in total, none by columns."""
    return nodes.groupBy(*(by or [])).agg(*counters(status))


def stats_by_directory(nodes: DataFrame, path: str = "path", status: str = "status") -> DataFrame:
    """Counters of every directory over all leaves below it. ``path``: array of parts without the leaf. Prefixes are exploded and combine before the shuffle, so the root is no hot task."""
    levels = F.transform(F.sequence(F.lit(1), F.size(path)), lambda n: F.array_join(F.slice(path, 1, n), "/"))
    return nodes.filter(F.size(path) > 0).select(F.explode(levels).alias("directory"), F.col(status)).groupBy("directory").agg(*counters(status))


def add_stats(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Counter-wise sum of two statistics."""
    names = ["total", *FILE_COUNTERS]
    return a.unionByName(b).groupBy(*by).agg(*[F.sum(n).cast("bigint").alias(n) for n in names])


def directory_status() -> Column:
    """One status for a directory from its counters; the first rule that holds decides."""
    c = {n: F.col(n) for n in ["total", *FILE_COUNTERS]}
    t, merged = c["total"], c["not_collected"] + c["unneeded"]
    return (
        F.when((t == 0) | (c["unknown"] == t), "Unknown")
        .when((c["corrupt"] == t) | ((c["corrupt"] > 0) & (c["missing"] - c["corrupt"] == 0) & (c["correct"] + merged + c["corrupt"] + c["fixes"] == t)), "Corrupt")
        .when(merged == t, F.when((c["unneeded"] > 0) & (c["not_collected"] == 0), "UnNeeded").otherwise("NotCollected"))
        .when((c["in_to_sort"] == t) | (c["fixes"] == t), "InToSort")
        .when(c["correct"] == t, "Correct")
        .when(c["missing"] > 0, "Missing")
        .when((c["fixes"] > 0) | (c["in_to_sort"] > 0), "InToSort")
        .otherwise("Unknown")
    )


def dominant_status(nodes: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """The most telling status among the members of each group; none listed gives UnScanned."""
    rank = F.array_position(F.array(*map(F.lit, DOMINANCE)), F.col(status))
    best = F.min(F.when(rank > 0, rank))
    return nodes.groupBy(*by).agg(F.coalesce(F.element_at(F.array(*map(F.lit, DOMINANCE)), best.cast("int")), F.lit("UnScanned")).alias("dominant"))


def classify_catalogs(nodes: DataFrame, by: str, status: str = "status") -> DataFrame:
    """complete, empty, partial or null per catalog, with the three figures it follows from."""
    n = lambda members: F.sum(F.when(F.col(status).isin(members), 1).otherwise(0)).cast("bigint")
    g = nodes.groupBy(by).agg(
        n(["Correct", "CorrectMIA"]).alias("correct"),
        n(["Missing", "MissingMIA", "Corrupt", "Incomplete", "UnScanned", "Unknown"]).alias("missing"),
        n([*FILE_COUNTERS["fixes"], "UnNeeded", "NotCollected", "InToSort"]).alias("fixes"),
    )
    c, m, f = F.col("correct"), F.col("missing"), F.col("fixes")
    return g.withColumn("class", F.when((c > 0) & (m == 0) & (f == 0), "complete").when((c == 0) & (m > 0) & (f == 0), "empty").when(((c > 0) & (m > 0)) | (f > 0), "partial"))


def actionable(nodes: DataFrame, status: str = "status") -> DataFrame:
    """How many selected rows ask for an action."""
    return nodes.agg(F.sum(F.when(F.col("selected") & F.col(status).isin(ACTIONABLE), 1).otherwise(0)).cast("bigint").alias("actionable"))


def visibility() -> list[Column]:
    """Flags of a grid row from its counters."""
    c = {n: F.col(n) for n in ["total", *FILE_COUNTERS]}
    t = c["total"]
    return [
        ((t > 0) & (c["correct"] == t)).alias("show_correct"),
        ((c["missing"] > 0) | (c["missing_mia"] > 0)).alias("show_missing"),
        ((c["fixes"] > 0) | (c["unneeded"] > 0)).alias("show_fixes"),
        ((c["missing_mia"] > 0) | (c["correct_mia"] > 0) | ((t > 0) & (c["fixes"] == t))).alias("show_mia"),
        ((t > 0) & (c["not_collected"] + c["unneeded"] == t)).alias("show_merged"),
        (c["unknown"] > 0).alias("show_unknown"),
    ]


def visible(complete: bool = True, partial: bool = True, empty: bool = True, fixes: bool = True, mia: bool = True, merged: bool = True, unknown: bool = True, needle: str = "", name: str = "name") -> Column:
    """Whether a grid row is shown under seven check boxes and a substring filter."""
    f = {n: F.col(f"show_{n}") for n in ("correct", "missing", "fixes", "mia", "merged", "unknown")}
    none = ~(f["correct"] | f["missing"] | f["fixes"] | f["mia"] | f["merged"] | f["unknown"])
    shown = (F.lit(complete) & f["correct"] & ~f["missing"] & ~f["fixes"]) | (F.lit(partial) & f["correct"] & f["missing"]) | (F.lit(empty) & ~f["correct"] & f["missing"]) | (F.lit(fixes) & f["fixes"]) | (F.lit(mia) & f["mia"]) | (F.lit(merged) & f["merged"]) | (F.lit(unknown) & f["unknown"]) | none
    return shown & (F.lower(F.col(name)).contains(needle.lower()) if needle else F.lit(True))


def summary_lines(totals: DataFrame) -> DataFrame:
    """The summary as one text row per line, from total counters."""
    lines = [("1 Total", F.col("total")), ("2 Correct", F.col("correct")), ("3 Missing", F.col("missing") + F.col("fixes")), ("4 Can Fix", F.col("fixes") + F.col("unknown") + F.col("unneeded")), ("5 Corrupt", F.col("corrupt")), ("6 In ToSort", F.col("in_to_sort")), ("7 Not Collected", F.col("not_collected"))]
    return totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("line"), v.alias("count")) for k, v in lines])).alias("x")).select("x.*")
