"""Session helpers: reading tables, the shared folder, joins whose strategy depends on a checked size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and holds at most so many rows.
BROADCAST_ROWS = 200_000
#: A key of at most so many rows may be ranked by a window in one task.
WINDOW_ROWS = 500_000
#: Copies of the other side when the counted side is larger and the keys may be hot.
SALTS = 16


def get_session(app: str = "tallyforge", cores: int | str = "*") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One table of a data folder; ``columns`` prunes clashing or unneeded columns at the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster must name its shared folder in spark.checkpoint.dir")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor costs no recomputation and lineage ends here."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled whatever Spark takes it for: estimates go by the bytes of compressed files and miss what explodes, and a broadcast by estimate has no bound in the driver."""
    return df.hint("merge")


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", limit: int | None = None) -> DataFrame:
    """Join a large side with one that is usually small.

    ``right`` is materialised and counted. Up to ``limit`` rows (``BROADCAST_ROWS``) it is broadcast, so hot keys of ``left``
    don't move. Beyond that both sides are shuffled, with the keys of ``left`` spread over ``SALTS`` salts
    and ``right`` repeated once per salt, so that no task gets all rows of one key.
    """
    right = cut(right)
    if right.count() <= (BROADCAST_ROWS if limit is None else limit):
        return left.join(F.broadcast(right), on, how)
    salted = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(shuffled(spread), [*on, "_salt"], how).drop("_salt")


def split_join(left: DataFrame, right: DataFrame, on: list[str], limit: int | None = None) -> DataFrame:
    """Left join of a large side with one that is large, too, and has each key once.

    A small ``right`` (counted) is broadcast. Else the keys that hold more than their share of ``left`` are told from a
    sample, and their rows, which would pile up in a task, meet the few rows of ``right`` by broadcast; all other rows
    are shuffled by key. The sample decides the way only, never the result. Rows with a null key meet nothing and don't move.
    """
    if right.count() <= (BROADCAST_ROWS if limit is None else limit):
        return left.join(F.broadcast(right), on, "left")
    null = F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    rest = left.filter(~null)
    share = 1 / (4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = rest.select(*on).sample(0.02, seed=7).groupBy(*on).count()
    total = sample.agg(F.sum("count")).first()[0] or 0
    hot = cut(sample.filter((F.col("count") > share * total) & (F.col("count") > 100)).select(*on))  # 4 x partitions keys at most
    held = cut(right.join(F.broadcast(hot), on, "left_semi"))
    columns = [*left.columns, *[c for c in right.columns if c not in on]]
    cold = rest.join(F.broadcast(hot), on, "left_anti").join(shuffled(right), on, "left").select(*columns)
    warm = rest.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(held), on, "left").select(*columns)
    none = left.filter(null).select("*", *[F.lit(None).cast(t).alias(c) for c, t in right.dtypes if c not in on])
    return cold.unionByName(warm).unionByName(none)


def spread_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Rank from 1 within ``keys`` by ``order``, without sorting a hot key in one task.

    The largest key is counted first; up to ``WINDOW_ROWS`` rows a window does. Beyond that rows are cut into ranges of (keys, order); ranks within a key and range are local, and each range adds the rows that
    ranges before it hold of the same key. ``order`` must tell rows of a key apart, or their ranks are arbitrary.
    """
    from pyspark.sql import Window

    df = cut(df)
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= WINDOW_ROWS:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "_part"]]
    joined = local.alias("l").join(before.alias("b"), same, "left")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("l._local") + F.col("b._before")).cast("bigint").alias(name))


def carry_last(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds the last non-null ``value`` of the rows up to and including each one, within ``keys`` by ``order``; null before the first.

    A window where the largest key is small; beyond that rows are cut into ranges, and each range starts with the last
    value of those before it.
    """
    from pyspark.sql import Window

    df = cut(df)
    upto = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= WINDOW_ROWS:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(upto(Window.partitionBy(*keys))))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    ends = ranged.filter(F.col(value).isNotNull()).groupBy(*keys, "_part").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    parts = ranged.select(*keys, "_part").distinct().join(ends, [*keys, "_part"], "left")
    before = parts.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    local = ranged.withColumn("_local", F.last(value, ignorenulls=True).over(upto(Window.partitionBy(*keys, "_part"))))
    joined = local.alias("l").join(before.alias("b"), [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*keys, "_part"]], "left")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce("l._local", "b._before").alias(name))


def components(links: DataFrame, node: str, key: str) -> DataFrame:
    """(node, component): nodes that share a key, directly or through others, get the least node of them all.

    ``links``: node, key. Minima over keys and over nodes take turns, and both combine before the shuffle, so a key with
    most of the rows is no hot task; rounds follow the longest chain. Rows with a null node or key take no part.
    """
    links = cut(links.select(node, key).filter(F.col(node).isNotNull() & F.col(key).isNotNull()).distinct())
    labels = cut(links.select(node, F.col(node).alias("component")).distinct())
    while True:
        by_key = links.join(labels, node).groupBy(key).agg(F.min("component").alias("_least"))
        step = cut(links.join(by_key, key).groupBy(node).agg(F.min("_least").alias("_least")).join(labels, node))
        labels = cut(step.select(node, F.least("component", "_least").alias("component")))
        if step.filter(F.col("_least") < F.col("component")).isEmpty():
            return labels


def by_group(df: DataFrame, keys: list[str], order: list[str], f, schema: str) -> DataFrame:
    """``f`` over the rows (tuples, nulls as None) of each group of ``keys`` in ``order``; it gives rows of ``schema``.

    Rows are shuffled by the keys and sorted, and a task streams through its groups, so many small groups cost no call
    each and a group is all that is held at once.
    """
    at = [df.columns.index(k) for k in keys]

    def run(batches):
        import pandas as pd

        names, held, key = [x.split(" ")[0] for x in schema.split(", ")], [], None
        for b in batches:
            out = []
            columns = [[None if v is None or v != v else v for v in b[c].tolist()] for c in b.columns]
            for row in zip(*columns, strict=True):
                k = [row[i] for i in at]
                if k != key and held:
                    out += f(held)
                    held = []
                key = k
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(f(held), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
