"""Relations of the engine derived from the test tables, once for Spark and once as SQL for the check.

``nodes`` reads every document as a file: what it is expected as and found as follows from its number, its identity from
its text. ``games`` and ``roms`` read parts and line items as sets and members; ``members`` reads archive entries.
No row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import table

NODES = """base AS (
  SELECT *, CASE WHEN doc_id % 4 <> 0 THEN substr(md5(coalesce(text, '')), 1, 2) ELSE coalesce(text, '') END AS content, doc_id % 20 = 14 AS headed FROM documents),
known AS (SELECT *, CASE WHEN doc_id % 31 = 0 THEN content || 'x' ELSE content END AS inner_text FROM base),
shown AS (SELECT *, CASE WHEN headed THEN 'H' || content ELSE content END AS whole, CASE WHEN headed THEN 'H' || inner_text ELSE inner_text END AS whole_text FROM known),
nodes AS (
  SELECT CAST(doc_id AS VARCHAR) AS node_id, doc_id AS ord, source AS dat, source || '/' || repo AS archive, repo AS game, path AS name, CAST(strlen(whole) AS BIGINT) AS size, CASE WHEN doc_id % 23 <> 0 THEN substr(md5(whole), 1, 8) END AS crc, CASE WHEN doc_id % 19 <> 0 THEN sha1(whole_text) END AS sha1, md5(whole_text) AS md5,
    CASE WHEN headed THEN CAST(strlen(content) AS BIGINT) END AS alt_size, CASE WHEN headed THEN substr(md5(content), 1, 8) END AS alt_crc, CASE WHEN headed THEN sha1(inner_text) END AS alt_sha1, CASE WHEN headed THEN md5(inner_text) END AS alt_md5,
    CASE WHEN headed THEN CASE WHEN doc_id % 3 = 0 THEN 'LYNX' ELSE 'NES' END WHEN doc_id % 7 = 2 THEN 'NES' END AS header_type, doc_id % 14 = 2 AS header_required, doc_id % 40 = 14 AS from_header,
    CASE doc_id % 10 WHEN 0 THEN 'InDatMerged' WHEN 1 THEN 'InDatNoDump' WHEN 2 THEN 'InDatMIA' WHEN 3 THEN 'NotInDat' WHEN 4 THEN 'InToSort' ELSE 'InDatCollect' END AS dat_status,
    CASE WHEN doc_id % 10 IN (3, 4) THEN 'Got' WHEN doc_id % 17 = 0 THEN 'Corrupt' WHEN doc_id % 3 = 0 THEN 'NotGot' WHEN doc_id % 43 = 0 THEN 'FileLocked' ELSE 'Got' END AS got_status,
    CASE WHEN lang IS NULL THEN 'FileZip' ELSE 'File' END AS file_type, doc_id % 37 <> 0 AS selected, doc_id % 13 = 0 AS locked, doc_id % 2 = 0 AS deep, 'disk/' || path AS physical
  FROM shown)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Files expected and found. Three quarters share their content with others, some of which clash in part of their hashes, lie behind a header, demand one, or know only some hashes."""
    t = table(spark, d, "documents", ["doc_id", "text", "source", "repo", "path", "lang"]).withColumn("text", F.coalesce("text", F.lit("")))
    i = F.col("doc_id")
    n = i % 10
    status = F.when(n == 0, "InDatMerged").when(n == 1, "InDatNoDump").when(n == 2, "InDatMIA").when(n == 3, "NotInDat").when(n == 4, "InToSort").otherwise("InDatCollect")
    got = F.when(n.isin(3, 4), "Got").when(i % 17 == 0, "Corrupt").when(i % 3 == 0, "NotGot").when(i % 43 == 0, "FileLocked").otherwise("Got")
    headed = i % 20 == 14
    content = F.when(i % 4 != 0, F.substring(F.md5("text"), 1, 2)).otherwise(F.col("text"))
    t = t.withColumn("c", content).withColumn("x", F.when(i % 31 == 0, F.concat("c", F.lit("x"))).otherwise(F.col("c")))
    t = t.withColumn("hc", F.when(headed, F.concat(F.lit("H"), "c")).otherwise(F.col("c"))).withColumn("hx", F.when(headed, F.concat(F.lit("H"), "x")).otherwise(F.col("x")))
    return t.select(
        i.cast("string").alias("node_id"), i.alias("ord"), F.col("source").alias("dat"), F.concat("source", F.lit("/"), "repo").alias("archive"), F.col("repo").alias("game"), F.col("path").alias("name"),
        F.octet_length("hc").cast("bigint").alias("size"), F.when(i % 23 != 0, F.substring(F.md5("hc"), 1, 8)).alias("crc"), F.when(i % 19 != 0, F.sha1("hx")).alias("sha1"), F.md5("hx").alias("md5"),
        F.when(headed, F.octet_length("c").cast("bigint")).alias("alt_size"), F.when(headed, F.substring(F.md5("c"), 1, 8)).alias("alt_crc"), F.when(headed, F.sha1("x")).alias("alt_sha1"), F.when(headed, F.md5("x")).alias("alt_md5"),
        F.when(headed, F.when(i % 3 == 0, "LYNX").otherwise("NES")).when(i % 7 == 2, "NES").alias("header_type"), (i % 14 == 2).alias("header_required"), (i % 40 == 14).alias("from_header"), status.alias("dat_status"), got.alias("got_status"),
        F.when(F.col("lang").isNull(), "FileZip").otherwise("File").alias("file_type"), (i % 37 != 0).alias("selected"), (i % 13 == 0).alias("locked"), (i % 2 == 0).alias("deep"), F.concat(F.lit("disk/"), "path").alias("physical"),
    )


SIDES = """expected AS (
  SELECT source AS place, 'doc_' || doc_id || '.bin' AS name, 'File' AS file_type, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
    CASE WHEN doc_id % 29 = 0 THEN sha1('x' || doc_id) ELSE sha1(coalesce(text, '')) END AS sha1, CASE WHEN doc_id % 29 = 0 THEN md5('x' || doc_id) ELSE md5(coalesce(text, '')) END AS md5,
    CASE doc_id % 20 WHEN 0 THEN 'InDatNoDump' WHEN 1 THEN 'InDatMIA' WHEN 2 THEN 'InDatMerged' ELSE 'InDatCollect' END AS dat_status
  FROM documents
  UNION ALL SELECT suite, 'eval_' || item_id || '.bin', 'File', CAST(strlen(text) AS BIGINT), sha1(text), md5(text), 'InDatCollect' FROM eval_item),
found AS (
  SELECT source AS place, CASE WHEN doc_id % 7 = 3 THEN 'stray_' || doc_id || '.bin' ELSE 'doc_' || doc_id || '.bin' END AS name, 'File' AS file_type, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
    sha1(coalesce(text, '')) AS sha1, md5(coalesce(text, '')) AS md5, CASE WHEN doc_id % 41 = 0 THEN 'FileLocked' ELSE 'Got' END AS got_status
  FROM documents)"""


def expected(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", ["doc_id", "text", "source"]).withColumn("text", F.coalesce("text", F.lit("")))
    odd, mark = F.col("doc_id") % 29 == 0, F.concat(F.lit("x"), "doc_id")
    n = F.col("doc_id") % 20
    status = F.when(n == 0, "InDatNoDump").when(n == 1, "InDatMIA").when(n == 2, "InDatMerged").otherwise("InDatCollect")
    docs = t.select(F.col("source").alias("place"), F.concat(F.lit("doc_"), "doc_id", F.lit(".bin")).alias("name"), F.lit("File").alias("file_type"), F.octet_length("text").cast("bigint").alias("size"), F.when(odd, F.sha1(mark)).otherwise(F.sha1("text")).alias("sha1"), F.when(odd, F.md5(mark)).otherwise(F.md5("text")).alias("md5"), status.alias("dat_status"))
    items = table(spark, d, "eval_item").select(F.col("suite").alias("place"), F.concat(F.lit("eval_"), "item_id", F.lit(".bin")).alias("name"), F.lit("File").alias("file_type"), F.octet_length("text").cast("bigint").alias("size"), F.sha1("text").alias("sha1"), F.md5("text").alias("md5"), F.lit("InDatCollect").alias("dat_status"))
    return docs.unionByName(items)


def found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents", ["doc_id", "text", "source"]).withColumn("text", F.coalesce("text", F.lit("")))
    name = F.concat(F.when(F.col("doc_id") % 7 == 3, "stray_").otherwise("doc_"), "doc_id", F.lit(".bin"))
    return t.select(F.col("source").alias("place"), name.alias("name"), F.lit("File").alias("file_type"), F.octet_length("text").cast("bigint").alias("size"), F.sha1("text").alias("sha1"), F.md5("text").alias("md5"), F.when(F.col("doc_id") % 41 == 0, "FileLocked").otherwise("Got").alias("got_status"))


SETS = """games AS (
  SELECT 'g' || p_partkey AS game, p_partkey AS ord, CASE WHEN p_partkey % 10 <> 0 THEN 'g' || (p_partkey - p_partkey % 10) WHEN p_partkey % 70 = 0 THEN 'g' || (p_partkey - p_partkey % 100) END AS clone_of,
    CASE WHEN p_partkey % 7 = 0 AND p_partkey % 100 <> 0 THEN 'g' || p_partkey WHEN p_partkey % 500 = 0 THEN NULL WHEN p_partkey % 100 = 0 THEN 'g' || (p_partkey - p_partkey % 500) WHEN p_partkey % 10 = 0 THEN 'g' || (p_partkey - p_partkey % 100) END AS rom_of,
    CASE WHEN p_partkey % 500 = 0 THEN 'yes' END AS is_bios, p_brand AS brand, p_type AS kind, CASE WHEN p_partkey % 4 = 0 THEN 'i' || p_partkey END AS id, CASE WHEN p_partkey % 3 = 0 THEN 'i' || (p_partkey - p_partkey % 4) END AS clone_of_id, p_name AS description,
    CASE WHEN p_partkey % 13 = 0 THEN 'yes' WHEN p_partkey % 17 = 0 THEN 'Yes' END AS is_device, CASE WHEN p_partkey % 2 = 1 THEN 'no' END AS runnable
  FROM part),
roms AS (
  SELECT 'g' || pk AS game, row_number() OVER (PARTITION BY pk ORDER BY sk, ln) AS ord, 'r' || sk || '-' || ln || '.bin' AS name, CASE WHEN (pk + sk) % 23 <> 0 THEN CAST(sk * 100 + ln AS BIGINT) END AS size,
    CASE WHEN (pk + ln) % 3 = 0 THEN substr(md5(sk || '-' || ln), 1, 8) END AS crc, CASE WHEN (pk + sk) % 6 <> 0 THEN sha1(sk || '-' || ln) END AS sha1, CASE WHEN pk % 5 = 0 THEN md5(sk || '-' || ln) END AS md5, CASE WHEN sk % 11 = 0 THEN 'nodump' WHEN sk % 13 = 0 THEN 'deduped' END AS status,
    CASE WHEN ln = 7 THEN 'yes' END AS mia, CASE WHEN sk % 5 = 0 THEN 'm' || sk ELSE NULL END AS merge, ln = 5 AS is_disk
  FROM (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln FROM lineitem))"""


def games(spark: SparkSession, d: str) -> DataFrame:
    """Sets whose parents lie up to three levels above them, some of which name themselves."""
    k = F.col("p_partkey")
    g = lambda x: F.concat(F.lit("g"), x.cast("string"))
    rom_of = F.when((k % 7 == 0) & (k % 100 != 0), g(k)).when(k % 500 == 0, None).when(k % 100 == 0, g(k - k % 500)).when(k % 10 == 0, g(k - k % 100))
    return table(spark, d, "part").select(
        g(k).alias("game"), k.alias("ord"), F.when(k % 10 != 0, g(k - k % 10)).when(k % 70 == 0, g(k - k % 100)).alias("clone_of"), rom_of.alias("rom_of"), F.when(k % 500 == 0, "yes").alias("is_bios"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"),
        F.when(k % 4 == 0, F.concat(F.lit("i"), k.cast("string"))).alias("id"), F.when(k % 3 == 0, F.concat(F.lit("i"), (k - k % 4).cast("string"))).alias("clone_of_id"), F.col("p_name").alias("description"),
        F.when(k % 13 == 0, "yes").when(k % 17 == 0, "Yes").alias("is_device"), F.when(k % 2 == 1, "no").alias("runnable"),
    )


def roms(spark: SparkSession, d: str) -> DataFrame:
    """Members of sets; which of their facts are known differs from set to set."""
    from pyspark.sql import Window

    pk, sk, ln = F.substring("game", 2, 20).cast("bigint"), F.col("sk"), F.col("ln")
    # equal rows are told apart within their set, so that rows move once and lie by set
    w = Window.partitionBy("game").orderBy("sk", "ln")
    m = table(spark, d, "lineitem", ["l_partkey", "l_suppkey", "l_linenumber"]).select(F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("game"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").alias("ln"))
    m = m.select("*", F.dense_rank().over(w).cast("bigint").alias("ord"), F.rank().over(w).alias("first"), F.row_number().over(w).alias("row")).filter("row = first")
    nul, text = F.lit(None).cast("string"), F.concat_ws("-", "sk", "ln")
    return m.select(
        "game", "ord", F.concat(F.lit("r"), "sk", F.lit("-"), "ln", F.lit(".bin")).alias("name"), F.when((pk + sk) % 23 != 0, (sk * 100 + ln).cast("bigint")).alias("size"),
        F.when((pk + ln) % 3 == 0, F.substring(F.md5(text), 1, 8)).alias("crc"), F.when((pk + sk) % 6 != 0, F.sha1(text)).alias("sha1"), nul.alias("sha256"), F.when(pk % 5 == 0, F.md5(text)).alias("md5"),
        F.when(sk % 11 == 0, "nodump").when(sk % 13 == 0, "deduped").alias("status"), F.when(ln == 7, "yes").alias("mia"), F.when(sk % 5 == 0, F.concat(F.lit("m"), "sk")).alias("merge"), (ln == 5).alias("is_disk"), nul.alias("dat_status"),
    )


COPIES = """copies AS (
  SELECT game, row_number() OVER (PARTITION BY game ORDER BY sk, ln) AS ord, CASE (sk + ln) % 3 WHEN 0 THEN 'd' || (ln % 2) || '/f' || (sk % 5) || '.bin' WHEN 1 THEN 'f' || (sk % 5) || '.bin' ELSE 'F' || (sk % 3) || '.bin' END AS name,
    substr(md5(c), 1, 8) AS crc, sha1(c) AS sha1, md5(c) AS md5, 'f' || (ln % 5) || '.bin' AS merge
  FROM (SELECT DISTINCT 'g' || l_partkey AS game, l_suppkey AS sk, l_linenumber AS ln, 'c' || (l_suppkey % 19) AS c FROM lineitem))"""


def copies(spark: SparkSession, d: str) -> DataFrame:
    """Members of sets of which many hold the same content under equal and other names, at the top and in directories."""
    from pyspark.sql import Window

    sk, ln = F.col("sk"), F.col("ln")
    m = table(spark, d, "lineitem", ["l_partkey", "l_suppkey", "l_linenumber"]).distinct().select(F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("game"), F.col("l_suppkey").alias("sk"), F.col("l_linenumber").alias("ln"))
    c = F.concat(F.lit("c"), (sk % 19).cast("string"))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    name = F.when((sk + ln) % 3 == 0, text("d", ln % 2, "/f", sk % 5, ".bin")).when((sk + ln) % 3 == 1, text("f", sk % 5, ".bin")).otherwise(text("F", sk % 3, ".bin"))
    return m.select("game", F.row_number().over(Window.partitionBy("game").orderBy("sk", "ln")).cast("bigint").alias("ord"), name.alias("name"), (sk * 7).cast("bigint").alias("size"), F.substring(F.md5(c), 1, 8).alias("crc"), F.sha1(c).alias("sha1"), F.lit(None).cast("string").alias("sha256"), F.md5(c).alias("md5"), text("f", ln % 5, ".bin").alias("merge"))


MEMBERS = """members AS (SELECT DISTINCT CAST(archive_id AS VARCHAR) AS archive, entry_index AS idx, filename AS name, uncompressed_size AS size, crc, is_directory AS is_dir FROM file_header)"""


def members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_header").select(F.col("archive_id").cast("string").alias("archive"), F.col("entry_index").alias("idx"), F.col("filename").alias("name"), F.col("uncompressed_size").alias("size"), "crc", F.col("is_directory").alias("is_dir")).distinct()
