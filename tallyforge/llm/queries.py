"""Queries of the text problems over the test tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.encoding_repair import garbled_names, garbled_texts, restored_headers
from tallyforge.llm.leakage import leaked
from tallyforge.llm.tokens import encode_corpus, load_merges
from tallyforge.llm.truncation import judged_texts, truncation_by_source
from tallyforge.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose name, as read, isn't the name given."""
    headers = garbled_texts(table(spark, d, "file_header", ["header_id", "filename"]), "filename", "header_id")
    entries = garbled_names(table(spark, d, "central_entry", ["entry_id", "filename_bytes", "flags"]), "filename_bytes", "flags", "entry_id")
    return headers.select(F.lit("file_header").alias("source_table"), "row_id").unionByName(entries.select(F.lit("central_entry").alias("source_table"), "row_id")).distinct()


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled names of both tables with the name as it was given, where it can be recovered."""
    entries = table(spark, d, "central_entry", ["entry_id", "archive_id", "entry_index", "filename_bytes", "flags"])
    headers = restored_headers(table(spark, d, "file_header", ["header_id", "archive_id", "entry_index", "filename"]), entries)
    names = garbled_names(entries, "filename_bytes", "flags", "entry_id")
    return headers.select(F.lit("file_header").alias("source_table"), "row_id", "name", "given").unionByName(names.select(F.lit("central_entry").alias("source_table"), "row_id", "name", "given")).distinct()


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; the folder is taken from TALLYFORGE_TOKENIZERS, /opt/tokenizers if unset."""
    return f"{os.environ.get('TALLYFORGE_TOKENIZERS', '/opt/tokenizers')}/{name}"


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, d, "documents", ["doc_id", "text"]), "text", load_merges(tokenizer_path("byte_bpe_50k.json")), ["doc_id"])


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Leaked pairs with their tiles, the longest of them, and how much of the item they cover."""
    return leaked(table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "eval_item", ["item_id", "text"]))


def p7_reordered(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items of which passages of six words and more cover six tenths at least, in whatever order."""
    return leaked(table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "eval_item", ["item_id", "text"]), least=6, least_coverage=0.6)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items that share at least 13 consecutive words."""
    return p7_coverage(spark, d).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut off."""
    return judged_texts(table(spark, d, "documents", ["doc_id", "text", "source"])).filter("truncated").select("doc_id").distinct()


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """The share of cut texts in each source."""
    return truncation_by_source(judged_texts(table(spark, d, "documents", ["doc_id", "text", "source"])))


def queries() -> dict:
    """The text problems' queries by name."""
    return {"p1_found": p1_found, "p1_restored": p1_restored, "p6_ids": p6_ids, "p7_found": p7_found, "p7_coverage": p7_coverage, "p7_reordered": p7_reordered, "p8_found": p8_found, "p8_sources": p8_sources}


_GRAMS = "SELECT DISTINCT {0}, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {0}, regexp_extract_all(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), '[a-z0-9]+') AS w FROM {1} WHERE text IS NOT NULL) WHERE len(w) >= 13)"


def oracle_sql() -> dict[str, str]:
    """SQL over whole tables for those that SQL can express."""
    return {"p7_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format('doc_id', 'documents')}) JOIN ({_GRAMS.format('item_id', 'eval_item')}) USING (g)"}
