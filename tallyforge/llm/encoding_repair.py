"""Names and texts garbled by a wrong character encoding: find them and restore the text.

Undoing one wrong reading is an edge of a graph: encode the text in the encoding it was read in, decode the bytes in the
one they were written in; unescaping entities, percent signs or backslash escapes is an edge too. A best-first search
with a set of visited states follows edges to the text of least cost, where a cost of character plausibility plus the
price of the edges orders the queue. A text is garbled if a sufficiently cheaper text can be reached, or if it holds
what only a failed decoding leaves behind.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a text may have been read in, with the price of supposing so, and what its bytes may have been written in.
READ_IN = {"cp1252": 0.0, "cp437": 0.0, "latin-1": 0.0, "cp850": 0.1, "cp1251": 0.2, "cp866": 0.3, "koi8-r": 0.4, "cp1253": 0.4, "cp932": 0.4, "cp1250": 0.5, "mac_roman": 0.6}
WRITTEN_IN = ["utf-8", "cp1252", "cp437", "cp932", "cp1251", "cp866", "koi8-r", "cp1253", "cp850", "mac_roman", "euc_jp", "gbk", "cp1250", "cp737"]
#: Price of an edge by the encoding the bytes are taken to be written in: UTF-8 proves itself, the rarer the dearer.
PRICE = {"utf-8": 0.2, "cp1252": 0.6, "cp437": 0.6, "cp932": 0.8, "cp1251": 0.8, "cp866": 0.9, "koi8-r": 1.0, "cp1253": 0.9, "cp850": 0.9, "mac_roman": 1.2, "euc_jp": 1.3, "gbk": 2.5, "cp1250": 1.6, "cp737": 1.2, "unescape": 0.3}
#: A reachable text must be cheaper by so much, price of the edges included.
MARGIN = 0.45
#: Edges on a path. Each must lead to a text that costs less than the start: undoing a wrong reading shortens and clears it.
DEPTH = 4

_COMMON_LATIN, _LESS_COMMON = set("éèêëáâäåæçíîñóôöøüßÉÈÊËÁÂÄÅÆÇÍÎÑÓÔÖØÜÃ"), set("ãàúïòùìõûÀÚÕÏÌÒÙÛÝýÿ")
_RUSSIAN = set("абвгдежзийклмнопрстуфхцчшщъыьэюяАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯёЁ")
_QUOTES = set("“”‘’–—…„‚™•‹›«»")
_ESCAPED = re.compile(r"&(?:#\d{2,7}|#x[0-9a-fA-F]{2,6}|[A-Za-z]{2,8});|%[0-9A-Fa-f]{2}|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}")
_NO_ESCAPE = set("&%\\")


def _table(codec: str) -> dict[str, int]:
    """One-byte encoder in which undefined bytes stand for the control characters that lenient readers make of them."""
    out = {}
    for i in range(256):
        try:
            out[bytes([i]).decode(codec)] = i
        except UnicodeDecodeError:
            out.setdefault(chr(i), i)
    return out


_ENCODE = {c: _table(c) for c in READ_IN if c != "cp932"}


def _encode(text: str, codec: str) -> bytes | None:
    if codec == "cp932":
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    table = _ENCODE[codec]
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _decode(raw: bytes, codec: str) -> str | None:
    try:
        return raw.decode(codec)
    except UnicodeDecodeError:
        return None


@lru_cache(65536)
def _char(c: str) -> tuple[str, str, float]:
    """(script, case, cost) of a character. Scripts: a ASCII or Latin letter, g Greek, c Cyrillic, k kana, h Han, 0 digit, blank and p plain punctuation, q typographic, s symbol, b box or block, x what no text has."""
    o = ord(c)
    if o < 128:
        if c.isalpha():
            return "a", "l" if c.islower() else "u", 0.0
        return ("0", "", 0.0) if c.isdigit() else (" ", "", 0.0) if c == " " else ("p", "", 0.0) if o >= 32 and o != 127 else ("x", "", 4.0)
    if c == "�" or 0x80 <= o < 0xA0 or 0xE000 <= o < 0xF900:
        return "x", "", 4.0
    if o == 0xAD or o == 0xA0:
        return "s", "", 2.0
    if c in _QUOTES:
        return "q", "", 0.15 if c in "“”–—…" else 0.3
    category, case = unicodedata.category(c), ""
    if category[0] == "L" and o not in (0xAA, 0xBA):
        case = "l" if category == "Ll" else "u" if category == "Lu" else ""
        if o < 0x250:
            return "a", case, (0.25 if case == "l" else 0.4) if c in _COMMON_LATIN else 0.5 if c in _LESS_COMMON else 1.1
        if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
            return "g", case, 0.06
        if 0x400 <= o < 0x530:
            return "c", case, 0.05 if c in _RUSSIAN else 1.4
        if 0x3040 <= o < 0x3100:
            return "k", "", 0.05
        if 0x4E00 <= o < 0xA000:
            return "h", "", 0.15
        if 0xFF66 <= o < 0xFFA0:
            return "k", "", 1.4
        return "o", case, 1.0
    if category in ("Mn", "Mc"):
        return "m", "", 2.0
    if o == 0x30FC:
        return "k", "", 0.05
    if 0x3000 <= o < 0x3020:
        return "p", "", 0.3
    if category in ("Cn", "Co", "Cc", "Cs"):
        return "x", "", 4.0
    return ("b", "", 0.2) if 0x2500 <= o < 0x25A0 else ("s", "", 0.7)


_LETTERS = set("agckho")
_VOWELS = set("аеёиоуыэюяйьАЕЁИОУЫЭЮЯЙЬαεηιουωάέήίόύώϊϋΐΰΑΕΗΙΟΥΩΆΈΉΊΌΎΏ")


def implausibility(text: str) -> float:
    """Cost of a text: of its characters, of scripts that meet inside a word, of capitals after small letters, of symbols inside words."""
    cost, bare, prev = 0.0, 0, (" ", "", 0.0)
    n = len(text)
    chars = [_char(c) for c in text]
    if not _NO_ESCAPE.isdisjoint(text):
        cost += 1.2 * len(_ESCAPED.findall(text))
    for i, cur in enumerate(chars):
        s, case, c = cur
        cost += c
        p, pcase, pc = prev
        if s in _LETTERS:
            if p in _LETTERS:
                if p != s and not (p in "kh" and s in "kh"):
                    cost += 2.2 if p in "agc" and s in "agc" else 1.3
                elif case == "u" and pcase == "l" and (c or pc or s != "a"):
                    cost += 1.1
                elif case == "l" and pcase == "u" and c == 0 and pc and i >= 2 and chars[i - 2][1] == "l":
                    cost += 0.3
                elif s == "a" and c and pc:
                    cost += 0.3  # accents in a row
            elif p in "sb":
                cost += 1.1
            bare = bare + 1 if s in "cg" and text[i] not in _VOWELS else 0
            if bare > 2:
                cost += 0.4  # more consonants in a row than the script's languages have
            if s == "g" and text[i] == "σ" and (i + 1 == n or chars[i + 1][0] != "g"):
                cost += 0.4
            if c and s in "agc" and case == "l" and p not in _LETTERS and (i + 1 == n or chars[i + 1][0] not in _LETTERS):
                cost += 1.0  # a small letter alone
        else:
            bare = 0
        if s in _LETTERS:
            pass
        elif s in "sb" and p in _LETTERS or s == "b" and p == "s" or s == "s" and p == "b":
            cost += 1.1
        elif s == "b" and (p not in " b" or p == " " and (i + 1 == n or chars[i + 1][0] != "b")) and i:
            cost += 0.8  # boxes stand in runs of their own
        elif s == "q" and p in _LETTERS and i + 1 < n and chars[i + 1][0] in _LETTERS and text[i] != "’":
            cost += 1.5
        elif s == "q" and p in "sb" or s in "sb" and p == "q":
            cost += 0.8
        elif s == "p" and p in _LETTERS and pc and text[i] in "[]\\^_`{|}~@" and i + 1 < n and (chars[i + 1][0] in _LETTERS or chars[i + 1][0] == "s"):
            cost += 0.6
        elif p == " " and i + 1 < n and chars[i + 1][0] in " p":
            if s == "q" and text[i] not in "–—…•™":
                cost += 1.1  # half a pair of quotes alone
            elif s == "s" and c < 1:
                cost -= 0.4  # a sign of its own
        prev = cur
    return cost


def _unescaped(text: str) -> list[str]:
    out = [html.unescape(text)]
    if "%" in text:
        raw = unquote_to_bytes(text)
        out.append(_decode(raw, "utf-8") or raw.decode("cp1252", "replace"))
    if "\\u" in text or "\\x" in text:
        out.append(re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), text))
    return out


def _edges(text: str):
    if _ESCAPED.search(text):
        for t in _unescaped(text):
            yield t, PRICE["unescape"]
    seen: set[bytes] = set()
    for r in READ_IN:
        raw = _encode(text, r)
        if raw is None or raw in seen:
            continue
        seen.add(raw)
        for w in WRITTEN_IN:
            if w != r and (t := _decode(raw, w)) is not None:
                yield t, PRICE[w] + READ_IN[r]


def restore(text: str, raw: bytes | None = None) -> tuple[str | None, bool]:
    """(text as given, whether ``text`` is garbled).

    The text comes back as it is if nothing cheaper can be reached; None says that it is garbled but can't be recovered.
    ``raw``, the stored bytes, opens further states where reading them has lost information. Empty text is sound.
    """
    if text.isascii() and not _ESCAPED.search(text):
        return text, False
    own = implausibility(text)
    lost = "�" in text
    if own < MARGIN + PRICE["utf-8"] and not lost:
        return text, False
    best, least = text, own
    visited, queue = {text}, [(own, 0, text, 0.0)]
    if raw is not None:
        for w in WRITTEN_IN:
            if (t := _decode(raw, w)) is not None and t not in visited:
                visited.add(t)
                cost = implausibility(t) + PRICE[w]
                heapq.heappush(queue, (cost, 1, t, PRICE[w]))
    while queue:
        total, depth, state, paid = heapq.heappop(queue)
        if total < least and "\x00" not in state:
            best, least = state, total
        if depth == DEPTH or paid + PRICE["utf-8"] >= least:  # nothing behind it can be cheaper
            continue
        for t, price in _edges(state):
            if t not in visited:
                visited.add(t)
                if paid + price < least and (total := implausibility(t) + paid + price) < own:
                    heapq.heappush(queue, (total, depth + 1, t, paid + price))
    if best != text and own - least >= MARGIN:
        return (None, True) if "�" in best else (best, True)
    return (None, True) if lost else (text, False)


#: What can be garbled at all: text beyond ASCII, or escapes.
_SUSPECT = r"[^\x00-\x7F]|&#?[A-Za-z0-9]{2,8};|%[0-9A-Fa-f]{2}|\\[ux][0-9a-fA-F]{2}"
_RESULT = T.StructType([T.StructField("given", T.StringType()), T.StructField("garbled", T.BooleanType())])
_RESTORED = T.StructType([*_RESULT.fields, T.StructField("cost", T.DoubleType())])
_NAMED = T.StructType([T.StructField("name", T.StringType()), *_RESULT.fields])


@lru_cache(1 << 16)
def _restore_cached(text: str, raw: bytes | None = None) -> tuple[str | None, bool]:
    """``restore`` with a bounded memory of what a worker has seen."""
    return restore(text, raw)


@F.pandas_udf(_RESULT)
def _restore_text(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None, False) if t is None else _restore_cached(t) for t in text], columns=["given", "garbled"])


def read_name(raw: bytes, flags: int) -> str:
    """An entry name as read: UTF-8 if bit 11 of flags is set, undecodable bytes replaced, else code page 437."""
    return raw.decode("utf-8", "replace") if flags & 2048 else raw.decode("cp437")


@F.pandas_udf(_NAMED)
def _restore_bytes(raw: pd.Series, flags: pd.Series) -> pd.DataFrame:
    rows = []
    for r, f in zip(raw, flags, strict=True):
        if r is None:
            rows.append((None, None, False))
        else:
            name = read_name(bytes(r), int(f))
            rows.append((name, *_restore_cached(name, bytes(r) if "\ufffd" in name else None)))
    return pd.DataFrame(rows, columns=["name", "given", "garbled"])


def garbled_texts(df: DataFrame, text: str, key: str) -> DataFrame:
    """Rows whose text is garbled: key, name (as read), given (restored, null if lost). One narrow pass, nothing moves.

    Null and empty texts, and plain ASCII without escapes, are sound. Very long texts are searched whole. Repeated rows
    come once. Only rows that can be garbled go to Python.
    """
    suspect = df.select(F.col(key).alias("row_id"), F.col(text).alias("name")).filter(F.col("name").rlike(_SUSPECT))
    return suspect.withColumn("r", _restore_text("name")).filter("r.garbled").select("row_id", "name", "r.given").distinct()


def garbled_names(df: DataFrame, raw: str, flags: str, key: str) -> DataFrame:
    """The same for names stored as bytes and read by flags; null flags read as code page 437."""
    rows = df.select(F.col(key).alias("row_id"), F.col(raw).alias("raw"), F.coalesce(F.col(flags), F.lit(0)).alias("flags")).filter(F.col("raw").isNotNull())
    # only bytes beyond ASCII, or escapes; a lossless one-byte reading lets the JVM tell
    rows = rows.filter(F.decode("raw", "ISO-8859-1").rlike(_SUSPECT))
    return rows.withColumn("r", _restore_bytes("raw", "flags")).filter("r.garbled").select("row_id", "r.name", "r.given").distinct()


@F.pandas_udf(_RESTORED)
def _read_back(raw: pd.Series, flags: pd.Series) -> pd.DataFrame:
    """The sound or restored name of an entry and how implausible it is; null if it is lost."""
    rows = []
    for r, f in zip(raw, flags, strict=True):
        name = read_name(bytes(r), int(f))
        given, garbled = _restore_cached(name, bytes(r) if "\ufffd" in name else None)
        rows.append((given, garbled, None if given is None else float(implausibility(given))))
    return pd.DataFrame(rows, columns=["given", "garbled", "cost"])


def restored_headers(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """Garbled header names with the name as it was given; where reading lost it, it is taken from the bytes of the tied entry.

    Of several tied entries, sound or garbled, the most plausible name holds; ties take a sound one, then the least name.
    """
    own = garbled_texts(headers, "filename", "header_id")
    lost = own.filter("given is null").select("row_id").join(headers.select(F.col("header_id").alias("row_id"), "archive_id", "entry_index").distinct(), "row_id")
    tied = entries.select("archive_id", "entry_index", F.col("filename_bytes").alias("raw"), F.coalesce("flags", F.lit(0)).alias("flags")).filter("raw is not null").join(lost, ["archive_id", "entry_index"])
    again = tied.withColumn("r", _read_back("raw", "flags")).filter("r.given <> ''").groupBy("row_id").agg(F.min(F.struct("r.cost", "r.garbled", "r.given")).alias("b")).select("row_id", F.col("b.given").alias("from_bytes"))
    return own.join(again, "row_id", "left").select("row_id", "name", F.coalesce("given", "from_bytes").alias("given"))
