"""Scalar expressions over names, paths, hashes and flags, all as JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WIDTH = {"crc": 8, "md5": 32, "sha1": 40, "sha256": 64}


def ascii_lower(c: Column) -> Column:
    """Fold A to Z only; ``lower`` would fold all of Unicode."""
    return F.translate(c, UPPER, LOWER)


def yes_no(c: Column) -> Column:
    """``yes`` and ``true`` in any case are true, all else, null included, is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("yes", "true"), F.lit(False))


def parse_u64(c: Column) -> Column:
    """Blank, ``-`` and unreadable text is null; ``0x`` is hexadecimal, else decimal. Values beyond 2^64-1 are null."""
    t = F.lower(F.trim(c))
    hexadecimal = F.when(F.length(t) <= 18, F.conv(F.substring(t, 3, 16), 16, 10))
    return F.when(t.rlike("^0x[0-9a-f]+$"), hexadecimal).when(t.rlike("^[0-9]{1,20}$"), t).try_cast("decimal(20,0)")


def clean_hash(c: Column, width: int) -> Column:
    """Trimmed lower-case hex without ``0x``, padded with zeros to ``width`` digits; longer text is kept; blank, odd and non-hex text is null."""
    t = F.regexp_replace(F.lower(F.trim(c)), "^0x", "")
    padded = F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)
    return F.when((t == "") | (t == "-") | ~padded.rlike("^[0-9a-f]+$") | (F.length(padded) % 2 == 1), None).otherwise(padded)


def clean_chd(c: Column) -> Column:
    """Trimmed, without a closing ``.chd`` in any case."""
    return F.regexp_replace(F.trim(c), r"(?i)\.chd$", "")


def clean_file_name(c: Column, replacement: str = "-") -> Column:
    """Blanks before the name, and dots and blanks after it, go; characters that file systems refuse become ``replacement``."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"[. ]+$", "")
    return F.regexp_replace(bare, r'[\x00-\x1f<>:"|?*\\/]', F.lit(replacement.replace("\\", "\\\\").replace("$", "\\$")))


def base_name(c: Column) -> Column:
    return F.regexp_extract(F.translate(c, "\\", "/"), r"([^/]*)$", 1)


def extension(c: Column) -> Column:
    """Lower-case extension after the last dot of the last part; null without one. A leading dot starts no extension."""
    e = F.regexp_extract(base_name(c), r"^.+\.([^.]*)$", 1)
    return F.when(base_name(c).rlike(r"^.+\.[^.]*$"), ascii_lower(e))


def stem(c: Column) -> Column:
    """The last part without its extension; a name that only starts with a dot stays whole."""
    b = base_name(c)
    return F.when(b.rlike(r"^.+\.[^.]*$"), F.regexp_extract(b, r"^(.+)\.[^.]*$", 1)).otherwise(b)


def dir_key(c: Column) -> Column:
    """Directory keys: ``\\`` as separator, trimmed, none at the end."""
    return F.regexp_replace(F.trim(F.translate(c, "/", "\\")), r"\\+$", "")


def within(path: Column, prefix: Column) -> Column:
    """Whether ``path`` is ``prefix`` or lies below it, by whole parts."""
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("\\")))


def combine(a: Column, b: Column) -> Column:
    return F.when(F.coalesce(a, F.lit("")) == "", b).when(F.coalesce(b, F.lit("")) == "", a).otherwise(F.concat(F.regexp_replace(a, r"[/\\]+$", ""), F.lit("/"), F.regexp_replace(b, r"^[/\\]+", "")))


def equal_or_null(a: Column, b: Column) -> Column:
    """Null-lenient equality: a null on either side makes no difference."""
    return F.coalesce(a == b, F.lit(True))


def compared(a: Column, b: Column) -> Column:
    """Whether both sides are present, so that the pair is evidence."""
    return a.isNotNull() & b.isNotNull()


def zip_order(name: Column) -> list[Column]:
    """Canonical zip order: folded bytes, then length, then the name itself."""
    return [F.encode(ascii_lower(name), "UTF-8"), F.length(name), name]


def seven_zip_order(name: Column) -> list[Column]:
    """Canonical 7z order: extension, stem, path."""
    b = base_name(name)
    dotted = b.rlike(r"\.")
    ext = F.when(dotted, F.regexp_extract(b, r"\.([^.]*)$", 1)).otherwise("")
    st = F.when(dotted, F.regexp_extract(b, r"^(.*)\.[^.]*$", 1)).otherwise(b)
    return [ext, st, F.regexp_extract(F.translate(name, "\\", "/"), r"^(.*/)?[^/]*$", 1), name]


def directory_order(name: Column, file_type: Column) -> list[Column]:
    return [ascii_lower(name), name, file_type]


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def flag_set(c: Column, bit: int) -> Column:
    return c.bitwiseOR(F.lit(bit))


def flag_clear(c: Column, bit: int) -> Column:
    return c.bitwiseAND(F.lit(~bit))


def flag_test(c: Column, bit: int) -> Column:
    return c.bitwiseAND(F.lit(bit)) == bit


def crc32_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0")


def dos_pack(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """Packed DOS date and time: date in the high 16 bits."""
    date = F.shiftleft((y - 1980).cast("bigint"), 9).bitwiseOR(F.shiftleft(mo.cast("bigint"), 5)).bitwiseOR(d.cast("bigint"))
    time = F.shiftleft(h.cast("bigint"), 11).bitwiseOR(F.shiftleft(mi.cast("bigint"), 5)).bitwiseOR(F.floor(s / 2).cast("bigint"))
    return F.shiftleft(date, 16).bitwiseOR(time)


def dos_text(packed: Column) -> Column:
    """``YYYY-MM-DD hh:mm:ss`` of a packed DOS stamp, fields as they are."""
    p = packed.cast("bigint")
    part = lambda shift, mask: F.shiftright(p, shift).bitwiseAND(F.lit(mask))
    return F.format_string("%04d-%02d-%02d %02d:%02d:%02d", part(25, 127) + 1980, part(21, 15), part(16, 31), part(11, 31), part(5, 63), part(0, 31) * 2)


def display_bytes_flags(text: Column, from_dat: Column, from_header: Column) -> Column:
    """A cell with the sources of its value: (D), (H), both or none."""
    flags = F.concat(F.when(from_dat, "D").otherwise(""), F.when(from_header, "H").otherwise(""))
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(flags == "", text).otherwise(F.concat(text, F.lit(" ("), flags, F.lit(")")))


#: Code page 437's characters for the bytes from 0x80 on, and those that ISO-8859-1 has there.
_CP437, _LATIN1 = (bytes(range(128, 256)).decode(c) for c in ("cp437", "latin-1"))


def entry_name(raw: Column, flags: Column) -> Column:
    """An archive entry's name as read: UTF-8 if bit 11 of flags is set, undecodable bytes replaced, else code page 437."""
    return F.when(F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(2048)) > 0, F.make_valid_utf8(raw.cast("string"))).otherwise(F.translate(F.decode(raw, "ISO-8859-1"), _LATIN1, _CP437))
