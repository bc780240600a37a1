"""Texts that stop before their file does.

Near-copies come first: min-hash banding of all texts brings each together with the longer texts that start alike, the
pair is verified and aligned, and the text is flagged if its alignment ends before the copy does. Texts that no copy
settles are scored by how they close: content, open brackets and strings and the closing word make a shape, and the
shape's terminality is how often texts end so against how often a text cut anywhere would. A length at which closed-off
texts of one source pile up is that source's limit.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.words import Words, mixed, split_words, windows
from tallyforge.session import cut, sized_join, spread_rank

#: Cut places tried in each text to learn what cut texts look like.
CUTS = 2
#: Words of a shingle, bands of a sketch and hashes of a band: texts of similarity 0.8 meet in a band with probability 0.983.
SHINGLE, BANDS, ROWS = 5, 4, 2
#: Sketches are taken of the first 2^k words, from this k on, so that a text meets a longer one that starts alike.
FIRST_SCALE = 4
#: Below this ratio a shape is that of a cut text; from SOUND on it is that of a whole one. A first look, before limits are known, uses LOOK.
CUT, LOOK, HALF, SOUND = 0.1, 0.25, 0.5, 20.0
#: Shapes seen less often in cut texts and at ends are judged by their coarse form.
SUPPORT = 8
#: A limit takes at least so many closed-off texts of a source, and this share of them.
LIMIT_TEXTS, LIMIT_SHARE = 3, 0.1
#: Characters at the end of a text that are aligned with its near-copy, and the share of them and of its shingles that the copy must hold.
TAIL, CONTAINED = 40, 0.8
#: How many times more copies each round tries.
ROUND = 8
CHUNK = 4 << 20

_QUOTED = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.){0,200}\'|/\*(?:[^*]|\*(?!/))*\*/|(?://|#|--)[^\n]*', re.S)
_MARK = re.compile(r"(?:…|\[(?:\.\.\.|…|truncated)\]|\((?:truncated|cut off)\))\Z", re.I)
_HEAD = re.compile(r"(?:return\b|#|//|--|[-*] |[}\])]|```|\w+\()")
_INDENTED, _STATEMENT_END = re.compile(r"^[^\S\n]*(?:def |class |import \w|from \w[\w.]* import|if __name__)", re.M), re.compile(r";[^\S\n]*$", re.M)
_SQL = re.compile(r"^[^\S\n]*(?:CREATE|INSERT|SELECT|ALTER|DROP|create|insert|select)\b", re.M)
_SHELL, _MARKDOWN = re.compile(r"^#!/|^[^\S\n]*(?:fi|done|then)\b|^\w+\(\) \{", re.M), re.compile(r"^#{1,6} |^```|^- ", re.M)
_KEYED, _HEX = re.compile(r"^\s*(?:- )?[\w\"'-]+:(?: |$)"), re.compile(r"(?:0x[0-9a-f]{2},\s*)+")
_FUNCTION, _JSON = re.compile(r"\b(?:func|fn|function)\b"), re.compile(r'[{\[]\s*(?:["{\[\]}]|\d)')


def kind_of(text: str) -> str:
    """What a text holds; names and stated languages are not trusted."""
    start = text.lstrip("﻿ \r\n\t")
    if _JSON.match(start):
        return "json"
    if _INDENTED.search(text) and not _STATEMENT_END.search(text):
        return "indented"
    if _SQL.search(text):
        return "sql"
    if "{" in text and (";" in text or _FUNCTION.search(text)):
        return "braces"
    if _SHELL.search(text):
        return "shell"
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 2 and sum(bool(_KEYED.match(x.rstrip("\r"))) for x in lines) > 0.6 * len(lines):
        return "keyed"
    if _MARKDOWN.search(text):
        return "markdown"
    for sep in ",;\t":
        fields = lines[0].count(sep) if lines else 0
        if len(lines) > 2 and fields and sum(x.count(sep) == fields for x in lines[:-1]) >= 0.8 * (len(lines) - 1):
            return "rows"
    return "braces" if _HEX.match(start) else "prose"


def shape_of(text: str, kind: str) -> tuple[str, str]:
    """(fine, coarse) shape of how a text closes: line end, open brackets and strings, class of the last character, first word and indent of the last line, and what the kind of content adds."""
    line_end = text[-1:] in ("\r", "\n")
    body = text.rstrip("\r\n")
    last = body[body.rfind("\n") + 1 :]
    line = last.strip()
    depth, opened = 0, False
    if kind in ("json", "braces", "indented", "sql", "shell"):
        rest = _QUOTED.sub("", text)
        depth = max(0, min(2, sum(map(rest.count, "([{")) - sum(map(rest.count, ")]}"))))
        opened = '"' in rest[rest.rfind("\n", 0, len(rest.rstrip())) + 1 :] or "/*" in rest
    c = line[-1:]
    close = "w" if c.isalnum() or c == "_" else c if c in "};)].,:({[\"'`=" and c else "o" if c else "e"
    m = _HEAD.match(line)
    head = "" if not m else "w(" if m[0].endswith("(") else m[0]
    indent = len(last) - len(last.lstrip())
    more = ""
    if kind == "rows":
        first = body[: body.find("\n")] if "\n" in body else body
        sep = max(",;\t", key=first.count)
        more = "=" if last.count(sep) == first.count(sep) else "<"
    elif kind == "keyed":
        more = "q" if line.count('"') % 2 else ":" if re.search(r":\s*\S", line) else "n"
    elif kind == "markdown":
        more = "f" if text.count("\n```") % 2 else ""
    coarse = f"{kind}|{int(line_end)}|{int(depth > 0 or opened)}|{close}"
    return f"{coarse}|{depth}|{int(opened)}|{head}|{min(indent, 5 if kind == 'indented' else 1)}|{more}", coarse


def describe(text: str) -> tuple[str, str, str, list[str], list[str]]:
    """(fine shape, coarse shape, the mark of omission that closes the text or nothing, fine and coarse shapes of the text cut at places drawn from its own checksum)."""
    kind = kind_of(text)
    mark = _MARK.search(text)
    whole = text[: mark.start()].rstrip(" ") if mark and mark.start() else text
    fine, coarse = shape_of(whole, kind)
    seed, shapes = zlib.crc32(text.encode("utf-8", "replace")), []
    for i in range(CUTS):
        seed = (seed * 1103515245 + 12345 + i) & 0x7FFFFFFF
        shapes.append(shape_of(text[: max(1, len(text) * (seed % 9973 + 500) // 10473)], kind))
    return fine, coarse, mark[0] if mark and mark.start() else "", [s[0] for s in shapes], [s[1] for s in shapes]


def sketches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all texts in order of scale and band, number of buckets of each text, words of each text)."""
    words = split_words(texts, all_scripts=True)
    n = len(texts)
    count = np.bincount(words.text, minlength=n)
    shingle, place = windows(words.hash, words.text, SHINGLE)
    owner = words.text[place]
    held = np.bincount(owner, minlength=n)
    begin = np.cumsum(held) - held
    least = np.full((BANDS * ROWS, n), np.iinfo(np.uint64).max, np.uint64)
    salted = [np.append(mixed(shingle ^ np.uint64(0xA0761D6478BD642F * (j + 1) & (1 << 64) - 1)), np.uint64(0)) for j in range(BANDS * ROWS)]
    found_text, found_order, found = [], [], []
    k, before = FIRST_SCALE, 0
    while True:
        upto = (1 << k) - SHINGLE + 1
        some = np.flatnonzero(held >= upto)
        if not len(some):
            break
        edges = np.stack([begin[some] + before, begin[some] + upto], 1).ravel()
        for j, v in enumerate(salted):
            least[j, some] = np.minimum(least[j, some], np.minimum.reduceat(v, edges)[::2])
        for band in range(BANDS):
            value = np.full(len(some), k * BANDS + band, np.uint64)
            for r in range(ROWS):
                value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + least[band * ROWS + r, some])
            found_text.append(some)
            found_order.append(np.full(len(some), k * BANDS + band))
            found.append(value)
        before, k = upto, k + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(n, np.int64), count
    text, order = np.concatenate(found_text), np.lexsort((np.concatenate(found_order), np.concatenate(found_text)))
    return np.concatenate(found)[order].view(np.int64), np.bincount(text, minlength=n), count


_FEATURES = "doc_id bigint, source string, key bigint, chars int, bytes int, words int, fine string, coarse string, mark string, cut_fine array<string>, cut_coarse array<string>, buckets array<bigint>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _FEATURES.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), None]
    for batch in batches:
        ids, sources, keys, texts = (batch.column(i).to_pylist() for i in range(4))
        begin = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held < CHUNK and i < len(texts) - 1:
                continue
            part = texts[begin : i + 1]
            raw = [x.encode("utf-8", "replace") for x in part]
            buckets, per, words = sketches(raw)
            d = [describe(x) for x in part]
            columns = [ids[begin : i + 1], sources[begin : i + 1], keys[begin : i + 1], [len(x) for x in part], [len(x) for x in raw], words.tolist(), *[[x[j] for x in d] for j in range(5)]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(buckets, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, types, strict=False)], lists], names=names)
            begin, held = i + 1, 0


def line_ended() -> Column:
    """Whether a text ends with its line, from its shape."""
    return F.substring_index(F.substring_index("coarse", "|", 2), "|", -1) == "1"


def left_open() -> Column:
    """Whether a bracket or string is open at the end, from its shape; then a middling ratio is proof enough."""
    return F.substring_index(F.substring_index("coarse", "|", 3), "|", -1) == "1"


def closing_ratios(features: DataFrame, name: str) -> DataFrame:
    """Terminality by shape: share of texts that end so, without those that a limit may have cut inside a line, over the share of cuts that do. The shapes come from a fixed set of classes, so the table stays small at any size of corpus."""
    ends = features.select(F.col(name).alias("shape"), F.when(F.col("at_limit") & ~line_ended(), 0).otherwise(1).alias("e"), F.lit(0).alias("c"))
    cuts = features.select(F.explode(f"cut_{name}").alias("shape"), F.lit(0).alias("e"), F.lit(1).alias("c"))
    counts = ends.unionByName(cuts).groupBy("shape").agg(F.sum("e").alias("e"), F.sum("c").alias("c"))
    everywhere = Window.partitionBy()  # over the table of shapes, not over texts
    total_e, total_c = F.greatest(F.sum("e").over(everywhere), F.lit(1)), F.greatest(F.sum("c").over(everywhere), F.lit(1))
    return counts.select(F.col("shape").alias(name), F.col("e").alias(f"{name}_e"), F.col("c").alias(f"{name}_c"), ((F.col("e") / total_e) / ((F.col("c") + 0.3) / total_c)).alias(f"{name}_r"))


def _rated(features: DataFrame) -> DataFrame:
    out = features
    for name in ("fine", "coarse"):
        out = sized_join(out, closing_ratios(features, name), [name], "left")
    return out.withColumn("ratio", F.when((F.col("fine_e") >= SUPPORT) | (F.col("fine_c") >= SUPPORT), F.col("fine_r")).otherwise(F.col("coarse_r"))).drop(*[f"{n}_{x}" for n in ("fine", "coarse") for x in "ecr"])


def source_limits(rated: DataFrame) -> DataFrame:
    """(source, unit, length) at which closed-off texts of a source pile up. Counts combine before the shuffle, so one source with most of the rows is no hot task."""
    looks = rated.filter((F.col("ratio") < LOOK) | (F.col("mark") != ""))
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")]))
    counts = looks.select("source", units.alias("u")).groupBy("source", "u.unit", "u.length").count()
    total = F.sum("count").over(Window.partitionBy("source", "unit"))
    return counts.withColumn("total", total).filter((F.col("count") >= LIMIT_TEXTS) & (F.col("count") >= LIMIT_SHARE * F.col("total"))).select("source", "unit", "length")


def _near_limit(features: DataFrame, limits: DataFrame) -> DataFrame:
    out = features.drop("at_limit")
    for unit in ("chars", "bytes"):
        out = sized_join(out, limits.filter(F.col("unit") == unit).select(F.col("source"), F.col("length").alias(unit), F.lit(True).alias(f"at_{unit}")), ["source", unit], "left")
    return out.withColumn("at_limit", F.coalesce("at_chars", "at_bytes", F.lit(False))).drop("at_chars", "at_bytes")


def _shingles(raw: bytes) -> tuple[Words, np.ndarray, np.ndarray]:
    words = split_words([raw], all_scripts=True)
    return (words, *windows(words.hash, words.text, SHINGLE))


def _spaced(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(characters with every run of white space as one blank, their places in the text)."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    blank = (codes == 32) | (codes >= 9) & (codes <= 13)
    place = np.flatnonzero(~blank | np.append(True, ~blank[:-1])[: len(blank)])
    return np.where(blank, np.uint32(32), codes)[place], place


def _last_anchor(mine: np.ndarray, theirs: np.ndarray) -> tuple[int, int] | None:
    """The end of the longest chain of shingles that occur once in both texts and in the same order in both."""
    sides = []
    for x in (mine, theirs):
        value, first, count = np.unique(x, return_index=True, return_counts=True)
        sides.append((value[count == 1], first[count == 1]))
    _, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    i, j = sides[0][1][i], sides[1][1][j]
    order = np.argsort(i)
    ends: list[int] = []
    last = None
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        k = bisect_left(ends, y)
        if k == len(ends):
            ends.append(y)
            last = (x, y)
        else:
            ends[k] = y
            if k == len(ends) - 1:
                last = (x, y)
    return last


def _end_in(tail: np.ndarray, window: np.ndarray, expected: int) -> int | None:
    """Where the best alignment of a tail with any part of a window ends: least edits, then nearest to ``expected``.

    The last character must agree, or the text has an ending of its own; at most 1 - ``CONTAINED`` of the tail is edited.
    """
    idx = np.arange(len(window) + 1)
    cost = np.zeros(len(window) + 1, np.int64)
    for k, c in enumerate(tail[:-1].tolist()):
        step = np.append(k + 1, np.minimum(cost[:-1] + (window != c), cost[1:] + 1))
        cost = np.minimum.accumulate(step - idx) + idx
    ends = np.flatnonzero(window == tail[-1])
    if not len(ends):
        return None
    edits = cost[ends]
    if edits.min() > (1 - CONTAINED) * len(tail):
        return None
    best = ends[edits == edits.min()] + 1
    return int(best[np.argmin(np.abs(best - expected))])


def aligned(text: str, other: str) -> str | None:
    """Where a text's alignment with a near-copy ends: ``line`` if the copy goes on within the line, ``text`` if it goes on after it, ``same`` if both end there; null if it is no near-copy or the text has an ending of its own.

    The pair is aligned by chained shingles up to the last one in common, and from there by edit distance of the text's
    tail, white space taken alike.
    """
    a = _MARK.sub("", text).rstrip()
    if not a:
        return None
    raw_a, raw_b = a.encode("utf-8", "replace"), other.encode("utf-8", "replace")
    (words_a, mine, at_a), (words_b, theirs, at_b) = _shingles(raw_a), _shingles(raw_b)
    own = set(mine.tolist())
    if len(own.intersection(theirs.tolist())) + 1 < CONTAINED * len(own):
        return None
    codes_a, place_a = _spaced(a)
    codes_b, place_b = _spaced(other)
    here = there = 0
    if anchor := _last_anchor(mine, theirs):
        ends = words_a.end[at_a[anchor[0]] + SHINGLE - 1], words_b.end[at_b[anchor[1]] + SHINGLE - 1]
        here, there = (int(np.searchsorted(place, len(raw[:e].decode("utf-8", "replace")))) for place, raw, e in zip((place_a, place_b), (raw_a, raw_b), ends, strict=True))
    left = len(codes_a) - here
    low = max(0, there - TAIL)
    window = codes_b[low : there + int(left / CONTAINED) + 2 * TAIL]
    end = _end_in(codes_a[-TAIL:], window, there + left - low)
    if end is None:
        return None
    stop = int(place_b[low + end - 1]) + 1
    rest = other[stop:]
    upto = set(_shingles(other[:stop].encode("utf-8", "replace"))[1].tolist())
    if len(own & upto) < CONTAINED * len(own | upto):
        return None
    if not rest.strip():
        return "same"
    return "text" if rest.lstrip(" \t")[:1] in "\r\n" else "line"


@F.pandas_udf(T.StringType())
def _aligned(text: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([aligned(a, b) for a, b in zip(text, other, strict=True)], dtype=object)


def bucket_ranks(texts: DataFrame) -> DataFrame:
    """(bucket, key, chars, top, rank): the members of every bucket that holds several texts, the longest first.

    ``texts``: key, chars, buckets, one row a text. ``top`` marks buckets of the text's largest sketch, in which it asks
    for longer copies. Counts combine before the shuffle, and ranks of a large bucket are dealt over ranges, so a bucket
    with a third of all texts is no hot task.
    """
    exploded = texts.select("key", "chars", F.size("buckets").alias("n"), F.posexplode("buckets").alias("pos", "bucket")).select("bucket", "key", "chars", (F.col("pos") >= F.col("n") - BANDS).alias("top"))
    # members shorter than all that ask are nobody's copies
    asked = exploded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.when(F.col("top"), F.col("chars"))).alias("least")).filter("n > 1 and least is not null").select("bucket", "least")
    members = exploded.join(asked, "bucket").filter("chars >= least").drop("least")
    return spread_rank(members.withColumn("longer", -F.col("chars")), ["bucket"], ["longer", "key"]).drop("longer")


def aligned_copies(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, other, how): of each text the longest near-copy with which it aligns where it ends, and how (see ``aligned``).

    ``texts``: key, text. Copies are tried by their rank in a bucket, in rounds that grow by ``ROUND``; a text leaves as
    soon as one settles it, and one that ends together with a longer copy is a member of that copy's class and settled,
    too. So no pairs within a bucket are formed beyond those tried, and no copy is left out for a text that isn't settled.
    """
    asking = cut(ranked.filter("top and rank > 1").select("bucket", "key", F.col("rank").alias("own")))
    most = asking.agg(F.max("own")).first()[0] or 0
    none = ranked.select("key", F.col("key").alias("other"), F.lit("same").alias("how")).limit(0)
    if not most:
        return none
    held = ranked.select("bucket", "rank", F.col("key").alias("other"), F.col("chars").alias("other_chars"))
    needed = cut(ranked.join(asking.select("bucket").distinct(), "bucket", "left_semi").select("key").distinct())
    texts = cut(sized_join(texts, needed, ["key"], "inner").groupBy("key").agg(F.first("text").alias("text")))
    settled, tried, low, high = none, asking.select("key", F.col("key").alias("other")).limit(0), 0, 1
    while low < most - 1:
        rest = asking.filter(F.col("own") > low + 1)
        if low:
            rest = rest.join(settled.select("key"), "key", "left_anti")
        # each asking row meets the members of these ranks only
        slots = rest.select("bucket", "key", F.explode(F.sequence(F.lit(low + 1), F.least(F.lit(high), F.col("own") - 1))).alias("rank"))
        pairs = slots.join(held, ["bucket", "rank"]).groupBy("key", "other").agg(F.first("other_chars").alias("other_chars"))
        if low:
            pairs = pairs.join(tried, ["key", "other"], "left_anti")
        pairs = cut(pairs)
        both = pairs.join(texts, "key").join(texts.select(F.col("key").alias("other"), F.col("text").alias("copy")), "other")
        found = both.select("key", "other", "other_chars", _aligned("text", "copy").alias("how")).filter("how is not null")
        best = found.groupBy("key").agg(F.max(F.struct("other_chars", "other", "how")).alias("b")).select("key", "b.other", "b.how")
        settled = cut(settled.unionByName(best))
        tried = tried.unionByName(pairs.select("key", "other"))
        low, high = high, high * ROUND
    return settled


def cut_by_copies(settled: DataFrame, half: DataFrame) -> DataFrame:
    """Keys of texts whose copy goes on where they end: within the line, or after it if their ending is more that of a cut text (``half``: key, half). Texts that end together with such a text are cut with it."""
    first = settled.join(half, "key").filter((F.col("how") == "line") | (F.col("how") == "text") & F.col("half")).select("key")
    found, fresh = cut(first), first
    together = settled.filter("how = 'same'").select("key", F.col("other"))
    while True:  # classes are stars about their longest text, so this takes a step or two
        fresh = cut(together.join(found.select(F.col("key").alias("other")), "other", "left_semi").select("key").join(found, "key", "left_anti").distinct())
        if fresh.isEmpty():
            return found
        found = cut(found.unionByName(fresh))


def judged_texts(documents: DataFrame) -> DataFrame:
    """Every text with its verdict: doc_id, source, truncated, reason (copy, limit, ending; null if whole).

    ``documents``: doc_id, text, source; other columns are ignored. Null and empty texts are whole. Repeated rows are
    judged once. A null source is a source of its own. Texts of fewer words than a sketch needs (16) have no near-copies
    and are judged by their ending alone. Equal texts are told by 64-bit hashes. An empty table gives an empty result.
    """
    given = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), "text")
    filled = given.filter("text is not null and text <> ''")
    features = cut(filled.select("doc_id", "source", F.xxhash64("text").alias("key"), "text").mapInArrow(_features, _FEATURES))
    sketched = features.filter(F.size("buckets") > 0).groupBy("key").agg(F.first("chars").alias("chars"), F.first("buckets").alias("buckets"))
    copies = aligned_copies(bucket_ranks(sketched), filled.select(F.xxhash64("text").alias("key"), "text"))
    shapes = features.drop("buckets")
    limits = cut(source_limits(_rated(shapes.withColumn("at_limit", F.lit(False)))))
    rated = cut(_rated(_near_limit(shapes, limits)).drop("cut_fine", "cut_coarse", "chars", "bytes"))
    by_copy = cut_by_copies(copies, rated.groupBy("key").agg(F.min(F.col("ratio") < HALF).alias("half"))).withColumn("copied", F.lit(True))
    line_end = line_ended()
    at_limit = F.col("at_limit") & F.when(line_end, F.col("ratio") < HALF).otherwise((F.col("ratio") < SOUND) | (F.col("mark") != ""))
    ending = (F.col("mark") == "") & ((F.col("ratio") < CUT) | left_open() & (F.col("ratio") < HALF)) | (F.length("mark") > 1)
    reason = F.when(F.col("copied"), "copy").when(at_limit, "limit").when(ending, "ending")
    judged = rated.join(by_copy, "key", "left").withColumn("reason", reason).groupBy("doc_id", "source").agg(F.min("reason").alias("reason"))
    rest = given.filter("text is null or text = ''").select("doc_id", "source").distinct().withColumn("reason", F.lit(None).cast("string"))
    return judged.unionByName(rest).select("doc_id", "source", F.col("reason").isNotNull().alias("truncated"), "reason")


def truncation_by_source(judged: DataFrame) -> DataFrame:
    """How often each source truncates: source, texts, truncated, share."""
    return judged.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("truncated").cast("bigint")).alias("truncated")).withColumn("share", F.col("truncated") / F.col("texts"))
