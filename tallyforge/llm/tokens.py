"""Byte-level BPE encoding of whole corpora in batched numpy merge rounds.

Splitting into words, finding the distinct words of a chunk and merging all work on flat arrays. In a merge round the
symbols of many words lie side by side in one array; every adjacent pair is looked up by binary search in the sorted
pair keys, each word's lowest rank is found by a segmented minimum, and all its pairs of that rank are merged at once.
Python never loops over words or tokens.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are laid out in arrays at once; a longer text is cut at places where a word must begin.
CHUNK = 2 << 20
_SEP = 0xFF  # occurs in no UTF-8 text
_LETTER, _NUMBER, _SPACE, _OTHER, _END = range(5)
_SHIFT = 20
_NEVER = np.int64(2**31)


def byte_symbols() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_merges(path: str) -> dict[str, np.ndarray]:
    """The merge table of a byte-level BPE vocabulary file: ids of the 256 bytes, sorted pair keys, their ranks and merged ids.

    Its size is bounded by the vocabulary, so it is shipped with the tasks.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, symbols = model["vocab"], byte_symbols()
    if len(vocab) >= 1 << _SHIFT:
        raise ValueError("vocabulary too large for the pair keys")
    first = np.full(256, -1, np.int64)
    for s, b in symbols.items():
        first[b] = vocab[s]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    keys = np.array([vocab[a] << _SHIFT | vocab[b] for a, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    return {"first": first, "keys": keys[order], "ranks": order.astype(np.int64), "merged": merged[order]}


@cache
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(sys.maxunicode + 2, _OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        g = unicodedata.category(chr(c))[0]
        if g == "L":
            table[c] = _LETTER
        elif g == "N":
            table[c] = _NUMBER
    table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    table[sys.maxunicode + 1] = _END
    return table


def _code_points(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, code point) of every character of UTF-8 bytes with separators."""
    at = np.flatnonzero((b & 0xC0) != 0x80)
    cp = b[at].astype(np.int32)
    for lead, mask, size in ((0xC0, 0x1F, 2), (0xE0, 0x0F, 3), (0xF0, 0x07, 4)):
        some = np.flatnonzero((cp >= lead) & (cp < (lead + 0x20 if size == 2 else lead + 0x10 if size == 3 else 0xF8)) & (np.diff(np.append(at, len(b))) == size))
        if len(some):
            p, v = at[some], b[at[some]].astype(np.int32) & mask
            for k in range(1, size):
                v = v << 6 | (b[p + k] & 0x3F)
            cp[some] = v
    cp[b[at] == _SEP] = sys.maxunicode + 1
    return at, cp


def word_starts(b: np.ndarray) -> np.ndarray:
    """Byte positions where the words of the public splitting pattern start; separators are words of their own.

    The pattern takes English contractions, runs of letters, numbers or other signs with one blank before them, and
    runs of white space without the blank that belongs to what follows.
    """
    at, cp = _code_points(b)
    n = len(at)
    kind = _classes()[cp]
    run = np.empty(n, bool)
    run[:1] = True
    run[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _END)
    start = run.copy()
    first = np.flatnonzero(run)
    last = np.append(first[1:], n) - 1
    space = kind[first] == _SPACE
    s, e = first[space], last[space]
    inner = (e + 1 < n) & (kind[np.minimum(e + 1, n - 1)] != _END)  # something that is no white space follows
    s, e = s[inner], e[inner]
    start[e] = True
    blank = cp[e] == 32
    start[e[blank] + 1] = False  # it begins at the blank
    q = first[(cp[first] == 39) & (first == last)]
    q = q[start[q] & (q + 1 < n)]
    if len(q):
        pad = np.append(cp, [-1, -1, -1])
        letter = lambda i: np.append(kind, [_END] * 3)[i] == _LETTER
        a, c = pad[q + 1], pad[q + 2]
        one = letter(q + 1) & np.isin(a, [ord(x) for x in "stmd"])
        two = letter(q + 1) & letter(q + 2) & (((a == ord("r")) | (a == ord("v"))) & (c == ord("e")) | (a == ord("l")) & (c == ord("l")))
        for hit, k in ((one, 2), (two, 3)):
            h = q[hit]
            start[h + 1] = False
            rest = h + k
            rest = rest[(rest < n) & letter(rest)]
            start[rest] = True
    return at[start]


def merge_words(symbols: np.ndarray, word: np.ndarray, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All merge rounds over the symbols of many words in one flat array. ``word`` numbers each symbol's word, ascending. Returns merged symbols and their words in the same order."""
    keys, ranks, merged = table["keys"], table["ranks"], table["merged"]
    done_symbols, done_words = [], []
    while len(symbols):
        pair = (symbols[:-1] << _SHIFT) | symbols[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank = np.full(len(symbols), _NEVER)
        rank[:-1] = np.where((keys[at] == pair) & (word[:-1] == word[1:]), ranks[at], _NEVER)
        new_word = np.append(True, word[1:] != word[:-1])
        head = np.flatnonzero(new_word)
        lowest = np.repeat(np.minimum.reduceat(rank, head), np.diff(np.append(head, len(symbols))))
        still = lowest < _NEVER
        if not still.all():
            done_symbols.append(symbols[~still])
            done_words.append(word[~still])
        hit = still & (rank == lowest)
        # of overlapping pairs every second one is merged, from the left
        i = np.arange(len(symbols))
        begin = hit & ~np.append(False, hit[:-1])
        since = i - np.maximum.accumulate(np.where(begin, i, -1))
        hit &= since % 2 == 0
        where = np.flatnonzero(hit)
        symbols[where] = merged[at[where]]
        keep = still
        keep[where + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done_words:
        return symbols, word
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], word[order]


def encode_chunk(texts: list[bytes], table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each text)."""
    b = np.frombuffer(bytes([_SEP]).join(texts) + bytes([_SEP]), np.uint8)
    start = word_starts(b)
    length = np.diff(np.append(start, len(b)))
    where = np.arange(len(b))
    inside = where - np.repeat(start, length)
    # distinct words by a polynomial hash, checked byte by byte against the first of each
    power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64))
    value = np.add.reduceat((b.astype(np.uint64) + np.uint64(1)) * power[inside], start)
    value ^= value >> np.uint64(29)
    _, chosen, of = np.unique(value, return_index=True, return_inverse=True)
    model = start[chosen][of]
    same = length[chosen][of] == length
    same &= np.logical_and.reduceat(b == b[np.minimum(np.repeat(model, length) + inside, len(b) - 1)], start)
    odd = np.flatnonzero(~same)  # equal hash, other word: each stands for itself
    of[odd] = len(chosen) + np.arange(len(odd))
    chosen = np.append(chosen, odd)
    size = length[chosen]
    flat = np.repeat(start[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    raw, word = b[flat], np.repeat(np.arange(len(chosen)), size)
    text = raw != _SEP
    ids, word = merge_words(table["first"][raw[text]], word[text], table)
    count = np.bincount(word, minlength=len(chosen))
    offset = np.cumsum(count) - count
    each = count[of]
    before = np.cumsum(each) - each
    out = ids[np.repeat(offset[of] - before, each) + np.arange(each.sum())].astype(np.int32)
    ends = np.flatnonzero(b[start] == _SEP)
    return out, np.diff(np.append(0, before[ends]))


def _pieces(text: bytes) -> list[bytes]:
    """A text longer than CHUNK, cut before blanks between ASCII letters or digits, where a word begins whatever comes before."""
    out, begin = [], 0
    while len(text) - begin > CHUNK:
        cut = begin + CHUNK
        while True:
            cut = text.find(b" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                return [*out, text[begin:]]
            if text[cut - 1 : cut].isalnum() and text[cut + 1 : cut + 2].isalnum():
                break
            cut += 1
        out.append(text[begin:cut])
        begin = cut
    return [*out, text[begin:]]


def encode_texts(texts: list[bytes | None], table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each text) of texts in UTF-8; null and empty texts have none."""
    ids, counts, chunk, owner, held = [], np.zeros(len(texts), np.int64), [], [], 0

    def flush() -> None:
        nonlocal chunk, owner, held
        if chunk:
            found, n = encode_chunk(chunk, table)
            ids.append(found)
            np.add.at(counts, owner, n)
            chunk, owner, held = [], [], 0

    for i, t in enumerate(texts):
        for piece in _pieces(t) if t else ():
            chunk.append(piece)
            owner.append(i)
            held += len(piece)
            if held >= CHUNK:
                flush()
    flush()
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts


def encode_corpus(df: DataFrame, text: str, table: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``ids`` (array<int>) of each row's text; rows stay where they are, nothing is shuffled.

    Text that looks like a special token is plain text. Null and empty texts give an empty list. Repeated rows are
    kept. Text of any length is encoded whole. Columns of ``df`` not in ``keep`` are pruned at the scan.
    """
    given = df.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias("_text"))
    schema = T.StructType([*[f for f in given.schema.fields if f.name != "_text"], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = encode_texts(batch.column("_text").to_pylist(), table)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, "ids"])

    return given.mapInArrow(run, schema)
