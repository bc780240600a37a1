"""Evaluation passages in training text by greedy string tiling.

Seeds are hashes of consecutive words that an evaluation item shares with a document. Pairs that share a seed are tiled:
the longest passages common to both that aren't marked yet are found by running Karp-Rabin and marked, again and again,
so that passages are found in any order and none counts twice.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.words import split_words, windows

#: Items, and bytes of them, whose seeds are shipped to the tasks at once; more take further passes over the documents.
BLOCK, BLOCK_BYTES = 20_000, 64 << 20
#: Bytes of text laid out in arrays at once.
CHUNK = 4 << 20
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def tile(a: list[bytes], b: list[bytes], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in a, place in b, length) of passages of at least ``least`` words, longest first, none overlapping another in a or b.

    Each round hashes every unmarked window of ``least`` words in both by running Karp-Rabin, checks and extends equal
    ones, and marks the longest; the next round looks for those that are left. A window is compared only with those
    whose word before it differs, as a match that goes on to the left was seen there, and only if it can be as long as
    the longest so far: a text of few words over and over costs no more than its length.
    """
    code: dict[bytes, int] = {}
    x, y = ([code.setdefault(w, len(code) + 1) for w in s] for s in (a, b))
    used_x, used_y = [False] * len(x), [False] * len(y)
    tiles: list[tuple[int, int, int]] = []
    top = pow(_BASE, least - 1, _MOD)

    def rolled(s: list[int], used: list[bool]) -> Iterator[tuple[int, int]]:
        value = run = 0
        for i, c in enumerate(s):
            if used[i]:
                value = run = 0
                continue
            if run == least:
                value = (value - s[i - least] * top) % _MOD
                run -= 1
            value, run = (value * _BASE + c) % _MOD, run + 1
            if run == least:
                yield i - least + 1, value

    def free(used: list[bool]) -> list[int]:
        """Where the unmarked run that holds each place ends."""
        out, end = [0] * len(used), len(used)
        for i in range(len(used) - 1, -1, -1):
            if used[i]:
                end = i
            out[i] = end
        return out

    def common(i: int, j: int, most: int) -> int:
        """Length of the match at (i, j), by slices that double and then halve."""
        k, step = 0, least
        while step:
            step = min(step, most - k)
            if step and x[i + k : i + k + step] == y[j + k : j + k + step]:
                k, step = k + step, step * 2
            else:
                step //= 2
        return k

    while True:
        places: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for j, h in rolled(y, used_y):
            places[h][y[j - 1] if j and not used_y[j - 1] else 0].append(j)
        end_x, end_y = free(used_x), free(used_y)
        best, found = least, []
        for i, h in rolled(x, used_x):
            if h not in places:
                continue
            before = x[i - 1] if i and not used_x[i - 1] else 0
            for left, js in places[h].items():
                if left == before and left:
                    continue
                for j in js:
                    most = min(end_x[i] - i, end_y[j] - j)
                    if most >= best and (k := common(i, j, most)) >= best:
                        best = k
                        found.append((k, i, j))
        if not found:
            return tiles
        for k, i, j in sorted(m for m in found if m[0] == best):
            if not any(used_x[i : i + k]) and not any(used_y[j : j + k]):
                used_x[i : i + k] = used_y[j : j + k] = [True] * k
                tiles.append((i, j, k))


class _Items:
    """One block of items: their words, and which items hold a seed."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.ids = [r[0] for r in rows]
        words = split_words([r[1].encode() for r in rows])
        self.words = [words.of(i) for i in range(len(rows))]
        self.count = np.array([len(w) for w in self.words], np.int64)
        self.longest = int(self.count.max(initial=0)) + 1
        seed, place = windows(words.hash, words.text, least)
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner = seed[order], words.text[place][order]
        self.place = (place - np.searchsorted(words.text, words.text[place]))[order]
        self.near = np.zeros(1 << 22, bool)
        self.near[(seed & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``seeds``, item, place in the item) of equal seeds."""
        maybe = np.flatnonzero(self.near[(seeds & np.uint64((1 << 22) - 1)).astype(np.int64)])
        lo = np.searchsorted(self.seed, seeds[maybe])
        n = np.searchsorted(self.seed, seeds[maybe], "right") - lo
        base = np.cumsum(n) - n
        at = np.repeat(lo - base, n) + np.arange(n.sum())
        return np.repeat(maybe, n), self.owner[at], self.place[at]


def leaked(documents: DataFrame, items: DataFrame, least: int = 13, least_coverage: float = 0.0) -> DataFrame:
    """Documents that contain passages of items: doc_id, item_id, tiles, longest, covered (words of the item), coverage.

    ``documents``: doc_id, text; ``items``: item_id, text; other columns are ignored. A pair is reported if it shares at
    least ``least`` consecutive words and the tiles cover at least ``least_coverage`` of the item's words. Null and
    empty texts and texts of fewer words share nothing; repeated rows come once; items of equal text are all reported.
    Documents are read where they lie; only pairs whose shared seeds can cover enough are tiled, whole. Items go out in
    blocks told by a hash, each a bounded piece of the stated query set.
    """
    schema = T.StructType([*documents.select(F.col("doc_id").cast("bigint").alias("doc_id")).schema.fields, T.StructField("item_id", T.LongType()), T.StructField("tiles", T.IntegerType()), T.StructField("longest", T.IntegerType()), T.StructField("covered", T.IntegerType()), T.StructField("coverage", T.DoubleType())])
    spark = documents.sparkSession
    given = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).filter(F.octet_length("text") >= 2 * least - 1)
    stated = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    size = stated.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size.n // BLOCK), -(-size.bytes // BLOCK_BYTES))
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        rows = stated.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        out = out.unionByName(given.mapInArrow(_finder(_Items([tuple(r) for r in rows], least), least, least_coverage), schema))
    return out.distinct()


def _finder(block: _Items, least: int, least_coverage: float):
    def search(ids: list[int], texts: list[bytes]) -> list[tuple]:
        words = split_words(texts)
        seed, place = windows(words.hash, words.text, least)
        at, item, where = block.hits(seed)
        pair = words.text[place[at]] * len(block.words) + item
        # words of the item that the shared seeds cover: no tiling covers more
        spot = np.unique(pair * block.longest + where)
        pair, where = spot // block.longest, spot % block.longest
        same = pair[1:] == pair[:-1]
        covered = np.append(np.where(same, np.minimum(least, where[1:] - where[:-1]), least), [least] * bool(len(pair)))
        some, first = np.unique(pair, return_index=True)
        most = np.add.reduceat(covered, first) if len(first) else covered
        enough = some[most >= least_coverage * block.count[some % len(block.words)]]
        pairs = [divmod(p, len(block.words)) for p in enough.tolist()]
        rows, current, own = [], -1, []
        for d, i in pairs:
            if d != current:
                current, own = d, words.of(d)
            tiles = tile(own, block.words[i], least)
            covered = sum(t[2] for t in tiles)
            if tiles and covered >= least_coverage * len(block.words[i]):
                rows.append((ids[d], block.ids[i], len(tiles), max(t[2] for t in tiles), covered, covered / len(block.words[i])))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        names = ["doc_id", "item_id", "tiles", "longest", "covered", "coverage"]
        for batch in batches:
            ids, texts, held, begin = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= CHUNK or i == len(texts) - 1:
                    rows = search(ids[begin : i + 1], texts[begin : i + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
                    held, begin = 0, i + 1

    return run
