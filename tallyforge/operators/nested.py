"""Nested catalog trees into flat linked tables by vectorised structural indexing.

A chunk of documents is one byte array. Bitmaps of quotes, brackets and delimiters come from whole-array comparisons;
prefix sums give string parity and nesting depth; sorting by depth pairs brackets and finds each token's container.
The grammar is checked on the same arrays, as which token may follow which in an object or a list. Nodes are then
followed level by level with array lookups: no document is parsed or walked in Python, at any depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of documents indexed at once; one longer document is a chunk of its own.
CHUNK = 4 << 20
#: Fields of a node element, of its Dir or File object, and of a game's object.
ELEMENT, BODY = ["name", "file_type", "dat_status", "date_modified"], ["size", "crc", "sha1", "md5", "sha256", "merge", "status", "region", "mia", "is_disk"]
GAME = ["description", "year", "manufacturer", "clone_of", "rom_of", "category", "device_ref"]
FIELDS = [*ELEMENT, *BODY, *GAME]
_KEYS = {k: i for i, k in enumerate(["Dir", "File", "children", "node", "d_game", *FIELDS])}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


#: Lexemes by byte: braces, brackets, comma, colon; then strings, other values, and strings that are keys. A document starts with START.
_LEXEME = np.zeros(256, np.int64)
_LEXEME[[123, 125, 91, 93, 44, 58]] = range(6)
_STRING, _PLAIN, _KEY, _START = 6, 7, 8, 9
#: What may follow a lexeme outside all brackets, in an object and in a list.
_FOLLOWS = np.zeros((3, 10, 8), bool)
_VALUE = [_STRING, _PLAIN, 0, 2]
_FOLLOWS[0, _START, _VALUE] = True
_FOLLOWS[1, 0, [_STRING, 1]] = _FOLLOWS[1, 4, _STRING] = _FOLLOWS[1, _KEY, 5] = True
_FOLLOWS[1, 5, _VALUE] = True
_FOLLOWS[2, 2, [*_VALUE, 3]] = True
_FOLLOWS[2, 4, _VALUE] = True
for _v in (_STRING, _PLAIN, 1, 3):
    _FOLLOWS[1, _v, [4, 1]] = _FOLLOWS[2, _v, [4, 3]] = True
_NUMBER = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|NaN|-?Infinity")
_ESCAPES, _HEX = np.zeros(256, bool), np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_HEX[list(b"0123456789abcdefABCDEF")] = True


def _malformed(b: np.ndarray, begin: np.ndarray, ok: np.ndarray, token: np.ndarray, doc: np.ndarray, kind: np.ndarray, depth: np.ndarray, quotes: np.ndarray) -> np.ndarray:
    """Documents that break the grammar, of those whose quotes and brackets balance (``ok``): all arrays are of these only."""
    size, bad = len(b), []
    opens, closes = (kind == 123) | (kind == 91), (kind == 125) | (kind == 93)
    level = depth + closes
    a, c = np.argsort(level[opens], kind="stable"), np.argsort(level[closes], kind="stable")
    bad.append(doc[opens][a][kind[opens][a] + 2 != kind[closes][c]])
    open_pos, open_level = token[opens][a], level[opens][a]
    open_key, is_object = open_level * size + open_pos, kind[opens][a] == 123
    # strings, and runs of what is neither string, blank nor structure
    first, last = quotes[0::2], quotes[1::2]
    inside = np.zeros(size + 1, np.int8)
    inside[first] += 1
    inside[last + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    plain = ~inside & ~_SPACE[b]
    plain[token] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[0], plain.view(np.int8), [0]])))
    run, stop = edge[0::2], edge[1::2]
    of = lambda pos: np.searchsorted(begin, pos, "right") - 1
    run_doc = of(run)
    run, stop, run_doc = run[ok[run_doc]], stop[ok[run_doc]], run_doc[ok[run_doc]]
    digit = np.concatenate([[0], np.cumsum((b >= 48) & (b <= 57))])
    length = stop - run
    fine = (digit[stop] - digit[run] == length) & ((length == 1) | (b[run] != 48))
    for word in (b"null", b"true", b"false"):
        same = length == len(word)
        for j, x in enumerate(word):
            same[same] = b[run[same] + j] == x
        fine |= same
    rest = np.flatnonzero(~fine)
    bad.append(run_doc[rest[[_NUMBER.fullmatch(b[i:j].tobytes()) is None for i, j in zip(run[rest].tolist(), stop[rest].tolist(), strict=True)]]] if len(rest) else rest)
    bad.append(of(np.flatnonzero(inside & (b < 32))))
    slash = np.flatnonzero(inside & (b == 92))
    if len(slash):  # the first of each pair of backslashes begins an escape
        new = np.append(True, np.diff(slash) > 1)
        head = slash[np.maximum.accumulate(np.where(new, np.arange(len(slash)), 0))]
        escape = slash[(slash - head) % 2 == 0]
        after = b[np.minimum(escape + 1, size - 1)]
        bad.append(of(escape[~_ESCAPES[after]]))
        coded = escape[after == 117]
        hexed = np.ones(len(coded), bool)
        for j in range(2, 6):
            hexed &= _HEX[b[np.minimum(coded + j, size - 1)]]
        bad.append(of(coded[~hexed]))
    pos = np.concatenate([token, first, run])
    code = np.concatenate([_LEXEME[kind], np.full(len(first), _STRING), np.full(len(run), _PLAIN)])
    owner = np.concatenate([doc, of(first), run_doc])
    order = np.argsort(pos, kind="stable")
    pos, code, owner = pos[order], code[order], owner[order]
    # the level a lexeme lies in is the depth behind the last bracket before it; a closing bracket lies in what it closes
    before = np.searchsorted(token, pos) - 1
    at = np.where((before >= 0) & (doc[np.maximum(before, 0)] == owner), depth[np.maximum(before, 0)], 0) if len(token) else np.zeros(len(pos), np.int64)
    where = np.zeros(len(pos), np.int64)
    deep = np.flatnonzero(at > 0)
    where[deep] = np.where(is_object[np.searchsorted(open_key, at[deep] * size + pos[deep]) - 1], 1, 2)
    previous = np.append(_START, code[:-1])
    previous[np.append(True, owner[1:] != owner[:-1])] = _START
    key = (code == _STRING) & (where == 1) & ((previous == 0) | (previous == 4))
    previous[np.flatnonzero(key[:-1] & (owner[1:] == owner[:-1])) + 1] = _KEY
    bad.append(owner[~_FOLLOWS[where, previous, code]])
    some = np.zeros(len(begin), bool)
    some[owner] = True
    bad.append(np.flatnonzero(~some))
    return np.concatenate(bad)


class _Index:
    """Structural index of documents joined by line ends. Unreadable documents have no tokens; ``ok`` says which are readable."""

    def __init__(self, docs: list[bytes]):
        self.docs = docs
        data = b"\n".join(docs) + b"\n"
        b = self.b = np.frombuffer(data, np.uint8)
        self.size = len(b)
        lengths = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
        self.start = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if docs else np.zeros(0, np.int64)
        quotes = np.flatnonzero(b == 34)
        if (b == 92).any():  # a quote after an odd run of backslashes is escaped
            i = np.arange(self.size)
            last = np.maximum.accumulate(np.where(b != 92, i, -1))
            before = np.maximum(quotes - 1, 0)
            quotes = quotes[(before - last[before]) % 2 == 0]
        owner = np.searchsorted(self.start, quotes, "right") - 1
        count = np.bincount(owner, minlength=len(docs))
        first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        token = np.flatnonzero((b == 123) | (b == 125) | (b == 91) | (b == 93) | (b == 44) | (b == 58))
        doc = np.searchsorted(self.start, token, "right") - 1
        outside = (np.searchsorted(quotes, token) - first[doc]) % 2 == 0  # string parity
        token, doc = token[outside], doc[outside]
        kind = b[token]
        opens, closes = (kind == 123) | (kind == 91), (kind == 125) | (kind == 93)
        step = opens.astype(np.int64) - closes
        depth = np.cumsum(step)
        if len(token):
            at = np.searchsorted(doc, np.arange(len(docs)))  # depth starts anew in each document
            base = np.where(at > 0, depth[np.maximum(at - 1, 0)], 0)
            depth = depth - base[doc]
        final = np.zeros(len(docs), np.int64)
        np.add.at(final, doc, step)
        ok = (count % 2 == 0) & (final == 0)
        ok[doc[depth < 0]] = False
        keep = ok[doc]
        ok[_malformed(b, self.start, ok, token[keep], doc[keep], kind[keep], depth[keep], quotes[ok[owner]])] = False
        self.ok = ok
        keep = ok[doc]
        token, doc, kind, depth, opens, closes = token[keep], doc[keep], kind[keep], depth[keep], opens[keep], closes[keep]
        quotes = quotes[ok[owner]]
        self.open_quote, self.close_quote = quotes[0::2], quotes[1::2]
        level = depth + closes  # the depth inside the bracket that a token opens or closes, or lies in
        self.open_pos, open_level = token[opens], level[opens]
        close_pos, close_level = token[closes], level[closes]
        # at one depth, brackets open and close in turn
        a, c = np.argsort(open_level, kind="stable"), np.argsort(close_level, kind="stable")
        self.match = np.empty(len(self.open_pos), np.int64)
        self.match[a] = close_pos[c]
        self._by_level, self._level_key = a, open_level[a] * self.size + self.open_pos[a]
        comma, colon = kind == 44, kind == 58
        self.comma_pos, self.comma_in = token[comma], self._container(token[comma], level[comma])
        order = np.argsort(self.comma_in, kind="stable")
        self.comma_pos, self.comma_in = self.comma_pos[order], self.comma_in[order]
        ends = np.concatenate([token[comma], close_pos])
        ends.sort()
        self.solid = np.flatnonzero(~_SPACE[b])
        at = token[colon]
        inside = self._container(at, level[colon])
        key = np.searchsorted(self.close_quote, at) - 1
        start, length = self.open_quote[key] + 1, self.close_quote[key] - self.open_quote[key] - 1
        code = np.full(len(at), -1, np.int64)
        for name, i in _KEYS.items():
            raw = np.frombuffer(name.encode(), np.uint8)
            fits = np.flatnonzero(length == len(raw))
            same = np.ones(len(fits), bool)
            for j, byte in enumerate(raw):
                same &= b[start[fits] + j] == byte
            code[fits[same]] = i
        known = code >= 0
        entry = inside[known] * len(_KEYS) + code[known]
        value = self.next_solid(at[known] + 1)
        order = np.argsort(entry, kind="stable")
        self.entry, self.value, self._ends = entry[order], value[order], ends

    def _container(self, pos: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Index of the innermost bracket around each position of known depth."""
        if not len(self._by_level):
            return np.zeros(0, np.int64)
        return self._by_level[np.searchsorted(self._level_key, level * self.size + pos) - 1]

    def next_solid(self, pos: np.ndarray) -> np.ndarray:
        return self.solid[np.minimum(np.searchsorted(self.solid, pos), len(self.solid) - 1)] if len(self.solid) else pos

    def bracket_at(self, pos: np.ndarray) -> np.ndarray:
        """Index of the bracket that opens at each position."""
        return np.searchsorted(self.open_pos, pos)

    def get(self, inside: np.ndarray, key: str) -> np.ndarray:
        """Where the value of a key starts in each object, -1 if it has none; of equal keys the last holds."""
        want = inside * len(_KEYS) + _KEYS[key]
        at = np.searchsorted(self.entry, want, "right") - 1
        found = (inside >= 0) & (at >= 0)
        found[found] = self.entry[at[found]] == want[found]
        out = np.full(len(inside), -1, np.int64)
        out[found] = self.value[at[found]]
        return out

    def object_at(self, pos: np.ndarray) -> np.ndarray:
        """Index of the object that starts at each position, -1 if something else does."""
        out = np.full(len(pos), -1, np.int64)
        is_object = (pos >= 0) & (self.b[np.maximum(pos, 0)] == 123)
        out[is_object] = self.bracket_at(pos[is_object])
        return out

    def text(self, pos: int) -> str | None:
        """The value that starts at ``pos``: a string's text, null as None, else the JSON as written."""
        byte = self.b[pos]
        if byte == 34:
            end = self.close_quote[np.searchsorted(self.open_quote, pos)]
            raw = self.b[pos + 1 : end].tobytes()
            if b"\\" in raw:
                return json.loads(b'"' + raw + b'"').encode("utf-8", "replace").decode("utf-8")
            return raw.decode("utf-8", "replace")
        end = self.match[np.searchsorted(self.open_pos, pos)] + 1 if byte in (91, 123) else self._ends[np.searchsorted(self._ends, pos)]
        raw = self.b[pos:end].tobytes().decode("utf-8", "replace").strip()
        return None if raw == "null" else raw


def _elements(ix: _Index, value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Children values to (owner, place, element start) and the embedded strings (owner, start)."""
    byte = np.where(value >= 0, ix.b[np.maximum(value, 0)], 0)
    single, listed, quoted = byte == 123, byte == 91, byte == 34
    lists = ix.bracket_at(value[listed])
    first = ix.next_solid(value[listed] + 1)
    filled = ix.b[first] != 93 if len(first) else np.zeros(0, bool)
    lists, first, who = lists[filled], first[filled], owner[listed][filled]
    lo, hi = np.searchsorted(ix.comma_in, lists), np.searchsorted(ix.comma_in, lists, "right")
    extra = hi - lo
    base = np.repeat(np.cumsum(extra) - extra, extra)
    nth = np.arange(extra.sum()) - base
    later = ix.next_solid(ix.comma_pos[np.repeat(lo, extra) + nth] + 1)
    who_all = np.concatenate([owner[single], who, np.repeat(who, extra)])
    place = np.concatenate([np.zeros(single.sum() + len(who), np.int64), nth + 1])
    start = np.concatenate([value[single], first, later])
    return who_all, place, start, list(zip(owner[quoted].tolist(), value[quoted].tolist(), strict=True))


def flatten_trees(docs: list[tuple[object, str]], fields: list[str]) -> tuple[dict[str, list], list[bool]]:
    """All nodes below the roots of (id, tree) pairs: columns id, parent_path, node_path, place, kind and ``fields``; and which trees could be read."""
    out: dict[str, list] = {c: [] for c in ["id", "parent_path", "node_path", "place", "kind", *fields]}
    ids, paths, texts, whole = [d for d, _ in docs], ["r"] * len(docs), [t.encode("utf-8", "replace") for _, t in docs], True
    readable: list[bool] = []
    while texts:  # the second and later rounds hold child lists that were embedded as strings
        ix = _Index(texts)
        if whole:
            readable = ix.ok.tolist()
        doc = np.flatnonzero(ix.ok)
        begin = ix.next_solid(ix.start[doc])
        next_round: list[tuple[object, str, bytes]] = []
        path_of, id_of = [paths[d] for d in doc], [ids[d] for d in doc]
        if whole:
            value = _children(ix, ix.object_at(begin))[0]
        else:
            value = begin
        owner = np.arange(len(doc))
        while len(owner):
            who, place, start, strings = _elements(ix, value, owner)
            for o, at in strings:
                if inner := ix.text(at):
                    next_round.append((id_of[o], path_of[o], inner.encode("utf-8", "replace")))
            element = ix.object_at(start)
            isnode = element >= 0
            who, place, element = who[isnode], place[isnode], element[isnode]
            order = np.lexsort((place, who))
            who, place, element = who[order], place[order], element[order]
            parents = [path_of[w] for w in who]
            path_of, id_of = [f"{p}/{k}" for p, k in zip(parents, place.tolist(), strict=True)], [id_of[w] for w in who]
            body_value, body, is_file = _children(ix, ix.object_at(ix.get(element, "node")))
            out["id"] += id_of
            out["parent_path"] += parents
            out["node_path"] += path_of
            if fields:
                game = ix.object_at(ix.get(body, "d_game"))
                out["place"] += place.tolist()
                out["kind"] += np.where(is_file, "file", np.where(game >= 0, "game", "dir")).tolist()
                for f in fields:
                    at = ix.get(element if f in ELEMENT else body if f in BODY else game, f)
                    out[f] += [None if p < 0 else ix.text(p) for p in at.tolist()]
            value, owner = body_value, np.arange(len(element))
        ids, paths, texts, whole = [x[0] for x in next_round], [x[1] for x in next_round], [x[2] for x in next_round], False
    return out, readable


def _children(ix: _Index, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of node values ({"Dir": ...} or {"File": ...}): where the children start, the inner object, whether it is a file."""
    directory, file = ix.object_at(ix.get(node, "Dir")), ix.object_at(ix.get(node, "File"))
    body = np.where(directory >= 0, directory, file)
    return ix.get(body, "children"), body, (directory < 0) & (file >= 0)


def _mapper(fields: list[str]):
    columns = ["dat_id", "parent_path", "node_path", *(["place", "kind", *fields] if fields else [])]
    types = [pa.int64(), pa.string(), pa.string(), *([pa.int32(), pa.string()] + [pa.string()] * len(fields) if fields else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, held = [], 0
            rows = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            for i, (dat_id, tree) in enumerate(rows):
                chunk.append((dat_id, tree := tree.as_py()))
                held += len(tree)
                if held >= CHUNK or i == batch.num_rows - 1:
                    flat, _ = flatten_trees(chunk, fields)
                    yield pa.RecordBatch.from_arrays([pa.array(flat["id" if c == "dat_id" else c], t) for c, t in zip(columns, types, strict=True)], columns)
                    chunk, held = [], 0

    return run


def last_loaded(trees: DataFrame) -> DataFrame:
    """The row of each dat_id that was loaded last; of ties the greatest tree. It holds even if it can't be read."""
    return trees.filter("dat_id is not null").groupBy("dat_id").agg(F.max(F.struct("loaded_at", "node")).alias("m")).select("dat_id", F.col("m.node").alias("node"))


def catalog_nodes(trees: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Every node below the root of each catalog, linked to its parent by path.

    ``trees``: dat_id bigint, node string, loaded_at; others are ignored. Child lists may be a list, one object, a string
    holding either, or null; places of a list count from 0 with nulls included. A null, empty or unreadable tree has no
    nodes, an unreadable embedded list has none either. Rows with a null dat_id take no part. An empty table gives an
    empty result. With ``fields`` (default all) come place, kind (dir, game, file) and the fields as text.
    """
    fields = FIELDS if fields is None else fields
    schema = "dat_id bigint, parent_path string, node_path string" + ("".join([", place int, kind string", *[f", `{f}` string" for f in fields]]) if fields else "")
    held = last_loaded(trees.select(F.col("dat_id").cast("bigint").alias("dat_id"), "node", "loaded_at")).filter("node is not null and node <> ''")
    return held.select("dat_id", "node").mapInArrow(_mapper(fields), schema)


def linked_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """Directories, games and files of ``catalog_nodes`` as tables of their own, each row with its parent's path. Categories and device references come as lists; one alone is a list of one."""
    listed = lambda c: F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).when(F.col(c).isNotNull(), F.array(c)).alias(c)
    link = ["dat_id", "node_path", "parent_path", "place"]
    size = F.col("size").try_cast("bigint").alias("size")
    return {
        "directories": nodes.filter("kind = 'dir'").select(*link, *ELEMENT),
        "games": nodes.filter("kind = 'game'").select(*link, *ELEMENT, *[listed(c) if c in ("category", "device_ref") else c for c in GAME]),
        "files": nodes.filter("kind = 'file'").select(*link, *ELEMENT, size, *BODY[1:]),
    }
