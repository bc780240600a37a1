"""Structural indexing against a plain walk of parsed JSON."""

import datetime as dt
import json
import random

from tallyforge.operators import nested
from tallyforge.operators.nested import catalog_nodes, flatten_trees, linked_tables

SCHEMA = "dat_id bigint, node string, loaded_at timestamp_ntz, path string"


def walk(tree, path="r"):
    body = isinstance(tree, dict) and (tree.get("Dir") or tree.get("File")) or {}
    children = body.get("children") if isinstance(body, dict) else None
    if isinstance(children, str):
        try:
            children = json.loads(children)
        except ValueError:
            children = None
    if isinstance(children, dict):
        children = [children]
    for k, c in enumerate(children or []):
        if isinstance(c, dict):
            yield path, f"{path}/{k}", c.get("name")
            yield from walk(c.get("node"), f"{path}/{k}")


def grow(r, depth):
    name = r.choice(["a", 'q"uo\\te', "{[,:]}", "日本", "", "\\", "tab\t"])
    if depth == 0 or r.random() < 0.4:
        return {"name": name, "file_type": "File", "node": {"File": {"size": r.choice([1, "2", None]), "crc": None}}}
    kids = [r.choice([None, grow(r, depth - 1), grow(r, depth - 1)]) for _ in range(r.randint(0, 4))]
    shape = r.random()
    children = kids if shape < 0.6 else json.dumps(kids) if shape < 0.75 else (kids[0] if kids else None) if shape < 0.9 else None
    return {"node": {"Dir": {"d_game": r.choice([None, {"description": "x", "category": ["a", "b"]}]), "children": children}}, "name": name}


def test_random_trees():
    r = random.Random(3)
    docs = []
    for i in range(300):
        text = json.dumps(grow(r, 5)["node"], ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        docs.append((i, text if r.random() < 0.9 else text[: r.randint(0, len(text))]))
    flat, readable = flatten_trees(docs, ["name"])
    want = set()
    for i, t in docs:
        try:
            tree = json.loads(t)
        except ValueError:
            assert not readable[i]
            continue
        want |= {(i, *x) for x in walk(tree)}
    assert set(zip(flat["id"], flat["parent_path"], flat["node_path"], flat["name"])) == want
    assert len(flat["id"]) == len(want)


def rows(spark, data):
    return catalog_nodes(spark.createDataFrame(data, SCHEMA), [])


def test_last_row_holds_even_if_unreadable(spark):
    t = lambda n: dt.datetime(2024, 1, n)
    one = '{"Dir": {"children": [null, {"name": "x", "node": {"File": {}}}]}}'
    data = [(1, one, t(1), "p"), (1, one, t(1), "p"), (2, one, t(1), "p"), (2, one[:-3], t(2), "p"), (3, None, t(1), "p"), (4, "", t(1), "p"), (None, one, t(1), "p"), (5, "[]", t(1), None), (6, "7", None, None)]
    assert [tuple(r) for r in rows(spark, data).collect()] == [(1, "r", "r/1")]
    assert rows(spark, []).count() == 0


def test_wide_and_deep(spark):
    wide = json.dumps({"Dir": {"children": [{"name": "x", "node": {"File": {}}}] * 20_000}})
    deep = '{"Dir": {"children": [{"name": "x", "node": ' * 400 + '{"File": {}}' + "}]}}" * 400
    got = rows(spark, [(1, wide, None, None), (2, deep, None, None)])
    assert got.groupBy("dat_id").count().orderBy("dat_id").collect() == [(1, 20_000), (2, 400)]


def test_linked_tables(spark):
    tree = {"Dir": {"children": [{"name": "d", "node": {"Dir": {"children": {"name": "g", "node": {"Dir": {"d_game": {"year": 1999, "category": "c"}, "children": [{"name": "fé", "file_type": "File", "node": {"File": {"size": "12", "is_disk": True}}}]}}}}}}]}}
    t = linked_tables(catalog_nodes(spark.createDataFrame([(1, json.dumps(tree), None, "clash")], SCHEMA)))
    assert [(r.node_path, r.name) for r in t["directories"].collect()] == [("r/0", "d")]
    assert [(r.node_path, r.year, r.category) for r in t["games"].collect()] == [("r/0/0", "1999", ["c"])]
    assert [(r.parent_path, r.name, r["size"], r.is_disk) for r in t["files"].collect()] == [("r/0/0", "fé", 12, "true")]


def test_the_grammar_is_that_of_a_parser():
    """Documents whole and broken at random places: the arrays say what json.loads says."""
    r = random.Random(1)

    def value(d=0):
        k = r.random()
        if d > 4 or k < 0.3:
            return r.choice([1, 0, -3, 2.5, 1e9, True, False, None, "a", 'x"y', "\\", "é\n", "{[,:", "", "\x01"])
        if k < 0.65:
            return [value(d + 1) for _ in range(r.randint(0, 4))]
        return {r.choice(["a", "b", "node", "children", "k\\", 'q"']): value(d + 1) for _ in range(r.randint(0, 4))}

    docs = [b"", b" ", b"nul", b"NaN", b"[-Infinity]", b"01", b"[1 2]", b"1 2", b'{"a" "b"}', b'{"a":}', b"[1,]", b'{"a":1,}', b'"\\u12g4"', b'"\\u1234"', b'"\\x"', b"[1}", b"{1:2}", b'{"a":1:2}', b'[{"a":1}"b"]', b'"a\tb"']
    for _ in range(6000):
        t = json.dumps(value(), ensure_ascii=r.random() < 0.5, indent=r.choice([None, None, 1]))
        if r.random() < 0.75:
            i = r.randrange(len(t) + 1)
            t = r.choice([t[:i] + t[i + 1 :], t[:i] + r.choice('{}[],:"\\ \n\t0-1.enul\x01\x0b') + t[i:], t[:i] + r.choice('{}[],:"\\ 01eE+-') + t[i + 1 :]])
        docs.append(t.encode())

    def reads(d):
        try:
            json.loads(d.decode())
        except ValueError:
            return False
        return True

    for i in range(0, len(docs), 500):
        assert nested._Index(docs[i : i + 500]).ok.tolist() == [reads(d) for d in docs[i : i + 500]]


def test_depth_makes_no_difference():
    deep = '{"Dir":{"children":[' * 1 + '{"name":"x","node":{"Dir":{"children":[' * 3000 + "]}}}" * 3000 + "]}}"
    flat, readable = nested.flatten_trees([(1, deep), (2, deep[:-1] + "]")], [])
    assert readable == [True, False] and len(flat["node_path"]) == 3000


def test_linked_lists(spark):
    tree = json.dumps({"Dir": {"children": [{"name": "g", "file_type": "Zip", "node": {"Dir": {"d_game": {"category": ["a", "b"], "device_ref": "d"}, "children": []}}}]}})
    games = nested.linked_tables(nested.catalog_nodes(spark.createDataFrame([(1, tree, 1)], "dat_id bigint, node string, loaded_at int")))["games"]
    assert [(r.category, r.device_ref) for r in games.collect()] == [(["a", "b"], ["d"])]
