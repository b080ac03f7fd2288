import random

import pytest

from tarnflow.operators import hierarchy, network

SCHEMA = "id long, up long, node long, root string"


def walk(parent):
    out = {}
    for n in parent:
        seen, at = [], n
        while at is not None and at not in seen:
            seen.append(at)
            at = parent[at]
        out[n] = (seen[-1], len(seen) - 1) if at is None else (min(seen[seen.index(at):]), -1)
    return out


def forest(seed, n):
    r = random.Random(seed)
    parent = {}
    for i in range(1, n + 1):
        k = r.random()
        parent[i] = None if k < 0.03 else r.randrange(1, n + 1) if k < 0.1 else max(1, i - r.randrange(1, 4))
    parent[1] = None
    return parent


def frame(spark, parent, r=random.Random(1)):
    none = lambda: r.choice([None, -1, 0, 10**9])
    rows = [(i, none() if p is None else p, i, "x") for i, p in parent.items()]
    rows += rows[::7] + [(None, 3, 1, "x"), (None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 300)])
def test_roots_depths_loops_paths_and_descendants(spark, seed, n):
    parent = forest(seed, n)
    links = hierarchy.parent_links(frame(spark, parent), "id", "up")
    res = hierarchy.resolve(links)
    rows = res.collect()
    want = walk(parent)
    assert len(rows) == n and {r["node"]: (r["root"], r["depth"]) for r in rows} == want
    on_loop = {r["node"] for r in rows if r["on_loop"]}
    assert on_loop == {x for x, (root, d) in want.items() if d == -1 and x in cycle(parent, root)}

    def chain(x):
        out = [x]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out

    trees = [x for x in parent if want[x][1] >= 0]
    got = {r["node"]: r["path"] for r in hierarchy.paths(links, res).collect()}
    assert got == {x: chain(x) if want[x][1] >= 0 else None for x in parent}
    pairs = {(r["node"], r["ancestor"], r["hops"]) for r in hierarchy.ancestors(links, res).collect()}
    assert pairs == {(x, y, k) for x in trees for k, y in enumerate(chain(x)) if k}
    counts = {r["node"]: r["descendants"] for r in hierarchy.descendant_counts(links, res).collect()}
    assert counts == {x: sum(a == x for _, a, _ in pairs) if x in trees else None for x in parent}
    sums = {r["node"]: r["total"] for r in hierarchy.sum_to_root(links.selectExpr("node", "parent", "node as value")).collect()}
    assert sums == {x: sum(chain(x)) for x in trees}
    label = {r["node"]: (r["root"], r["first"], r["last"]) for r in hierarchy.intervals(links, res).collect()}
    assert set(label) == set(trees)
    up = lambda x, y: label[x][0] == label[y][0] and label[y][1] <= label[x][1] <= label[y][2]
    assert {(x, y) for x in trees for y in trees if up(x, y) and x != y} == {(x, y) for x, y, _ in pairs}
    near = hierarchy.ancestors_within(links.selectExpr("node", "parent", "node as value"), links.filter("node % 5 = 0"), 40.0)
    want_near = set()
    for x in range(5, n + 1, 5):
        at, total = x, 0
        while parent[at] is not None and total + at <= 40:
            total, at = total + at, parent[at]
            want_near.add((x, at, total))
    assert {(r["node"], r["ancestor"], r["total"]) for r in near.collect()} == want_near


@pytest.mark.parametrize("block", [1, 7, 40])
def test_blocks_give_what_one_gives(spark, block):
    parent = forest(3, 150) | {1000: 1001, 1001: 1002, 1002: 1000, 1003: 1001}
    rows = [("a", i, p) for i, p in parent.items()] + [("b", i, None if p is None else p) for i, p in forest(4, 60).items()] + [("b", 5000, 5000)]
    links = hierarchy.parent_links(spark.createDataFrame(rows, "net string, id long, up long"), "id", "up", ["net"])
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    res = hierarchy.resolve(links, ["net"])
    assert key(hierarchy.resolve(links, ["net"], block)) == key(res)
    value = links.selectExpr("net", "node", "parent", "node * 0.5 as value")
    tree = res.filter("depth >= 0").select("net", "node")
    assert key(hierarchy.sum_to_root(value, ["net"], block)) == key(hierarchy.sum_to_root(value, ["net"]))
    assert key(hierarchy.accumulate(value, tree, ["net"], block)) == key(hierarchy.accumulate(value, tree, ["net"]))


def cycle(parent, at):
    out, x = {at}, parent[at]
    while x != at:
        out.add(x)
        x = parent[x]
    return out


def test_long_chain_self_link_and_empty(spark):
    parent = {i: i - 1 for i in range(2, 700)} | {1: None, 5000: 5000, 5001: 5000}
    links = hierarchy.parent_links(frame(spark, parent), "id", "up")
    rows = {r["node"]: (r["root"], r["depth"]) for r in hierarchy.resolve(links).collect()}
    assert rows[699] == (1, 698) and rows[5000] == rows[5001] == (5000, -1)
    none = hierarchy.parent_links(spark.createDataFrame([], SCHEMA), "id", "up")
    assert hierarchy.resolve(none).collect() == [] and hierarchy.paths(none, hierarchy.resolve(none)).collect() == []


def test_reaches_of_the_d8_example(spark):
    down = {0: 1, 1: 5, 2: 5, 3: -1, 4: 5, 5: 10, 6: 10, 7: 6, 8: 4, 9: 10, 10: 10, 11: 6}
    rows = [(k + 100, v + 100 if v >= 0 else -1) for k, v in down.items()]
    links = hierarchy.parent_links(spark.createDataFrame(rows, "id long, up long"), "id", "up")
    kinds = {r["node"] - 100: r["indegree"] for r in network.node_kinds(links).collect()}
    assert [kinds[i] for i in range(12)] == [0, 1, 0, 0, 1, 3, 2, 0, 0, 0, 4, 0]
    by = {}
    for r in network.reaches(links).orderBy("position").collect():
        by.setdefault(r["reach_id"], []).append(r["node"] - 100)
    assert sorted(by.values()) == [[0, 1], [2], [3], [5], [6], [7], [8, 4], [9], [10], [11]]
    joins = {(r["tail"] - 100, r["destination"] - 100) for r in network.junctions(links, network.reaches(links)).collect()}
    assert joins == {(1, 5), (2, 5), (4, 5), (5, 10), (6, 10), (7, 6), (9, 10), (10, 10), (11, 6)}


def test_closure_stops_in_loops(spark):
    links = hierarchy.parent_links(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 1), (5, 0)], "id long, up long"), "id", "up")
    seeds = spark.createDataFrame([(1,), (99,)], "node long")
    assert {r["node"] for r in network.downstream_closure(links, seeds).collect()} == {1, 2, 3}
