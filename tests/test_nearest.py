import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.operators.nearest import DAY, LearnedIndex, nearest_in_time


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 10**12), max_size=300), min_size=1, max_size=5), st.integers(2, 20))
def test_learned_index_finds_exact_positions(lanes, error):
    keys = [np.unique(np.array(x, np.int64)) for x in lanes]
    starts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    index = LearnedIndex(np.concatenate(keys), starts, error, 32)
    r = np.random.default_rng(1)
    lane = r.integers(0, len(keys), 200)
    x = np.where(r.random(200) < 0.5, r.integers(-5, 10**12 + 5, 200), np.array([r.choice(keys[k]) if len(keys[k]) else 0 for k in lane]))
    want = np.array([starts[k] + np.searchsorted(keys[k], v, side="right") for k, v in zip(lane, x)])
    assert (index.insertion(lane, x) == want).all()


def test_skewed_keys_keep_the_bound():
    key = np.unique((np.random.default_rng(2).random(20_000) ** 8 * 1e15).astype(np.int64))
    index = LearnedIndex(key, np.array([0, len(key)]))
    seg = np.searchsorted(index.begin, np.arange(len(key)), side="right") - 1
    off = np.abs(index.begin[seg] + index.slope[seg] * (key - key[index.begin[seg]]) - np.arange(len(key)))
    long = (index.end - index.begin)[seg] > index.max_error
    assert off[long].max() <= index.max_error and len(index.begin) < len(key) / 10


def brute(left, right, tolerance):
    out = set()
    for e, t, i in left:
        if None in (e, t, i):
            continue
        best = min(((abs(u - t), u, j) for f, u, j in right if f == e and u is not None and j is not None and abs(u - t) <= tolerance), default=None)
        if best:
            out.add((i, best[2], best[1] - t))
    return out


def test_against_brute_force_with_ties_skew_and_nulls(spark):
    r = random.Random(3)
    ents = ["a"] * 6 + ["b", "c", None]
    left = [(r.choice(ents), r.randrange(0, 900) * DAY // 2, i) for i in range(600)] + [("a", None, 9000), ("z", 5, 9001)]
    left += left[:50]
    right = [(r.choice(ents), r.randrange(0, 900) * DAY // 2, 10_000 + i) for i in range(400)] + [("a", 7, None)]
    right += right[:30]
    a, b = (spark.createDataFrame(x, "e string, t long, id long") for x in (left, right))
    for k in ({}, {"rows_per_shard": 20, "max_error": 2}):
        rows = [tuple(x) for x in nearest_in_time(a, b, ["e"], 14 * DAY, **k).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute(left, right, 14 * DAY)


def test_tolerance_is_inclusive_and_empty_sides(spark):
    schema = "e string, t long, id long, block int, deal int"
    a = spark.createDataFrame([("a", 0, 1, 0, 0), ("a", -1, 2, 0, 0)], schema)
    b = spark.createDataFrame([("a", 14 * DAY, 5, 0, 0)], schema)
    assert [tuple(x) for x in nearest_in_time(a, b, ["e"], 14 * DAY).collect()] == [(1, 5, 14 * DAY)]
    assert nearest_in_time(a, b.limit(0), ["e"], 14 * DAY).collect() == []
    assert nearest_in_time(a.limit(0), b, ["e"], 14 * DAY).collect() == []


def test_hot_entity_is_cut_on_both_sides(spark):
    from tarnflow.operators import lanes

    right = spark.range(60_000).selectExpr("'hot' as e", "id * 3600000000 + pmod(xxhash64(id), 1000) as t", "id")
    left = spark.range(3_000).selectExpr("'hot' as e", "pmod(xxhash64(id, 7), 90000) * 3600000000 as t", "id")
    # a long stretch without right rows, and shards of left rows only
    left = left.unionByName(spark.range(4_000).selectExpr("'hot' as e", "70000 * 3600000000 + id as t", "10000 + id as id"))
    u = np.array(sorted(x["t"] for x in right.collect()))
    want = {}
    for x in left.collect():
        k = np.searchsorted(u, x["t"])
        gap = min(abs(int(u[j]) - x["t"]) for j in (k - 1, k) if 0 <= j < len(u))
        if gap <= 10**6 * DAY:
            want[x["id"]] = gap
    got = {x["left_id"]: abs(x["dt_us"]) for x in nearest_in_time(left, right, ["e"], 10**6 * DAY, rows_per_shard=2000).collect()}
    assert got == want and len(want) == 7000
    both = left.unionByName(right)
    assert lanes.ranges(both, ["e"], ["t"], 2000).groupBy("_bin").count().agg({"count": "max"}).first()[0] < 6000
