import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.llm import shared_spans
from tarnflow.llm.chunks import WINDOW, Chunked, gear_table

SCHEMA = "doc_id long, text string, key long, pos int"


def pairs_of(rows, span):
    sets = {}
    for d, t, *_ in rows:
        if d is not None and t is not None:
            sets[d] = {t[i : i + span] for i in range(len(t) - span + 1)}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b]}


def all_pairs(spark, rows, span, **k):
    docs = spark.createDataFrame(rows, SCHEMA)
    texts, copies = shared_spans.distinct_texts(docs)
    long = docs.filter(f"length(text) >= {span}").select("doc_id")
    out = [tuple(r) for r in shared_spans.expand_copies(shared_spans.shared_pairs(texts, span, **k), copies, copies.join(long, "doc_id", "left_semi")).collect()]
    assert len(out) == len(set(out))
    return set(out)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text("abé😀 \n", max_size=400), max_size=6), st.integers(2, 50))
def test_cuts_are_the_least_gear_hashes(texts, spread):
    table = gear_table()
    got = Chunked(texts, spread)
    base, want = 0, set()
    for k, t in enumerate(texts):
        h = []
        for i in range(len(t) - WINDOW + 1):
            x = 0
            for ch in t[i : i + WINDOW]:
                x = (2 * x + int(table[ord(ch)])) % 2**64
            h.append(x)
        for i in range(len(h) - spread + 1):
            j = max(range(i, i + spread), key=lambda p: (-h[p], p))
            want.add((k, base + j))
        base += len(t)
    assert set(zip(got.text.tolist(), got.cut.tolist())) == want


def test_digests_are_equal_for_equal_texts_only():
    c = Chunked(["hello world, hello world", "hello"], 5)
    a, b = np.array([0, 13, 24, 0, 0, 6]), np.array([5, 18, 29, 4, 0, 11])
    d = c.digest(a, b).tolist()
    assert d[0] == d[1] == d[2] and len(set(d)) == 4


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé😀") for _ in range(r.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(r.randrange(20, 120)))[: r.choice([199, 200, 201, 240, 400])] for _ in range(12)]
    rows = []
    for d in range(70):
        parts = []
        for _ in range(r.randrange(0, 6)):
            parts.append(r.choice(passages) if r.random() < 0.4 else " ".join(word() for _ in range(r.randrange(1, 80))))
        text = "".join(parts)
        if r.random() < 0.2 and len(text) > 300:  # an insertion
            k = r.randrange(len(text))
            text = text[:k] + "#" + text[k:]
        rows.append((d, text, 1, 1))
    rows += [(100 + i, rows[i][1], 1, 1) for i in range(10)]
    rows += [(200, None, 1, 1), (201, "", 1, 1), (202, "x" * 199, 1, 1), (203, "x" * 199, 1, 1), (None, rows[3][1], 1, 1), (204, "y" * 5000, 1, 1), (205, "y" * 220 + "z", 1, 1), (206, "ab" * 300, 1, 1), (207, "b" + "ab" * 100, 1, 1)]
    want = pairs_of(rows, 200)
    for hot in (64, 3, 0):
        assert all_pairs(spark, rows, 200, hot_rows=hot) == want and len(want) > 30


def test_two_hundred_exactly(spark):
    r = random.Random(5)
    rand = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = [rand(200) for _ in range(30)] + [rand(199) for _ in range(10)]
    rows = [(2 * i + k, rand(r.randrange(0, 300)) + "-+"[k] + s + "+-"[k] + rand(r.randrange(0, 300)), 0, 0) for i, s in enumerate(shared) for k in (0, 1)]
    assert all_pairs(spark, rows, 200) == {(2 * i, 2 * i + 1) for i in range(30)}


def test_hot_passage_in_every_text(spark):
    r = random.Random(6)
    rand = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    formula, near = rand(320), rand(190)
    rows = [(i, rand(40) + formula + rand(60) if i % 2 else rand(50) + near + rand(100), 0, 0) for i in range(60)]
    odd = [i for i in range(60) if i % 2]
    for hot in (64, 8):
        assert all_pairs(spark, rows, 200, hot_rows=hot) == {(a, b) for a in odd for b in odd if a < b}


def test_empty(spark):
    assert all_pairs(spark, [], 200) == set()


def test_report(spark):
    r = random.Random(7)
    rand = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    s = rand(300)
    rows = [(1, rand(100) + "." + s + "!" + rand(50), 0, 0), (2, s, 0, 0), (3, rand(400), 0, 0), (4, s, 0, 0), (5, None, 0, 0), (6, "", 0, 0), (7, s[:210] + "#" + rand(90) + "!" + s[40:300], 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x["doc_id"]: (x["n_chars"], x["shared_chars"], x["share"]) for x in shared_spans.report(docs).collect()}
    assert got == {1: (452, 300, 300 / 452), 2: (300, 300, 1.0), 3: (400, 0, 0.0), 4: (300, 300, 1.0), 5: (0, 0, 0.0), 6: (0, 0, 0.0), 7: (562, 470, 470 / 562)}
    spans = {(x["doc_id"], x["start"], x["length"]) for x in shared_spans.passages(docs).collect()}
    assert spans == {(1, 101, 300), (2, 0, 300), (4, 0, 300), (7, 0, 210), (7, 302, 260)}


@pytest.mark.parametrize("n", [1000, 3000])
def test_report_counts_each_copy_inside_a_text(spark, n):
    r = random.Random(8)
    rand = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    s = rand(n)
    rows = [(1, rand(300) + "." + s + "!" + rand(500) + "." + s + "!" + rand(90), 0, 0), (2, rand(70) + "#" + s + "?" + rand(400), 0, 0), (3, "y" * 900 + "#" + rand(50), 0, 0), (4, rand(50) + "!" + "y" * 700, 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spans = {(x["doc_id"], x["start"], x["length"], x["texts"]) for x in shared_spans.passages(docs).collect()}
    assert spans == {(1, 301, n, 1), (1, 301 + n + 502, n, 1), (2, 71, n, 1), (3, 0, 900, 1), (4, 51, 700, 1)}
    assert {x["doc_id"]: x["shared_chars"] for x in shared_spans.report(docs).collect()} == {1: 2 * n, 2: n, 3: 900, 4: 700}


def test_repeated_stretch_with_another_continuation(spark):
    r = random.Random(9)
    rand = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    rows = []
    for i in range(120):
        said, next_, n, k = rand(600), rand(100), r.choice([199, 200, 205, 214]), r.randrange(120, 190)
        # what is said twice stands before or behind what is shared besides, and the shared place is the first or the second
        both = [said, next_] if i % 2 else [next_, said]
        alone = [said, rand(100)] if i % 2 else [rand(100), said]
        copies = [*both, "-", *alone] if i % 3 == 0 else [*alone, "-", *both]
        joint, at = "".join(both), len(both[0]) - (k if i % 2 else n - k)  # k characters are of `said`
        rows += [(2 * i, "".join(copies), 0, 0), (2 * i + 1, rand(80) + "+" + joint[at : at + n] + "+" + rand(80), 0, 0)]
    want = pairs_of(rows, 200)
    for hot in (64, 0):
        assert all_pairs(spark, rows, 200, hot_rows=hot) == want and len(want) > 60


def test_texts_of_one_character(spark):
    rows = [(i, "-+"[i % 2] * (i % 3) + "y" * (3000 + i) + str(i), 0, 0) for i in range(12)] + [(20, "y" * 199, 0, 0), (21, "z" + "y" * 199, 0, 0), (22, "yz" * 2000, 0, 0), (23, "-" + "yz" * 100, 0, 0)]
    for hot in (64, 0):
        assert all_pairs(spark, rows, 200, hot_rows=hot) == pairs_of(rows, 200)


def test_false_candidates_are_dropped_and_members_hold_all_pairs(spark):
    r = random.Random(10)
    rand = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    s, t = rand(250), rand(230)
    rows = [(1, s, 0, 0), (2, s, 0, 0), (3, s, 0, 0), (4, rand(40) + s[:210], 0, 0), (5, t, 0, 0), (6, rand(300), 0, 0), (7, "short", 0, 0), (8, "short", 0, 0), (9, None, 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts, copies = shared_spans.distinct_texts(docs)
    claimed = spark.createDataFrame([(1, 0, 5, 0), (1, 0, 4, 40), (4, 3, 6, 9)], "doc_a long, pos_a int, doc_b long, pos_b int")
    assert [tuple(x) for x in shared_spans._verified(texts, claimed, 200).collect()] == [(1, 4)]
    pairs = shared_spans.shared_pairs(texts)
    assert [tuple(x) for x in pairs.collect()] == [(1, 4)]
    got = {tuple(x) for x in shared_spans.memberships(copies, docs, pairs).collect()}
    assert got == {(1, 1, 2, 1), (2, 1, 2, 1), (3, 1, 2, 1), (4, 4, 0, 1)}
