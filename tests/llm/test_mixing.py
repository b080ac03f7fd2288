import random

import numpy as np

from tarnflow.llm import mixing

WORDS = {"a": ["river", "water", "stone"], "b": ["vote", "house", "bill"], "c": ["song", "dance", "drum"]}
SCHEMA = "doc_id long, text string, source string, tokens string, label string"


def docs(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.choices("abc", [60, 30, 10])[0]
        rows.append((i, " ".join(r.choice(WORDS[s]) for _ in range(r.randrange(5, 60))), s, "x", "x"))
    return rows


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    rows = docs(1500) + [(9000, None, "a", "", ""), (9001, "", "a", "", ""), (9002, "some text", None, "", ""), (9003, "other", "zz", "", "")]
    want = targets(spark, [("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.4, 3), ("none", 0.0, 2)])
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA), want, train_rows=400)
    got = out.collect()
    assert len({r["doc_id"] for r in got}) == len(got) and all(1 <= r["repeats"] <= {"a": 1, "b": 2, "c": 3}[r["source"]] for r in got)
    share = {r["source"]: (r["share"], r["target_share"]) for r in mixing.reached(out, want).collect()}
    assert all(abs(a - b) < 0.01 for a, b in share.values())
    # the scarcest source is used up to its cap
    assert sum(r["repeats"] for r in got if r["source"] == "c") >= 0.97 * 3 * sum(r[2] == "c" for r in rows)


def test_absent_source_and_empty(spark):
    want = targets(spark, [("a", 0.5, 1), ("gone", 0.5, 1), (None, 0.1, 1)])
    out = mixing.mix(spark.createDataFrame(docs(60), SCHEMA), want)
    assert {r["source"] for r in out.collect()} == {"a"}
    share = {r["source"]: (r["share"], r["texts"]) for r in mixing.reached(out, want).collect()}
    assert share["a"][0] == 1.0 and share["gone"] == (0.0, 0)
    assert mixing.mix(spark.createDataFrame([], SCHEMA), want).collect() == []
    assert mixing.mix(spark.createDataFrame(docs(5), SCHEMA), want.limit(0)).collect() == []


def test_classifier_on_held_out_texts(spark):
    train = spark.createDataFrame(docs(800, 2), SCHEMA)
    logs = mixing.train(train, ["a", "b", "c"], train_rows=800)
    test = docs(300, 3)
    kernel = mixing._score(mixing.TOKENIZER, ["a", "b", "c"], logs, np.array([0.6, 0.3, 0.1]), 0.99)
    unlabelled = spark.createDataFrame([(d, t, None) for d, t, *_ in test], "doc_id long, text string, source string").select("doc_id", "source", "text")
    got = unlabelled.mapInArrow(kernel, "doc_id bigint, source string, tokens bigint, label int, member array<double>").collect()
    truth = {d: s for d, _, s, *_ in test}
    right = sum("abc"[int(np.argmax(r["member"]))] == truth[r["doc_id"]] for r in got)
    assert right / len(got) > 0.95 and all(abs(sum(r["member"]) - 1) < 1e-9 for r in got)


def corpus(seed=1, n=2000):
    r = np.random.default_rng(seed)
    label = r.choice(3, n, p=[0.6, 0.3, 0.1])
    member = r.dirichlet([0.2, 0.2, 0.2], n) * 0.1
    member[np.arange(n), label] += 0.9
    return mixing.features(member, label), r.integers(1, 500, n).astype(float), np.array([1.0, 2.0, 3.0])[label], label


def fitted(f, n, cap, label, share):
    held = np.bincount(label, n, 3)
    total = (held * np.array([1.0, 2.0, 3.0]) / share).min()
    evaluate = lambda tries: np.array([mixing.sums(f, n / total, cap, w) for w in tries])
    return *mixing.fit(evaluate, share, np.concatenate([np.zeros(3), total * share / held])), total


def test_fit_ends_at_the_targets_and_at_the_optimum():
    f, n, cap, label = corpus()
    for share in (np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.1, 0.8]), np.array([0.01, 0.01, 0.98])):
        w, came, passes, total = fitted(f, n, cap, label, share)
        r = mixing.rates(f, cap, w)
        assert passes <= (30 if share.max() > 0.9 else 15) and (r >= 0).all() and (r <= cap).all()
        recorded = np.bincount(label, n * r, 3) / total
        assert np.allclose(recorded, came[3:]) and np.abs(recorded - share).max() < 1e-3
        # no small change of any rate lowers what is minimised
        ridge = np.concatenate([np.full(3, 1e-3), np.full(3, 1e-6)]) * np.tile(share, 2)
        slope = f @ ((f.T @ (n * r) / total - np.tile(share, 2)) / ridge) + r
        free = (r > 1e-9) & (r < cap - 1e-9)
        tight = 1e-6 / ridge.min()
        assert (np.abs(slope[free]) < tight).all() and (slope[r <= 1e-9] > -tight).all() and (slope[r >= cap - 1e-9] < tight).all()


def test_rounding_keeps_tokens_and_caps():
    r = np.random.default_rng(2)
    size = np.sort(r.lognormal(5, 1, 3000)).astype(int)[::-1].astype(float)
    cap = r.integers(1, 4, 3000).astype(float)
    rate = np.minimum(r.uniform(0, 3, 3000), cap)
    n = mixing.whole_repeats(rate, size, cap)
    assert (np.abs(n - rate) < 1).all() and (n <= cap).all() and abs((size * (n - rate)).sum()) <= size.min()
    assert mixing.whole_repeats(np.array([1.0, 0.0, 2.0]), np.array([9.0, 5.0, 1.0]), np.array([1.0, 1.0, 2.0])).tolist() == [1, 0, 2]
