"""Mixing sources to target weights: soft memberships and distributed projected-gradient least squares.

The fit is lazy projected gradient descent: all gradient steps so far add up to one weight per equation, and the rate of a
text is the projection of its weighted equations into 0..max_repeats. So a pass needs no history, and a step may be scaled
by the curvature that the same pass sums up.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.tokens import TOKENIZER, encoder
from tarnflow.operators.lanes import map_lanes
from tarnflow.session import materialise

#: Labelled rows (about) that the classifier learns from, and buckets of token ids it counts.
TRAIN_ROWS, BUCKETS = 8_000, 8_192
#: Belief in a recorded source against the classifier's view of the text.
TRUST = 0.99
#: Evidence of a text is that of at most this many tokens.
EVIDENCE = 40
#: What an error of an equation may cost against the size of the rates: expected totals by membership, recorded totals.
SOFTNESS = (1e-3, 1e-6)
#: Gradient (in shares of the total) below which the fit is at its optimum, and passes after which it is given up with an error.
GOOD, MOST_PASSES = 1e-6, 100
#: Dampings of the curvature whose steps one pass tries at once.
DAMPINGS = (0.0, *(4.0**-i for i in range(1, 14)))
#: Texts of a source that are rounded together.
ROUNDED = 20_000


def _count_features(path: str, sources: list[str]):
    place = {s: i for i, s in enumerate(sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        counts = np.zeros((len(sources), BUCKETS))
        for b in batches:
            for source, text in zip(b.column("source").to_pylist(), b.column("text").to_pylist()):
                if source in place and text:
                    counts[place[source]] += np.bincount(np.array(encode(text)) % BUCKETS, minlength=BUCKETS)
        s, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(k), pa.array(counts[s, k])], ["s", "k", "n"])

    return run


def train(docs: DataFrame, sources: list[str], path: str = TOKENIZER, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Log probabilities (source x bucket) of a multinomial naive Bayes over token ids.

    It learns from about `train_rows` labelled rows picked by hash of the id; the counts that reach the driver
    have at most sources x BUCKETS numbers whatever the corpus.
    """
    part = max(1, math.ceil(docs.count() / train_rows))
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0)
    rows = picked.select("source", "text").mapInArrow(_count_features(path, sources), "s bigint, k bigint, n double").groupBy("s", "k").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(sources), BUCKETS))
    for s, k, n in rows:
        counts[s, k] = n
    background = counts.sum(axis=0) + 1.0
    counts += 200 * background / background.sum()  # smoothed towards the corpus
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def posterior(evidence: np.ndarray, tokens: np.ndarray, prior: np.ndarray, label: np.ndarray, trust: float) -> np.ndarray:
    """Source probabilities of each text from its summed log probabilities, its length and its recorded source."""
    logit = evidence / np.maximum(tokens / EVIDENCE, 1.0)[:, None] + np.log(prior)
    logit = logit - logit.max(axis=1, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(axis=1, keepdims=True)
    said = np.full(p.shape, (1 - trust) / max(p.shape[1] - 1, 1))
    known = label >= 0
    said[np.flatnonzero(known), label[known]] = trust
    said[~known] = 1.0
    p = np.maximum(p, 1e-3) * said
    return p / p.sum(axis=1, keepdims=True)


def _score(path: str, sources: list[str], logs: np.ndarray, prior: np.ndarray, trust: float):
    place = {s: i for i, s in enumerate(sources)}
    by_bucket = np.ascontiguousarray(logs.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            tokens, evidence = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(sources)))
            for i, t in enumerate(texts):
                if t:
                    ids = encode(t)
                    tokens[i] = len(ids)
                    evidence[i] = by_bucket[np.array(ids) % BUCKETS].sum(axis=0)
            label = np.array([place.get(s, -1) for s in b.column("source").to_pylist()], np.int64)
            p = posterior(evidence, tokens, prior, label, trust)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(tokens), pa.array(label.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(sources)).cast(pa.list_(pa.float64()))], ["doc_id", "source", "tokens", "label", "member"])

    return run


def _matrix(b: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return b.column(name).flatten().to_numpy().reshape(-1, width)


def rates(feature: np.ndarray, cap: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rates of texts: the sums of their equations' weights, projected into 0..cap."""
    return np.clip(feature @ weight, 0.0, cap)


def features(member: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How much a text counts in each equation: its memberships, then its recorded source."""
    said = np.zeros(member.shape)
    known = np.flatnonzero(label >= 0)
    said[known, label[known]] = 1.0
    return np.hstack([member, said])


def sums(feature: np.ndarray, size: np.ndarray, cap: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Totals per equation, potential and curvature (flat) of texts at one weight; the totals are the potential's gradient."""
    z = feature @ weight
    r = np.clip(z, 0.0, cap)
    inside = size * ((z > 0) & (z < cap))
    return np.concatenate([(size * r) @ feature, [(size * (r * z - r * r / 2)).sum()], ((feature * inside[:, None]).T @ feature).ravel()])


def _pass(width: int, total: float, tries: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(tries), 2 * width + 1 + 4 * width * width))
        for b in batches:
            f = features(_matrix(b, "member", width), b.column("label").to_numpy())
            size, cap = b.column("tokens").to_numpy() / total, b.column("cap").to_numpy()
            for k, w in enumerate(tries):
                out[k] += sums(f, size, cap, w)
        k, at = np.indices(out.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(at.ravel()), pa.array(out.ravel())], ["k", "at", "total"])

    return run


def fit(evaluate: Callable[[np.ndarray], np.ndarray], share: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Weights at the optimum, the totals reached there (as shares) and the passes: projected-gradient least squares.

    Minimised is the squared error of all equations, each by its SOFTNESS, plus the squared rates. `evaluate(tries)` gives
    `sums` over all texts for some weights at once, which is one pass over the data. A step is the gradient scaled by the
    curvature of the rates that are free to move, more or less damped; of the steps tried at once the best counts. It ends where the gradient is
    below GOOD, which for this convex function is the optimum whether or not the targets can be met.
    """
    k = len(share)
    aim = np.concatenate([share, share])
    ridge = np.concatenate([np.full(k, SOFTNESS[0]), np.full(k, SOFTNESS[1])]) * np.maximum(aim, 1e-9)
    tries = start[None, :]
    for passes in range(1, MOST_PASSES + 1):
        found = evaluate(tries)
        value = found[:, 2 * k] + (ridge * tries * tries).sum(axis=1) / 2 - tries @ aim
        gradients = found[:, : 2 * k] + ridge * tries - aim
        best = int(np.argmin(value))
        level = np.abs(gradients).max(axis=1)
        if level.min() <= GOOD:  # near the optimum values differ by rounding only
            best = int(np.argmin(level))
            return tries[best], found[best, : 2 * k], passes
        curvature = found[best, 2 * k + 1 :].reshape(2 * k, 2 * k) + np.diag(ridge)
        tries = np.array([tries[best] - np.linalg.solve(curvature + d * np.eye(2 * k), gradients[best]) for d in DAMPINGS])
    raise RuntimeError(f"the fit has not ended in {MOST_PASSES} passes; its gradient is {level.min():.2g}")


def whole_repeats(rate: np.ndarray, size: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Rates as whole numbers, in turn from the largest text down: each is rounded so that the tokens rounded away so far
    stay within half a text. Rates that are whole stay, none goes above its cap."""
    out = np.floor(rate + 1e-9)
    part = np.where(out < cap, np.maximum(rate - out, 0.0), 0.0)
    owed = 0.0
    for i in np.flatnonzero(part > 1e-9).tolist():
        owed += part[i] * size[i]
        if 2 * owed >= size[i]:
            out[i] += 1
            owed -= size[i]
    return out


def _chosen(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    rate, size, cap = (table.column(c).to_numpy() for c in ("rate", "tokens", "cap"))
    n = np.concatenate([whole_repeats(rate[s:e], size[s:e], cap[s:e]) for s, e in zip(starts[:-1], starts[1:])]).astype(np.int32)
    keep = pa.array(np.flatnonzero(n > 0))
    return pa.RecordBatch.from_arrays([*(table.column(c).take(keep).combine_chunks() for c in ("doc_id", "source", "tokens", "rate")), pa.array(n).take(keep)], ["doc_id", "source", "tokens", "rate", "repeats"])


def _rated(width: int, weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = rates(features(_matrix(b, "member", width), b.column("label").to_numpy()), b.column("cap").to_numpy(), weight)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "tokens", "cap")), pa.array(r)], ["doc_id", "source", "tokens", "cap", "rate"])

    return run


def mix(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER, train_rows: int = TRAIN_ROWS, trust: float = TRUST) -> DataFrame:
    """Texts and how often to take them so that each source has its share of all tokens: doc_id, source, tokens, rate, repeats (above 0).

    See `mix_and_report`.
    """
    return mix_and_report(docs, targets, path, train_rows, trust)[0]


def mix_and_report(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER, train_rows: int = TRAIN_ROWS, trust: float = TRUST) -> tuple[DataFrame, DataFrame]:
    """Texts and how often to take them so that each source has its share of all tokens, and what the fit came to.

    `docs`: doc_id (unique), text, source, with copies of a text left out before (`shared_spans.distinct_texts`), so
    that max_repeats holds for a text in total. `targets`: source, target_share, max_repeats; a few rows, their
    shares are scaled to sum to 1. Results: doc_id, source, tokens, rate, repeats (above 0); and per source that takes part:
    source, aim (its share of the total), expected (share by memberships), recorded (share by recorded source), both at the
    fitted rates before rounding, and passes.

    1. A naive Bayes classifier trained on labelled rows gives every text a probability of each source; together
    with the recorded source, believed to `trust`, they are its soft membership. 2. The total is the largest at
    which no source needs more than all its texts at max_repeats. 3. Projected-gradient least squares (`fit`) gives every
    text a rate from 0 to max_repeats such that both the expected totals by membership and the recorded totals are each
    source's share of the total; where both can't be, the recorded ones weigh a thousand times more. It runs to its optimum
    or raises. 4. Rates are rounded to whole repeats, in groups of texts by hash (`whole_repeats`).

    Sources without a target, NULL sources, and texts that are NULL or empty are not taken. A target without any
    text gets none and the others keep their shares of the rest. No texts or targets: no rows.
    """
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.dropna(subset=["source"]).collect()}
    spark, schema = docs.sparkSession, "doc_id bigint, source string, tokens bigint, rate double, repeats int"
    told = "source string, aim double, expected double, recorded double, passes int"
    named = docs.filter(F.col("source").isin(*wanted) & (F.length("text") > 0)).select("doc_id", "source", "text") if wanted else None
    counts = {r["source"]: r["count"] for r in named.groupBy("source").count().collect()} if wanted else {}
    sources = sorted(s for s in wanted if wanted[s][0] > 0 and wanted[s][1] > 0 and counts.get(s))
    if not sources:
        return spark.createDataFrame([], schema), spark.createDataFrame([], told)
    width = len(sources)
    named = named.filter(F.col("source").isin(*sources))
    prior = np.array([counts[s] for s in sources], float)
    prior /= prior.sum()
    logs = train(named, sources, path, train_rows)
    per_source = lambda f: F.create_map(*(x for s in sources for x in (F.lit(s), F.lit(f(s)))))[F.col("source")]
    scored = named.mapInArrow(_score(path, sources, logs, prior, trust), "doc_id bigint, source string, tokens bigint, label int, member array<double>")
    scored = materialise(scored.filter("tokens > 0").withColumn("cap", per_source(lambda s: float(wanted[s][1]))))
    held = np.ones(width)
    for r in scored.groupBy("label").agg(F.sum("tokens").alias("n")).collect():
        held[r["label"]] = r["n"]
    share = np.array([wanted[s][0] for s in sources])
    share /= share.sum()
    total = float(np.min(held * np.array([wanted[s][1] for s in sources]) / share))

    def evaluate(tries: np.ndarray) -> np.ndarray:
        out = np.zeros((len(tries), 2 * width + 1 + 4 * width * width))
        for k, at, x in scored.mapInArrow(_pass(width, total, tries), "k bigint, at bigint, total double").groupBy("k", "at").agg(F.sum("total")).collect():
            out[k, at] = x
        return out

    weight, came, passes = fit(evaluate, share, np.concatenate([np.zeros(width), total * share / held]))
    groups = per_source(lambda s: math.ceil(counts[s] / ROUNDED))
    rated = scored.mapInArrow(_rated(width, weight), "doc_id bigint, source string, tokens bigint, cap double, rate double").filter("rate > 0")
    rated = rated.withColumns({"deal": F.pmod(F.xxhash64("doc_id"), groups), "_down": -F.col("tokens")})
    report = [(s, float(share[i]), float(came[i]), float(came[width + i]), passes) for i, s in enumerate(sources)]
    return map_lanes(rated, ["source", "deal"], ["_down", "doc_id"], _chosen, schema), spark.createDataFrame(report, told)


def reached(chosen: DataFrame, targets: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Per target source: target_share, share really reached, texts, tokens (with repeats), most repeats; with the `report`
    of the fit also its aim, expected and recorded shares and passes (NULL for a source without texts)."""
    by = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    total = by.agg(F.sum("tokens").alias("all_tokens"))
    by = by.join(F.broadcast(total))  # one row
    out = targets.select("source", "target_share").join(by, "source", "left")
    out = out.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    return out if report is None else out.join(report, "source", "left")
