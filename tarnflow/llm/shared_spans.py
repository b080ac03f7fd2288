"""Long exact spans shared between texts, found through content-defined chunks."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.chunks import WINDOW, Chunked, mix
from tarnflow.session import materialise, small_side

#: Least length of a shared span in characters, and characters of texts that are chunked at once.
SPAN, BLOCK_CHARS = 200, 400_000
#: Places that hold one key beyond which windows are compared and not candidates.
HOT_ROWS = 64


def _blocks(batches: Iterator[pa.RecordBatch], keep_shorter: int = 0) -> Iterator[tuple[list, list[str]]]:
    """Lists of ids and texts of about BLOCK_CHARS; texts under `keep_shorter` characters are left out."""
    ids, texts, size = [], [], 0
    for b in batches:
        extra = [b.column(k).to_pylist() for k in range(b.num_columns)]
        for row in zip(*extra):
            if len(row[1]) >= keep_shorter:
                ids.append(row)
                texts.append(row[1])
                size += len(row[1])
                if size >= BLOCK_CHARS:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def _chunk_rows(span: int):
    spread = span - WINDOW + 1
    side = (span - WINDOW) // 2  # a span around a cut reaches at least this far before or behind its window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _blocks(batches, span):
            c = Chunked(texts, spread)
            if not len(c.cut):
                continue
            ident = np.array([r[0] for r in rows], np.int64)
            start, end = c.start[c.text], c.start[c.text + 1]
            same = c.text[1:] == c.text[:-1]
            own = c.digest(start, np.minimum(start + 1, end)) ^ (ident[c.text] * 2 + 1)  # what no other text has
            chunk = c.digest(c.cut[:-1], c.cut[1:] + WINDOW)  # from one cut to the end of the next one's window
            before, behind = own.copy(), own.copy()
            before[1:][same] = chunk[same]
            behind[:-1][same] = chunk[same]
            ahead = c.cut + WINDOW + (span - WINDOW - side) <= end
            back = c.cut - side >= start
            f, g = np.flatnonzero(ahead), np.flatnonzero(back)
            key = np.concatenate([c.digest(c.cut[f], c.cut[f] + WINDOW + span - WINDOW - side), ~c.digest(c.cut[g] - side, c.cut[g] + WINDOW)])
            other = np.concatenate([before[f], behind[g]])
            at = np.concatenate([f, g])
            doc, pos = ident[c.text[at]], (c.cut - start)[at].astype(np.int32)
            # a text that repeats itself gives a row at each place: what stands further off differs from place to place
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, other, doc, pos)], ["key", "other", "doc_id", "pos"])

    return run


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, copies): doc_id, text of one document per distinct text, the least id; and doc_id, rep_id of the others."""
    named = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    digests = named.select("doc_id", F.sha2("text", 256).alias("digest"))
    reps = digests.groupBy("digest").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # only digests held twice matter; both sides of this join are as long as the ids, not as the texts
    copies = materialise(digests.join(reps, "digest").filter("doc_id <> rep_id").select("doc_id", "rep_id").distinct())
    return named.join(small_side(copies.select("doc_id").distinct()), "doc_id", "left_anti"), copies


def chunk_hits(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """The places of `texts` around a cut whose text near the cut stands in another text as well.

    Columns key, other, doc_id, pos. A cut gives two keys: the digest of its window and what follows, and that of
    its window and what precedes it, together long enough that texts with a shared span share one of them.
    `other` is the digest of the whole variable chunk before (for the first kind) or behind the cut.
    """
    rows = materialise(texts.select("doc_id", "text").mapInArrow(_chunk_rows(span), "key bigint, other bigint, doc_id bigint, pos int"))
    live = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("key")
    return materialise(rows.join(small_side(materialise(live)), "key", "left_semi"))


def _context(span: int):
    reach = span - WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, pos, left, right = [], [], [], []
            for d, text, places in zip(*(b.column(k).to_pylist() for k in range(3))):
                for p in places:
                    doc.append(d)
                    pos.append(p)
                    left.append(text[max(0, p - reach) : p])
                    right.append(text[p : p + span])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(pos, pa.int32()), pa.array(left, pa.string()), pa.array(right, pa.string())], ["doc_id", "pos", "left", "right"])

    return run


def _common(a: list[str], b: list[str], width: int, backward: bool) -> np.ndarray:
    """Length of the common start (or end) of each pair of strings, at most `width`."""
    def matrix(x: list[str], pad: int) -> np.ndarray:
        out = np.full((len(x), width), pad, np.uint32)
        for i, s in enumerate(x):
            code = np.frombuffer((s[::-1] if backward else s).encode("utf-32-le", "surrogatepass"), np.uint32)
            out[i, : len(code)] = code
        return out

    differs = matrix(a, 0x110000) != matrix(b, 0x110001)
    return np.where(differs.any(axis=1), differs.argmax(axis=1), width)


def _verify(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n) for n in b.schema.names}
            left = _common(c["l_a"].to_pylist(), c["l_b"].to_pylist(), span - WINDOW, True)
            right = _common(c["r_a"].to_pylist(), c["r_b"].to_pylist(), span, False)
            good = pa.array(np.flatnonzero((right >= WINDOW) & (left + right >= span)))
            yield pa.RecordBatch.from_arrays([c["doc_a"].take(good), c["doc_b"].take(good)], ["doc_a", "doc_b"])

    return run


def _window_rows(span: int, once: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _blocks(batches, span):
            c = Chunked(texts, span + 1)
            ids, starts, joined = [], [], []
            for k, (doc, text, places) in enumerate(rows):
                # every window that holds the hash window of a cut that another text makes too
                low = np.maximum(np.array(places) - (span - WINDOW), 0)
                high = np.minimum(np.array(places), len(text) - span)
                mark = np.zeros(len(text) - span + 2, np.int32)
                ok = low <= high
                np.add.at(mark, low[ok], 1)
                np.add.at(mark, high[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                ids.append(np.full(len(at), doc, np.int64))
                starts.append(at + c.start[k])
                joined.append(np.diff(at, prepend=-2) == 1)
            at, doc, after = np.concatenate(starts), np.concatenate(ids), np.concatenate(joined)
            own = (at - c.start[np.searchsorted(c.start, at, side="right") - 1]).astype(np.int32)
            key = c.digest(at, at + span)
            other = mix((doc.astype(np.uint64) << np.uint64(20)) + own.astype(np.uint64)).view(np.int64)
            other[1:][after[1:]] = key[:-1][after[1:]]
            if once:
                order = np.lexsort((other, key, doc))
                first = np.ones(len(order), bool)
                first[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (doc, key, other)], axis=0)
                key, other, doc, own = (x[order[first]] for x in (key, other, doc, own))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(other), pa.array(doc), pa.array(own)], ["key", "other", "doc_id", "pos"])

    return run


def _apart(hits: DataFrame) -> DataFrame:
    """doc_a, pos_a, doc_b, pos_b of rows with the same key and another `other`, doc_a < doc_b."""
    kinds = materialise(hits.select("key", "other").distinct())
    a, b = kinds.withColumnRenamed("other", "oa"), kinds.withColumnRenamed("other", "ob")
    ha = hits.select("key", F.col("other").alias("oa"), F.col("doc_id").alias("da"), F.col("pos").alias("pa"))
    hb = hits.select("key", F.col("other").alias("ob"), F.col("doc_id").alias("db"), F.col("pos").alias("pb"))
    found = a.join(b, "key").filter("oa < ob").join(ha, ["key", "oa"]).join(hb, ["key", "ob"]).filter("da <> db")
    a_first = F.col("da") < F.col("db")
    pick = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))
    return found.select(pick("da", "db").alias("doc_a"), pick("pa", "pb").alias("pos_a"), pick("db", "da").alias("doc_b"), pick("pb", "pa").alias("pos_b"))


def _verified(texts: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """Pairs of `found` (doc_a, pos_a, doc_b, pos_b) whose characters around the two places agree over `span`."""
    found = materialise(found.distinct())
    used = found.select(F.col("doc_a").alias("doc_id"), F.col("pos_a").alias("pos")).unionByName(found.select(F.col("doc_b").alias("doc_id"), F.col("pos_b").alias("pos")))
    wanted = materialise(used.distinct().groupBy("doc_id").agg(F.collect_list("pos").alias("places")))
    around = texts.join(small_side(wanted), "doc_id").select("doc_id", "text", "places").mapInArrow(_context(span), "doc_id bigint, pos int, left string, right string")
    around = materialise(around)
    for s in ("a", "b"):
        found = found.join(around.select(F.col("doc_id").alias(f"doc_{s}"), F.col("pos").alias(f"pos_{s}"), F.col("left").alias(f"l_{s}"), F.col("right").alias(f"r_{s}")), [f"doc_{s}", f"pos_{s}"])
    return found.mapInArrow(_verify(span), "doc_a bigint, doc_b bigint")


def _windows(texts: DataFrame, hits: DataFrame, span: int, once: bool = False) -> DataFrame:
    """Digests of all `span` characters around the cuts of `hits`: key, other (that of the characters one place before), doc_id, pos.

    `once` gives any one place of each (key, other, doc_id), for who asks only which texts hold them.
    """
    places = hits.groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    around = texts.join(small_side(materialise(places)), "doc_id").select("doc_id", "text", "places")
    return materialise(around.mapInArrow(_window_rows(span, once), "key bigint, other bigint, doc_id bigint, pos int"))


def shared_pairs(texts: DataFrame, span: int = SPAN, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs doc_a < doc_b of distinct texts with at least `span` characters in common, exactly as written.

    `texts` has a unique doc_id and a text per row. Texts that share a long passage share all its chunks; of such
    a row of chunks only the ends give candidates, for inside it `other` is equal. Candidates are then held against
    the characters themselves, at every place where a text that repeats itself has them. A key that more than `hot_rows` places hold would give many candidates in vain (a
    formula a little too short): there the digests of all windows of `span` characters around the cut are paired instead, which
    only texts with such a window in common share. Of these a pair of texts is held against the characters at one common
    window; if that were the chance of two equal digests, at all of them. NULL, empty and short texts pair with nothing;
    there is no bound on partners.
    """
    hits = chunk_hits(texts, span)
    hot = small_side(materialise(hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).select("key")))
    often = materialise(_apart(_windows(texts, hits.join(hot, "key", "left_semi"), span, once=True)))
    one = often.groupBy("doc_a", "doc_b").agg(F.min(F.struct("pos_a", "pos_b")).alias("at")).select("doc_a", "at.pos_a", "doc_b", "at.pos_b")
    good = materialise(_verified(texts, _apart(hits.join(hot, "key", "left_anti")).unionByName(one), span).distinct())
    lost = materialise(one.select("doc_a", "doc_b").join(good, ["doc_a", "doc_b"], "left_anti"))
    if lost.isEmpty():
        return good
    return good.unionByName(_verified(texts, often.join(lost, ["doc_a", "doc_b"], "left_semi"), span)).distinct()


def memberships(copies: DataFrame, docs: DataFrame, pairs: DataFrame, span: int = SPAN) -> DataFrame:
    """Every document with its class of equal texts and its links: doc_id, rep_id, copies, links.

    With `pairs` of representatives (`shared_pairs`) it is the whole result without a row per pair of copies: `copies` are
    the other documents with the same text (of at least `span` characters, else 0), `links` the other texts that share a
    span with it. Documents without either have no row.
    """
    long = docs.filter(F.length("text") >= span).select("doc_id")
    held = copies.join(long, "doc_id", "left_semi")
    group = held.groupBy("rep_id").agg(F.count(F.lit(1)).alias("copies"))
    either = pairs.select(F.col("doc_a").alias("rep_id")).unionByName(pairs.select(F.col("doc_b").alias("rep_id"))).groupBy("rep_id").agg(F.count(F.lit(1)).alias("links"))
    reps = group.join(either, "rep_id", "full_outer").select("rep_id", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    own = reps.select(F.col("rep_id").alias("doc_id"), "rep_id", "copies", "links")
    return own.unionByName(held.join(reps, "rep_id").select("doc_id", "rep_id", "copies", "links"))


def expand_copies(pairs: DataFrame, copies: DataFrame, long_copies: DataFrame) -> DataFrame:
    """`pairs` of representatives as pairs of all documents, and the pairs inside each group of `long_copies`."""
    def members(c: DataFrame) -> DataFrame:
        return c.unionByName(c.select(F.col("rep_id").alias("doc_id"), "rep_id").distinct())

    held = members(copies)
    for s in ("a", "b"):
        other = held.select(F.col("rep_id").alias(f"doc_{s}"), F.col("doc_id").alias("_d"))
        pairs = pairs.join(other, f"doc_{s}", "left").withColumn(f"doc_{s}", F.coalesce("_d", f"doc_{s}")).drop("_d")
    held = members(long_copies)
    inside = held.select("rep_id", F.col("doc_id").alias("doc_a")).join(held.select("rep_id", F.col("doc_id").alias("doc_b")), "rep_id").filter("doc_a < doc_b")
    return pairs.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).unionByName(inside.select("doc_a", "doc_b"))


def passages(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The spans of each text, as long as they go, made of runs of `span` characters that another text holds too.

    Columns doc_id, start, length (characters from 0), windows (how many runs), texts (most other distinct texts that
    hold one of them). Copies of a whole text share all of it, if it is long enough. Only windows around cuts that two
    texts make are looked at, and every shared run holds such a cut. Two runs are equal by their 64-bit digest.
    """
    texts, copies = distinct_texts(docs)
    windows = _windows(texts, chunk_hits(texts, span), span).select(F.col("key").alias("digest"), "doc_id", F.col("pos").alias("start"))
    held = windows.select("digest", "doc_id").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = windows.join(held, "digest").select("doc_id", "start", "n")
    # runs of successive starts, or starts no further apart than a window, make one span
    along = Window.partitionBy("doc_id").orderBy("start")
    new = F.when(F.col("start") - F.lag("start").over(along) <= span, 0).otherwise(1)
    runs = shared.withColumn("_run", F.sum(new).over(along)).groupBy("doc_id", "_run")
    spans = runs.agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + span).alias("length"), F.count(F.lit(1)).alias("windows"), (F.max("n") - 1).alias("texts"))
    whole = docs.filter(F.length("text") >= span).select("doc_id", F.length("text").alias("length"))
    group = copies.groupBy("rep_id").agg(F.count(F.lit(1)).alias("n"))
    members = copies.unionByName(copies.select(F.col("rep_id").alias("doc_id"), "rep_id").distinct()).join(group, "rep_id").join(whole, "doc_id")
    full = members.select("doc_id", F.lit(0).alias("start"), "length", (F.col("length") - span + 1).cast("bigint").alias("windows"), F.col("n").alias("texts"))
    return spans.drop("_run").join(members.select("doc_id"), "doc_id", "left_anti").unionByName(full)


def report(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """How much of every text stands elsewhere: doc_id, n_chars, shared_chars, share (0 for NULL and empty texts)."""
    by = passages(docs, span).groupBy("doc_id").agg(F.sum("length").alias("shared_chars"))
    n = F.coalesce(F.length("text"), F.lit(0))
    out = docs.filter("doc_id is not null").select("doc_id", n.cast("bigint").alias("n_chars")).join(by, "doc_id", "left")
    k = F.coalesce("shared_chars", F.lit(0))
    return out.select("doc_id", "n_chars", k.alias("shared_chars"), F.when(F.col("n_chars") > 0, k / F.col("n_chars")).otherwise(0.0).alias("share"))
