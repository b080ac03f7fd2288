"""Queries of the problems on texts."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import mixing, packing, shared_spans, tokens
from tarnflow.session import materialise
from tarnflow.sources.tables import read_table


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every text, or piece of an oversized one, for every capacity, with its fill."""
    # a fixed table of a few capacities
    capacities = {r["capacity_id"]: r["capacity_tokens"] for r in read_table(spark, d, "pack_capacity").collect()}
    return packing.fill_containers(packing.sized(tokens.token_counts(read_table(spark, d, "documents"))), capacities)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and how well they are filled, for every capacity."""
    return packing.container_fill(p6_containers(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, d, "documents")
    texts, _ = shared_spans.distinct_texts(docs)
    return mixing.mix_and_report(texts.join(docs.select("doc_id", "source"), "doc_id"), read_table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The texts to take and how often, so that the sources have their target shares."""
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target shares and the shares really reached, with those of the fit before rounding."""
    chosen, report = _mix(spark, d)
    return mixing.reached(materialise(chosen), read_table(spark, d, "mix_targets"), report)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of speeches with 200 or more characters in common."""
    docs = read_table(spark, d, "documents")
    texts, copies = shared_spans.distinct_texts(docs)
    long = docs.filter(F.length("text") >= shared_spans.SPAN).select("doc_id")
    return shared_spans.expand_copies(shared_spans.shared_pairs(texts), copies, copies.join(long, "doc_id", "left_semi"))


def p8_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between the representatives (least id) of equal texts: p8_found without a row per pair of copies."""
    return shared_spans.shared_pairs(shared_spans.distinct_texts(read_table(spark, d, "documents"))[0])


def p8_members(spark: SparkSession, d: str) -> DataFrame:
    """Each speech that shares a passage, with its representative, its copies and its links: the membership to p8_links."""
    docs = read_table(spark, d, "documents")
    texts, copies = shared_spans.distinct_texts(docs)
    return shared_spans.memberships(copies, docs, materialise(shared_spans.shared_pairs(texts)))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How much of each speech also stands in another one."""
    return shared_spans.report(read_table(spark, d, "documents"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages themselves: where they stand, how long they are and in how many other speeches they occur."""
    docs = read_table(spark, d, "documents")
    spans = shared_spans.passages(docs)
    return spans.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "start", "length", "texts", F.expr("substring(text, start + 1, length)").alias("passage"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p6_containers": p6_containers, "p6_fill": p6_fill, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_links": p8_links, "p8_members": p8_members, "p8_report": p8_report, "p8_passages": p8_passages}
SQL: dict[str, str] = {}
