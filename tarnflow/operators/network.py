"""Drainage networks of cells: reaches, junctions, masks and accumulation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.hierarchy import accumulate, resolve
from tarnflow.session import materialise, release


def indegrees(links: DataFrame) -> DataFrame:
    """node, indegree of every node of `hierarchy.parent_links`; a self-link counts for its own node."""
    into = links.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("_n"))
    return links.join(into, "node", "left").select("node", "parent", F.coalesce("_n", F.lit(0)).alias("indegree"))


def node_kinds(links: DataFrame) -> DataFrame:
    """node, indegree, headwater (nothing flows in), confluence (more than one does), sink (no outflow)."""
    return indegrees(links).select("node", "indegree", (F.col("indegree") == 0).alias("headwater"), (F.col("indegree") > 1).alias("confluence"), F.col("parent").isNull().alias("sink"))


def reaches(links: DataFrame) -> DataFrame:
    """The reach of every node: node, reach_id (its first node), position (0 at the head).

    A reach begins at a headwater or confluence and runs down to the next confluence, sink or table edge. Nodes on loops
    that nothing enters are in no reach. Inside a reach every node but the head has one inflow, so the head is the root of
    the links turned upstream (`hierarchy.resolve`).
    """
    kinds = materialise(indegrees(links))
    head = F.col("indegree") != 1
    above = links.filter("parent is not null").select(F.col("parent").alias("node"), F.col("node").alias("_up"))
    inflow = above.join(kinds.filter(~head).select("node"), "node", "left_semi")
    towards = kinds.select("node").join(inflow, "node", "left").select("node", F.col("_up").alias("parent"))
    return resolve(towards).filter("depth >= 0").select("node", F.col("root").alias("reach_id"), F.col("depth").alias("position"))


def junctions(links: DataFrame, reach: DataFrame) -> DataFrame:
    """reach_id, tail, destination of every reach whose last node flows to a node of the table."""
    last = reach.groupBy("reach_id").agg(F.max_by("node", "position").alias("tail"))
    return last.join(links.select(F.col("node").alias("tail"), F.col("parent").alias("destination")), "tail").filter("destination is not null").select("reach_id", "tail", "destination")


def downstream_closure(links: DataFrame, seeds: DataFrame, also: list[str] = []) -> DataFrame:  # noqa: B006
    """Every node at or below a seed (column node), loops included: node, and per value of the columns `also`.

    The closure doubles: each round adds, to all nodes marked so far, the nodes 2^k links below them.
    """
    marked = seeds.select("node", *also).distinct().join(links.select("node"), "node", "left_semi")
    jump = links.filter("parent is not null").select("node", F.col("parent").alias("up"))
    marked, jump = materialise(marked), materialise(jump)
    count, before = marked.count(), 0
    # a round that marks nothing new is the last: all that lies within twice its links is marked then
    while count > before:
        below = marked.join(jump, "node").select(F.col("up").alias("node"), *also)
        marked, old = materialise(marked.unionByName(below).distinct()), marked
        release(old)
        before, count = count, marked.count()
        further = jump.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        jump, old = materialise(jump.join(further, "up").select("node", F.col("_up").alias("up"))), jump
        release(old)
    return marked


def flow_accumulation(links: DataFrame, values: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """node, total: the sum of `values` (node, value) over each node and all upstream; 0 counts for NULL and NaN.

    Nodes whose path enters a loop have no row. `tree` are the others, if they are known already.
    """
    if tree is None:
        tree = resolve(links).filter("depth >= 0").select("node")
    value = F.when(~F.isnan(F.col("value").cast("double")), F.col("value"))
    return accumulate(links.join(values.select("node", value.alias("value")), "node", "left"), tree)


def accumulate_steps(links: DataFrame, values: DataFrame, step: str) -> DataFrame:
    """node, `step`, total: the sum of `values` (node, step, value; a row per node and step) over each node and all upstream, step by step.

    Rows are those of `values` whose node reaches a root; NULL values count as 0. Nodes without values only pass on what
    comes from above, so the links are first contracted to the nodes that have some: work grows with nodes that have
    values times steps, and not with the whole network times steps.
    """
    held = materialise(values.select("node").distinct().join(resolve(links).filter("depth >= 0").select("node"), "node", "left_semi"))
    # the first node with values at or below each node: roots of the links cut at such nodes
    mark = held.withColumn("_held", F.lit(True))
    cut = links.join(mark, "node", "left").select("node", F.when(F.col("_held").isNull(), F.col("parent")).alias("parent"))
    first = resolve(cut).filter("depth >= 0").select(F.col("node").alias("parent"), F.col("root").alias("_first"))
    below = links.join(held, "node", "left_semi").join(first, "parent", "left").select("node", F.col("_first").alias("parent"))
    below = below.join(held.select(F.col("node").alias("parent"), F.lit(True).alias("_held")), "parent", "left")
    below = materialise(below.select("node", F.when(F.col("_held"), F.col("parent")).alias("parent")))
    # a step that a node lacks still passes through it
    passed = downstream_closure(below, values.select("node", step), [step])
    dense = passed.join(below, "node").join(values, ["node", step], "left").select(step, "node", "parent", "value")
    tree = dense.select(step, "node")
    return accumulate(dense, tree, [step]).join(values.select("node", step), ["node", step], "left_semi")


def junction_inflow(junction: DataFrame, flow: DataFrame) -> DataFrame:
    """destination, inflow: the positive flow (node, q) of all tails into a node."""
    tails = junction.join(flow.select(F.col("node").alias("tail"), "q"), "tail")
    return tails.groupBy("destination").agg(F.sum(F.when(F.col("q") > 0, F.col("q")).otherwise(0.0)).alias("inflow"))
