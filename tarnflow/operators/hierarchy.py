"""Parent-child links to full hierarchies: root, depth, path, descendants, loops, for trees of any depth.

A strict level-by-level frontier needs one join per level, and river chains are thousands of links long. Two things make
it short. Nodes are first cut into blocks of near ids, inside which links are followed at once, so that only the nodes
that links from other blocks enter take part in joins. And the frontier doubles: after round k it holds every such node of
depth below 2^k, because each node not yet reached keeps a link to its 2^k-th ancestor, joined to itself each round. A
round that reaches nothing is the last: a node that is never reached runs into a loop. Ids that lie near each other often
are near in the network too; where they are not, the blocks save nothing and the frontier does all of it.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.lanes import lane_starts, map_lanes, running
from tarnflow.session import materialise, release

#: Nodes of a block, inside which links are followed in one task.
BLOCK_NODES = 65_536


def _seek(up: str) -> Column:
    """`up`, or where it is NULL a value that no parent has: rows without `up` spread over all tasks in a left join.

    Parents are above 0, so the sides joined to it keep only such nodes.
    """
    return F.coalesce(F.col(up), F.when(F.col("node") > 0, -F.col("node")).otherwise(F.col("node")))


def parent_links(df: DataFrame, node: str, parent: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per distinct non-NULL node: keys, node, parent; parent is NULL where the path ends.

    It ends where `parent` is NULL, 0 or negative, or not a node of the table (of the same `keys`). A node
    with several parents keeps the smallest, so that every node has one path.
    """
    rows = df.filter(F.col(node).isNotNull()).select(*keys, F.col(node).alias("node"), F.when(F.col(parent) > 0, F.col(parent)).alias("parent"))
    rows = rows.groupBy(*keys, "node").agg(F.min("parent").alias("parent"))
    known = rows.filter("node > 0").select(*keys, F.col("node").alias("parent"), F.lit(True).alias("_known"))
    seeking = rows.select(*keys, "node", _seek("parent").alias("parent"))
    return seeking.join(known, [*keys, "parent"], "left").select(*keys, "node", F.when(F.col("_known"), F.col("parent")).alias("parent"))


def _blocked(links: DataFrame, keys: list[str], block_nodes: int) -> DataFrame:
    """`links` (keys, node, parent, value) written in blocks of near ids of about `block_nodes` nodes, numbered by `_block`.

    Whole values become BIGINT, others DOUBLE.
    """
    kind = "bigint" if dict(links.dtypes)["value"] in ("tinyint", "smallint", "int", "bigint") else "double"
    rows = links.select(*keys, F.col("node").cast("bigint").alias("node"), F.col("parent").cast("bigint").alias("parent"), F.col("value").cast(kind).alias("value"))
    n = -(-rows.count() // block_nodes)
    if n <= 1:
        return materialise(rows.withColumn("_block", F.lit(0)))
    return materialise(rows.repartitionByRange(n, *keys, "node").withColumn("_block", F.spark_partition_id()))


def _parents(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row of each row's parent in the same block and of the same keys, -1 where there is none."""
    starts = lane_starts(table, ["_block", *keys])
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    node = table.column("node").to_numpy()
    parent = table.column("parent").fill_null(0).to_numpy()
    has = ~table.column("parent").is_null().to_numpy(zero_copy_only=False)
    ids = np.unique(node)
    own = group * len(ids) + np.searchsorted(ids, node)
    at = np.minimum(np.searchsorted(ids, parent), max(len(ids) - 1, 0))
    wanted = group * len(ids) + at
    row = np.minimum(np.searchsorted(own, wanted), max(len(own) - 1, 0))
    return np.where(has & (ids[at] == parent) & (own[row] == wanted), row, -1) if len(node) else np.zeros(0, np.int64)


def _follow(keys: list[str]):
    """Kernel: the end of each node's path inside its block, and the sum of `value` on the way.

    `up` is the node outside that the path goes on to; without it `root` is the path's end, or the least node of the loop
    that it enters, which has no `total`.
    """
    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        inner = _parents(table, keys)
        n = len(inner)
        here = np.arange(n)
        node, value = table.column("node").to_numpy(), table.column("value").to_numpy()
        goes = inner >= 0
        last, total = np.where(goes, inner, here), np.where(goes, value, np.zeros(1, value.dtype))
        least, jump = node.copy(), np.where(goes, inner, here)
        for _ in range(n.bit_length() + 1):
            total = total + total[last]
            last = last[last]
            least = np.minimum(least, least[jump])
            jump = jump[jump]
        looped = goes[last]  # still going on: `last` is on a loop then, and every loop node is one's last
        on_loop = np.zeros(n, bool)
        on_loop[last[looped]] = True
        total = total + value[last]
        up = table.column("parent").take(pa.array(last)).combine_chunks()
        leaves = ~up.is_null().to_numpy(zero_copy_only=False) & ~looped
        root = np.where(looped, least[last], node[last])
        return pa.table(
            [*(table.column(k) for k in keys), table.column("node"), pa.array(up.fill_null(0).to_numpy(zero_copy_only=False), mask=~leaves), pa.array(root, mask=leaves), pa.array(total, mask=looped), pa.array(on_loop)],
            names=[*keys, "node", "up", "root", "total", "on_loop"],
        )

    return run


def _gather(keys: list[str]):
    """Kernel: the sum of `value` over each node and everything above it inside its block; `leaves` where its link goes outside."""
    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        inner = _parents(table, keys)
        value = table.column("value").to_numpy()
        total, at = value.astype(float), inner.copy()
        while (goes := np.flatnonzero(at >= 0)).size:
            gift = np.bincount(at[goes], total[goes], len(total))
            at[goes] = at[at[goes]]
            total = total + gift
        total = np.rint(total).astype(np.int64) if value.dtype.kind == "i" else total
        leaves = ~table.column("parent").is_null().to_numpy(zero_copy_only=False) & (inner < 0)
        return pa.table([*(table.column(k) for k in keys), table.column("node"), table.column("parent"), pa.array(total), pa.array(leaves)], names=[*keys, "node", "up", "total", "leaves"])

    return run


def _schema(links: DataFrame, keys: list[str], rest: str) -> str:
    kinds = dict(links.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "node bigint", rest.format(value=kinds["value"])])


def _walk(links: DataFrame, keys: list[str], block_nodes: int) -> tuple[DataFrame, DataFrame | None]:
    """Root and sum of `value` (no NULL) from each node to it, both included: keys, node, root, total, on_loop.

    `total` is NULL where the path enters a loop inside one block, whose least node is the root. Also the nodes (keys, node)
    that run into loops across blocks, None if there are none.
    """
    blocked = _blocked(links, keys, block_nodes)
    schema = _schema(blocked, keys, "up bigint, root bigint, total {value}, on_loop boolean")
    hops = materialise(map_lanes(blocked, ["_block"], [*keys, "node"], _follow(keys), schema, block_nodes))
    release(blocked)
    ends, pending = hops.filter("up is null").drop("up"), hops.filter("up is not null").drop("root", "on_loop")
    # only nodes that links from other blocks enter can be met on the way
    entered = hops.join(pending.select(*keys, F.col("up").alias("node")).distinct(), [*keys, "node"], "left_semi")
    entered = materialise(entered)
    parts, left = [entered.filter("up is null").select(*keys, "node", "root", "total")], entered.filter("up is not null").select(*keys, "node", "up", "total")
    count = left.count()
    while count:
        done = reduce(DataFrame.unionByName, parts).select(*keys, F.col("node").alias("up"), F.col("root").alias("_root"), F.col("total").alias("_total"))
        far = done.unionByName(left.select(*keys, F.col("node").alias("up"), F.col("up").alias("_next"), F.col("total").alias("_total")), allowMissingColumns=True)
        joined = materialise(left.join(far, [*keys, "up"]).select(*keys, "node", F.col("_next").alias("up"), F.col("_root").alias("root"), (F.col("total") + F.col("_total")).alias("total")))
        before, left = count, joined.filter("up is not null").drop("root")
        count = left.count()
        if count == before:
            break
        parts.append(joined.filter("up is null").drop("up"))
    met = reduce(DataFrame.unionByName, parts).select(*keys, F.col("node").alias("up"), "root", F.col("total").alias("_total"))
    reached = pending.join(met, [*keys, "up"]).select(*keys, "node", "root", (F.col("total") + F.col("_total")).alias("total"), F.lit(False).alias("on_loop"))
    return ends.unionByName(reached), pending.join(met, [*keys, "up"], "left_anti").select(*keys, "node") if count else None


def resolve(links: DataFrame, keys: list[str] = [], block_nodes: int = BLOCK_NODES) -> DataFrame:  # noqa: B006
    """Root and depth of every node of `parent_links`: keys, node, root, depth INT, on_loop BOOLEAN.

    Nodes whose path enters a loop have the smallest node of that loop as root and depth -1; on_loop is true for
    the loop's own nodes. An empty table gives an empty result. A node that ends many paths is joined as the one row it
    is, and AQE splits the many.
    """
    found, lost = _walk(links.withColumn("value", F.lit(1).cast("bigint")), keys, block_nodes)
    out = found.select(*keys, "node", "root", F.coalesce((F.col("total") - 1).cast("int"), F.lit(-1)).alias("depth"), "on_loop")
    if lost is None:
        return out
    left = materialise(links.join(lost, [*keys, "node"], "left_semi").select(*keys, "node", "parent", F.col("parent").alias("up")))
    own, step, most = left.select(*keys, "node", "parent"), 1, left.count()
    if most <= block_nodes:  # all of them fit in one block, and so does every link of theirs
        return out.unionByName(resolve(own, keys, block_nodes))
    # loops across blocks: after as many links as there are such nodes `up` is on a loop, and every loop node is the `up`
    # of one of its own loop
    while step < most:
        far = left.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"))
        left, old = materialise(left.join(far, [*keys, "up"]).select(*keys, "node", F.col("_up").alias("up"))), left
        if step > 1:  # the first one is read below
            release(old)
        step *= 2
    loop = materialise(left.select(*keys, F.col("up").alias("node")).distinct())
    turn = loop.join(own, [*keys, "node"])
    least = materialise(turn.select(*keys, "node", F.col("parent").alias("up"), F.least("node", "parent").alias("least")))
    step, most = 1, least.count()
    while step < most:
        other = least.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        least, old = materialise(least.join(other, [*keys, "up"]).select(*keys, "node", F.col("_up").alias("up"), F.least("least", "_least").alias("least"))), least
        release(old)
        step *= 2
    roots = least.select(*keys, F.col("node").alias("up"), F.col("least").alias("root"))
    on_loop = loop.select(*keys, "node", F.lit(True).alias("_on"))
    rest = left.join(roots, [*keys, "up"]).join(on_loop, [*keys, "node"], "left")
    return out.unionByName(rest.select(*keys, "node", "root", F.lit(-1).alias("depth"), F.coalesce("_on", F.lit(False)).alias("on_loop")))


def ancestors(links: DataFrame, resolved: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Every pair of a node and one of its ancestors: keys, node, ancestor, hops (1 for the parent).

    Read by `ancestor` it lists all descendants of a node. Nodes on a path into a loop have no rows, for their
    ancestors never end. Pairs are made by doubling: those of 1..2^k hops joined with the 2^k-th ancestor's. The
    result has one row per pair, its size is the sum of all depths.
    """
    tree = resolved.filter("depth >= 0").select(*keys, "node")
    pairs = materialise(links.filter("parent is not null").join(tree, [*keys, "node"], "left_semi").select(*keys, "node", F.col("parent").alias("ancestor"), F.lit(1).alias("hops")))
    deepest = resolved.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step < deepest:
        edge = pairs.filter(F.col("hops") == step).select(*keys, "node", F.col("ancestor").alias("_via"))
        more = pairs.select(*keys, F.col("node").alias("_via"), F.col("ancestor"), (F.col("hops") + F.lit(step)).alias("hops"))
        longer = pairs.unionByName(edge.join(more, [*keys, "_via"]).select(*keys, "node", "ancestor", "hops"))
        step *= 2
        if step < deepest:
            longer = materialise(longer)
            release(pairs)
        pairs = longer
    return pairs


def paths(links: DataFrame, resolved: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Full path of every node: keys, node, root, depth, path ARRAY from the node to its root.

    A node whose path enters a loop has the path NULL. Paths are put together by doubling: each round appends the
    path of the last node so far, so a path of d links takes log2(d) + 1 joins.
    """
    deepest = resolved.agg(F.max("depth")).first()[0] or 0
    tree = resolved.filter("depth >= 0").select(*keys, "node")
    end = F.array().cast("array<bigint>")
    state = links.join(tree, [*keys, "node"], "left_semi").select(*keys, "node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), end).otherwise(F.array("parent")).alias("rest"))
    state, step = materialise(state), 1
    while step < deepest:
        going = state.filter("up is not null")
        other = state.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("rest").alias("_rest"))
        going = going.join(other, [*keys, "up"]).select(*keys, "node", F.col("_up").alias("up"), F.concat("rest", "_rest").alias("rest"))
        state, old = materialise(going.unionByName(state.filter("up is null"))), state
        release(old)
        step *= 2
    full = state.select(*keys, "node", F.concat(F.array("node"), "rest").alias("path"))
    return resolved.select(*keys, "node", "root", "depth").join(full, [*keys, "node"], "left")


def descendant_counts(links: DataFrame, resolved: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Number of descendants of every node: keys, node, descendants (0 at a leaf; NULL for nodes whose path enters a loop).

    Counted by `accumulate`, without listing the pairs.
    """
    tree = resolved.filter("depth >= 0").select(*keys, "node")
    return accumulate(links.withColumn("value", F.lit(1).cast("bigint")), tree, keys).select(*keys, "node", (F.col("total") - 1).alias("descendants")).join(resolved.select(*keys, "node"), [*keys, "node"], "right")


def _accumulate_rounds(links: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of `value` over each node and everything upstream: keys, node, total, by a frontier that doubles.

    Round k gives the totals so far to the nodes 2^k links below. Nodes with no link left take no further part: what they
    hold, and what is given to them later, is put aside and summed up at the end.
    """
    state = links.select(*keys, "node", F.col("parent").alias("up"), F.col("value").alias("total"))
    aside = [state.filter("up is null").drop("up")]
    active = materialise(state.filter("up is not null"))
    while not active.isEmpty():
        gifts = active.groupBy(*keys, F.col("up").alias("node")).agg(F.sum("total").alias("_gift"))
        jump = active.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"))
        going = active.join(gifts, [*keys, "node"], "left").join(jump, [*keys, "up"], "left")
        moved = materialise(going.select(*keys, "node", F.col("_up").alias("up"), (F.col("total") + F.coalesce("_gift", F.lit(0))).alias("total")))
        aside += [moved.filter("up is null").drop("up"), gifts.join(active, [*keys, "node"], "left_anti").withColumnRenamed("_gift", "total")]
        active = moved.filter("up is not null")
    return reduce(DataFrame.unionByName, aside).groupBy(*keys, "node").agg(F.sum("total").alias("total"))


def accumulate(links: DataFrame, tree: DataFrame, keys: list[str] = [], block_nodes: int = BLOCK_NODES) -> DataFrame:  # noqa: B006
    """Sum of `value` over each node and everything upstream of it: keys, node, total.

    `links` has keys, node, parent, value; only nodes of `tree` (those that reach a root) take part. NULL values
    count as 0. Sums are taken inside blocks, what leaves the blocks is accumulated over the nodes it enters
    (`_accumulate_rounds`), and that is summed inside the blocks again.
    """
    rows = links.join(tree, [*keys, "node"], "left_semi").withColumn("value", F.coalesce("value", F.lit(0)))
    blocked = _blocked(rows, keys, block_nodes)
    schema = _schema(blocked, keys, "up bigint, total {value}, leaves boolean")
    inside = materialise(map_lanes(blocked, ["_block"], [*keys, "node"], _gather(keys), schema, block_nodes))
    given = inside.filter("leaves").groupBy(*keys, F.col("up").alias("node")).agg(F.sum("total").alias("value"))
    given = materialise(given)
    if given.isEmpty():
        return inside.select(*keys, "node", "total")
    hops = map_lanes(blocked, ["_block"], [*keys, "node"], _follow(keys), _schema(blocked, keys, "up bigint, root bigint, total {value}, on_loop boolean"), block_nodes)
    entered = hops.select(*keys, "node", F.col("up").alias("parent")).join(given, [*keys, "node"])
    come = _accumulate_rounds(materialise(entered), keys).withColumnRenamed("total", "_come")
    more = blocked.join(come, [*keys, "node"], "left").withColumn("value", F.col("value") + F.coalesce("_come", F.lit(0))).drop("_come")
    return map_lanes(more, ["_block"], [*keys, "node"], _gather(keys), schema, block_nodes).select(*keys, "node", "total")


def sum_to_root(links: DataFrame, keys: list[str] = [], block_nodes: int = BLOCK_NODES) -> DataFrame:  # noqa: B006
    """Sum of `value` over each node and everything below it to its root: keys, node, total.

    `links` has keys, node, parent, value (no NULL). Nodes whose path enters a loop have no row.
    """
    return _walk(links, keys, block_nodes)[0].filter("total is not null").select(*keys, "node", "total")


def intervals(links: DataFrame, resolved: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Labels that tell ancestors without listing pairs: keys, node, root, first, last (BIGINT, 0 at a root).

    A node lies at or above (upstream of) another one if both have the same root and its `first` is in the other's first..last.
    Nodes are numbered parent before children, children by their ids: a node comes after its parent and after all that
    is above its earlier siblings. Nodes whose path enters a loop have no row. One row per node, whatever the depth.
    """
    tree = resolved.filter("depth >= 0").select(*keys, "node", "root")
    size = accumulate(links.withColumn("value", F.lit(1).cast("bigint")), tree, keys)
    sized = materialise(links.select(*keys, "node", "parent").join(size, [*keys, "node"]))
    children = running(sized.filter("parent is not null"), [*keys, "parent"], ["node"], "total", "_before")
    step = children.select(*keys, "node", "parent", (F.col("_before") + 1).alias("value")).unionByName(sized.filter("parent is null").select(*keys, "node", "parent", F.lit(0).cast("bigint").alias("value")))
    first = sum_to_root(step, keys).withColumnRenamed("total", "first")
    return tree.join(first, [*keys, "node"]).join(sized.select(*keys, "node", "total"), [*keys, "node"]).select(*keys, "node", "root", "first", (F.col("first") + F.col("total") - 1).alias("last"))


def ancestors_within(links: DataFrame, seeds: DataFrame, most: float, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Ancestors of the `seeds` (keys, node) along paths whose sum of `value` is at most `most`: keys, node, ancestor, total.

    `links` has keys, node, parent, value (0 or more, no NULL); total sums the values from the node to the ancestor's
    child. Doubling as in `ancestors`, but only from the seeds, and jumps beyond `most` are left out in each round, so
    that rows grow with what lies within reach. Loops end where the sum does; a path of zeros in a loop is not followed
    for more links than there are nodes.
    """
    jump = materialise(links.filter(F.col("parent").isNotNull() & (F.col("value") <= most)).select(*keys, "node", F.col("parent").alias("up"), F.col("value").alias("total")))
    start = seeds.select(*keys, "node").distinct()
    pairs = materialise(start.join(jump, [*keys, "node"]).select(*keys, "node", F.col("up").alias("ancestor"), "total"))
    rounds = links.count().bit_length()
    for _ in range(rounds):
        if jump.isEmpty():
            break
        via = jump.select(*keys, F.col("node").alias("ancestor"), "up", F.col("total").alias("_more"))
        further = pairs.join(via, [*keys, "ancestor"]).select(*keys, "node", F.col("up").alias("ancestor"), (F.col("total") + F.col("_more")).alias("total"))
        pairs, old = materialise(pairs.unionByName(further).filter(F.col("total") <= most).groupBy(*keys, "node", "ancestor").agg(F.min("total").alias("total"))), pairs
        release(old)
        other = jump.select(*keys, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_more"))
        jump, old = materialise(jump.join(other, [*keys, "up"]).select(*keys, "node", F.col("_up").alias("up"), (F.col("total") + F.col("_more")).alias("total")).filter(F.col("total") <= most)), jump
        release(old)
    return pairs
