"""Connected components by random contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, settled, table

MOST_ROUNDS = 60
FEW = 100_000  # edges that one task finishes


def _finish(t: pa.Table) -> pa.Table:
    """Union-find over at most FEW edges."""
    a, b = t["a"].to_pylist(), t["b"].to_pylist()
    parent: dict = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return pa.table({"a": pa.array(nodes, t["a"].type), "p": pa.array([find(x) for x in nodes], t["a"].type)})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, component) for every end of an edge; a component is named by its least node.

    Each round every node joins its neighbour (or itself) of the least hash, a
    new hash each round, and the edges between the joined nodes remain: their
    number falls by a constant factor in expectation whatever the shape, so
    chains and stars take a logarithmic number of rounds. When at most ``few``
    edges remain, one task finishes them by union-find. Each round is a written
    table; the chain of maps is folded pairwise from its end, a table a step.
    Groups are aggregated before they are shuffled; a hub is one partial row a
    task. Null ends and loops give no edge; repeated edges count once.
    """
    now = table(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "edges")
    kind = now.schema["a"].dataType.simpleString()
    maps: list[DataFrame] = []
    for r in range(MOST_ROUNDS):
        if now.count() <= few:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, r=r: F.struct(F.xxhash64(F.lit(r), c).alias("h"), F.col(c).alias("v"))
        parent = table(both.groupBy("a").agg(F.least(F.min(rank("b")), F.min(rank("a"))).getField("v").alias("p")), "parents")
        maps.append(parent)
        pa_, pb = parent.select(F.col("a"), F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        after = table(now.join(pa_, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct(), "edges")
        drop(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    label = now.coalesce(1).withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_finish, f"a {kind}, p {kind}").select(F.col("a").alias("node"), F.col("p").alias("root"))
    if not maps:  # the task's roots are its least nodes already
        out = settled(label.select("node", F.col("root").alias("component")), "components")
        drop(now)
        return out
    label = table(label, "labels")
    drop(now)
    for parent in reversed(maps):
        up = label.select(F.col("node").alias("p"), "root")
        after = table(parent.join(up, "p", "left").select(F.col("a").alias("node"), F.coalesce("root", "p").alias("root")), "labels")
        drop(label, parent)
        label = after
    least = label.groupBy("root").agg(F.min("node").alias("component"))  # contraction names nodes by hash
    out = settled(label.join(least, "root").select("node", "component"), "components")
    drop(label)
    return out
