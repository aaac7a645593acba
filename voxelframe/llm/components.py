"""Connected components as Spark jobs over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import broadcast_if, stored

#: Components that hold a surrogate node and may be broadcast.
MOST_FIXES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges (a, b).

    Each round hooks every node to its smallest neighbour, shortens the chains by
    pointer doubling and contracts the edges, so the edges shrink until none is
    left. All state lives in written tables; no link reaches the driver. Null
    ends and self-links are ignored; an empty table gives no row.
    """
    labels = None
    edges = stored(edges.selectExpr("least(a, b) a", "greatest(a, b) b").where("a < b").distinct())
    while not edges.isEmpty():
        both = edges.union(edges.selectExpr("b", "a"))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("p")))
        while True:
            up = parent.selectExpr("node up", "p pp")
            jumped = stored(parent.join(up, parent.p == up.up, "left").select("node", F.coalesce("pp", "p").alias("p"), (F.col("pp") < F.col("p")).alias("moved")))
            parent = jumped.select("node", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.withColumnRenamed("p", "component")
        else:
            labels = stored(labels.join(parent, labels.component == parent.node, "left").select(labels.node, F.coalesce("p", "component").alias("component")))
        pa, pb = parent.selectExpr("node a", "p pa"), parent.selectExpr("node b", "p pb")
        edges = stored(edges.join(pa, "a").join(pb, "b").selectExpr("least(pa, pb) a", "greatest(pa, pb) b").where("a < b").distinct())
    return labels if labels is not None else edges.selectExpr("a node", "b component")


def nodes(named: DataFrame) -> DataFrame:
    """(key, least, node, copies) of the contents of named(key, id): the smallest id that has it, a node of its own, and its rows.

    A node is its content's smallest id. Where an id has several contents, the first
    by key has the id for its node, each further one a hash of the key above the ids
    in use, so that no link of one goes to another.
    """
    g = named.groupBy("key").agg(F.min(F.col("id").cast("long")).alias("least"), F.count(F.lit(1)).alias("copies"))
    own = F.xxhash64("key").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    nth = F.row_number().over(Window.partitionBy("least").orderBy("key"))
    return g.withColumn("node", F.when(nth == 1, F.col("least")).otherwise(own))


def smallest_ids(rep: DataFrame, label: DataFrame) -> DataFrame:
    """(key, component) of rep (nodes()) and label (node, component): the smallest id of the component. A component's name is that already, unless it holds a node that is no id."""
    c = rep.join(label, "node", "left").select("key", "least", "node", F.coalesce("component", "node").alias("c"))
    fixes = stored(c.where("node <> least").groupBy("c").agg(F.min("least").alias("other")))
    return c.join(broadcast_if(fixes, fixes.count(), MOST_FIXES), "c", "left").select("key", F.least("c", "other").alias("component"))
