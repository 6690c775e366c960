"""Connected components of an edge table, in rounds of distributed label minimisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.skew import ROWS, split_join
from vecloom.session import materialise


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 64, rows: int = ROWS) -> DataFrame:
    """``(node, component)`` for every endpoint of ``edges``; the component is its smallest node.

    Alternating star contraction: every round links each node to the smallest neighbour it knows
    ("large star": only larger neighbours are re-pointed; "small star": a node and its smaller
    neighbours are re-pointed), which keeps the edge count from growing and needs a number of rounds
    logarithmic in the number of nodes. Every step is a shuffle of edge rows with a map-side minimum;
    nothing is gathered in the driver. A node's neighbourhood is never collected: its minimum is joined back
    to the edges, and a node with very many edges, as the smallest of a giant component gets, is split over
    tasks in that join.

    Self-loops give a component of one node. Rows with a null endpoint are ignored. No edges give no rows.
    """
    known = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    nodes = known.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    current = materialise(known.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    size = lambda table: table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = size(current)
    for _ in range(max_rounds):
        # no node of few edges in all has many of its own
        lower = (lambda e, m: e.join(m, "u")) if before[0] <= rows else (lambda e, m: split_join(e, m, ["u"], rows))
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = lower(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        if before[0] > rows:
            large = materialise(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lower(large, low).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        current = materialise(small, "cc")
        now = size(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return nodes.join(current.withColumnRenamed("u", "node").withColumnRenamed("v", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
