"""Connected components over an edge table that no task or driver needs to hold.

Alternating large-star and small-star rounds: every node's edges are hung on its smallest
neighbour until nothing changes. Minima are pre-aggregated before the shuffle; the join
that hands them back is a plain one of two written tables, which adaptive execution splits
where one node holds many of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hinted


def _stars(edges: DataFrame, large: bool, rows: int, width: int, scratch: Scratch) -> DataFrame:
    """One round over ``u > v`` edges, ``rows`` of them with nodes of ``width`` bytes."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    held = hinted(least, 2 * rows, 2 * width)  # as many nodes at most
    joined = around.join(scratch.keep(least, "least") if held is least else held, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(
            F.col("x.v").alias("u"), F.col("x.m").alias("v")
        )
    return out.where("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node, component`` (the smallest node) of every node in ``edges`` (``u, v``).

    Loops and repeated or null edges are dropped. No edges give no rows.
    """
    now = scratch.keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        size = F.max(F.octet_length(F.col("u").cast("string")))
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), size).first()
        if new[0] == 0 or new == state:
            break
        state, width = new, max(8, new[2])
        step = scratch.keep(_stars(_stars(now, True, new[0], width, scratch), False, new[0], width, scratch), "edges")
        scratch.drop(now)
        now = step
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
