"""Connected components of an edge table by repeated contraction.

In each round every node moves to the neighbour that comes first in an order
drawn anew for the round, if that one comes before itself; edges follow their
ends, loops and repeats go. A constant share of the nodes goes in each round.
Minima are combined before the shuffle, so a node with very many edges is no
hot group, and no component is ever gathered in one place. Each round is written
as a table: a checkpoint would keep the filters' constraints, which the planner
multiplies round by round.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import stored


def _edges(df: DataFrame) -> DataFrame:
    return df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, seed: int = 7) -> DataFrame:
    """``node, root`` for each node of ``edges`` (bigint ``a, b``); nodes of one component share a root, one of them.

    Loops, repeats and either direction of an edge make no difference; rows
    with a null end are ignored; no edges give no rows.
    """
    rnd = random.Random(seed)
    steps: list[DataFrame] = []
    left = stored(_edges(edges))
    while not left.isEmpty():
        salt = F.lit(rnd.getrandbits(64) - (1 << 63))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(salt)).alias("least"))
        step = stored(first.select(F.col("a").alias("node"), F.least("least", F.col("a").bitwiseXOR(salt)).bitwiseXOR(salt).alias("root")))
        steps.append(step)
        ends = {x: step.select(F.col("node").alias(x), F.col("root").alias(f"to_{x}")) for x in "ab"}
        moved = left.join(ends["a"], "a").join(ends["b"], "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        left = stored(_edges(moved))
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps.pop()
    while steps:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = steps.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return out
