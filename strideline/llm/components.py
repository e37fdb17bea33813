"""Connected components of an edge table, by minimum neighbours and pointer jumping; everything stays in Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v): the root is the smallest node that it is connected with.

    Each round maps every node to its smallest neighbour, follows the maps to their ends, and joins the ends' edges; the
    longest path shrinks by a factor each time. Empty edges have no rows.
    """
    edges = written(edges.select("u", "v").where("u <> v"), "edges")
    total = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        jump = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("f")), "jump")
        while True:
            ends = jump.select(F.col("u").alias("f"), F.col("f").alias("g"))
            far = jump.join(ends, "f", "left").select("u", "f", F.coalesce("g", "f").alias("g"))
            far = written(far, "jump")
            moved = far.where("g <> f").limit(1).count()
            jump = far.select("u", F.col("g").alias("f"))
            if not moved:
                break
        if total is None:
            total = jump.select(F.col("u").alias("node"), F.col("f").alias("root"))
        else:
            step = jump.select(F.col("u").alias("root"), F.col("f").alias("next"))
            total = written(total.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        a = jump.select(F.col("u").alias("u"), F.col("f").alias("fu"))
        b = jump.select(F.col("u").alias("v"), F.col("f").alias("fv"))
        edges = written(edges.join(a, "u").join(b, "v").where("fu <> fv").select(F.col("fu").alias("u"), F.col("fv").alias("v")).distinct(), "edges")
        if not edges.limit(1).count():
            return total
