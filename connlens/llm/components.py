"""Connected components of an edge list, by smallest neighbours and contracted edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from connlens.llm.common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge, and one node that stands for its component.

    In each round a node points to its smallest neighbour, if that is smaller,
    and then to where that one points. The edges are contracted to these nodes;
    those inside one node go, so that few are left after a round or two. Each
    round is a written table.
    """
    links = saved(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x != y").distinct(), "links")
    labels = None
    while labels is None or links.limit(1).count():
        ends = links.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e"))
        to = saved(ends.groupBy(F.col("e.x").alias("node")).agg(F.min("e.y").alias("near")).select("node", F.least("node", "near").alias("up")), "pointers")
        top = to.select(F.col("node").alias("up"), F.col("up").alias("top"))
        to = saved(to.join(top, "up").select("node", "top"), "pointers")
        if labels is None:
            labels = to.withColumnRenamed("top", "root")
        else:
            moved = labels.join(to.select(F.col("node").alias("root"), "top"), "root", "left")
            labels = saved(moved.select("node", F.coalesce("top", "root").alias("root")), "labels")
        one = links.join(to.select(F.col("node").alias("x"), F.col("top").alias("new_x")), "x")
        two = one.join(to.select(F.col("node").alias("y"), F.col("top").alias("new_y")), "y")
        links = saved(two.select(F.col("new_x").alias("x"), F.col("new_y").alias("y")).filter("x != y").distinct(), "links")
    return labels
