"""Connected components of an edge table, by least neighbours, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import WorkTable, materialize

#: Rows of two or three numbers in a file.
NARROW = 1_000_000


def _roots(parents: WorkTable) -> WorkTable:
    """node, label: each node's root in the forest of ``parents``; the distance halves each time."""
    while True:
        p = parents.df
        above = p.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = WorkTable(p.join(above, "label").select("node", F.col("further").alias("label"), F.col("label").alias("was")), "roots", NARROW, F.col("label") != F.col("was"))
        parents.drop()
        parents = jumped
        if not jumped.watched:
            return jumped


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, label (least node it is connected with) of each node that has an edge.

    In each round every node takes its least neighbour as parent, trees are flattened, and the edges are those
    left between roots. A star or a chain in the order of its numbers takes one round, and of other graphs at least
    half of the nodes go in each.
    """
    links = WorkTable(edges.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).where("a <> b").distinct(), "links", NARROW, F.lit(True))
    found = None
    while links.watched or found is None:
        ends = links.df.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        parents = ends.groupBy(F.col("e.a").alias("node")).agg(F.min("e.b").alias("least")).select("node", F.least("node", "least").alias("label"))
        roots = _roots(WorkTable(parents, "parents", NARROW)).df.select("node", "label")
        left = links.df.join(roots.select(F.col("node").alias("a"), F.col("label").alias("root_a")), "a").join(roots.select(F.col("node").alias("b"), F.col("label").alias("root_b")), "b")
        left = left.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).where("a <> b").distinct()
        after = WorkTable(left, "links", NARROW, F.lit(True))
        links.drop()
        links = after
        if found is None:
            found = roots
        else:
            above = roots.select(F.col("node").alias("label"), F.col("label").alias("further"))
            found = materialize(found.join(above, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels", NARROW)
    return found
