"""Connected components of a link table, by contraction.

Each round every node points at its smallest neighbour or itself, pointers are followed
once more, and the links are rewritten to the nodes pointed at; links inside one node
vanish and equal links merge. The remaining graph shrinks until no link is left. All steps are joins and
grouped minima with a partial aggregate, so a node with very many links is
no large group, and each round's tables are written to the shared folder.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitboard.sources import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Forest:
    """Components among the nodes 0..n-1 of one task; root[i] leads to the smallest node of i's component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := self.root[x], x):
            x = up
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links between a[i] and b[i]."""
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.root)))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), two columns of one orderable type; root is the smallest node reachable.

    An empty table gives an empty result; links of a node with itself and repeated links do no harm;
    links with a null end are left out.
    """
    ordered = links.where("a IS NOT NULL AND b IS NOT NULL")
    edges = stage(ordered.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        points = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))
        points = stage(points, "pointers")
        further = points.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        points = stage(points.join(further, "parent").select("node", F.col("grand").alias("parent")), "pointers")
        if roots is None:
            roots = points.withColumnRenamed("parent", "root")
        else:
            step = points.select(F.col("node").alias("root"), "parent")
            roots = roots.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
        roots = stage(roots, "roots")
        of_a, of_b = points.select(F.col("node").alias("a"), F.col("parent").alias("pa")), points.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(of_a, "a").join(of_b, "b").where("pa <> pb")
        edges = stage(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return roots
