"""Connected components of link tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in a link; root is the smallest node of its component.

    Alternates large-star and small-star rounds: links are rewired to ever smaller
    neighbours until every component is a star, after a number of rounds that grows with the
    logarithm of its size. Minima are reduced before each shuffle, and the joins are plain
    ones on a node, so a node with very many links is split at run time. Links with a null
    end and links of a node to itself count for nothing.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    stars = checkpointed(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(high.alias("u"), low.alias("v")).distinct())
    mark = _mark(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(stars: DataFrame) -> tuple:
    """Changes when the links change."""
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


class Forest:
    """Smallest linked index of each of n items, as links come in by arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
        self.label = label
