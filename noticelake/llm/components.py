"""Connected components of a graph of links by union-find and label rounds.

Links are first contracted by union-find inside each partition, which turns dense
groups into stars; rounds of least labels with pointer jumping then join what spans
partitions. Neither links nor components ever leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.scratch import stored

#: Nodes that a task's forest holds before its stars are handed on.
FOREST_NODES = 1_000_000


def _forests(links: DataFrame) -> DataFrame:
    """Links (a, b) of each partition as stars around the least node of each tree."""

    def contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[tuple, tuple] = {}

        def stars() -> Iterator[pd.DataFrame]:
            rows = [(*root(x), *x) for x in parent if root(x) != x]
            if rows:
                yield pd.DataFrame(rows, columns=["a_id", "a_set", "b_id", "b_set"])

        def root(x: tuple) -> tuple:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while x != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a_id, a_set, b_id, b_set in batch.itertuples(index=False):
                a, b = root((a_id, a_set)), root((b_id, b_set))
                if a != b:
                    low, high = min(a, b), max(a, b)
                    parent[high] = low
            if len(parent) > FOREST_NODES:
                yield from stars()
                parent.clear()
        yield from stars()

    flat = links.select(
        F.col("a.id").alias("a_id"), F.col("a.set").alias("a_set"), F.col("b.id").alias("b_id"), F.col("b.set").alias("b_set")
    )
    node = lambda side: F.struct(F.col(f"{side}_id").alias("id"), F.col(f"{side}_set").alias("set")).alias(side)
    return flat.mapInPandas(contracted, flat.schema).select(node("a"), node("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the least node that it is connected to.

    Nodes are structs of id and set; a link with a null in a node joins nothing and is left
    out; repeated links and links of a node with itself change nothing; an empty graph gives
    no rows; other columns are not read.
    """
    links = links.filter("a.id is not null and a.set is not null and b.id is not null and b.set is not null")
    stars = stored(_forests(links).distinct())
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("label")))
    while True:  # a round that moves nothing comes after at most as many rounds as a path has nodes, with jumps far fewer
        # The least label among neighbours, then the label of that label.
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(seen.select(F.col("a").alias("node"), "near"), "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = least.join(jump, "next", "left").select("node", (F.coalesce("far", "next") != F.col("label")).alias("moved"), F.least("next", F.coalesce("far", "next")).alias("label"))
        found = stored(moved)
        labels = found.drop("moved")
        if found.filter("moved").isEmpty():
            return labels
