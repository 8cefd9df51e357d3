"""Connected components of an edge list by local stars and alternating large-star and small-star steps.

Every round first turns the edges of each task into stars, a bounded number of edges at a time, and
ends if all of them together are stars; else a large-star and a small-star step follow, each a
grouped minimum (combined before its shuffle) and a join.  Nothing is collected.  Each round is
written to the shared folder, so its lineage is short and it survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.shared import drop_written, written

#: Edges that one task turns into stars together.
AT_ONCE = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the least of its component, and that least."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _local(edges: DataFrame) -> DataFrame:
    """The edges of each task as stars: as connected as before, and no more of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush() -> pd.DataFrame:
            b = pd.concat(held, ignore_index=True)
            return pd.DataFrame(dict(zip("uv", stars(b["u"].to_numpy(), b["v"].to_numpy()), strict=True)))

        held, count = [], 0
        for b in batches:
            held.append(b)
            count += len(b)
            if count >= AT_ONCE:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    return edges.mapInPandas(run, edges.schema)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every child (u) has one parent (v), and no parent is a child."""
    ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.lit(None).alias("v")))
    node = ends.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max(F.col("v").isNull()).alias("parent"))
    return node.filter("least <> most OR (least IS NOT NULL AND parent)").count() == 0


def _round(now: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
    return small.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: one orderable type) to (node, root): the smallest node of each component.

    Self loops and repeated edges do no harm; nodes without edges do not appear.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    while True:
        last, now = now, written(_local(now), "stars")
        drop_written(last)
        if _are_stars(now):
            break
        last, now = now, written(_round(now), "edges")
        drop_written(last)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
