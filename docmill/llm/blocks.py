"""Comparing all members of a cluster by their whole sets in tasks of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Rows (node, cluster) with `block` and the tasks (i, j) that they go to, one for every pair of blocks that their own is part of.

    A block has about `block` members, so a task has twice that at most, whatever the cluster."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tasks = placed.select("node", "cluster", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return tasks.select("node", "cluster", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def overlaps(sets: list[np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
    """Sizes of the intersections of sets (of distinct numbers), of those in `rows` (positions) with all."""
    n = len(sets)
    rows = np.arange(n) if rows is None else rows
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    codes = np.concatenate(sets)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    times = np.diff(np.r_[first, len(codes)])
    column = np.repeat(np.arange(len(first)), times)
    keep = np.repeat(times > 1, times)  # what one set alone has adds to no intersection
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    both = np.zeros((len(rows), n), np.float32)
    total, step = int(column.max(initial=-1)) + 1, 4096
    edges = np.searchsorted(column, np.arange(0, total + step, step))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        x = np.zeros((n, min(step, total - k * step)), np.float32)
        x[owner[part], column[part] - k * step] = 1
        both += x[rows] @ x.T
    return both.astype(np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest number that edges a-b between numbers below n join each number with; root: from earlier edges."""
    root = np.arange(n) if root is None else root
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
