"""Ward's hierarchy of poses at any number of rows.

Rows are first summed up into at most ``leaves`` groups, each kept as its number of rows, sum and sum of squares. Such
summaries add up, so tasks make them map-side and merge them in turns until they are few. The order of merges is found on the
summaries alone: Ward's distance needs nothing else. With no more distinct poses than ``leaves`` every pose is a leaf of its own
and the hierarchy is the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from trackloom.operators.latent import complete, flat_columns, flat_matrix
from trackloom.session import materialised

#: Summaries merged by one task at once, as a multiple of the number of leaves.
TURN = 8


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0)


def condensed(entries: np.ndarray, leaves: int) -> np.ndarray:
    """Entries (n, sum of squares, sums) merged until there are no more than ``leaves``.

    Entries within a radius of a leader join it; leaders are taken from the heaviest down. The radius starts at the least
    distance that can matter and grows by half until the leaders are few enough.
    """
    entries = entries[np.lexsort((*entries[:, 2:].T, -entries[:, 0]))]
    reach = 0.0
    while len(entries) > leaves:
        centres = entries[:, 2:] / entries[:, :1]
        if not reach:
            some = centres[np.linspace(0, len(centres) - 1, min(len(centres), 256)).astype(int)]
            gaps = squared(some, centres)
            reach = float(np.sqrt(np.partition(gaps, 1, axis=1)[:, 1].mean())) / 2 or 1e-9
        free, groups = np.ones(len(entries), bool), np.zeros(len(entries), np.int64)
        made = 0
        while made <= leaves and free.any():
            lead = int(free.argmax())
            near = free & (squared(centres, centres[lead : lead + 1])[:, 0] <= reach * reach)
            near[lead] = True
            groups[near], free[near] = made, False
            made += 1
        groups[free] = made + np.arange(int(free.sum()))  # those not reached stay as they are
        total = np.zeros((groups.max() + 1, entries.shape[1]))
        np.add.at(total, groups, entries)
        entries, reach = total, reach * 1.5
    return entries


def merges_of(n: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Ward's merges (a, b, height, rows) from the lowest: ids below the number of leaves are leaves, then merges in order; the
    rows are left at 0.

    Nearest-neighbour chains: from any group to its nearest, on to that one's nearest, until two are each other's. The height
    is sqrt(2 n m / (n + m)) times the distance of the two centres, so half its square is the rise of the squared error.
    """
    leaves = len(n)
    n, centres, alive = n.astype(float).copy(), centres.astype(float).copy(), np.ones(leaves, bool)
    name, found, chain = np.arange(leaves), [], []
    for _ in range(leaves - 1):
        if not chain:
            chain = [int(alive.argmax())]
        while True:
            top = chain[-1]
            d = ((centres - centres[top]) ** 2).sum(axis=1) * (2 * n * n[top] / (n + n[top]))
            d[~alive], d[top] = np.inf, np.inf
            best = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[best]:
                best = chain[-2]
                break
            chain.append(best)
        a, b = sorted((chain.pop(), chain.pop()))
        found.append((np.sqrt(d[best]), a, b))
        centres[a] = (n[a] * centres[a] + n[b] * centres[b]) / (n[a] + n[b])
        n[a], alive[b] = n[a] + n[b], False
    out = np.zeros((max(0, leaves - 1), 4))
    root = list(range(leaves))

    def up(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    own = {k: k for k in range(leaves)}
    for step, (height, a, b) in enumerate(sorted(found, key=lambda m: m[0])):
        a, b = up(a), up(b)
        first, second = sorted((own[a], own[b]))
        root[b] = a
        out[step] = first, second, height, 0
        own[a] = leaves + step
    return out


@dataclass(frozen=True)
class Hierarchy:
    """``rows`` and ``centres`` of the leaves, ``errors`` (squared error inside each), and the ``merges`` (a, b, height, rows)."""

    rows: np.ndarray
    centres: np.ndarray
    errors: np.ndarray
    merges: np.ndarray

    def labels(self, clusters: int) -> np.ndarray:
        """Cluster (from 0, by size, the largest first) of each leaf where the tree is cut into ``clusters``."""
        leaves = len(self.rows)
        root = np.arange(2 * leaves)
        for step, (a, b, _, _) in enumerate(self.merges[: max(0, leaves - max(1, clusters))]):
            root[int(a)] = root[int(b)] = leaves + step
        at = np.arange(leaves)
        while (root[at] != at).any():
            at = root[at]
        names, place = np.unique(at, return_inverse=True)
        total = np.bincount(place, self.rows)
        order = np.lexsort((names, -total))
        rank = np.empty(len(names), int)
        rank[order] = np.arange(len(names))
        return rank[place]

    def table(self, spark: SparkSession) -> DataFrame:
        """step, a, b, height, n: one row per merge, at most the number of leaves."""
        made = [(k, int(a), int(b), float(h), int(n)) for k, (a, b, h, n) in enumerate(self.merges.tolist())]
        return spark.createDataFrame(made, "step long, a long, b long, height double, n long")


def ward(df: DataFrame, vector: str, size: int, leaves: int = 2000) -> Hierarchy:
    """The hierarchy of the complete rows of an array column of ``size`` entries.

    Equal poses are counted first. The driver gets ``leaves`` summaries of ``size`` + 2 numbers at most.
    """
    counted = df.where(F.col(vector).isNotNull() & complete(vector)).groupBy(vector).agg(F.count(F.lit(1)).alias("_n"))
    names = ["n", "q", *[f"s{i}" for i in range(size)]]
    schema = ", ".join(f"{c} double" for c in names)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, size + 2))
        for pdf in batches:
            x, n = flat_matrix(pdf, vector, size), pdf["_n"].to_numpy(dtype=float)[:, None]
            held = condensed(np.vstack([held, np.hstack([n, n * (x * x).sum(axis=1, keepdims=True), n * x])]), leaves)
        yield pd.DataFrame(held, columns=names)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, size + 2))
        for pdf in batches:
            held = condensed(np.vstack([held, pdf.to_numpy(dtype=float)]), leaves)
        yield pd.DataFrame(held, columns=names)

    now = materialised(counted.select(*flat_columns(vector, size), "_n").mapInPandas(summarise, schema), "summaries")
    total = now.count()
    while total > leaves:
        now = materialised(now.repartition(max(1, -(-total // (TURN * leaves)))).mapInPandas(merge, schema), "summaries")
        total = now.count()
    found = now.orderBy(*names).toPandas().to_numpy(dtype=float).reshape(-1, size + 2)
    n, centres = found[:, 0], found[:, 2:] / found[:, :1]
    merges = merges_of(n, centres)
    rows = dict(enumerate(n))
    for step, (a, b, _, _) in enumerate(merges):
        rows[len(n) + step] = merges[step, 3] = rows[int(a)] + rows[int(b)]
    return Hierarchy(n, centres, np.maximum(found[:, 1] - n * (centres * centres).sum(axis=1), 0.0), merges)


def ward_clusters(df: DataFrame, vector: str, size: int, clusters: int, leaves: int = 2000) -> DataFrame:
    """Complete rows of ``df`` with ``cluster``: that of the leaf nearest to the row, in the hierarchy cut into ``clusters``."""
    tree = ward(df, vector, size, leaves)
    centres, labels = tree.centres, tree.labels(clusters)
    rows = df.where(F.col(vector).isNotNull() & complete(vector))
    rest = [c for c in rows.columns if c != vector]
    sent = rows.select(*rest, *flat_columns(vector, size))
    schema = rows.select(*rest, *flat_columns(vector, size)).schema.add("cluster", "long")

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = flat_matrix(pdf, vector, size)
            near = [squared(x[k : k + 1024], centres).argmin(axis=1) for k in range(0, len(x), 1024)]
            yield pdf.assign(cluster=labels[np.concatenate(near)] if near else np.zeros(0, int))

    made = sent.mapInPandas(label, schema)
    return made.select(*rest, F.array(*[f"_{vector}_{i}" for i in range(size)]).alias(vector), "cluster")
