"""Connected components by alternating large-star and small-star steps over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, ship, written

_BATCH = 1 << 20
#: A node with more than 1 / PART of all edges' ends, and so many at least, is a hub; its rows go to so many keys.
PART, LEAST_HUB, SALTS = 4096, 500, 64


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of about a million edges at a time, the stars that they make: long chains are short before the first shuffle."""
    held: list[np.ndarray] = []
    n = 0
    for b in batches:
        held.append(np.stack([b.column("a").to_numpy(), b.column("b").to_numpy()]))
        n += len(b)
        if n >= _BATCH:
            yield _stars(np.concatenate(held, axis=1))
            held, n = [], 0
    if held:
        yield _stars(np.concatenate(held, axis=1))


def _stars(edges: np.ndarray) -> pa.RecordBatch:
    ids, place = np.unique(edges, return_inverse=True)
    a, b = place.reshape(2, -1)
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"])


def _least(edges: DataFrame) -> DataFrame:
    """For each a: the least of a and its neighbours b. Aggregated on the map side."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large(edges: DataFrame, hubs: list[int]) -> DataFrame:
    """Of each node the neighbours that are greater, with the least of all. The rows of a hub, of which all lead to one row,
    are dealt over ``SALTS`` keys."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both)
    if not hubs:
        found = both.join(least, "a")
    else:
        known = F.broadcast(edges.sparkSession.createDataFrame([(x,) for x in hubs], "a long").withColumn("hub", F.lit(True)))  # <= 2 * PART ids
        salted = both.join(known, "a", "left").withColumn("s", F.when(F.col("hub"), F.pmod(F.xxhash64("b"), F.lit(SALTS))).otherwise(0))
        copies = least.join(known, "a", "left").withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("hub"), F.lit(SALTS - 1)).otherwise(0).cast("long"))))
        found = salted.join(copies.drop("hub"), ["a", "s"])
    return found.where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges lead from a to a lesser b."""
    least = _least(edges)
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _look(edges: DataFrame) -> tuple[bool, list[int]]:
    """Whether all are stars (no end of an edge is the start of one, and no start has two ends), and the hubs: nodes with
    more than a 4096th of all ends, at most twice as many as that."""
    least = max(LEAST_HUB, 2 * edges.count() // PART)
    ends = edges.select("a", F.lit(1).alias("o")).union(edges.select("b", F.lit(0)))
    each = ends.groupBy("a").agg(F.sum("o").alias("o"), F.count(F.lit(1)).alias("n"))
    r = each.agg(F.count_if((F.col("o") > 1) | ((F.col("o") == 1) & (F.col("n") > 1))).alias("open"), F.collect_list(F.when(F.col("n") > least, F.col("a"))).alias("hubs")).first()
    return not r.open, list(r.hubs or [])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that an edge to another id has; component is the least id reachable.

    Edges are first contracted where they lie, a million at a time. Each pair of steps is written to the shared folder,
    so lineage stays short and a lost executor costs one step. The joins are plain sort-merge joins against one row for
    each id; the rows of an id that has a great part of all edges are dealt over many keys. Loops and edges with a null
    are ignored; repeated edges count once.
    """
    spark = edges.sparkSession
    ship(spark)
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a != b")
    now, path = written(ends.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    while True:
        done, hubs = _look(now)
        if done:
            break
        after, new = written(_small(_large(now, hubs)), "edges")
        remove(spark, path)
        now, path = after, new
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
