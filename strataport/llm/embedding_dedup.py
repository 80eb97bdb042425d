"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its ``NEAREST`` nearest reference points (pivots) in order. An inverted list for each pivot has
the vectors that are described by it; two vectors are candidates when they share at least ``SHARED`` pivots, and
candidates are verified by their cosine in double precision. A pair is counted in the list of its lowest shared pivot
alone, so no pair is counted twice and no pairs are emitted: a task returns a count for each vector and a spanning
forest of the links it found.

Equal vectors are collapsed first and carry their number. A list of up to ``BLOCK`` vectors is a task's unit, which
compares them ``TILE`` by ``TILE``: a vector goes to the ``NEAREST`` lists that it is in, once each, as bytes of the width
that the table has. A longer list, of a pivot near which a great part of all vectors lie, is dealt by hash into blocks
and each pair of blocks is a unit, so it is spread out.

Vectors of different dimensions are never compared: each dimension has pivots and lists of its own. All vectors of a
dimension that has no more than ``FEW`` are compared with each other. Pivots grow with the root of the number of vectors,
so lists do too, and neither side outgrows the other; only where ``PIVOT_BYTES`` of pivots are reached (262,144 pivots of
64 dimensions, four billion vectors) do lists alone grow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import ship, written

NEAREST, SHARED = 8, 2
#: The index is fitted on a sample: of each dimension 4 sqrt(vectors) pivots, so many at least, and so many bytes of them
#: at most in all dimensions together as long as each has its least. They are broadcast.
LEAST_PIVOTS, PIVOT_BYTES = 32, 64 << 20
BLOCK, TILE, FEW = 4096, 512, 256


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and numbers of a list column, and which rows can be compared at all: those that aren't null or empty and
    hold no null, infinite or zero-only components."""
    n = len(column)
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    x = values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    ok = (size > 0) & ~np.asarray(column.is_null())
    bad = ~np.isfinite(x)
    if values.null_count:
        bad |= np.asarray(values.is_null())
    count = lambda mark: np.concatenate([[0], np.cumsum(mark)])
    for mark, wanted in ((bad, False), (x != 0, True)):
        total = count(mark)
        ok &= ((total[offsets[1:]] - total[offsets[:-1]]) > 0) == wanted
    return offsets, x, ok if n else np.zeros(0, bool)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of a table as vectors of length one, in double precision; no square under- or overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A vector as its bytes (zeros without a sign) and its dimension; null where it can't be compared."""
    for b in batches:
        offsets, x, ok = _flat(b.column("v"))
        ok &= ~np.asarray(b.column("id").is_null())
        x = x + 0.0 if len(x) else x
        width = x.dtype.itemsize
        data = np.ascontiguousarray(x).view(np.uint8)
        kept = np.repeat(ok, np.diff(offsets) * width)
        lengths = np.where(ok, np.diff(offsets) * width, 0)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        raw = pa.Array.from_buffers(
            pa.binary(), len(ok),
            [
                pa.py_buffer(np.packbits(ok, bitorder="little").tobytes()), pa.py_buffer(ends.tobytes()),
                pa.py_buffer(data[int(offsets[0]) * width : int(offsets[-1]) * width][kept].tobytes())
            ]
        )
        yield pa.RecordBatch.from_arrays([b.column("id"), raw, pa.array(np.diff(offsets).astype(np.int32), mask=~ok)], ["id", "v", "d"])


def _table(column: pa.Array, rows: np.ndarray, d: int, kind: str) -> np.ndarray:
    """Unit vectors of some rows of one dimension."""
    some = column.take(pa.array(rows))
    _, ends, data = some.buffers()
    first = np.frombuffer(ends, np.int32, 1, some.offset * 4)[0] if len(some) else 0
    return unit(np.frombuffer(data, kind, len(rows) * d, int(first)).reshape(len(rows), d)) if len(rows) else np.zeros((0, d))


def describe(vectors: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots of each unit vector, the nearest first."""
    nearest = min(nearest, len(pivots))
    near = vectors @ pivots.T
    some = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest]
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


class _Describe:
    """Adds the cells of the index that each vector is in. ``pivots``: for each dimension the number of the first one, and
    all. A dimension without pivots has ``shared`` cells of its own, with negative numbers, and each of its vectors is in
    all of them."""

    def __init__(self, pivots, nearest: int, shared: int, kind: str):
        self.pivots, self.nearest, self.shared, self.kind = pivots, nearest, shared, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = self.pivots.value
        for b in batches:
            dim = b.column("d").to_numpy()
            many, cells, order = np.zeros(len(dim), np.int64), [], []
            for d in np.unique(dim).tolist():
                rows = np.flatnonzero(dim == d)
                if d in pivots:
                    first, some = pivots[d]
                    found = np.concatenate([first + describe(_table(b.column("v"), rows[i : i + 1024], d, self.kind), some, self.nearest) for i in range(0, len(rows), 1024)])
                else:
                    found = np.tile(-1 - d * self.shared - np.arange(self.shared), (len(rows), 1))
                many[rows] = found.shape[1]
                cells.append(found.astype(np.int32).ravel())
                order.append(np.repeat(rows, found.shape[1]))
            flat = np.concatenate(cells)[np.argsort(np.concatenate(order), kind="stable")] if cells else np.zeros(0, np.int32)
            perm = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns, perm], [*b.schema.names, "perm"])


def count_links(left: tuple, right: tuple | None, pivot: int, shared: int, cosine: float):
    """Links between two blocks of a pivot's list, or within one: places of the pairs that are linked and belong to this
    pivot. A block: permutations and unit vectors."""
    (p, v), (q, w) = left, right or left
    names, place = np.unique(np.concatenate([p.ravel(), q.ravel()]), return_inverse=True)

    def matrix(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        m = np.zeros((len(x), len(names)), np.float32)
        np.put_along_axis(m, at.reshape(x.shape), 1, 1)
        return m

    m, n = matrix(p, place[: p.size]), matrix(q, place[p.size :])
    low = int(np.searchsorted(names, pivot))
    candidate = (m @ n.T >= shared) & (m[:, :low] @ n[:, :low].T == 0)
    if right is None:
        candidate &= np.arange(len(p))[:, None] < np.arange(len(q))[None, :]
    return np.nonzero(candidate & (v @ w.T >= cosine))


class _Cells:
    """Units arrive together: a pivot's list or two blocks of it."""

    def __init__(self, shared: int, cosine: float, kind: str):
        self.shared, self.cosine, self.kind = shared, cosine, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not len(b):
                continue
            keys = np.stack([b.column(c).to_numpy() for c in ("pivot", "x", "y")])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(b)]):
                key = tuple(keys[:, i].tolist())
                if key != last and held:
                    yield from self._done(last, held)
                    held = []
                held.append(b.slice(i, j - i))
                last = key
        if held:
            yield from self._done(last, held)

    def _done(self, key, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pa.Table.from_batches(held).combine_chunks()
        if len(b) < 2:
            return
        pivot, x, y = key
        column = lambda c: b.column(c).combine_chunks() if isinstance(b.column(c), pa.ChunkedArray) else b.column(c)
        ids, many, block, d = (column(c).to_numpy() for c in ("id", "many", "block", "d"))
        perm = column("perm").flatten().to_numpy().reshape(len(ids), -1)
        v = _table(column("v"), np.arange(len(ids)), int(d[0]), self.kind)
        if x == y:
            sides = [(p, q) for p in self._tiles(np.arange(len(ids))) for q in self._tiles(np.arange(len(ids))) if p[0] <= q[0]]
        else:
            sides = [(p, q) for p in self._tiles(np.flatnonzero(block == x)) for q in self._tiles(np.flatnonzero(block == y))]
        found = []
        for p, q in sides:
            same = x == y and p[0] == q[0]
            i, j = count_links((perm[p], v[p]), None if same else (perm[q], v[q]), pivot, self.shared, self.cosine)
            found.append((p[i], q[j]))
        i, j = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        if not len(i):
            return
        links = np.bincount(i, many[j], len(ids)) + np.bincount(j, many[i], len(ids))
        root = np.arange(len(ids))  # the least of what each row is linked to, until nothing changes: a forest of stars
        while True:
            least = root.copy()
            np.minimum.at(least, i, root[j])
            np.minimum.at(least, j, root[i])
            least = least[least]
            if (least == root).all():
                break
            root = least
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[root[some]])], ["id", "links", "root"])

    @staticmethod
    def _tiles(rows: np.ndarray) -> list[np.ndarray]:
        return [rows[i : i + TILE] for i in range(0, len(rows), TILE)]


def _drawn(classes: DataFrame, pivots: int | None, seed: int, kind: str) -> dict[int, tuple[int, np.ndarray]]:
    """Pivots of each dimension of more than ``FEW`` vectors: the number of the first one, and all."""
    dims = {r.d: r["count"] for r in classes.groupBy("d").count().where(F.col("count") > FEW).collect()}
    if not dims:
        return {}
    most = {d: pivots or max(LEAST_PIVOTS, math.ceil(4 * math.sqrt(n))) for d, n in dims.items()}
    size = sum(8 * d * m for d, m in most.items())
    if not pivots and size > PIVOT_BYTES:
        most = {d: max(LEAST_PIVOTS, m * PIVOT_BYTES // size) for d, m in most.items()}
    # those of least luck, of somewhat more than are needed
    share = F.create_map(*[F.lit(x) for d, m in most.items() for x in (d, (m + 6 * math.sqrt(m) + 8) / dims[d])])
    luck = F.xxhash64(F.lit(seed), "v")
    some = classes.where(luck.cast("double") / 2.0**64 + 0.5 < F.coalesce(share[F.col("d")], F.lit(0.0))).select(luck.alias("luck"), "d", "v").collect()
    by_dim: dict[int, list] = {}
    for r in sorted(some, key=lambda r: (r.luck, bytes(r.v))):
        by_dim.setdefault(r.d, []).append(np.frombuffer(r.v, kind))
    out, first = {}, 0
    for d, found in sorted(by_dim.items()):
        out[d] = first, unit(np.stack(found[: most[d]]))
        first += len(out[d][1])
    return out


def near_vectors(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, nearest: int = NEAREST, shared: int = SHARED, pivots: int | None = None, seed: int = 1, block_rows: int = BLOCK,
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row: other rows whose vectors' cosine is ``cosine`` or more, the
    least id reachable by such links, and whether that is the row's own id.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows with a null
    id (component null, kept false). Vectors of different dimensions don't link. Equal vectors link with each other.
    Rows of one id are one vertex. Recall against brute force is measured in the tests; no pair under ``cosine`` is
    linked. An empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    ship(spark)
    single = dict(embeddings.dtypes)[vector] == "array<float>"
    kind = "<f4" if single else "<f8"
    raw = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>" if single else "array<double>").alias("v"))
    rows = raw.mapInArrow(_raw, "id long, v binary, d int").withColumns({"h1": F.xxhash64("v", "d"), "h2": F.xxhash64(F.lit("second"), "v")})
    valid = rows.where("v is not null")
    classes, _ = written(valid.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("v").alias("v"), F.first("d").alias("d")), "vectors")
    if classes.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    drawn = _drawn(classes, pivots, seed, kind)
    sent = spark.sparkContext.broadcast(drawn)  # <= PIVOT_BYTES, or LEAST_PIVOTS of each dimension
    named = classes.select(F.col("rep").alias("id"), "many", "v", "d")
    index, _ = written(named.mapInArrow(_Describe(sent, nearest, shared, kind), "id long, many long, v binary, d int, perm array<int>"), "permutations")
    posted = index.select("*", F.explode("perm").alias("pivot"))
    long = posted.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts")).where("parts > 1")  # at most a row for each pivot, of which PIVOT_BYTES are the bound
    posted = posted.join(F.broadcast(long), "pivot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    posted = posted.withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    cells = posted.select("*", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("other"))
    cells = cells.select("pivot", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "many", "perm", "v", "d", "block")
    dealt = cells.repartition("pivot", "x", "y").sortWithinPartitions("pivot", "x", "y", "id")
    linked, _ = written(dealt.mapInArrow(_Cells(shared, cosine, kind), "id long, links long, root long"), "vector-links")
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"))
    keyed = valid.select("id", "h1", "h2")
    member = keyed.join(classes.select("h1", "h2", "rep", "many"), ["h1", "h2"]).select("id", "rep", "many")
    label = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")).union(member.where("id != rep").select("id", "rep")))
    by_class = classes.select("h1", "h2", "rep", "many").join(counts, F.col("rep") == counts.id, "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links")
    )
    out = rows.select("id", "h1", "h2", F.col("v").isNotNull().alias("ok")).join(by_class, ["h1", "h2"], "left").join(label, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.when(
            F.col("ok"), F.coalesce("links", F.lit(0))
        ).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
