"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence.

Documents are rows of a 0/1 matrix, word shingles its columns; the product with its transpose has the overlap of every
two documents. Only blocks of it that can hold a pair at the threshold are ever formed:

1. Rows with the same set of shingles are one row (a class), whose id is the least.
2. Size-derived bound on columns: two sets with Jaccard t or more share a shingle among the first n - ceil(t n) + 1 of
   each, in any common order. The order is from rare to frequent, by a fixed-size count sketch of the whole corpus, so
   that passages which many documents share seldom come among the first.
3. Lists of at most ``SHORT`` documents give pairs whose sizes allow t, and a pair's shared first shingles are counted:
   two sizes demand so many, and pairs with fewer are discarded (what longer lists may add to them is granted). Longer
   lists aren't spelled out as pairs; their documents are chained by size. The components of all this hold every
   pair that can link. A component is dealt by hash into blocks of about ``BLOCK`` rows, and a few leaders go to all its
   blocks. Each block is one product, and its links make subcomponents: a group of copies, however large, is one by now,
   at one product a block.
4. What is left are pairs of different subcomponents. Lists of at most ``SHORT`` documents name the pairs of blocks that
   their pairs fall in; longer lists, which aren't spelled out as pairs, name the pairs of all blocks in which they have
   documents of different subcomponents. Blocks now follow the subcomponents; each named pair of blocks is a product.

In a product, shingles are taken a slab of columns at a time, overlaps accumulate, and a pair whose overlap can no longer
reach what its two sizes demand is discarded. It returns a spanning forest of its links, not the pairs.

Sets are of 64-bit hashes. Texts are read again rather than storing the sets; for the products a bit map of fixed size
sieves out most texts that are in no block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import mark, release, ship, written

WORDS, PERCENT = 5, 75
BLOCK, SHORT, SLAB, LEADERS, SALTS = 256, 32, 4096, 8, 16
#: Counters of the sketch: 16 MB. Its noise is shingles / counters.
SKETCH_BITS = 22
CHUNKS = 64
#: Bits of the map by which texts are sieved: 1 MB.
MARK_BITS = 23


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> Iterator[np.ndarray]:
    """Of each row the distinct hashes of its runs of k words, ascending; of fewer words, the whole sequence."""
    for i, j in K.groups(offsets):
        w = K.words(raw, offsets[i : j + 1], K.SPACED)
        g = K.grams(w.hash, k)
        for lo, hi in zip(w.first[:-1], w.first[1:]):
            if hi - lo >= k:
                s = np.sort(g[lo : hi - k + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                yield K.grams(w.hash[lo:hi], hi - lo) if hi > lo else np.zeros(0, K.U)


def required(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of n and m with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _slot(s: np.ndarray, bits: int) -> np.ndarray:
    return (K.mixed(s) >> K.U(64 - bits)).astype(np.int64)


def _hashes(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set."""
    return tuple(int(K.mixed(x).sum(dtype=K.U).view(np.int64)) for x in (s * K.STEP, s ^ K.STEP))


class _Sketch:
    """A row for each document (n and two hashes of its set) and, at a task's end, one for each chunk of its counters."""

    def __init__(self, k: int, bits: int):
        self.k, self.bits = k, bits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << self.bits, np.uint32)
        names = ["id", "n", "h1", "h2", "chunk", "counts"]
        for b in batches:
            n, h = [], []
            for s in shingle_sets(*K.buffers(b.column("text")), self.k):
                np.add.at(count, _slot(s, self.bits), 1)
                n.append(len(s))
                h.append(_hashes(s))
            h1, h2 = (pa.array([x[i] for x in h], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), h1, h2, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        none = pa.nulls(1, pa.int64())
        for i, c in enumerate(np.split(count, CHUNKS)):
            few = np.minimum(c, 0xFFFF).astype(np.uint16)  # the order needs no more from one task
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([i], pa.int32()), pa.array([few.tobytes()], pa.binary())], names)


class _Total:
    """Counters added up, a chunk at a time; they stop at the largest 32-bit number. ``kind``: of the numbers that come."""

    def __init__(self, kind: str):
        self.kind = kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                total[i] = np.minimum(total.get(i, 0) + np.frombuffer(c, self.kind).astype(np.int64), 0xFFFFFFFF)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.astype(np.uint32).tobytes() for c in total.values()], pa.binary())], ["chunk", "counts"])


def in_two_steps(chunks: DataFrame, first, last) -> DataFrame:
    """Chunks that every task gives, merged by groups of tasks and then all: no reducer reads a chunk of every task. How
    many groups there are follows from the session's shuffle partitions."""
    spark, schema = chunks.sparkSession, chunks.schema
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // CHUNKS)
    some = chunks.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups))).repartition("chunk", "g").drop("g").mapInArrow(first, schema) if groups > 1 else None
    return (chunks if some is None else some).repartition("chunk").mapInArrow(first if some is None else last, schema)


class _First:
    """The first shingles of each document in the order of the sketch."""

    def __init__(self, k: int, percent: int, sketch):
        self.k, self.percent, self.sketch = k, percent, sketch

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = self.sketch.value
        bits = len(sketch).bit_length() - 1
        for b in batches:
            n, h, first = [], [], []
            for s in shingle_sets(*K.buffers(b.column("text")), self.k):
                n.append(len(s))
                h.append(_hashes(s))
                p = len(s) - -(-self.percent * len(s) // 100) + 1 if len(s) else 0
                if p < len(s):
                    s = s[np.lexsort((s, sketch[_slot(s, bits)]))[:p]]
                first.append(s.tobytes())
            h1, h2 = (pa.array([x[i] for x in h], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), h1, h2, pa.array(first, pa.binary())], ["id", "n", "h1", "h2", "first"])


class _Marks:
    """A bit map of fixed size with the hashes of some ids, in chunks."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << MARK_BITS, bool)
        for b in batches:
            mark[_slot(b.column("id").to_numpy().astype(K.U), MARK_BITS)] = True
        for i, c in enumerate(np.split(np.packbits(mark), CHUNKS)):
            if c.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([c.tobytes()], pa.binary())], ["chunk", "counts"])


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' bit maps, one on another."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, c in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
            total[i] = total.get(i, np.uint8(0)) | np.frombuffer(c, np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["chunk", "counts"])


class _Sieve:
    """Rows whose id may be among those marked: spares the shuffle most other texts."""

    def __init__(self, marks):
        self.marks = marks

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.unpackbits(self.marks.value).astype(bool)
        for b in batches:
            ids = b.column("id")
            hit = mark[_slot(ids.fill_null(0).to_numpy().astype(K.U), MARK_BITS)]
            yield b.filter(pa.array(hit))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        many = np.array([len(x) // 8 for x in b.column("first").to_pylist()], np.int64)
        h = np.frombuffer(b"".join(b.column("first").to_pylist()), np.int64)
        take = np.repeat(np.arange(len(many)), many)
        yield pa.RecordBatch.from_arrays([pa.array(h), *(b.column(c).take(pa.array(take)) for c in ("id", "n"))], ["h", "id", "n"])


def least_shared(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Of how many first shingles at least two linked sets of n and m share: all but n - overlap of the set's own whose
    first ones end earlier in the order."""
    alpha = required(n, m, percent)
    first = lambda k: k - -(-percent * k // 100) + 1
    return np.maximum(np.minimum(first(n) - n + alpha, first(m) - m + alpha), 1)


class _Chains:
    """Lists of one shingle arrive together, by size. ``kind`` 0: neighbours in a long list, 1: a pair of short lists, in
    how many (``c``) of how many it must be (``need``), 2: a document of a long list (b: the shingle)."""

    def __init__(self, percent: int, short: int):
        self.percent, self.short = percent, short

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        long_on = None  # the shingle of a long list of which a part has been sent
        for b in batches:
            new = [b.column(c).to_numpy() for c in ("h", "id", "n")]
            h, i, n = (np.concatenate(x) for x in zip(held, new))
            cut = int(np.searchsorted(h, h[-1], "left")) if len(h) else 0
            if len(h) - cut > 4 * self.short:  # a long list is sent as it comes
                yield from self._send(h, i, n, long_on)
                long_on = h[-1]
                held = [x[-1:] for x in (h, i, n)]
            else:
                yield from self._send(h[:cut], i[:cut], n[:cut], long_on)
                held = [x[cut:] for x in (h, i, n)]
        yield from self._send(*held, long_on)

    def _send(self, h, i, n, long_on) -> Iterator[pa.RecordBatch]:
        if not len(h):
            return
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        size = np.diff(edge)
        big = (size > self.short) | (h[edge[:-1]] == long_on if long_on is not None else False)
        row_big = np.repeat(big, size)
        near = (h[1:] == h[:-1]) & row_big[1:] & (100 * n[:-1] >= self.percent * n[1:])  # by size: if neighbours can't link, none across can
        none = np.zeros(0, np.int64)
        a, b, need = [none], [none], [none]
        of = np.repeat(size, size)
        for d in range(1, min(self.short, int(size[~big].max(initial=0)))):
            ok = np.flatnonzero((of[:-d] > d) & ~row_big[:-d] & (h[d:] == h[:-d]) & (100 * n[:-d] >= self.percent * n[d:]))
            a.append(i[ok])
            b.append(i[ok + d])
            need.append(least_shared(n[ok], n[ok + d], self.percent))
        a, b, need = (np.concatenate(x) for x in (a, b, need))
        order = np.lexsort((b, a))
        a, b, need = a[order], b[order], need[order]
        start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else none
        count = np.diff(np.concatenate([start, [len(a)]]))
        yield self._rows(1, a[start], b[start], need[start], count)
        yield self._rows(0, i[:-1][near], i[1:][near], np.ones(int(near.sum()), np.int64), np.ones(int(near.sum()), np.int64))
        yield self._rows(2, i[row_big], h[row_big], np.ones(int(row_big.sum()), np.int64), np.ones(int(row_big.sum()), np.int64))

    def _rows(self, kind: int, a, b, need, count) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(need.astype(np.int32)), pa.array(count.astype(np.int32))],
            ["kind", "a", "b", "need", "c"]
        )


def product(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning forest of the links among some documents, by accumulating overlaps a slab of columns at a time."""
    size = np.array([len(s) for s in sets], np.int64)
    need = required(size[:, None], size[None, :], percent)
    alive = (np.minimum(size[:, None], size[None, :]) >= need) & (np.arange(len(sets))[:, None] < np.arange(len(sets))[None, :])
    column, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    new = np.concatenate([[True], column[1:] != column[:-1]])
    start = np.flatnonzero(new)
    shared = np.repeat(np.diff(np.concatenate([start, [len(column)]])) > 1, np.diff(np.concatenate([start, [len(column)]])))
    rest = np.bincount(row[shared], minlength=len(sets))  # shingles to come that another document has
    number = np.cumsum(new[shared]) - 1
    row = row[shared]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, SLAB):
        i, j = np.searchsorted(number, [lo, lo + SLAB])
        use = np.unique(row[i:j])
        use = use[alive[use].any(axis=1) | alive[:, use].any(axis=0)]
        if len(use) > 1:
            place = np.full(len(sets), -1)
            place[use] = np.arange(len(use))
            ok = place[row[i:j]] >= 0
            slab = np.zeros((len(use), SLAB), np.float32)
            slab[place[row[i:j][ok]], number[i:j][ok] - lo] = 1
            overlap[np.ix_(use, use)] += slab @ slab.T
        rest = rest - np.bincount(row[i:j], minlength=len(sets))
        alive &= overlap + np.minimum(rest[:, None], rest[None, :]) >= need
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(alive & (overlap >= need))):
        p, q = find(int(x)), find(int(y))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(ids[x]), int(ids[y])))
    return out


class _Products:
    """Texts arrive by cell; a set of hashes takes more room than its text, so it is made here."""

    def __init__(self, k: int, percent: int):
        self.k, self.percent = k, percent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, sets = None, [], []
        for b in batches:
            out = []
            for c, i, s in zip(b.column("cell").to_pylist(), b.column("id").to_pylist(), shingle_sets(*K.buffers(b.column("text")), self.k)):
                if c != cell:
                    out += self._done(ids, sets)
                    cell, ids, sets = c, [], []
                ids.append(i)
                sets.append(s)
            yield _pairs(out)
        yield _pairs(self._done(ids, sets))

    def _done(self, ids, sets):
        return product(np.array(ids), sets, self.percent) if len(ids) > 1 else []


def _pairs(p: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(p, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def _compare(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Links found in the products of some cells, of which ``members`` has (id, cells)."""
    spark = docs.sparkSession
    members, _ = written(members, "members")
    marks = in_two_steps(members.select("id").mapInArrow(_Marks(), "chunk int, counts binary"), _either, _either)
    got = {r.chunk: bytes(r.counts) for r in marks.collect()}
    size = (1 << MARK_BITS) // 8 // CHUNKS
    sieve = _Sieve(spark.sparkContext.broadcast(np.frombuffer(b"".join(got.get(i, bytes(size)) for i in range(CHUNKS)), np.uint8)))  # of fixed size
    texts = docs.mapInArrow(sieve, "id long, text string").join(members, "id").select(F.explode("cells").alias("cell"), "id", "text")
    return texts.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(_Products(k, percent), "a long, b long")


def join_ngrams(
    documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS,
    block_rows: int = BLOCK, short: int = SHORT
) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row; documents link when 100 * intersection >= percent * union of
    their sets, and component_id is the least id reachable by links, itself included.

    Null or empty texts have no shingles and link with nothing. A null id is in no component and links with nothing. Rows
    of one id are one vertex: its rows' links add up. Only the id and text columns are read. An empty table gives an
    empty result.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    since = mark()
    seen, shingles = written(docs.mapInArrow(_Sketch(k, sketch_bits), "id long, n long, h1 long, h2 long, chunk int, counts binary"), "shingles")
    counts = in_two_steps(seen.where("chunk is not null").select("chunk", "counts"), _Total("<u2"), _Total("<u4"))
    sketch = np.zeros((CHUNKS, (1 << sketch_bits) // CHUNKS), np.uint32)
    for r in counts.collect():
        sketch[r.chunk] = np.frombuffer(r.counts, np.uint32)
    sent = spark.sparkContext.broadcast(sketch.ravel())  # of fixed size
    del sketch
    rows = seen.where("chunk is null").select("id", "n", "h1", "h2")
    some = rows.where("n > 0 and id is not null")
    first = docs.mapInArrow(_First(k, percent, sent), "id long, n long, h1 long, h2 long, first binary").where("n > 0 and id is not null")
    reps = first.groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "first")).alias("r")).select("r.id", "n", "r.first")
    posted = reps.mapInArrow(_postings, "h long, id long, n long")
    chains, _ = written(posted.repartition("h").sortWithinPartitions("h", "n", "id").mapInArrow(_Chains(percent, short), "kind tinyint, a long, b long, need int, c int"), "chains")
    in_long = chains.where("kind = 2").select("a", "b").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("l"))
    counted = chains.where("kind = 1").groupBy("a", "b").agg(F.max("need").alias("need"), F.sum("c").alias("c"))
    both = counted.where("c < need").join(in_long.withColumnRenamed("l", "la"), "a").join(
        in_long.select(F.col("a").alias("b"), F.col("l").alias("lb")), "b"
    ).where("c + least(la, lb) >= need")
    pairs, _ = written(counted.where("c >= need").select("a", "b").union(both.select("a", "b")), "pairs")
    group = components(pairs.union(chains.where("kind = 0").select("a", "b")))
    sizes = group.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    luck = F.xxhash64("id")
    blocks, _ = written(group.join(sizes, "component").select("id", "component", "size", F.ceil(F.col("size") / block_rows).alias("parts")), "blocks")
    cell = lambda i: F.xxhash64("component", i.cast("long"))
    leads = (F.col("parts") > 1) & (F.pmod(F.xxhash64(F.lit("lead"), "id"), F.greatest(F.floor(F.col("size") / LEADERS), F.lit(1))) == 0)
    first_cells = F.when(leads, F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), cell)).otherwise(F.array(cell(F.pmod(luck, F.col("parts")))))
    near, _ = written(_compare(docs, blocks.select("id", first_cells.alias("cells")), k, percent), "links")
    sub = components(near).withColumnRenamed("component", "sub")
    of = blocks.join(sub, "id", "left").withColumn("sub", F.coalesce("sub", "id"))
    of = of.join(of.groupBy("sub").agg(F.count(F.lit(1)).alias("many")), "sub")
    large = F.col("many") >= block_rows // 2
    block = F.when(
        large, F.xxhash64(F.lit("large"), "sub", F.pmod(luck, F.ceil(F.col("many") / block_rows)))
    ).otherwise(F.xxhash64(F.lit("small"), "component", F.pmod(luck, F.col("parts"))))
    state, _ = written(of.select("id", "component", "sub", block.alias("block"), large.alias("large")), "states")
    left, right = (state.select(F.col("id").alias(s), F.col("sub").alias(f"s{s}"), F.col("block").alias(f"b{s}")) for s in "ab")
    brief = pairs.join(left, "a").join(right, "b").where("sa != sb").select(F.least("ba", "bb").alias("x"), F.greatest("ba", "bb").alias("y"))
    listed = chains.where("kind = 2").select(F.col("a").alias("id"), F.col("b").alias("h")).distinct().join(state, "id")
    mixed = listed.groupBy("h", "component").agg(F.min("sub").alias("low"), F.max("sub").alias("high")).where("low != high").select("h", "component")
    lists = listed.select("h", "component", "block", F.when(F.col("large"), F.col("sub")).alias("sub")).distinct().join(mixed, ["h", "component"])
    together = F.coalesce(F.col("l.sub") == F.col("r.sub"), F.lit(False))
    left_lists = lists.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a hot list's pairs of blocks are made in many tasks
    right_lists = lists.withColumn("s", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    same = (F.col("l.h") == F.col("r.h")) & (F.col("l.component") == F.col("r.component")) & (F.col("l.s") == F.col("r.s"))
    across = left_lists.alias("l").join(right_lists.alias("r"), same & (F.col("l.block") <= F.col("r.block")) & ~together)
    named = brief.union(across.select(F.col("l.block").alias("x"), F.col("r.block").alias("y"))).distinct()
    apart = named.where("x != y")
    alone = named.where("x = y").join(apart.select("x").union(apart.select(F.col("y").alias("x"))).distinct(), "x", "left_anti").select("x", "y")
    sides = apart.union(alone).select(F.xxhash64("x", "y").alias("cell"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    far = _compare(docs, state.join(sides, "block").groupBy("id").agg(F.collect_list("cell").alias("cells")), k, percent)
    classes = some.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("many"))
    copies = some.join(classes.where("many > 1").drop("many"), ["h1", "h2", "n"]).where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found, links = written(near.union(far).union(copies), "links")
    release(spark, since, (shingles, links))  # all that the links were made of
    label = components(found)
    return rows.select("id", "n").join(label, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))

