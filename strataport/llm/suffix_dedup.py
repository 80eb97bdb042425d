"""Repeated passages by sparse suffix arrays.

Of every text only the suffixes at minimiser positions are retained: the word 8-gram with the least hash of each 30
consecutive ones, so the content alone selects them, and two texts that share a passage of 50 words share a retained
suffix within its first 30 words; from there at least 21 words agree. That many words' hash is the suffix's key.

1. Keys of all retained suffixes are aggregated to those of more than one document, which go into a bit map of fixed
   size. Suffixes whose key hits it are kept with their next 50 and last 29 words (as 32-bit hashes).
2. These are range-partitioned and sorted by key, next words and document: stretches of the sparse suffix array. A
   passage that a third of all documents have fills several partitions.
3. Neighbours in that order are compared, and matches extended to the right and to the left; 50 words or more make a
   repeat. Where more than two suffixes have a key, a partner that agrees less to the right and more to the left may not
   stand next to its suffix: there the 50-grams around the suffixes of a key are compared too, for each of the 30 places
   where one can start.
4. A key that a partition's first or last row has may go on in the next partition: of its 50-grams one row for each
   partition goes to an aggregation over all partitions: its least document there, and whether there are others.
5. A document's spans are merged where they are found, before they leave the task, and again once they are together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .ngram_join import CHUNKS, _either, in_two_steps
from .shared import ship, written

LEAST, GRAM, SPAN = 50, 8, 30
#: Bits of the map of repeated keys: 8 MB.
KEY_BITS = 26
#: Kinds of rows that a stretch of the suffix array gives.
ANY, GRAMS, LATER = 0, 1, 2


def retained(w: K.Words, least: int, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of retained suffixes that have least - span + 1 words or more to the end of their row, and their keys."""
    key_words = least - span + 1
    g = K.grams(w.hash, gram)
    n = len(g) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, K.U)
    best = _sliding(np.minimum, g, span)
    last = w.last()
    best[np.arange(n) + span + gram - 1 > last[:n]] = 0  # a window of two rows
    none = np.zeros(span - 1, K.U)
    chosen = g == _sliding(np.maximum, np.concatenate([none, best, none]), span)  # the least of some window that it is in
    place = np.flatnonzero(chosen)
    keys = K.grams(w.hash, key_words)
    place = place[place < len(keys)]
    place = place[place + key_words <= last[place]]
    return place, keys[place]


def _sliding(what, x: np.ndarray, span: int) -> np.ndarray:
    """Least or greatest of each ``span`` consecutive numbers."""
    n, width, y = len(x) - span + 1, 1, x
    while 2 * width <= span:
        y = what(y[: len(y) - width], y[width:])
        width *= 2
    return what(y[:n], y[span - width : span - width + n])


class _Keys:
    def __init__(self, *args: int):
        self.args = args

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = K.buffers(b.column("text"))
            for i, j in K.groups(offsets):
                w = K.words(raw, offsets[i : j + 1], K.ALNUM)
                at, keys = retained(w, *self.args)
                row = np.searchsorted(w.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column("id").take(pa.array(i + row))], ["key", "id"])


class _Marks:
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << KEY_BITS, bool)
        for b in batches:
            mark[_slot(b.column("key").to_numpy().view(K.U))] = True
        for i, c in enumerate(np.split(np.packbits(mark), CHUNKS)):
            if c.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([c.tobytes()], pa.binary())], ["chunk", "counts"])


def _slot(keys: np.ndarray) -> np.ndarray:
    return (K.mixed(keys) >> K.U(64 - KEY_BITS)).astype(np.int64)


class _Suffixes:
    """Retained suffixes whose key may be repeated, with the words around them."""

    def __init__(self, marks, *args: int):
        self.marks, self.args = marks, args

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, _, span = self.args
        packed = self.marks.value
        for b in batches:
            raw, offsets = K.buffers(b.column("text"))
            for i, j in K.groups(offsets):
                w = K.words(raw, offsets[i : j + 1], K.ALNUM)
                at, keys = retained(w, *self.args)
                slot = _slot(keys)
                hit = (packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0
                at, keys = at[hit], keys[hit]
                row = np.searchsorted(w.first, at, "right") - 1
                near = (w.hash >> K.U(32)).astype(">u4")
                right = np.minimum(w.first[row + 1] - at, least)
                left = np.minimum(at - w.first[row], span - 1)
                # positions outside the row repeat its ends; ``right`` and ``left`` say how many count
                next_ = near[np.minimum(at[:, None] + np.arange(least), len(w) - 1)] if len(at) else np.zeros((0, least), ">u4")
                back = near[np.maximum(at[:, None] - 1 - np.arange(span - 1), 0)] if len(at) else np.zeros((0, span - 1), ">u4")
                next_[np.arange(least) >= right[:, None]] = 0
                back[np.arange(span - 1) >= left[:, None]] = 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.view(np.int64)), _fixed(next_), _fixed(back), pa.array(right.astype(np.int16)), pa.array(left.astype(np.int16)),
                        b.column("id").take(pa.array(i + row)), pa.array((at - w.first[row]).astype(np.int64))
                    ],
                    ["key", "next", "back", "right", "left", "id", "at"],
                )


def _fixed(x: np.ndarray) -> pa.Array:
    n, size = len(x), x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def merged(ids: np.ndarray, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each id in order, those that overlap or touch made one."""
    if not len(ids):
        return ids, first, past
    order = np.lexsort((first, ids))
    ids, first, past = ids[order], first[order], past[order]
    rank = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]))
    reach = np.maximum.accumulate(rank * (past.max() + 1) + past) - rank * (past.max() + 1)  # within each id
    new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (first[1:] > reach[:-1])]))
    return ids[new], first[new], reach[np.concatenate([new[1:], [len(ids)]]) - 1]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each id, from its spans of both kinds in the order of ids; of an id that goes on in the next batch only
    merged spans are held."""
    held: list[tuple] = []  # ids, first and past of each kind
    for b in batches:
        if not len(b):
            continue
        kind, *rows = (b.column(c).to_numpy() for c in ("kind", "id", "first", "past"))
        new = [merged(*(np.concatenate([h, x[kind == k]]) for h, x in zip(old, rows))) for k, old in zip((ANY, LATER), held or [(rows[0][:0],) * 3] * 2)]
        last = rows[0][-1]
        yield _rows(*(tuple(x[ids != last] for x in (ids, *rest)) for ids, *rest in new))
        held = [tuple(x[ids == last] for x in (ids, *rest)) for ids, *rest in new]
    if held:
        yield _rows(*held)


def _rows(every: tuple, later: tuple) -> pa.RecordBatch:
    ids, top = np.unique(every[0], return_index=True)
    if len(ids):
        words = np.add.reduceat(every[2] - every[1], top)
    else:
        words = ids

    def spans(of: tuple) -> pa.Array:
        ends = np.concatenate([np.searchsorted(of[0], ids), [len(of[0])]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(of[1]), pa.array(of[2])], ["first", "past"]))

    n = np.diff(np.concatenate([top, [len(every[0])]])).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(words), spans(every), spans(later)], ["id", "n_spans", "n_repeated", "spans", "later_spans"])


class _Compare:
    """Rows of a partition in order: repeats (kind ANY: id, first and past-the-last word, merged), those of them that an
    earlier document has (kind LATER), and 50-grams of keys that other partitions may have (kind GRAMS: id, hash, first
    words, whether other documents of these rows have it)."""

    def __init__(self, least: int, span: int, rows: int = 20_000):
        self.least, self.span, self.rows = least, span, rows

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        opened = None  # a key of which earlier rows have gone: of the partition's start, or of a very large group
        for b in batches:
            if not len(b):
                continue
            new = self._read(b)
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if opened is None:
                opened = held[0][0]
            key = held[0]
            cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if len(key) - cut > self.rows:
                yield self._done(held, opened, key[-1])
                opened, held = key[-1], [x[-1:] for x in held]
            elif cut > self.rows:
                yield self._done([x[:cut] for x in held], opened, None)
                held = [x[cut:] for x in held]
        if held is not None:
            yield self._done(held, opened, held[0][-1])

    def _read(self, b: pa.RecordBatch) -> list[np.ndarray]:
        n = len(b)
        ints = [b.column(c).to_numpy() for c in ("key", "right", "left", "id", "at")]
        texts = [np.frombuffer(b"".join(b.column(c).to_pylist()), ">u4").reshape(n, -1).astype(np.uint32) for c in ("next", "back")]
        return [ints[0], *texts, *(x.astype(np.int64) for x in ints[1:])]

    def _done(self, rows: list, opened, going_on) -> pa.RecordBatch:
        key, next_, back, right, left, ids, at = rows
        i, first, past, flag = [], [], [], []

        def put(i_, first_, past_, flag_) -> None:
            i.append(i_)
            first.append(first_)
            past.append(past_)
            flag.append(flag_)

        near = np.flatnonzero((key[1:] == key[:-1]) & (ids[1:] != ids[:-1]))
        reach = _agree(next_[near], next_[near + 1], np.minimum(right[near], right[near + 1]))
        before = _agree(back[near], back[near + 1], np.minimum(left[near], left[near + 1]))
        ok = reach + before >= self.least
        near, reach, before = near[ok], reach[ok], before[ok]
        for me, other in ((near, near + 1), (near + 1, near)):
            put(ids[me], at[me] - before, at[me] + reach, ids[other] < ids[me])
        loose = (key == opened) | (key == going_on) if going_on is not None else key == opened
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        open_ = np.diff(edge) > 2  # in a group of two the neighbours are all there is
        whole = np.concatenate([back[:, ::-1], next_], axis=1)
        sent = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_())], ["id", "h", "firsts", "others"])
        for rest, edge_rows in ((np.flatnonzero(open_[group] & ~loose), False), (np.flatnonzero(loose), True)):
            h, who, start = self._grams(rest, whole, left, right, ids, at)
            if not len(h):
                continue
            top = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.diff(np.concatenate([top, [len(h)]]))
            low, high = np.repeat(who[top], size), np.repeat(who[top + size - 1], size)
            two = low < high
            put(who[two], start[two], start[two] + self.least, (who > low)[two])
            if edge_rows:  # of each 50-gram its least document stands for all of this partition
                one = who == low
                many = np.add.reduceat(one.astype(np.int64), top)
                places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(start[one]))
                sent = pa.RecordBatch.from_arrays([pa.array(who[top]), pa.array(h[top].view(np.int64)), places, pa.array(two[top])], ["id", "h", "firsts", "others"])
        i, first, past, flag = (np.concatenate(x) for x in (i, first, past, flag))
        spans = [(kind, *merged(i[some], first[some], past[some])) for kind, some in ((ANY, slice(None)), (LATER, flag))]
        kinds, i, first, past = (np.concatenate(x) for x in zip(*((np.full(len(i), kind), i, first, past) for kind, i, first, past in spans)))
        n0, n1 = len(i), len(sent)
        empty = np.zeros(n1, np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([kinds, empty + GRAMS]).astype(np.int8)),
                pa.array(np.concatenate([i, sent.column("id").to_numpy()])),
                pa.array(np.concatenate([first, empty])),
                pa.array(np.concatenate([past, empty])),
                pa.array(np.concatenate([np.zeros(n0, np.int64), sent.column("h").to_numpy()])),
                pa.concat_arrays([pa.nulls(n0, pa.list_(pa.int64())), sent.column("firsts")]),
                pa.concat_arrays([pa.nulls(n0, pa.bool_()), sent.column("others")]),
            ],
            ["kind", "id", "first", "past", "h", "firsts", "others"],
        )

    def _grams(self, rows, whole, left, right, ids, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document and first word of each 50-gram around some suffixes, once each, by these."""
        h, who, start = [np.zeros(0, K.U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for o in range(self.span):
            some = rows[(left[rows] >= o) & (right[rows] >= self.least - o)]
            h.append(K.grams_of(whole[some, self.span - 1 - o : self.span - 1 - o + self.least]))
            who.append(ids[some])
            start.append(at[some] - o)
        h, who, start = (np.concatenate(x) for x in (h, who, start))
        order = np.lexsort((start, who, h))
        h, who, start = h[order], who[order], start[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1]) | (start[1:] != start[:-1])]) if len(h) else np.zeros(0, bool)
        return h[new], who[new], start[new]


def _agree(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many first columns of two tables agree, row by row."""
    differ = np.concatenate([x != y, np.ones((len(x), 1), bool)], axis=1)
    return np.minimum(differ.argmax(axis=1), most)


def repeats(documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """A row for each document that shares a run of ``least`` words or more with another: id_col, n_spans, n_repeated
    (words in them), spans (first and past-the-last word of each, merged) and later_spans (those of them that a document
    with a lesser id has too: what deduplication removes).

    Words are runs of ASCII letters (in any case), digits and all that isn't ASCII. Null, empty and short texts, and rows
    with a null id, aren't reported; rows of one id are one document, whose repeats among themselves don't count. Only
    the id and text columns are read. An empty table gives an empty result.
    """
    if least - span + 1 < gram:
        raise ValueError("a retained suffix must have the words of a gram")
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")
    keys = docs.mapInArrow(_Keys(least, gram, span), "key long, id long").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    marks = in_two_steps(keys.mapInArrow(_Marks(), "chunk int, counts binary"), _either, _either)
    got = {r.chunk: bytes(r.counts) for r in marks.collect()}  # of fixed size
    size = (1 << KEY_BITS) // 8 // CHUNKS
    sent = spark.sparkContext.broadcast(np.frombuffer(b"".join(got.get(i, bytes(size)) for i in range(CHUNKS)), np.uint8))
    suffixes = docs.mapInArrow(_Suffixes(sent, least, gram, span), "key long, next binary, back binary, right short, left short, id long, at long")
    order = ["key", "next", "id", "at"]
    dealt = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    found, _ = written(dealt.mapInArrow(_Compare(least, span), "kind tinyint, id long, first long, past long, h long, firsts array<long>, others boolean"), "repeats")
    loose = found.where(F.col("kind") == GRAMS).select("id", "h", "firsts", "others")
    shared = loose.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max("others").alias("others")).where("a < b or others").select("h", "a")
    kinds = F.when(F.col("id") > F.col("a"), F.array(F.lit(ANY), F.lit(LATER))).otherwise(F.array(F.lit(ANY)))
    rest = loose.join(shared, "h").select("id", F.explode("firsts").alias("first"), kinds.alias("kinds")).select(
        F.explode(F.col("kinds").cast("array<tinyint>")).alias("kind"), "id", "first", (F.col("first") + least).alias("past")
    )
    every = found.where(F.col("kind") != GRAMS).select("kind", "id", "first", "past").union(rest)
    by_doc = every.repartition("id").sortWithinPartitions("id")
    out = by_doc.mapInArrow(_report, "id long, n_spans long, n_repeated long, spans array<struct<first:long,past:long>>, later_spans array<struct<first:long,past:long>>")
    return out.withColumnRenamed("id", id_col)
