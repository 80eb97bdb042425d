"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ten consecutive words of the test items (an item of fewer words is one window). Windows of
one length share a block shift table, indexed by the hash of the last two words under the window's end: it says how far
the end can move without passing an occurrence. Where it says zero, the bucket of that suffix block lists the windows
that may end there, and direct comparison confirms them, first by the hashes of all words, then by their bytes.

The scan runs many cursors in lockstep, one for each 64 words of a group of documents, so the skipping is vectorised.
Nothing is shuffled: the driver compiles the test items in blocks of at most ``block_bytes`` of text into arrays (about
six bytes for each of text), once, and these are sent to the tasks; a second block passes over the rows that come out of
the first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import ship, without

WINDOW = 10
_BITS = 18
_LANE = 64


class _Length:
    """Tables for the windows of one length. ``first``: the first word of each among the items' words; ``items``: a list
    of items for each, as numbers."""

    def __init__(self, of: K.Words, m: int, first: np.ndarray, items: tuple[np.ndarray, np.ndarray]):
        self.m, self.block = m, min(2, m)
        seen = lambda j: of.hash[first + j]
        self.shift = np.full(1 << _BITS, self.m - self.block + 1, np.int16)
        for end in range(self.block - 1, self.m):
            np.minimum.at(self.shift, self._index([seen(j) for j in range(end - self.block + 1, end + 1)]), self.m - 1 - end)
        suffix = self._index([seen(j) for j in range(self.m - self.block, self.m)])
        order = np.argsort(suffix, kind="stable")
        self.first = first[order].astype(np.int32)
        self.bucket = np.searchsorted(suffix[order], np.arange((1 << _BITS) + 1)).astype(np.int32)
        size = np.diff(items[0])[order]
        self.ends = np.concatenate([[0], np.cumsum(size)])
        self.items = items[1][np.repeat(items[0][:-1][order] - self.ends[:-1], size) + np.arange(self.ends[-1])].astype(np.int32)

    def _index(self, block) -> np.ndarray:
        h = block[0] if self.block == 1 else K.mixed(block[0] * K.STEP + block[1])
        return (h >> K.U(64 - _BITS)).astype(np.int64)

    def find(self, w: K.Words, of: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """First words of the occurrences in ``w`` and the windows that occur there."""
        n, h = len(w), w.hash
        at = np.arange(self.block - 1, n, _LANE)
        stop = np.minimum(at + _LANE, n)
        ends = []
        while len(at):
            skip = self.shift[self._index([h[at]] if self.block == 1 else [h[at - 1], h[at]])]
            ends.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        end = end[end >= self.m - 1]
        first = end - self.m + 1
        row = np.searchsorted(w.first, first, "right") - 1
        inside = end < w.first[row + 1]
        first, end = first[inside], end[inside]
        k = self._index(h[end][None] if self.block == 1 else np.stack([h[end - 1], h[end]]))
        lo, many = self.bucket[k].astype(np.int64), (self.bucket[k + 1] - self.bucket[k]).astype(np.int64)
        first = np.repeat(first, many)
        which = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        for j in range(self.m):
            same = h[first + j] == of.hash[self.first[which] + j]
            first, which = first[same], which[same]
        same = np.fromiter((w.text(f, f + self.m) == of.text(p, p + self.m) for f, p in zip(first, self.first[which].tolist())), bool, len(first))
        return first[same], which[same]


class Patterns:
    """Compiled windows of some items, and the items of each window. Arrays alone, so that sending them is cheap."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.names = [i for i, _ in items]
        w = K.words(np.frombuffer(b"".join(t for _, t in items), np.uint8), np.concatenate([[0], np.cumsum([len(t) for _, t in items], dtype=np.int64)]), K.ALNUM)
        self.words = K.Words(w.data, w.start.astype(np.int32), w.end.astype(np.int32), w.hash, w.first)
        size = np.diff(w.first)
        self.lengths = []
        for m in np.unique(np.minimum(size, window)).tolist():
            if m:
                rows = np.flatnonzero(np.minimum(size, window) == m)
                many = size[rows] - m + 1
                first = np.repeat(w.first[rows], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                self.lengths.append(self._length(m, first, np.repeat(rows, many)))

    def _length(self, m: int, first: np.ndarray, item: np.ndarray) -> _Length:
        """Windows of equal text are one; hashes only bring them together."""
        g = K.grams(self.words.hash, m)[first]
        order = np.lexsort((first, g))
        g, first, item = g[order], first[order], item[order]
        edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        window = np.repeat(edge[:-1], np.diff(edge))  # each window by its first place
        for lo, hi in zip(edge[:-1][np.diff(edge) > 1].tolist(), edge[1:][np.diff(edge) > 1].tolist()):
            known: dict[bytes, int] = {}
            for k in range(lo, hi):
                window[k] = known.setdefault(self.words.text(int(first[k]), int(first[k]) + m), k)
        by = np.unique(np.stack([window, item]), axis=1)
        top = np.flatnonzero(np.concatenate([[True], by[0][1:] != by[0][:-1]]))
        return _Length(self.words, m, first[by[0][top]], (np.concatenate([top, [by.shape[1]]]), by[1]))

    def search(self, w: K.Words) -> tuple[np.ndarray, dict[int, set]]:
        """For each word whether an occurrence covers it, and the items found in each row that has any."""
        edge = np.zeros(len(w) + 1, np.int64)
        found: dict[int, set] = defaultdict(set)
        for length in self.lengths:
            first, which = length.find(w, self.words)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + length.m, -1)
            row = np.searchsorted(w.first, first, "right") - 1
            for r, p in np.unique(np.stack([row, which]), axis=1).T.tolist():
                found[r].update(self.names[k] for k in length.items[length.ends[p] : length.ends[p + 1]].tolist())
        return np.cumsum(edge[:-1]) > 0, found


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    """Test items in blocks of at most ``block_bytes`` of text, one item at least; only one block is in memory."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null")
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, bytes(r.t)))
        size += len(r.t)
    if block:
        yield block


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = 16 << 20,
) -> DataFrame:
    """Every row of ``documents`` with n_words, n_hit, n_items, item_ids (sorted as strings), hit_spans (first and
    past-the-last word of each run of covered words), items_sha256 and contaminated.

    ``keep``: columns to carry (all). Null or empty text: no words, not contaminated; null or empty test items have no
    window; null item ids are named "null"; repeated rows, and items with equal text, each count. Columns of ``documents``
    with the names above give way. Empty tables give an empty or an all-clean result.
    """
    spark = documents.sparkSession
    ship(spark)
    own = {
        "n_words": "long", "n_hit": "long", "n_items": "long", "item_ids": "array<string>", "hit_spans": "array<struct<first:long,past:long>>",
        "items_sha256": "string", "contaminated": "boolean"
    }
    kept = without(documents if keep is None else documents.select(*[f"`{c}`" for c in keep]), *own).columns
    df = documents.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("binary").alias("text"),
        F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<first:long,past:long>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    schema = df.schema
    blocks = 0
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(Patterns([("null" if i is None else str(i), t) for i, t in block], window))  # a few times block_bytes
        df = df.mapInArrow(_Search(sent), schema)
        blocks += 1
    if not blocks:
        df = df.mapInArrow(_Search(None), schema)
    spans = F.col("spans")
    if blocks > 1:
        spans = _merged(spans)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["past"] - s["first"])
    items = F.array_sort(F.array_distinct("items"))
    return df.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], F.col("n").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("item_ids"),
        spans.alias("hit_spans"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def _merged(spans):
    """Spans without overlap, from spans of several blocks."""
    zero = F.array().cast("array<struct<first:long,past:long>>")

    def add(done, s):
        top = F.element_at(done, -1)
        join = F.struct(top["first"].alias("first"), F.greatest(top["past"], s["past"]).alias("past"))
        return F.when(
            (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["past"] >= s["first"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(join))
        ).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), zero, add)


class _Search:
    def __init__(self, sent):
        self.sent = sent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = self.sent.value if self.sent else Patterns([])
        for b in batches:
            raw, offsets = K.buffers(b.column("text"))
            n, spans, items = [], b.column("spans").to_pylist(), b.column("items").to_pylist()
            for i, j in K.groups(offsets):
                w = K.words(raw, offsets[i : j + 1], K.ALNUM)
                n.append(np.diff(w.first))
                hit, found = patterns.search(w)
                for row, ids in found.items():
                    lo, hi = w.first[row], w.first[row + 1]
                    edge = np.diff(np.concatenate([[0], hit[lo:hi].view(np.int8), [0]]))
                    spans[i + row] += [{"first": f, "past": p} for f, p in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
                    items[i + row] += sorted(ids)
            counts = np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)
            new = {"n": pa.array(counts), "spans": pa.array(spans, b.schema.field("spans").type), "items": pa.array(items, b.schema.field("items").type)}
            yield pa.RecordBatch.from_arrays([new.get(f.name, c) for f, c in zip(b.schema, b.columns)], schema=b.schema)
