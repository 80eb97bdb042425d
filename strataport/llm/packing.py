"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens. Window after window, a queue is granted its target share of the window;
what it can't be given as whole tokens is its deficit, carried to the next window, so after w windows it has sent
floor(w x share) tokens, never a token off its target. Because that count depends on w alone, the deficits carry across
partitions without any message: a document's place follows from its place in its queue, a prefix sum. Windows follow one
another without a gap and sequences of ``length`` tokens are cut from them, so only the last sequence of all is padded.

When given targets differ from what the sources hold, a queue runs empty at some time; a new phase then shares its part
among the others, in proportion to their targets.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, without, written
from .tokens import default_path, encoder

LENGTH = 1024
#: Tokens in which every queue gets its share once.
WINDOW = 64 * LENGTH
#: A source with at least this part of the text, or with a target, has a queue of its own; there are at most as many of
#: the first kind. The documents of the smaller ones go through shared queues, of which each source always has the same.
OWN_SHARE, SHARED_QUEUES = 4096, 256


class Schedule:
    """Where each token of each queue goes. ``totals``: tokens in each queue; ``targets``: its share of the mixture (the
    totals, if none is given)."""

    def __init__(self, totals: list[int], targets: list[float] | None = None, window: int = WINDOW):
        self.window = window
        left, used, place = list(totals), [0] * len(totals), 0
        share = [Fraction(x) for x in (targets if targets is not None else totals)]
        self.phases: list[tuple[int, int, list[int], list[int]]] = []  # place, tokens, tokens by queue, used before
        while any(left):
            live = [q for q, n in enumerate(left) if n and share[q] > 0] or [q for q, n in enumerate(left) if n]
            weight = {q: share[q] if share[q] > 0 else Fraction(1) for q in live}
            rounds = min(Fraction(left[q]) / weight[q] for q in live)
            take = [int(weight[q] * rounds) if q in weight else 0 for q in range(len(totals))]
            self.phases.append((place, sum(take), take, list(used)))
            left = [n - t for n, t in zip(left, take)]
            used = [u + t for u, t in zip(used, take)]
            place += sum(take)
        self.ends = [[p[3][q] + p[2][q] for p in self.phases] for q in range(len(totals))]
        self.sent = lru_cache(1024)(self._sent)
        self.before = lru_cache(1024)(self._before)

    def _sent(self, phase: int, w: int) -> list[int]:
        """Tokens of each queue in the first w windows of a phase: its grants less its deficit."""
        _, n, take, _ = self.phases[phase]
        done = min(w * self.window, n)
        return [t * done // n for t in take]

    def _before(self, phase: int, w: int) -> list[int]:
        """Where each queue's tokens of window w start."""
        now, then = self.sent(phase, w), self.sent(phase, w + 1)
        start = self.phases[phase][0] + sum(now)
        return [start + x for x in accumulate((b - a for a, b in zip(now, then)), initial=0)][:-1]

    def runs(self, queue: int, at: int, n: int) -> Iterator[tuple[int, int]]:
        """Tokens at, ..., at + n - 1 of a queue as runs: place in the packed stream, tokens."""
        while n:
            k = bisect_right(self.ends[queue], at)
            _, total, take, used = self.phases[k]
            t = at - used[queue]
            w = t * total // (take[queue] * self.window)
            while self.sent(k, w + 1)[queue] <= t:
                w += 1
            while self.sent(k, w)[queue] > t:
                w -= 1
            many = min(n, self.sent(k, w + 1)[queue] - t)
            yield self.before(k, w)[queue] + t - self.sent(k, w)[queue], many
            at, n = at + many, n - many

    def pieces(self, queue: int, at: int, n: int, length: int) -> Iterator[tuple[int, int, int]]:
        """The same, cut at sequences and joined where runs touch within one: sequence, offset, tokens."""
        held = None
        for place, many in self.runs(queue, at, n):
            while many:
                seq, off = divmod(place, length)
                m = min(many, length - off)
                if held and held[0] == seq and held[1] + held[2] == off:
                    held = (seq, held[1], held[2] + m)
                else:
                    if held:
                        yield held
                    held = (seq, off, m)
                place, many = place + m, many - m
        if held:
            yield held


class _Encode:
    """Adds ids, the partition, and where a document starts among its queue's tokens of this partition."""

    def __init__(self, tokenizer: str, end_id: int):
        self.tokenizer, self.end_id = tokenizer, end_id

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(self.tokenizer)
        end = np.array([self.end_id], enc.dtype).tobytes()
        sent: dict[str, int] = defaultdict(int)
        for b in batches:
            ids, at, many = [], [], []
            for text, queue in zip(b.column("text").to_pylist(), b.column("queue").to_pylist()):
                x = enc.ids(text or "") + end
                ids.append(x)
                at.append(sent[queue])
                many.append(len(x) // enc.dtype.itemsize)
                sent[queue] += many[-1]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(ids, pa.binary()), pa.array([part] * len(ids), pa.int64()), pa.array(at, pa.int64()), pa.array(many, pa.int64())],
                [*names, "ids", "part", "at", "n"],
            )


class _Cut:
    def __init__(self, queues: list[str], totals: list[int], targets, window: int, length: int, with_ids: bool):
        self.queues, self.args, self.length, self.with_ids = queues, (totals, targets, window), length, with_ids

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, number = Schedule(*self.args), {q: i for i, q in enumerate(self.queues)}
        for b in batches:
            row, start, length, crc, doc, seq, off, ids = [], [], [], [], [], [], [], []
            for i, (raw, queue, base, at, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("ids", "queue", "base", "at", "n")))):
                x, done = np.frombuffer(raw, f"<u{len(raw) // n}"), 0
                for s, o, m in schedule.pieces(number[queue], base + at, n, self.length):
                    row.append(i)
                    start.append(done)
                    length.append(m)
                    crc.append(zlib.crc32(x[done : done + m].astype("<u4").tobytes()))
                    doc.append(n)
                    seq.append(s)
                    off.append(o)
                    if self.with_ids:
                        ids.append(x[done : done + m].astype("<u4").tobytes())
                    done += m
            kept = [c for c in b.schema.names if c[0] == "k"]
            take = pa.array(row, pa.int64())
            new = [pa.array(x, pa.int64()) for x in (start, length, crc, doc, seq, off)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in kept), *new, *([pa.array(ids, pa.binary())] if self.with_ids else [])],
                [*kept, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if self.with_ids else [])],
            )


def pack(
    documents: DataFrame, *, text: str = "text", source: str = "source", keep: list[str] | None = None, targets: dict[str, float] | None = None, tokenizer: str | None = None,
    end_id: int = 0, length: int = LENGTH, window: int = WINDOW, own_share: int = OWN_SHARE, with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents in sequences: the columns ``keep`` (all but the text), start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``with_ids`` the ids as little-endian unsigned 32-bit integers.

    ``targets``: a share for each source (those left out come last); by default what each source holds, so that the
    mixture is even from first to last. Each source with a target, or with 1 / ``own_share`` of all text or more, keeps to
    its own share; smaller ones do so in groups. Null or empty text: the end id alone. A null source is a source of its
    own. Repeated rows are packed as often as they occur. Columns with the names above give way. An empty table gives no pieces.
    """
    spark = documents.sparkSession
    ship(spark)
    tokenizer = tokenizer or default_path()
    own = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kept = without(documents.drop(text) if keep is None else documents.select(*[f"`{c}`" for c in keep]), *own).columns
    of = F.col(f"`{source}`").cast("string")
    named = F.coalesce(F.concat(F.lit("s:"), of), F.lit("null"))
    sizes = documents.rollup(named.alias("q")).agg(F.sum(F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)) + 1).alias("n"))
    top = sizes.orderBy(F.desc("n"), "q").limit(own_share + 1).collect()  # all that can have such a share, and the total
    total = max((r.n or 0 for r in top if r.q is None), default=0)
    own_queue = {r.q for r in top if r.q is not None and r.n * own_share >= total} | {f"s:{q}" for q in targets or ()}
    lane = F.concat(F.lit("h:"), F.pmod(F.xxhash64(named), F.lit(SHARED_QUEUES)).cast("string"))
    name = F.when(named.isin(sorted(own_queue)), named).otherwise(lane) if own_queue else lane
    targets = None if targets is None else {f"s:{q}": x for q, x in targets.items()}
    df = documents.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], name.alias("queue"), F.col(f"`{text}`").alias("text"))
    types = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.drop("text").schema), "ids binary, part long, at long, n long"])
    rows, _ = written(df.mapInArrow(_Encode(tokenizer, end_id), types), "packing-ids")
    by_part = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases, _ = written(by_part.select("queue", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "packing-bases")
    found = sorted((r.queue, r.n) for r in bases.groupBy("queue").agg(F.sum("n").alias("n")).collect())  # <= own_share + SHARED_QUEUES, and targets
    queues, totals = [q for q, _ in found], [n for _, n in found]
    shares = None if targets is None else [targets.get(q, 0) for q in queues]
    cut = _Cut(queues, totals, shares, window, length, with_ids)
    placed = rows.join(bases.drop("n"), ["queue", "part"])
    out = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.drop("text", "queue").schema), *(f"{c} long" for c in own[:-1]), *(["ids binary"] if with_ids else [])])
    pieces = placed.mapInArrow(cut, out)
    return pieces.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *own[: None if with_ids else -1])


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """Whole sequences from pieces with ids: sequence_id, ids (of ``length`` tokens, padded) and n_tokens."""
    got = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    joined = F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    pad = F.lit(pad_id.to_bytes(4, "little") * length)
    return got.select("sequence_id", F.substring(F.concat(joined, pad), 1, 4 * length).alias("ids"), "n_tokens")
