"""Resumable copy of a table into a snapshot store, a range of keys at a time."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import TableSpec
from ..sources.store import Progress, SnapshotStore
from .paging import after_key, numbered
from .project import apply_spec


def copy_table(
    source: DataFrame, spec: TableSpec, key: list[str], store: SnapshotStore, progress: Progress, batch_size: int = 10_000, rows_per_second: int | None = None,
    stop: Callable[[], bool] = lambda: False, on_batch: Callable[[dict], None] = lambda _: None, unique: bool = False,
) -> str:
    """Copy page by page after the last page recorded: completed or interrupted. Rows that the target has already win,
    and so do all changes.

    The bounds of all pages are found in one pass over the keys. A stride is one page at first and becomes four times
    as many as long as that makes the copy faster; it is read by its range of keys, by which the scan is pruned, and written
    once, so a source that isn't clustered by its key is scanned a logarithmic number of times. With a rate, a stride is
    a page. ``unique``: the caller knows that no key is repeated; else repeated keys count once.
    """
    done = progress.last(spec.name)
    number, last = done if done else (0, None)
    progress.set(phase="backfill")
    store.clear_pages(spec.name)
    left = source.where(after_key(key, last)) if last is not None else source
    bounds = page_bounds(left, key, batch_size)
    many, best, misses = 1, 0.0, 0
    while not stop():
        began = time.time()
        pages = list(itertools.islice(bounds, many))
        if not pages:
            store.settle(spec.name)
            progress.set(phase="copied")
            return "completed"
        end, n = pages[-1][1], sum(p[2] for p in pages)
        rows = source.where(after_key(key, last)) if last is not None else source
        rows = apply_spec(rows.where(~after_key(key, end)), spec)
        store.append_pages(spec.name, number + len(pages), rows if unique else rows.dropDuplicates(spec.target_key(key)), spec.target_key(key))
        took = time.time() - began
        progress.record(spec.name, [(number + i, *p, max(1, int(took * 1000 * p[2] / n))) for i, p in enumerate(pages, 1)])
        for _, last, size in pages:
            number += 1
            on_batch({"batch_no": number, "rows": size, "end_key": last})
        if rows_per_second:
            wait = max(n / rows_per_second - took, 0)
            while wait > 0 and not stop():
                time.sleep(min(wait, 0.1))
                wait -= 0.1
        elif misses < 3:
            faster = n / took > 1.1 * best
            many, best, misses = many * 4 if faster else many, max(best, n / took), 0 if faster else misses + 1
    return "interrupted"


def page_bounds(source: DataFrame, key: list[str], size: int) -> Iterator[tuple[list, list, int]]:
    """First key, last key and rows of each page in order, from one pass over the keys; the driver holds a part at a time."""
    rows = numbered(source.select(*key), key)
    page = F.floor((F.col("rn") - 1) / size).cast("long").alias("page")
    by = rows.groupBy(page).agg(F.min(F.struct(*key)).alias("first"), F.max(F.struct(*key)).alias("last"), F.count(F.lit(1)).alias("n"))
    for r in by.orderBy("page").toLocalIterator():
        yield list(r.first), list(r.last), r.n


def copy_whole(source: DataFrame, spec: TableSpec, key: list[str], store: SnapshotStore) -> None:
    """Copy a table in one parallel scan, as a single page; rows that the target has already win."""
    store.clear_pages(spec.name)
    store.append_pages(spec.name, 1, apply_spec(source, spec).dropDuplicates(spec.target_key(key)), spec.target_key(key))
    store.settle(spec.name)
