"""Line deduplication by overlapping windows of three lines, in DataFrame functions alone.

Every run of three consecutive lines is hashed (128 bits). Windows found more than once in the corpus keep their first
occurrence, by document id and then place; the lines that any later occurrence covers are removed.

Shuffles: the hashes once, aggregated on the map side to a count and a first place, so that a window that a third of the
documents have sends one row from each task; the occurrences of repeated windows, in a sort-merge join that adaptive
execution splits where a window is hot; and the texts, by document, to meet their removed lines. Only ids, hashes and
places are in the first two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import without

WINDOW = 3


def _lines(text):
    return F.split(text, "\n", -1)


def _windows(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """Hash, document and place of each window; windows of blank lines alone don't count."""
    docs = documents.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), _lines(F.col(f"`{text}`")).alias("l"))

    def window(i):
        at = [F.element_at("l", (i + k).cast("int")) for k in range(1, WINDOW + 1)]
        solid = F.length(F.trim(at[0])) + F.length(F.trim(at[1])) + F.length(F.trim(at[2])) > 0
        return F.struct(i.cast("int").alias("at"), F.xxhash64(*at).alias("h1"), F.xxhash64(F.lit("second"), *at).alias("h2"), solid.alias("solid"))

    places = F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), window)
    one = docs.where(F.size("l") >= WINDOW).select("id", "th", F.explode(places).alias("w")).where("w.solid")
    return one.select("w.h1", "w.h2", F.struct("id", "th", F.col("w.at").alias("at")).alias("place"))


def dedup_lines(documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with its text without the lines of repeated windows, n_lines and removed_lines (their places from 0, in
    order).

    Lines are compared as they are, and only windows of three lines count: documents with fewer lines stay as they are.
    Null text stays null, with no lines. Rows equal in id and text are one document: what is removed from one is removed
    from each. A null id comes before all others. ``keep``: columns to carry besides the text; columns named n_lines or
    removed_lines give way. An empty table gives an empty result.
    """
    own = ["n_lines", "removed_lines"]
    kept = [c for c in without(documents if keep is None else documents.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])]), *own).columns]
    windows = _windows(documents, id_col, text)
    repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where("place != first")
    covered = later.groupBy(F.col("place.id").alias("id"), F.col("place.th").alias("th")).agg(F.collect_set("place.at").alias("at"))
    docs = documents.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"))
    both = docs.alias("d").join(covered.alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.th") == F.col("c.th")), "left")
    body = F.col(f"k{kept.index(text)}")
    lines = _lines(body)
    removed = F.array_sort(F.array_distinct(F.flatten(F.transform("c.at", lambda p: F.array(*[p + k for k in range(WINDOW)])))))
    both = both.withColumn("removed", removed)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    cleaned = F.when(F.col("removed").isNull(), body).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n"))
    return both.select(
        *[(cleaned if c == text else F.col(f"k{i}")).alias(c) for i, c in enumerate(kept)],
        F.when(body.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"),
    )
