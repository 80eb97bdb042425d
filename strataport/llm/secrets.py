"""Secret scan with corpus-wide ownership frequency, in DataFrame functions alone.

Base patterns give spans of three kinds in every text. To these, wider candidates are added: long runs of letters,
digits and base-64 signs. The values of all candidates are hashed and their distinct repositories and owners counted
over the whole corpus. A value that several owners have is a copied example. A value of a single owner that looks random
is a live-looking credential of that owner: used in one place, or spread over several of the owner's repositories, where
it is a credential that services share (it opens more, and takes more to replace). Live-looking candidates outside the
base spans become spans of kind ``owned``; base spans stay whatever their count.

A regular expression's places come from the lengths of the pieces between its matches. The texts are read once; what is
found (a few spans a document, with hashes for values) is written to the shared folder, and only that is shuffled. Counts are of distinct rows
aggregated on the map side, so an example that a third of the documents have sends one row from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import without, written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # of 20 or more: what a shorter match takes holds no longer one
HEX = r"[0-9a-f]{24,}"
WIDE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A value of at most so many owners is owner-specific; of so many distinct signs it looks random.
OWNERS, SIGNS = 1, 10
#: An owner-specific value in more of its owner's repositories than this is spread.
REPOSITORIES = 1
_SPAN = "array<struct<start:int,kind:int,past:int,value:string>>"


def _spans(kind: int, text: Column, pieces: Column, pattern: str) -> Column:
    """Matches with their places in code points, from the pieces between them."""
    found = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(a, x):
        start = a["at"] + x["gap"]
        past = start + F.length(x["m"])
        return F.struct(
            past.alias("at"),
            F.concat(a["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), past.alias("past"), x["m"].alias("value")))).alias("out")
        )

    return F.when(F.size(pieces) > 1, F.aggregate(found, zero, add)["out"]).otherwise(F.array().cast(_SPAN))


def _written_spans(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["past"])), ",")


def _of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan_secrets(
    documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", owner: str = "source", repository: str | None = None, keep: list[str] | None = None, owners: int = OWNERS, repositories: int = REPOSITORIES,
) -> DataFrame:
    """Every row with n_assign, n_access, n_hex, base_sha256, spans (kind:start:past, by start and then kind, of base and
    owned spans), n_owned, n_live and n_copied (candidates whose value is owner-specific, or copied) and n_spread (those
    owner-specific ones that are in more than ``repositories`` of their owner's repositories).

    ``owner`` and ``repository`` name columns; without a repository each document is one. A null owner or repository is
    an owner or repository of its own. Null or empty text has no spans. Rows equal in id and text are one document.
    ``keep``: columns to carry (all but the text); columns with the names above give way. An empty table gives an empty
    result.
    """
    own = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_owned", "n_live", "n_copied", "n_spread"]
    kept = without(documents.drop(text) if keep is None else documents.select(*[f"`{c}`" for c in keep]), *own).columns
    repo = F.col(f"`{repository or id_col}`").cast("string")
    df = documents.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{owner}`").cast("string").alias("owner"), repo.alias("repo"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")
    )
    t, low = F.col("t"), F.lower("t")
    some = F.lit(False)
    for word in ("passw", "secret", "token", "apikey", "api_key"):
        some = some | low.contains(word)
    whole = F.array(t)
    df = df.withColumns({
        "th": F.xxhash64("t"), "p0": F.when(some, F.split(t, ASSIGN, -1)).otherwise(whole), "p1": F.when(t.contains("AKIA"), F.split(t, ACCESS, -1)).otherwise(whole),
        "p2": F.split(t, HEX, -1), "p3": F.split(t, WIDE, -1),
    })
    value = F.regexp_extract
    assign = F.filter(_spans(0, t, F.col("p0"), ASSIGN), lambda s: F.length(value(s["value"], ASSIGN, 2)) >= 6)
    base = F.concat(assign, _spans(1, t, F.col("p1"), ACCESS), _spans(2, t, F.col("p2"), HEX))
    df = df.select(*[c for c in df.columns if c[0] == "k"], "id", "th", "owner", "repo", base.alias("base"), _spans(3, t, F.col("p3"), WIDE).alias("wide"))
    mixed = F.filter("wide", lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= SIGNS))
    apart = F.filter(mixed, lambda s: ~F.exists("base", lambda b: (b["start"] < s["past"]) & (s["start"] < b["past"])))
    secret = lambda x: F.when(x["kind"] == 0, value(x["value"], ASSIGN, 2)).otherwise(x["value"])
    hashed = lambda spans: F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["past"].alias("past"), F.sha2(secret(x), 256).alias("h"))
    )
    spans = {c: F.when(F.size(c) > 0, hashed(x)).otherwise(F.array().cast("array<struct<start:int,kind:int,past:int,h:string>>")) for c, x in (
        ("base", F.col("base")), ("wide", apart)
    )}
    found, _ = written(df.select(*[c for c in df.columns if c not in spans], *[x.alias(c) for c, x in spans.items()]), "secrets")
    each = found.select("id", "th", "owner", "repo", F.explode(F.concat("base", "wide")).alias("s")).withColumn("h", F.col("s.h"))
    seen = each.select("h", "owner", "repo").distinct().groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos"))
    owned = seen.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.max("repos").alias("repos"))
    live = F.col("owners") <= owners
    judged = each.join(owned, "h").select(
        "id", "th", F.struct("s.start", "s.kind", "s.past", live.alias("live"), (live & (F.col("repos") > repositories)).alias("spread")).alias("s")
    )
    by_doc = judged.groupBy("id", "th").agg(F.collect_set("s").alias("s"))
    out = found.alias("f").join(by_doc.alias("j"), F.col("f.id").eqNullSafe(F.col("j.id")) & (F.col("f.th") == F.col("j.th")), "left")
    s = F.coalesce("j.s", F.array().cast("array<struct<start:int,kind:int,past:int,live:boolean,spread:boolean>>"))
    count = lambda test: F.size(F.filter(s, test)).cast("long")
    return out.select(
        *[F.col(f"f.k{i}").alias(c) for i, c in enumerate(kept)], *[_of_kind("base", k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(_written_spans(F.col("base")), 256).alias("base_sha256"), _written_spans(F.filter(s, lambda x: (x["kind"] < 3) | x["live"])).alias("spans"),
        count(lambda x: (x["kind"] == 3) & x["live"]).alias("n_owned"), count(lambda x: x["live"]).alias("n_live"), count(lambda x: ~x["live"]).alias("n_copied"), count(lambda x: x["spread"]).alias("n_spread"),
    )
