import hashlib
import pathlib
import random
import re

from strataport.llm.line_dedup import dedup_lines
from strataport.llm.secrets import scan_secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = ("assign", "access", "hex")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans_equal_regular_expressions(spark):
    rng = random.Random(4)
    bits = [
        "password", "Secret", "TOKEN", "api_key", "apikey", ": ", " = ", '"', "'", "abcdef", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef",
        "é😀", " ", "\n", "token: abcdefgh", "."
    ]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(14))), "s") for i in range(400)] + [(400, None, None), (401, "", "s"), (402, "secret=token: abcdefgh", "s")]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "0 as spans"))
    for r in got.collect():
        kept = ",".join(s for s in r.spans.split(",") if s and not s.startswith("owned"))
        assert kept == base(dict((i, t) for i, t, _ in rows)[r.doc_id] or ""), r
        assert r.base_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len([x for x in kept.split(",") if x])


def test_ownership(spark):
    mine, copied = "Zq8xK1vN4mTt7LpW2sYd9R", "Aa1Bb2Cc3Dd4Ee5Ff6Gg7H"
    rows = [
        (1, f"use {mine} here", "x"), (1, f"use {mine} here", "x"), (2, f"as {mine}", "x"), (3, copied, "x"), (4, copied, "y"), (5, "nothing", "y"),
        (None, f"{mine} {copied}", "x")
    ]
    got = sorted(((r.doc_id, r.spans, r.n_owned, r.n_copied) for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), key=str)
    want = [(1, "owned:4:26", 1, 0), (1, "owned:4:26", 1, 0), (2, "owned:3:25", 1, 0), (3, "", 0, 1), (4, "", 0, 1), (5, "", 0, 0), (None, "owned:0:22", 1, 1)]
    assert got == sorted(want, key=str)
    assert scan_secrets(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_repositories_of_one_owner(spark):
    """One place, several repositories of one owner, several owners."""
    one, spread, copied = "Zq8xK1vN4mTt7LpW2sYd9R", "Hh3Jj5Kk7Ll9Mm1Nn2Pp4Q", "Aa1Bb2Cc3Dd4Ee5Ff6Gg7H"
    rows = [
        (1, one, "x", "r1"), (2, one, "x", "r1"), (3, f"token={spread}", "x", "r1"), (4, spread, "x", "r2"), (5, copied, "x", "r1"),
        (6, copied, "y", "r3"), (7, copied, "y", None)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: (r.n_live, r.n_spread, r.n_copied) for r in scan_secrets(df, repository="repo").collect()}
    assert got == {1: (1, 0, 0), 2: (1, 0, 0), 3: (1, 1, 0), 4: (1, 1, 0), 5: (0, 0, 1), 6: (0, 0, 1), 7: (0, 0, 1)}
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    for path in pathlib.Path(base).glob("strataport/secrets-*"):  # no value is written in plain text
        kept = str(spark.read.parquet(str(path)).collect())
        assert not any(v in kept for v in (one, spread, copied))


def test_a_very_long_text(spark):
    text = "word " * 400_000 + "password=abcdef123 " * 300 + "x" * 100_000
    r = scan_secrets(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert r.n_assign == 300 and r.base_sha256 == hashlib.sha256(base(text).encode()).hexdigest()


def brute_lines(docs):
    first, out = {}, []
    for i, t in sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0)):
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip(" ") and first.setdefault(w, (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        out.append((i, t, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), sorted(gone)))
    return {(i, t): (c, n, g) for i, t, c, n, g in out}


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, "\n".join(rng.choice(["a", "b", "c", "d", "", " "]) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "x\ny"), (73, "p\nq\nr"), (74, "p\nq\nr"), (74, "p\nq\nr"), (75, "m\n" * 500)]
    want = brute_lines(docs)
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text as original", "1 as n_lines").repartition(3)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.text, r.n_lines, list(r.removed_lines)) == want.get((r.doc_id, r.original), (None, 0, [])), r
    assert dedup_lines(spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc")], "doc_id long, text string")).where("doc_id is null").first().text == "a\nb\nc"
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
