import random
import re

from strataport.llm import suffix_dedup
from strataport.llm.suffix_dedup import repeats


def brute(docs, least):
    words = {}
    for i, t in docs:
        if i is not None:
            words.setdefault(i, []).append([w.lower() for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", t or "")])
    where = {}
    for i, texts in words.items():
        for w in texts:
            for k in range(len(w) - least + 1):
                where.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = {}
    for i, texts in words.items():
        hit = set()
        for w in texts:
            for k in range(len(w) - least + 1):
                if len(where[tuple(w[k : k + least])]) > 1:
                    hit |= set(range(k, k + least))
        if hit:
            out[i] = len(hit)
    return out


def test_equals_brute_force(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["x", "y", f"w{rng.randrange(40)}"])
    passages = [[word() for _ in range(n)] for n in (12, 13, 20, 40, 90) for _ in range(3)]
    docs = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(1, 5)):
            w += [f"u{rng.random()}"] * rng.randrange(2) + [word() for _ in range(rng.randrange(12))]
            p = rng.choice(passages)
            a = rng.randrange(4)
            w += p[a : len(p) - rng.randrange(4)] if rng.random() < 0.5 else p
        docs.append((i, ", ".join(w) if i % 2 else " ".join(w).upper()))
    docs += [(200, None), (201, ""), (202, "a b c"), (203, " ".join(map(str, range(9))) * 2), (None, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as spans")
    for least, gram, span in ((12, 4, 6), (20, 5, 9)):
        got = {r.doc_id: r.n_repeated for r in repeats(df.repartition(3), least=least, gram=gram, span=span).collect()}
        assert got == brute(docs, least)
    assert repeats(df.limit(0)).count() == 0


def brute_later(docs, least):
    """Merged spans of what a document with a lesser id has too."""
    words = {i: [w.lower() for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", t)] for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - least + 1):
            first.setdefault(tuple(words[i][k : k + least]), i)
    out = {}
    for i, w in words.items():
        hit = sorted({j for k in range(len(w) - least + 1) if first[tuple(w[k : k + least])] < i for j in range(k, k + least)})
        out[i] = [(a, b + 1) for a, b in zip([x for x in hit if x - 1 not in set(hit)], [x for x in hit if x + 1 not in set(hit)])]
    return out


def test_equals_brute_force_as_registered(spark):
    """50 words, grams of 8, windows of 30: passages of 49, 50, 51 and more words, some within others, in up to 12 documents."""
    rng = random.Random(11)
    passages = [[f"p{k}x{j}" for j in range(n)] for k, n in enumerate((49, 50, 50, 51, 60, 79, 80, 120, 300))]
    docs = []
    for i in range(90):
        w = [f"d{i}a{j}" for j in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(3) if len(p) > 55 and rng.random() < 0.6 else 0
            b = len(p) - (rng.randrange(30) if len(p) > 100 else 0)
            w += p[a:b] + [f"d{i}b{rng.random()}" for _ in range(rng.randrange(1, 30))]
        docs.append((i, " ".join(w)))
    rows = repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.n_repeated for r in rows} == brute(docs, 50)
    later = brute_later(docs, 50)
    assert {r.doc_id: [tuple(s) for s in r.later_spans] for r in rows} == {r.doc_id: later[r.doc_id] for r in rows}
    assert all(r.n_spans == len(r.spans) and r.n_repeated == sum(s.past - s.first for s in r.spans) for r in rows)


def test_a_longer_agreement_with_a_later_document(spark):
    """What two later documents share beyond the first one's passage is no later copy in the first of them."""
    p = [f"w{j}" for j in range(90)]
    docs = [(1, " ".join(p[:55])), (2, " ".join(p)), (3, " ".join(p))]
    got = {r.doc_id: [tuple(s) for s in r.later_spans] for r in repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(0, 55)], 3: [(0, 90)]} == brute_later(docs, 50)


def test_later_copies(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(4, text), (9, "before " + text + " after"), (9, "before " + text + " after"), (5, "nothing " * 70)]
    got = {r.doc_id: ([tuple(s) for s in r.spans], [tuple(s) for s in r.later_spans]) for r in repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {4: ([(0, 80)], []), 9: ([(1, 81)], [(1, 81)])}


def test_a_key_over_several_stretches(spark, monkeypatch):
    """The least document has a passage twice, in stretches of one hot key; another document has it in one of them."""
    monkeypatch.setattr(suffix_dedup._Compare.__init__, "__defaults__", (3,))
    docs, n = [], 0
    for k in range(12):
        hot, before = [f"h{k}x{j}" for j in range(8)], [f"b{k}x{j}" for j in range(5)]
        own = lambda: [f"u{random.Random(len(docs)).random()}"]
        docs.append((n, " ".join([*before, *hot, "aaa", "p", *before, *hot, "zzz"])))
        docs.append((n + 1, " ".join([*before, *hot, "aaa"])))
        for j in range(30):
            docs.append((n + 2 + j, " ".join([*own(), *hot, f"m{k}x{j}"])))
        n += 40
    df = spark.createDataFrame(docs, "doc_id long, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {r.doc_id: (r.n_repeated, r.n_spans) for r in repeats(df, least=12, gram=4, span=6).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {i: m for i, (m, _) in got.items()} == brute(docs, 12)
    assert all(got[40 * k][1] == 2 for k in range(12))
