import random
import re

import numpy as np

from strataport.llm import kernels as K
from strataport.llm.decontamination import Patterns, decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    w = words(text)
    hit, found = [False] * len(w), set()
    for item, t in items:
        v = words(t)
        m = min(10, len(v))
        for i in range(len(v) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[i : i + m]:
                    hit[j : j + m] = [True] * m
                    found.add("null" if item is None else str(item))
    return len(w), sum(hit), sorted(found)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "é", "Ab1", "x", "ZZ", "naïve", "q9"]
    items = [(i % 7, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 9, 10, 11, 30])))) for i in range(24)]
    items += [(None, "lone pattern here"), (99, None), (98, "")]
    docs = []
    for i in range(60):
        t = " ".join(rng.choices(vocabulary + ["other", "words"], k=rng.choice([0, 1, 5, 40, 300])))
        if rng.random() < 0.5:
            t += ", " + rng.choice(items)[1:][0].upper() if (x := rng.choice(items)[1]) is None else "; " + x
        docs.append((i, t))
    return items, [*docs, (60, None), (61, ""), (61, ""), (None, "LONE-Pattern.here")]


def test_equals_brute_force_in_one_block_and_in_many(spark):
    items, docs = corpus(3)
    d = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "5 as n_hit", "'mine' as extra").repartition(3)
    b = spark.createDataFrame(items, "item_id int, text string")
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=str)
    for block_bytes in (1 << 20, 40):
        got = decontaminate(d, b, block_bytes=block_bytes)
        assert got.columns[:3] == ["doc_id", "text", "extra"]
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got.collect()), key=str) == want


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some words")], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontaminate(d, none).collect()] == [(2, 0, False)]
    assert decontaminate(d.limit(0), none).count() == 0


def test_word_hashes_of_long_words_and_documents():
    text = ("a" * (1 << 21) + " b ").encode() * 2 + "é Ab".encode()
    w = K.words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), K.ALNUM)
    assert len(w) == 6 and w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3] and len(set(w.hash.tolist())) == 4
    hit, found = Patterns([(1, b"a b c")]).search(K.words(np.frombuffer(b"A  b-C d", np.uint8), np.array([0, 8]), K.ALNUM))
    assert hit.tolist() == [True, True, True, False] and dict(found) == {0: {1}}
