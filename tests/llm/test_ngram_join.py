import random
import re
from collections import defaultdict

import numpy as np
import pytest

from strataport.llm.ngram_join import join_ngrams, product

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    root = {i: i for i, _ in docs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in docs]
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 75 * len(s | t):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs, pool = [], []
    for i in range(n):
        if pool and rng.random() < 0.7:
            w = list(rng.choice(pool[-6:]))
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = rng.choices(words, k=rng.choice([1, 3, 4, 5, 6, 30, 60, 90]))
        pool.append(w)
        docs.append((i * 7 % 1009, " ".join(w) if rng.random() < 0.9 else "  ".join(w).upper() + "\n"))
    return docs


@pytest.mark.parametrize(("seed", "block_rows", "short"), [(1, 4, 3), (2, 256, 32), (3, 8, 2)])
def test_equals_brute_force(spark, seed, block_rows, short):
    docs = corpus(seed, 160)
    got = join_ngrams(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), block_rows=block_rows, short=short, sketch_bits=10).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "A"), (6, "a b c d e"), (6, "a b c d e"), (None, "a b c d e"), (7, "A b  c\td e")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as component_id", "'x' as n_shingles")
    got = sorted((tuple(r) for r in join_ngrams(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (None, 1, None), (7, 1, 6)], key=str)
    assert join_ngrams(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_product_discards_by_size():
    sets = [np.arange(n, dtype=np.uint64) for n in (100, 75, 74, 300)]
    assert product(np.array([9, 8, 7, 6]), sets) == [(9, 8), (8, 7)]
    assert not product(np.array([1, 2]), [np.arange(3, dtype=np.uint64), np.arange(5, 9, dtype=np.uint64)])


def test_forest_spans():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 62, 9000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 9000 - 10 * i], rng.integers(0, 1 << 62, 50, dtype=np.uint64)])) for i in range(20)]
    pairs = product(np.arange(20), sets)
    seen = defaultdict(set)
    for a, b in pairs:
        seen[a].add(b)
    assert len(pairs) == 19
