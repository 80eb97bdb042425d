import numpy as np
import pytest
from pyspark.sql import functions as F

from strataport.llm import kernels as K
from strataport.llm.embedding_dedup import NEAREST, SHARED, describe, near_vectors, unit
from strataport.llm.language_id import SEGMENT, Network, identify, labelled, pooled, train

WORDS = {
    "en": "the of and with that this from which their would".split(), "de": "der die und nicht mit für über werden auch eine".split(),
    "fr": "les des une dans pour est avec être où ça".split()
}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n))


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(0)
    net = Network(["a", "b", "c"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    seg = rng.integers(97, 110, (12, 5)).astype(np.uint8)
    label, weight = np.array([0, 1, 2, 1, 0]), np.ones(5, np.float32)
    _, g = net.gradients(seg, label, weight)
    for k, v in net.w.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old = v[at]
        v[at] = old + 1e-3
        up, _ = net.gradients(seg, label, weight)
        v[at] = old - 1e-3
        down, _ = net.gradients(seg, label, weight)
        v[at] = old
        assert abs(g[k][at] - (up - down) / 2e-3) < 1e-4, k


def test_pooling_covers_every_position_whatever_the_grouping():
    rng = np.random.default_rng(1)
    net = Network(["a", "b"], hidden=4)
    texts = [bytes(rng.integers(65, 123, n).astype(np.uint8)) for n in (0, 1, 127, 128, 129, 1000)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = pooled(net, np.frombuffer(b"".join(texts), np.uint8), off)
    one = np.concatenate([pooled(net, np.frombuffer(t + b"x", np.uint8), np.array([0, len(t)])) for t in texts])
    assert np.allclose(whole, one, rtol=1e-4)
    assert np.allclose(whole.sum(axis=1), [sum(chr(c).isalpha() for c in t) for t in texts], rtol=1e-4)


def test_identify(spark):
    rng = np.random.default_rng(2)
    rows = [(i, text(rng, lang, int(rng.integers(3, 60))), lang) for i, lang in enumerate(rng.choice(list(WORDS), 400))]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 !?", "de"), (1003, "x" * 3000, None), (None, "the of and with", "en")]
    df = spark.createDataFrame([(i, t, None if lang is None else str(lang)) for i, t, lang in rows], "doc_id long, text string, lang string").selectExpr("*", "1 as score")
    got = {r.doc_id: r for r in identify(df, rows=60).collect()}
    held = [r for r in rows[:400] if got[r[0]].held_out]
    assert 60 < len(held) < 140
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    none = identify(df.where("lang is null and doc_id = 1003").select("doc_id", "text", "lang"))
    assert [r.lang_pred for r in none.collect()] == ["und"]
    assert identify(df.limit(0)).count() == 0


def test_training_is_repeatable():
    a = train([b"the of and", b"der die und"] * 4, ["en", "de"] * 4, steps=3, batch=4)
    b = train([b"the of and", b"der die und"] * 4, ["en", "de"] * 4, steps=3, batch=4)
    assert all((a.w[k] == b.w[k]).all() for k in a.w)
    assert K.ALNUM[ord("a")]


def brute(rows, cosine=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and len(v) == 4]
    ids = [i for i, _ in ok]
    ok = [(i, v / np.abs(v).max()) for i, v in ok]
    e = np.array([v / np.linalg.norm(v) for _, v in ok])
    a = e @ e.T >= cosine
    np.fill_diagonal(a, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[k], *label[a[k]]]) for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return {i: (int(n), int(c)) for i, n, c in zip(ids, a.sum(1), label)}


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 4))
    rows = [(i, (centres[i % 8] + 0.15 * rng.standard_normal(4)).tolist()) for i in range(300)]
    rows += [
        (300, rows[0][1]), (301, rows[0][1]), (302, None), (303, []), (304, [0.0] * 4), (305, [1.0, None, 0.0, 0.0]), (306, [float("nan")] * 4),
        (307, [float("inf"), 1.0, 1.0, 1.0]), (None, rows[0][1]), (308, [1.0, 2.0]), (309, [1e200, 0.0, 0.0, 0.0]), (310, [1e-200, 0.0, 0.0, 0.0])
    ]
    got = {r.vec_id: r for r in near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as kept"), pivots=24, nearest=12, shared=1
    ).collect()}
    want = brute(rows)
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i in want)
    assert found >= 0.9 * sum(n for n, _ in want.values()) and all(got[i].n_links <= n for i, (n, _) in want.items())
    assert np.mean([got[i].component_id == c for i, (_, c) in want.items()]) > 0.9
    for i in (302, 303, 304, 305, 306, 307, 308):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert got[309].component_id == got[310].component_id
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    nulls = near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")).collect()
    assert [tuple(r) for r in nulls] == [(1, 0, 1, True)]


def test_every_dimension_is_compared_within_itself(spark):
    rng = np.random.default_rng(4)
    rows = []
    for dim, n, centres in ((6, 400, 80), (5, 300, 60), (3, 6, 2)):
        c = rng.standard_normal((centres, dim))
        rows += [(len(rows) + k, (c[k % centres] + 0.05 * rng.standard_normal(dim)).tolist()) for k in range(n)]
        rows.append((len(rows), rows[-1][1]))
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for dim in (6, 5, 3):
        mine = [(i, v) for i, v in rows if len(v) == dim]
        e = np.array([np.array(v) / np.linalg.norm(v) for _, v in mine])
        want = (e @ e.T >= 0.9).sum(1) - 1
        links = np.array([got[i].n_links for i, _ in mine])
        assert (links <= want).all() and links.sum() >= 0.9 * want.sum() > 0
        assert dim > 3 or (links == want).all()
        assert got[mine[-1][0]].n_links > 0 and got[mine[-1][0]].component_id in {i for i, _ in mine}


def test_blocks_and_widths_give_the_same(spark):
    """A list in one unit or in many blocks, and single or double precision, links alike; links equal brute force where
    every pivot counts."""
    rng = np.random.default_rng(8)
    c = rng.standard_normal((30, 8))
    x = np.float32(c[rng.integers(0, 30, 700)] + 0.1 * rng.standard_normal((700, 8)))
    x[:200] = x[0] + np.float32(0.02) * rng.standard_normal((200, 8))  # a list with a great part of all
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    e = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = ((e @ e.T) >= 0.9).sum(1) - 1
    whole = {r.vec_id: tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), pivots=16, nearest=16, shared=1).collect()}
    assert [whole[i][1] for i in range(700)] == want.tolist()
    for kind in ("float", "double"):
        some = near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3), pivots=16, nearest=16, shared=1, block_rows=50)
        assert {r.vec_id: tuple(r) for r in some.collect()} == whole


@pytest.mark.parametrize("n", [2_000, 10_000, 40_000])
def test_recall_of_the_index_by_size(n):
    """What the defaults retrieve of pairs planted at a cosine of 0.90 to 0.91 among n vectors of 64 dimensions."""
    rng = np.random.default_rng(n)
    x = unit(rng.standard_normal((n, 64)))
    pivots = x[rng.permutation(n)[: int(np.ceil(4 * np.sqrt(n)))]]
    a, b = x[:500], rng.standard_normal((500, 64))
    b = unit(b - (a * b).sum(1)[:, None] * a)
    c = rng.uniform(0.9001, 0.91, 500)[:, None]
    p, q = describe(a, pivots, NEAREST), describe(unit(c * a + np.sqrt(1 - c * c) * b), pivots, NEAREST)
    shared = np.array([len(set(s) & set(t)) for s, t in zip(p.tolist(), q.tolist())])
    assert (shared >= SHARED).mean() >= 0.95


def test_the_sample_is_bounded_whatever_the_ids(spark):
    """One id for all rows, and one row for all."""
    ids = spark.range(4000).select(F.lit(5).alias("k"), F.concat(F.lit("some words "), F.col("id") % 2000).alias("t"), F.lit("en").alias("l"))
    seen, _ = labelled(ids, text="t", lang="l", key=F.col("k"), rows=50, slices=2)
    assert 2 * 20 < len(seen) < 2 * 120
    one = spark.range(4000).select(F.lit(5).alias("k"), F.lit("the same").alias("t"), F.lit("en").alias("l"))
    assert len(labelled(one, text="t", lang="l", key=F.col("k"), rows=50, slices=2)[0]) == 2


def test_pooling_equals_a_loop_over_bytes():
    """Every byte's probabilities, one step of each direction at a time, summed over letters."""
    rng = np.random.default_rng(2)
    net = Network(["a", "b", "c"], hidden=4)
    texts = [("ab é1 " * 60).encode(), b"", b"x", b"1 2 3", bytes(rng.integers(97, 122, 300).astype(np.uint8))]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = pooled(net, raw, offsets)
    for k, t in enumerate(texts):
        want = np.zeros(3)
        for lo in range(0, len(t), SEGMENT):
            part = np.frombuffer(t[lo : lo + SEGMENT], np.uint8)
            p = net.probabilities(part[:, None].copy(), np.array([len(part)]))[:, 0]
            want += p[[chr(x).isalpha() if x < 128 else True for x in part]].sum(axis=0)
        assert np.allclose(got[k], want, rtol=1e-4, atol=1e-4)


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(5)
    pairs = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopq"]
    rows = [(pair, " ".join(rng.choice([pair, pair[::-1], pair * 2], 20))) for k, pair in enumerate(pairs) for _ in range(20 + (k < 64))]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    got = identify(df, keep=["doc_id", "lang"], rows=20, slices=2).where("held_out").collect()
    rare = [r.lang_pred == r.lang for r in got if r.lang in pairs[64:]]
    assert len(pairs) == 70 and len(rare) > 15 and np.mean(rare) > 0.8
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.8


def test_recall_of_the_defaults_near_the_threshold(spark):
    """Pairs planted at cosines of 0.90 to 0.92 in 64 dimensions."""
    rng = np.random.default_rng(6)
    n = 1500
    a, b = (rng.standard_normal((n, 64)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = rng.uniform(0.9001, 0.92, n)[:, None]
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]))]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    recall = np.mean([got[n + i].component_id == i and got[i].n_links == 1 for i in range(n)])
    print("recall", recall)
    assert recall >= 0.95
    assert all(r.n_links <= 1 for r in got.values())
