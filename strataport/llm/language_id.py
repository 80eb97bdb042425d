"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each direction's cell has update gate z, reset gate r and candidate n:

    z = sigmoid(Xz[byte] + h Uz)    r = sigmoid(Xr[byte] + h Ur)    n = tanh(Xn[byte] + r * (h Un) + c)
    h = n + z * (h - n)

A softmax over both directions' states labels every position; the labels of a document's letter bytes (ASCII letters and
all above ASCII) are averaged to its probabilities. Texts are read whole, in segments of 128 bytes that run side by
side, each from a zero state: memory is bounded by a group of segments, whatever a text's length.

Training is backpropagation through time with Adam, on the driver, from slices of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import ship, without

SEGMENT = 128
HIDDEN = 8
#: Labelled rows of each language that the sample aims at, slices taken of each, and rows that all languages share.
SAMPLE_ROWS, SLICES, ALL_ROWS = 600, 6, 38_400
STEPS, BATCH = 260, 192
_GROUP = 4096  # segments that run side by side; fewer where there are more than 64 labels
_LETTER = np.array([b > 127 or chr(b).isalpha() for b in range(256)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


class Network:
    """``w``: for each direction tables Xg (256 x 2H) and Xn (256 x H), Ug (H x 2H), Un (H x H), c (H); and the output
    layer V (2H x labels), b."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden

        def make(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.w = {}
        for d in "fb":
            self.w |= {
                "Xg" + d: make(256, 2 * hidden, scale=0.3), "Xn" + d: make(256, hidden, scale=0.5), "Ug" + d: make(hidden, 2 * hidden, scale=0.3),
                "Un" + d: make(hidden, hidden, scale=0.3), "c" + d: make(hidden, scale=0.0)
            }
        self.w |= {"V": make(2 * hidden, len(labels), scale=0.3), "b": make(len(labels), scale=0.0)}

    def _run(self, d: str, seg: np.ndarray, keep: list | None = None, many: np.ndarray | None = None) -> np.ndarray:
        """States after each byte, (steps, segments, H); ``keep`` gets what backpropagation needs. ``many``: how many
        segments, the first ones, have a byte at each step; others stay in the zero state."""
        w, (steps, n), h_ = self.w, seg.shape, self.h
        h = np.zeros((n, h_), np.float32)
        out = np.empty((steps, n, h_), np.float32)
        for t in range(steps):
            g = h @ w["Ug" + d]
            g += w["Xg" + d].take(seg[t], axis=0, mode="clip")
            _sigmoid(g)
            z, r = g[:, :h_], g[:, h_:]
            a = h @ w["Un" + d]
            a += w["c" + d]
            c = a * r
            c += w["Xn" + d].take(seg[t], axis=0, mode="clip")
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            if keep is not None:
                keep.append((h, z.copy(), r.copy(), c, a))
            h = out[t]
            h[:] = new
            if many is not None:
                h[many[t] :] = 0
        return out

    def probabilities(self, seg: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Label probabilities of each position of segments (steps, segments) of falling lengths: (steps, segments, labels)."""
        many = np.searchsorted(-length, -np.arange(len(seg)), "left")
        p = self._run("f", seg) @ self.w["V"][: self.h]
        p += self._run("b", seg[::-1], many=many[::-1])[::-1] @ self.w["V"][self.h :]
        p += self.w["b"]
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        return p

    def gradients(self, seg: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the letter positions, weighted by segment, and its gradients, by backpropagation
        through time."""
        w, h_, (steps, n) = self.w, self.h, seg.shape
        kept: dict[str, list] = {"f": [], "b": []}
        sides = {"f": (seg, self._run("f", seg, kept["f"])), "b": (seg[::-1], self._run("b", seg[::-1], kept["b"]))}
        both = np.concatenate([sides["f"][1], sides["b"][1][::-1]], axis=2)
        p = both @ w["V"] + w["b"]
        p = np.exp(p - p.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        m = _LETTER[seg] * weight
        m = (m / max(m.sum(), 1e-9)).astype(np.float32)
        loss = float(-(m * np.log(p[:, np.arange(n), label] + 1e-9)).sum())
        e = p
        e[:, np.arange(n), label] -= 1
        e *= m[:, :, None]
        flat = e.reshape(-1, e.shape[2])
        g = {"V": both.reshape(-1, 2 * h_).T @ flat, "b": flat.sum(axis=0)}
        down = e @ w["V"].T
        for d in "fb":
            into = down[:, :, :h_] if d == "f" else down[::-1, :, h_:]
            g |= {k + d: np.zeros_like(w[k + d]) for k in ("Xg", "Xn", "Ug", "Un", "c")}
            dg_all, dn_all = np.empty((steps, n, 2 * h_), np.float32), np.empty((steps, n, h_), np.float32)
            dh = np.zeros((n, h_), np.float32)
            for t in range(steps - 1, -1, -1):
                h, z, r, c, a = kept[d][t]
                dh = dh + into[t]
                dc = dh * (1 - z) * (1 - c * c)
                da = dc * r
                dg = np.concatenate([dh * (h - c) * z * (1 - z), dc * a * r * (1 - r)], axis=1)
                g["Ug" + d] += h.T @ dg
                g["Un" + d] += h.T @ da
                g["c" + d] += da.sum(axis=0)
                dg_all[t], dn_all[t] = dg, dc
                dh = dh * z + dg @ w["Ug" + d].T + da @ w["Un" + d].T
            side = sides[d][0].ravel()
            order = np.argsort(side, kind="stable")
            seen, first = np.unique(side[order], return_index=True)
            g["Xg" + d][seen] = np.add.reduceat(dg_all.reshape(-1, 2 * h_)[order], first)
            g["Xn" + d][seen] = np.add.reduceat(dn_all.reshape(-1, h_)[order], first)
        return loss, g


def train(slices: list[bytes], labels: list[str], *, hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 1) -> Network:
    """Fit a network by Adam; languages weigh the same, however many slices each has. Of more than ``batch`` / 3
    languages each is still seen about three times ``steps`` times: batches grow, and where their memory would not stay
    bounded, steps do."""
    names = sorted(set(labels))
    net = Network(names, hidden, seed)
    if 3 * len(names) > batch:
        seen = 3 * len(names) * steps
        batch = max(batch, min(3 * len(names), (1 << 18) // len(names)))
        steps = -(-seen // batch)
    number = {x: k for k, x in enumerate(names)}
    y = np.array([number[x] for x in labels])
    seg = np.zeros((len(slices), SEGMENT), np.uint8)
    for i, s in enumerate(slices):
        seg[i, : len(s)] = np.frombuffer(s[:SEGMENT], np.uint8)
    rng = np.random.default_rng(seed)
    by = [np.flatnonzero(y == k) for k in range(len(names))]
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.array([by[k][rng.integers(len(by[k]))] for k in rng.integers(len(names), size=batch)])
        size = int(rng.choice([12, 32, SEGMENT // 2]))  # short texts are learned too
        at = int(rng.integers(0, SEGMENT - size + 1)) if step % 2 else 0
        _, g = net.gradients(np.ascontiguousarray(seg[pick, at : at + size].T), y[pick], np.ones(batch, np.float32))
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.02 * min(1.0, 3 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v * v
            net.w[k] = (net.w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


class _Predict:
    def __init__(self, sent):
        self.sent = sent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = self.sent.value
        for b in batches:
            raw, offsets = K.buffers(b.column("text"))
            total = np.zeros((len(offsets) - 1, len(net.labels)))
            for i, j in K.groups(offsets, SEGMENT * _GROUP):
                total[i:j] = pooled(net, raw, offsets[i : j + 1])
            sums = total.sum(axis=1)
            best = total.argmax(axis=1)
            score = np.where(sums > 0, total[np.arange(len(best)), best] / np.maximum(sums, 1e-30), 0.0)
            lang = [net.labels[k] if s > 0 else "und" for k, s in zip(best, sums)]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], [*names, "lang_pred", "score"])


def pooled(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the label probabilities over the letter bytes of each row."""
    size = np.diff(offsets)
    many = -(-size // SEGMENT)
    row = np.repeat(np.arange(len(size)), many)
    k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = offsets[:-1][row] + k * SEGMENT
    length = np.minimum(offsets[1:][row] - start, SEGMENT)
    out = np.zeros((len(size), len(net.labels)))
    group = max(1, _GROUP * 64 // max(64, len(net.labels)))
    for a in range(0, len(row), group):
        s, n = start[a : a + group], length[a : a + group]
        order = np.argsort(-n, kind="stable")  # full segments first, so that short ones end early
        s, n, to = s[order], n[order], row[a : a + group][order]
        for lo, hi in _even(n):
            steps = int(n[lo])
            at = np.arange(steps)[:, None]
            seg = raw[np.minimum(s[lo:hi] + at, len(raw) - 1)]
            seg[at >= n[lo:hi]] = 0
            p = net.probabilities(seg, n[lo:hi])
            p *= _LETTER[seg][:, :, None]
            np.add.at(out, to[lo:hi], p.sum(axis=0, dtype=np.float64))
    return out


def _even(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of falling lengths in which none is under half of the first."""
    i = 0
    while i < len(n):
        j = int(np.searchsorted(-n, -(n[i] // 2), "left")) if n[i] > 16 else len(n)
        yield i, max(j, i + 1)
        i = max(j, i + 1)


def labelled(documents: DataFrame, *, text: str, lang: str, key, rows: int, slices: int) -> tuple[list[bytes], list[str]]:
    """The sample: of each language about ``rows`` rows, by a hash of key and text (rows equal in both are one), and of each ``slices`` slices of 128
    bytes at hashed places of the whole text. Every language is in it. Where they would have more than ALL_ROWS rows
    together, each aims at an equal part of these, a row at least."""
    t = F.col(f"`{text}`")
    df = documents.select(
        F.col(f"`{lang}`").cast("string").alias("lang"), key.cast("string").alias("key"), t.cast("binary").alias("text")
    ).where(F.col("lang").isNotNull() & (F.length("text") > 0)).withColumn("th", F.xxhash64("text"))
    luck = F.pmod(F.xxhash64(F.lit("sample"), "key", "th"), F.lit(1 << 40)) / float(1 << 40)
    counts = df.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.min(luck).alias("least")).collect()  # a row for each language
    if not counts:
        return [], []
    rows = min(rows, max(1, ALL_ROWS // len(counts)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(1.0, rows / r["count"])))])
    least = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(r.least))])
    at = [F.pmod(F.xxhash64(F.lit(i), "key", "th"), F.greatest(F.length("text") - SEGMENT + 1, F.lit(1))) + 1 for i in range(slices)]
    got = df.where((luck < share[F.col("lang")]) | (luck <= least[F.col("lang")])).select(
        "lang", "key", F.array(*[F.substring("text", a.cast("int"), F.lit(SEGMENT)) for a in at]).alias("s")
    ).distinct()
    picked = sorted(((r.lang, r.key or "", tuple(bytes(x) for x in r.s)) for r in got.collect()))
    return [x for _, _, s in picked for x in s], [lang for lang, _, s in picked for _ in s]


def identify(
    documents: DataFrame, *, id_col: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None, network: Network | None = None, rows: int = SAMPLE_ROWS, slices: int = SLICES,
) -> DataFrame:
    """Every row with held_out, lang_pred and score (the pooled probability of lang_pred).

    A network is trained, unless one is given, on rows with a language whose crc32(id as text) mod 4 isn't 2, and on every
    language of these; held_out marks those with 2. Prediction uses the text alone. Null texts and texts without a letter: ``und``, score 0; so are
    all rows where there is nothing to learn from. A null id isn't held out. Repeated rows get equal results. Columns
    with the names above give way.
    """
    spark = documents.sparkSession
    ship(spark)
    own = ["held_out", "lang_pred", "score"]
    kept = without(documents if keep is None else documents.select(*[f"`{c}`" for c in keep]), *own).columns
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    if network is None:
        seen, names = labelled(documents.where(~held), text=text, lang=lang, key=F.col(f"`{id_col}`"), rows=rows, slices=slices)
        network = train(seen, names) if seen else None
    t = F.col(f"`{text}`")
    letters = F.coalesce(t.rlike(r"\p{L}"), F.lit(False))
    df = documents.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], held.alias("held_out"), letters.alias("letters"), t.alias("text"))
    if network is None:
        out = df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    else:
        types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.drop("text").schema) + ", lang_pred string, score double"
        out = df.mapInArrow(_Predict(spark.sparkContext.broadcast(network)), types)  # a network is about 50 kB
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "held_out", F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
    )
