import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from strataport.llm.packing import Schedule, pack, sequences
from strataport.llm.token_files import TokenFiles, write_token_files
from strataport.llm.tokens import default_path, encoder

pytest.importorskip("public_tokenizers")
PIECES = ["a", "the", " ", "  ", "\n", " \n", "'s", "12", "é", "é", "漢", " ", "\t", "!", "<|endoftext|>", "\x00", ".", "😀", "’", "don't", "я", " "]
DOCS = [(5, "Hello there, world.", "a"), (1, None, "a"), (3, "", None), (2, "x " * 3000, "b"), (2, "twice", "b"), (2, "twice", "b"), (None, "no id", "a"), (7, "end\n", "b")]


def ids(text):
    return encoder(default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_chunks_give_the_ids_of_the_whole_text():
    rng, enc = random.Random(1), encoder(default_path())
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))
        assert np.frombuffer(enc.ids(text), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_files(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(3)
    files = write_token_files(df)
    got = [tuple(r) for r in TokenFiles.open(files.folder).read(spark).orderBy("start").collect()]
    want, start = [], 0
    hashed = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    for i, t in sorted(((d[0], d[1]) for d in DOCS), key=lambda d: (d[0] is not None, d[0] or 0, hashed(d[1]))):
        x = np.array(ids(t), "<u4")
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert got == want
    assert write_token_files(df.limit(0)).read(spark).count() == 0


def check_pieces(docs, pieces, length):
    """Every id of every document in one piece, in order; sequences without gaps."""
    seen = defaultdict(list)
    for p in pieces:
        seen[p.sequence_id].append((p.offset, p.length))
    for s, at in seen.items():
        end = 0
        for o, n in sorted(at):
            assert o == end and n > 0
            end += n
        assert end == length or s == max(seen)
    assert sorted(seen) == list(range(len(seen)))
    left = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        left[p.doc_id].append(p)
    for i in {d[0] for d in docs}:
        texts = [np.array(ids(d[1]), "<u4") for d in docs if d[0] == i]
        assert sum(map(len, texts)) == sum(p.length for p in left[i])
        if len(texts) == 1:
            at = 0
            for p in left[i]:
                assert p.start == at and p.doc_tokens == len(texts[0]) and p.ids_crc32 == zlib.crc32(texts[0][at : at + p.length].tobytes())
                at += p.length


def test_one_repeated_id_fills_several_files(spark):
    rows = [(7, f"text {i}", "s") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join such small ones
    try:
        files = write_token_files(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = TokenFiles.open(files.folder).read(spark).orderBy("start").collect()
    assert len(got) == 400 and len(files.parts) > 1 and sum(r.n_tokens for r in got) == got[-1].start + got[-1].n_tokens


def test_pack(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumnRenamed("source", "source").repartition(3)
    out = pack(df, keep=["doc_id"], length=64, window=256, with_ids=True).cache()
    check_pieces(DOCS, out.collect(), 64)
    whole = sequences(out, 64).orderBy("sequence_id").collect()
    assert all(len(r.ids) == 256 for r in whole) and all(r.n_tokens == 64 for r in whole[:-1])
    assert pack(df.limit(0), keep=["doc_id"]).count() == 0
    for share in (1, 3, 10_000):  # none, some and all sources have a queue of their own
        check_pieces(DOCS, pack(df, keep=["doc_id"], length=64, own_share=share).collect(), 64)


def robin(totals, share, window):
    """Deficit round-robin token by token: what each queue has sent after each window of the first phase."""
    total, sent, out = sum(totals), [0] * len(totals), []
    owed = [Fraction(0)] * len(totals)
    done = 0
    while done < total:
        grant = min(window, total - done)
        for q in range(len(totals)):
            owed[q] += Fraction(share[q], sum(share)) * grant
            n = int(owed[q])
            owed[q] -= n
            sent[q] += n
        done += grant
        out.append(list(sent))
    return out


def test_schedule_is_deficit_round_robin():
    totals, window = [700, 90, 11, 0, 2300], 97
    s = Schedule(totals, None, window)
    assert [s.sent(0, w + 1) for w in range(-(-sum(totals) // window))] == robin(totals, totals, window)
    places = sorted(p + k for q, n in enumerate(totals) for p, m in s.runs(q, 0, n) for k in range(m))
    assert places == list(range(sum(totals)))


def test_targets_hold_until_a_source_ends():
    totals = [1000, 1000, 50]
    s = Schedule(totals, [3, 1, 1], 100)
    first = s.phases[0]
    assert first[2][2] == 50 and abs(first[2][0] - 3 * first[2][1]) <= 3
    places = sorted(p + k for q, n in enumerate(totals) for p, m in s.runs(q, 0, n) for k in range(m))
    assert places == list(range(sum(totals)))


def test_large_sources_keep_their_own_queue(spark):
    docs = [(i, "word " * 40, "big") for i in range(60)] + [(100 + i, "word " * 40, "large") for i in range(60)] + [(200 + i, "few words", f"s{i}") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    out = pack(df, keep=["doc_id", "source"], length=64, window=256, own_share=4).collect()
    check_pieces(docs, out, 64)
    total = sum(p.length for p in out)
    for source in ("big", "large"):
        mine = [p for p in out if p.source == source]
        first = sum(min(p.length, max(0, total // 2 - p.sequence_id * 64 - p.offset)) for p in mine)
        assert abs(first - sum(p.length for p in mine) / 2) < 256
    aimed = pack(df, keep=["doc_id", "source"], length=64, window=256, own_share=4, targets={"big": 3, "large": 1}).collect()
    check_pieces(docs, aimed, 64)
    first = [p for p in aimed if p.sequence_id < 16]
    assert abs(sum(p.length for p in first if p.source == "big") - 768) <= 1 and {p.source for p in first} == {"big", "large"}
