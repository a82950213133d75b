"""Near-duplicates: bitmaps that lose no pair, tiles of hot shingles, and whole groups against brute force."""

import random

import numpy as np
import pyarrow as pa

from skyledger.llm import near_dedup as N

SCHEMA = "doc_id long, text string, id string, bits long"


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def near(x, y, least=0.8):
    return len(x & y) >= least * len(x | y) - 1e-9


def edited(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def corpus(seed, groups=12, copies=6):
    """Groups whose members are edited from their first, appended to, or cut; a common start for all."""
    rng, out = random.Random(seed), []
    head = [f"h{k}" for k in range(12)]
    for _ in range(groups):
        base = head + [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 30, 80, 300]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(copies)):
            kind = rng.randrange(3)
            more = [f"z{rng.randrange(999)}" for _ in range(int(len(base) * rng.choice([0.1, 0.2, 0.3])))]
            out.append(" ".join(edited(rng, base, rng.choice([0.005, 0.02, 0.05])) if kind == 0 else base + more if kind == 1 else base[: int(len(base) * rng.choice([0.7, 0.85, 0.95]))]))
    return out


def test_bitmaps_lose_no_near_pair_and_drop_most_others(spark):
    texts = corpus(3, groups=20)
    width = 5
    row, code = N.shingle_hashes(pa.array([t.encode() for t in texts], pa.binary()), width)
    known = [set(code[row == k].tolist()) for k in range(len(texts))]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, text string")
    maps = {r.id: r for r in N.parity_maps(df, width).collect()}
    assert all(maps[k].n == len(s) and 64 * len(maps[k].bits) >= len(s) for k, s in enumerate(known))
    left = {(r.a, r.b) for r in N.possible(spark.createDataFrame(pairs, "a long, b long"), N.parity_maps(df, width), 0.8).collect()}
    truth = {(a, b) for a, b in pairs if near(known[a], known[b])}
    assert truth and truth <= left
    far = [p for p in pairs if not near(known[p[0]], known[p[1]], 0.5) and min(len(known[p[0]]), len(known[p[1]])) > 30]
    assert sum(p in left for p in far) <= len(far) / 100


def test_a_common_passage_makes_no_pairs_of_texts_that_differ_elsewhere(spark):
    passage = " ".join(f"p{k}" for k in range(89))  # 85 shingles; 15 more are of one text alone, and prefixes hold 21
    texts = [(k, 0, passage + "".join(f" own{k}x{j}" for j in range(15))) for k in range(60)]
    near = [(60 + k, 0, passage + "".join(f" near{j if j < 14 else k}" for j in range(15))) for k in range(3)]
    df = spark.createDataFrame(texts + near, "id long, apart long, text string")
    met = N.meetings(df, 5, 0.8, 63)
    assert {(r.a, r.b) for r in met.collect()} == {(60, 61), (60, 62), (61, 62)}
    assert {(r.a, r.b) for r in N.candidates(df, 5, 0.8, 63).collect()} == {(60, 61), (60, 62), (61, 62)}


def test_groups_equal_brute_force(spark, monkeypatch):
    """With tiles, blocks and leaders so small that every path is taken (the pipeline's test has the real constants)."""
    for name, value in {"TILE": 3, "LONE": 1, "BLOCK": 2, "PAIRED": 2, "FEW": 1, "SMALL": 5, "HELD": 10}.items():
        monkeypatch.setattr(N, name, value)
    texts = [*corpus(8, groups=8), "", None, "same words here and nothing else at all", "same words here and nothing else at all", "w " * 3000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if near(sets[a], sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(r.doc_id for r in N.keep_one(df).collect()) == sorted({find(k) for k in range(len(texts))})


def test_parity_of_long_and_short_texts():
    row = np.repeat(np.arange(3), [1, 64, 1000])
    code = np.random.default_rng(1).integers(-(2**62), 2**62, len(row))
    bits = N.parity_bits(row, code, 4).to_pylist()
    assert [len(b) for b in bits] == [1, 1, 16, 1] and bits[3] == [0] and sum(x.bit_count() if x >= 0 else (x + 2**64).bit_count() for x in bits[0]) == 1
    fold = [np.bitwise_xor.reduce(np.array(bits[2], "<i8").reshape(-1, n), axis=0) for n in (8, 1)]
    for own in fold:
        want = np.zeros(64 * len(own), int)
        np.add.at(want, code[row == 2].view(np.uint64) & np.uint64(64 * len(own) - 1), 1)
        assert (np.unpackbits(own.view(np.uint8), bitorder="little") == want & 1).all()
