"""Periodic runs against every stretch of every period, and their digests."""

import hashlib
import random

import numpy as np
import pytest

from skyledger.llm import runs as R

SCHEMA = "doc_id long, text string, n_runs long, copy string"


def brute(words: list) -> list[tuple[int, int, int]]:
    """start, length, period of all runs, by comparing every word with the word every period on."""
    best = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def expected(doc_id, text) -> tuple:
    words = (text or "").encode().split()
    n, h = len(words), __import__("zlib").crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(brute(words), key=lambda r: (r[0], r[2]))
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(found), *top, None if not found else 1000 * top[1] // top[2], hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def made(seed: int) -> str:
    rng = random.Random(seed)
    words = [rng.choice("abc") if rng.random() < 0.3 else rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 40))]
    for _ in range(rng.randrange(4)):
        unit = [rng.choice("abxy") for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40]))]
        words += unit * rng.randrange(2, 9) + unit[: rng.randrange(len(unit) + 1)]
        words += [rng.choice("abxyz") for _ in range(rng.randrange(6))]
    return " ".join(words)


@pytest.mark.parametrize("seed", range(150))
def test_tiles_find_every_run(seed, monkeypatch):
    """Also with rows of tiles cut small, whose fragments must touch."""
    words = made(seed).split()
    codes = np.unique(words, return_inverse=True)[1]
    for span in (8, 1 << 15):
        monkeypatch.setattr(R, "SPAN", span)
        held = {}
        for octave, start, places, part in R.tiles(codes):
            for q, a, b in R.fragments(octave, places.tolist(), part.tolist()):
                held.setdefault(q, []).append((start + a, start + b))
        found = {}
        for q, parts in sorted(held.items()):
            whole = []
            for a, b in sorted(parts):
                if whole and a <= whole[-1][1]:
                    whole[-1][1] = max(b, whole[-1][1])
                else:
                    whole.append([a, b])
            for a, b in whole:
                if b - a + q >= max(6, 4 * q):
                    found.setdefault((a, b - a + q), q)
        assert sorted((s, n, q) for (s, n), q in found.items()) == brute(words)


def test_digests_equal_brute_force(spark, monkeypatch):
    """Nulls, empty and very long texts, repeated rows, white space of all kinds, and ids whose words are made to repeat."""
    monkeypatch.setattr(R, "SPAN", 64)
    rows = [(k, made(k)) for k in range(120)] + [(None, "a a a a a a a"), (None, None), (5000, None), (5001, ""), (5002, " \t\n "), (7, made(7)), (7, made(7))]
    rows += [(5003, " ".join("the cat sat on a mat".split() * 900)), (5004, "x\x0by\x0cx\ty\nx\ry x y é é"), (5005, " ".join("aaaaaaaa"))]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in R.run_digests(df).collect()), key=str)
    assert got == sorted(((i, *expected(i, t)) for i, t in rows), key=str)


def test_empty_table(spark):
    out = R.run_digests(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
