"""Packing by least squares: solver, levels, pouring, and every piece of the operator against the tokenizer."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from skyledger.llm import window_packing as P
from skyledger.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, length long, copy string"
POWERS = {1 << k for k in range(13)}


def padding(sequences, capacity=4096):
    return sum(0 if n in POWERS else capacity - n for n in sequences)


def test_combinations_fill_the_window_once_each():
    parts, matrix = P.combinations(12, 3)
    want = {tuple(sorted((a, b, 12 - a - b), reverse=True)) for a in range(13) for b in range(13 - a)}
    assert sorted(parts) == sorted(tuple(x for x in w if x) for w in want) and len(set(parts)) == len(parts)
    assert (np.arange(1, 13) @ matrix == 12).all() and (matrix.sum(0) == [len(p) for p in parts]).all()


def test_least_squares_meets_its_conditions():
    """No negative entry, no gradient that an entry could follow, and none at entries in use."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * 10
        x = P.least_squares(a, b)
        gain = a.T @ (b - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max(initial=0) < 1e-6


@pytest.mark.parametrize("kind", ["short", "mixed", "same", "awkward", "few", "one"])
def test_every_token_once_and_little_padding(kind):
    rng = random.Random(kind)
    lengths = {
        "short": [rng.randrange(1, 200) for _ in range(6000)], "mixed": [min(4095, int(rng.lognormvariate(6, 1)) + 1) for _ in range(4000)],
        "same": [300] * 2000, "awkward": [3000] * 500, "few": [100, 4095, 7], "one": [1],
    }[kind]
    out = P.pack_lengths(lengths, 4096)
    seen, cut = defaultdict(list), 0
    for own in out:
        assert 0 < sum(n for *_, n in own) <= 4096
        for i, at, n in own:
            seen[i].append((at, n))
            cut += n < lengths[i]
    for i, n in enumerate(lengths):
        ends = 0
        for at, m in sorted(seen[i]):
            assert at == ends and m > 0
            ends += m
        assert ends == n
    assert padding([sum(n for *_, n in own) for own in out]) <= sum(lengths) / 400
    if kind in ("short", "mixed"):
        assert padding([sum(n for *_, n in own) for own in out]) <= sum(lengths) / 2000 and cut < 0.6 * len(out)  # plain chunking cuts about one document a sequence


def test_pieces_equal_the_tokenizer(spark):
    rng = random.Random(1)
    words = "the quick brown fox it's 42 Zürich naïve 東京 jumps don't over".split()
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 5, 50, 300, 900]))) for _ in range(300)] + [" ".join(rng.choices(words, k=20_000))] * 3
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, None), (900, None), (901, ""), (5, texts[5]), (5, texts[5]), (None, "a b")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    path = tokenizer("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    own = [(i, np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows]
    out = P.pack_windows(df, path, group_pieces=120).collect()
    known, places, docs = defaultdict(list), defaultdict(list), defaultdict(int)
    for i, ids in own:
        known[i].append(ids)
        docs[i] += len(ids)
    for r in out:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32 for ids in known[r.doc_id])
        places[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id] -= r.length
    assert not any(docs.values())
    for own in places.values():
        ends = 0
        for at, n in sorted(own):
            assert at == ends
            ends += n
        assert ends <= 4096
    total = sum(r.length for r in out)
    assert padding([sum(n for _, n in own) for own in places.values()]) <= total / 400


def test_empty_table(spark):
    out = P.pack_windows(spark.createDataFrame([], SCHEMA), tokenizer("word_bpe_49k.json"))
    assert out.collect() == [] and out.columns == "doc_id start length ids_crc32 doc_tokens sequence_id offset".split()
