"""Each corpus operator on a small table that holds the awkward rows, against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyledger.llm.lm import lm_scores
from skyledger.llm.mixing import MIX_SQL, mix
from skyledger.llm.neighbours import Index, nearest
from skyledger.llm.packing import best_fit, pack_documents
from skyledger.llm.quality import IsolationForest, quality_rules, rule_statistics, statistics
from skyledger.llm.queries import tokenizer
from skyledger.llm.sharding import shard_documents
from skyledger.llm.simhash import VantageTree, fingerprint, forest, links, simhash_near_duplicates
from skyledger.llm.token_counts import LengthCache, token_counts
from skyledger.llm.toxicity import toxicity
from skyledger.llm.urls import propagate, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, copies string"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "Ünïcode", "naïve", "x1", "—", "42", "don't"]


def make_rows() -> list[tuple]:
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(WORDS, int(n))) + (".\nA line that several of the documents share, long enough to be a link between them.\n" if k % 9 == 0 else "") for k, n in enumerate(rng.integers(1, 160, 60))]
    texts += [None, "", "   \n\t ", texts[0], texts[0], texts[3] + " more", "word " * 20_000, "a\x85b\xa0 c\x1cd  e\u3000f", "<|endoftext|> and <|startoftext|>", "You are an idiot, you loser!!"]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 1, "x", "y") for i, t in enumerate(texts)]
    return [*rows, (None, "no id here", None, None, None, None, None), rows[5], rows[5]]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(60)] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def text_of(rows):
    return [(r[0], r[1] or "") for r in rows]


def test_shards(docs, rows, empty):
    got = shard_documents(docs, 4).toPandas()
    assert Counter(zip(got["size"], got.text_crc32, strict=True)) == Counter((len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t in text_of(rows))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = got[got["size"] < 50_000].groupby("shard")["size"].sum()
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    small = shard_documents(docs.where("doc_id < 60"), 4).toPandas().groupby("shard")["size"].sum()
    assert small.max() - small.min() < 0.15 * small.mean() and len(sizes)
    assert shard_documents(empty).count() == 0


def test_equal_texts_stay_in_one_shard(spark, monkeypatch):
    rng = np.random.default_rng(9)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    lines = [word(70) for _ in range(12)]
    texts = [f"{word(int(n))}\n{lines[k % 12] if k % 3 else ''}" for k, n in enumerate(rng.integers(20, 300, 400))]
    texts += [word(200)] * 60 + [word(90)] * 200 + [word(int(n)) for n in (1, 1, 40) for _ in range(20)] + [word(400)] * 300  # the last is larger than a shard
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = shard_documents(df, 4).toPandas()
    total, by = got["size"].sum(), got.groupby("shard")["size"].sum()
    assert by.max() - by.min() < 0.03 * total / 4
    groups = got.groupby("text_crc32").agg(shards=("shard", "nunique"), size=("size", "sum"))
    assert (groups[groups["size"] <= total / 4].shards == 1).all() and groups[groups["size"] > total / 4].shards.iloc[0] > 1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    monkeypatch.setattr("skyledger.llm.sharding.BUCKET_ROWS", 20)  # hot links are dealt over buckets
    small = shard_documents(df, 4).toPandas()
    assert (small.groupby("text_crc32").shard.nunique()[groups[groups["size"] <= total / 4].index] == 1).all()


def test_token_counts(docs, rows, empty):
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = Counter((i, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in text_of(rows))
    got = token_counts(docs, tokenizer("byte_bpe_50k.json")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts(empty, tokenizer("byte_bpe_50k.json")).count() == 0


def test_token_counts_of_odd_white_space():
    cache, rng = LengthCache.of(tokenizer("byte_bpe_50k.json")), np.random.default_rng(1)
    alphabet = list(" \t\n\r\x0b\x0c\x1c\x1d\x85\xa0\u2003\u3000") + ["a", "B", "é", "1", "!", "'s", "'", "中", "\u0301", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, 40)) for _ in range(400)]
    assert cache.counts(texts) == [len(cache.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_packing(docs, rows, empty):
    t, got = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), pack_documents(docs, tokenizer("word_bpe_49k.json"), 64).toPandas()
    want = Counter()
    for i, x in text_of(rows):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            want[(i, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes()))] += 1
    key = lambda r: (None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, got.itertuples())) == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert (part.offset.to_numpy() == np.append(0, part.length.cumsum()[:-1])).all() and part.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.02 * math.ceil(got.length.sum() / 64) + 1
    assert pack_documents(empty, tokenizer("word_bpe_49k.json")).count() == 0


def test_word_ids_of_odd_white_space(monkeypatch):
    from skyledger.llm.packing import WordIds

    coder, rng = WordIds.of(tokenizer("word_bpe_49k.json")), np.random.default_rng(2)
    alphabet = list(" \t\n\r\x0b\x0c\x1c\x85\xa0\u3000") + ["a", "B", "É", "e\u0301", "Σ", "İ", "Ɓ", "ŸŒ", "×÷", "1", "!", "'s", "'ll", "中", "\u0301", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, 30)) for _ in range(400)]
    want = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, edges = coder.encode(pa.array([t.encode() for t in texts], pa.binary()))
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == want
    monkeypatch.setattr("skyledger.llm.packing.RUN_BYTES", 50)  # a long text is cut at white space
    assert coder.encode_long(" ".join(texts).encode()).tolist() == coder.tokenizer.encode(" ".join(texts), add_special_tokens=False).ids
    monkeypatch.setattr("skyledger.llm.packing.KEPT_WORDS", 100)  # the words used least go
    coder.encode(pa.array([t.encode() for t in texts], pa.binary()))
    coder.shrink()
    assert len(coder.words) == 50
    ids, edges = coder.encode(pa.array([t.encode() for t in texts], pa.binary()))
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == want


def test_best_fit_takes_the_tightest_bin():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 65, 500))[::-1]
    where, offset = best_fit(lengths, 64)
    rooms: list[int] = []
    for n in lengths:  # the plain algorithm
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(64 - n)
    filled = np.bincount(where, lengths)
    assert sorted(64 - filled) == sorted(rooms) and (offset >= 0).all()


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 8)).astype("float32")
    vectors[50:60] = vectors[40]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    odd = [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] * 8, 0), (1060, [1.0, None] * 4, 0), (1080, [1.0] * 3, 0), (None, [1.0] * 8, 0), rows[20], (1100, [float("inf")] * 8, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    got = nearest(df).toPandas()
    v, hits = vectors.astype(float), 0
    for q in range(0, 400, 20):
        s = (v * v[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        mine = got[got.query_id == q].sort_values("rank")
        hits += len(set(want) & set(mine.vec_id))
        assert list(mine["rank"]) == list(range(1, 21))
        assert np.allclose(mine.score, s[mine.vec_id], rtol=1e-12)
        assert list(zip(-mine.score, mine.vec_id, strict=True)) == sorted(zip(-mine.score, mine.vec_id, strict=True))
    assert set(got.query_id) == set(range(0, 400, 20)) and hits >= 0.97 * 400
    few = nearest(df.where("vec_id < 5")).toPandas()
    assert len(few) == 4 and nearest(df.where("vec_id < 0")).count() == 0


def test_neighbours_in_cells_and_chunks(spark, monkeypatch):
    from skyledger.llm import neighbours

    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 50)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    v = np.random.default_rng(5).normal(size=(600, 16))
    got = nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).toPandas()
    hits = sum(len({i for i in np.argsort(-(v @ v[q])) if i != q and True} & set(got[got.query_id == q].vec_id) & set([i for i in np.argsort(-(v @ v[q])) if i != q][:20])) for q in range(0, 600, 20))
    assert hits >= 0.9 * 600


@pytest.mark.parametrize("kind", ["near copies", "few large components", "three components", "queries of another kind"])
def test_neighbours_where_codes_tell_little(spark, monkeypatch, kind):
    from skyledger.llm import neighbours

    rng = np.random.default_rng(8)
    n = 6000
    x = rng.normal(size=(n, 3 if kind == "three components" else 32))
    if kind == "near copies":
        centres = rng.normal(size=(4, 32))
        x = centres[rng.integers(0, 4, n)] + 0.01 * x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "few large components":
        x *= np.arange(1, 33) ** -1.5
    elif kind == "queries of another kind":
        monkeypatch.setattr(neighbours, "CHUNK_ROWS", 500)
        asked = rng.normal(size=(n, 32))
        x = np.where((np.arange(n) % 20 == 0)[:, None], asked, 0.3 * x + rng.normal(size=(30, 32))[rng.integers(0, 30, n)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    hit = total = 0
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, n, 20):
        exact = x @ x[q]
        exact[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-exact, kind="stable")[:20].tolist()))
        total += 20
    assert hit / total > (0.95 if kind == "queries of another kind" else 0.999)


def test_anisotropic_codes_favour_the_parallel_error():
    v = np.random.default_rng(6).normal(size=(800, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = Index(v, 1, 20)
    rest, unit = index.split(v)
    codes = index.assign(rest, unit)
    plain = np.stack([((rest[:, m, None] - index.books[m]) ** 2).sum(2).argmin(1) for m in range(index.parts)], 1)
    along = lambda c: np.abs(sum(((rest[:, m] - index.books[m][c[:, m]]) * unit[:, m]).sum(1) for m in range(index.parts))).mean()
    assert along(codes) < along(plain)


def test_mixing(docs, rows, empty):
    once = docs.dropDuplicates(["doc_id"])
    got = mix(once).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    c = duckdb.connect()
    c.register("documents", once.toArrow())
    want = c.execute(MIX_SQL).df()
    order = lambda d: d.sort_values(["doc_id", "size"]).reset_index(drop=True)[["doc_id", "size", "source_size", "target", "taken"]].astype(float)
    pd.testing.assert_frame_equal(order(got), order(want))
    again = mix(docs).toPandas()
    assert len(again) == len(rows) and (again.taken <= 2 * again["size"]).all()
    assert mix(empty).count() == 0 and set(mix(docs.where("text is null")).toPandas().taken) == {0}


def test_url_rules(spark):
    cases = {
        "http://A.Example.com/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"), "https://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "x://shop.net/de/": ("shop.net", "/de/", "net/de/", "block"), "x://example.net/de/81#q": ("example.net", "/de/81", "example.net/de/8", "block"), "x://examplecom/en/": ("examplecom", "/en/", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://host.org": ("host.org", "", None, "allow"), "http://big-casino.org/x": ("big-casino.org", "/x", None, "block"),
        "http://friend.org/a": ("friend.org", "/a", None, "block"), "http://ÄB.Org/es/": ("Äb.org", "/es/", "org/es/", "block"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    html = {"http://friend.org/a": '<a href="http://big-casino.org/1">x</a> <a href=\'/own\'>y</a>'}
    df = spark.createDataFrame([(i, u, html.get(u)) for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter(df.limit(0)).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    urls = {"x://net/de/": "allow", "x://shop.net/de/9": "allow", "x://casino.net/de/": "allow", "x://a.example.net/de/8": "block", "x://a.com/en/1": "block", "x://example.com/en/7": "allow", "x://a.org/es/": "block"}
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert [r.verdict for r in url_filter(df).orderBy("page_id").collect()] == list(urls.values())


@pytest.mark.parametrize("pull", [False, True])
def test_page_rank_follows_the_plain_iteration(spark, pull):
    """Shares of the host that gives, and of the one that receives, as the operator uses them."""
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("d", "a", 1)]
    seeds = {("trust", "a"): 1.0, ("distrust", "c"): 1.0}
    rank = propagate(spark.createDataFrame([(*k, v) for k, v in seeds.items()], "kind string, host string, seed double"), spark.createDataFrame(edges, "src string, dst string, weight long"), rounds=5, pull=pull)
    want = {}
    for kind in ("trust", "distrust"):
        links_ = [(s, t, w) if kind == "trust" else (t, s, w) for s, t, w in edges]
        out = defaultdict(float)
        for s, t, w in links_:
            out[t if pull else s] += w
        start = {h: 0.15 * v for (k, h), v in seeds.items() if k == kind}
        now = dict(start)
        for _ in range(5):
            after = defaultdict(float, start)
            for s, t, w in links_:
                after[t] += 0.85 * now.get(s, 0) * w / out[t if pull else s]
            now = after
        want |= {(kind, h): v for h, v in now.items() if v}
    got = {(r.kind, r.host): r.rank for r in rank.where("rank > 0").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_farms_are_blocked_whatever_their_size(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(f"http://farm{i}.biz/", link("big-casino.biz")) for i in range(100)] + [(f"http://rule{i}.biz/", link("x.org")) for i in range(30)]
    rows += [("http://big-casino.biz/", None), ("http://second.biz/", link("farm0.biz")), ("http://usual.biz/", link("big-casino.biz", *(f"site{i}.biz" for i in range(30)))), ("http://x.org/es/1", None), ("http://y.org/es/1", None), ("http://y.org/fr", None), ("http://z.biz/", link("y.org"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    blocked = {r.host for r in url_filter(df).where("verdict = 'block'").collect()}
    assert blocked == {*(f"farm{i}.biz" for i in range(100)), *(f"rule{i}.biz" for i in range(30)), "second.biz", "big-casino.biz", "x.org", "y.org"}
    assert {r.verdict for r in url_filter(df).where("host = 'y.org' and path = '/fr'").collect()} == {"allow"}


def test_parts_of_one_site_share_its_standing(spark):
    urls = ["http://www.casino-x.shop.com/", "http://blog.good.site.com/", "http://m.good.site.com/", "http://a.bad.site.org/es/1", "http://b.bad.site.org/fr", "http://other.site.org/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate([*urls, urls[-1]])], "page_id long, url string, html string").withColumn("rank", F.lit(1))
    got = [(r.page_id, r.rule, r.verdict) for r in url_filter(df).orderBy("page_id").collect()]
    assert got == [(0, None, "block"), (1, None, "allow"), (2, None, "allow"), (3, "org/es/", "block"), (4, None, "block"), (5, None, "allow"), (6, None, "allow")]


def test_forest_paths_and_threshold_follow_the_plain_ones():
    from skyledger.llm.quality import best_cut, expected_path

    rng = np.random.default_rng(6)
    usual, odd = rng.normal(0, 1, (300, 3)), rng.normal(4, 1, (40, 3))
    forest = IsolationForest(usual, np.concatenate([usual, odd]), trees=20, sample=64)
    seen = np.concatenate([usual, odd])
    want = []
    for x in np.clip(seen, forest.low, forest.high):
        depths = []
        for f, t, path in zip(forest.feature, forest.threshold, forest.path, strict=True):
            i = 0
            while f[i] >= 0:
                i = 2 * i + 1 + int(x[f[i]] > t[i])
            depths.append(path[i])
        want.append(2 ** (-np.mean(depths) / expected_path(64)))
    score = forest.score(seen)
    assert np.allclose(score, want)
    good = np.arange(len(seen)) < 300
    tried = [c for c in sorted(set(score)) if (score[good] <= c).mean() >= 0.9]
    value = lambda c: (score[good] <= c).mean() + (score[~good] > c).mean()
    assert abs(value(best_cut(score, good, 0.9)) - max(map(value, tried))) < 1e-12


def brute_components(prints, ids, bits):
    own = list(range(len(prints)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = find(i), find(j)
                own[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(docs, rows, empty):
    prints = []
    for _, t in text_of(rows):
        w = t.encode().lower().split()
        h = [xxhash.xxh64(b" ".join(w[k : k + 4]), seed=42).intdigest() for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comps = brute_components(prints, [r[0] for r in rows], 4)
    want = Counter((r[0], format(p, "016x"), c) for r, p, c in zip(rows, prints, comps, strict=True))
    got = simhash_near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits, tile", [(4, 40), (7, 10_000), (1, 16)])
def test_vantage_trees_lose_no_link(spark, bits, tile):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, bits + 2), replace=False))) for b in base for _ in range(3)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = links(df, bits, leaf_rows=16, tile_rows=tile).collect()
    index = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    own = list(range(len(fps)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for e in edges:
        assert bin(int(fps[index[e.a]] ^ fps[index[e.b]])).count("1") <= 64
        a, b = find(index[e.a]), find(index[e.b])
        own[max(a, b)] = min(a, b)
    mine = [find(i) for i in range(len(fps))]
    want = brute_components([int(x) for x in fps], list(range(len(fps))), bits)
    assert mine == want


def test_triangle_bound_prunes():
    sample = np.random.default_rng(8).integers(0, 2**63, 4000).astype(np.uint64)
    trees = forest(sample, 4, len(sample), 64)
    assert len(trees) == 3 and all(isinstance(t, VantageTree) for t in trees)
    assert max(len(t.route(sample)[1]) for t in trees) < 0.5 * len(sample) * 2**6
    assert fingerprint([], 4) == 0


def test_quality(docs, rows, labels, empty):
    got = quality_rules(docs, labels).toPandas()
    want = Counter()
    for i, t in text_of(rows):
        w = [x for x in t.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 2 * len(covered) > len(w))] += 1
    key = lambda r: (None if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert Counter(map(key, got.itertuples())) == want
    assert not (got.kept & got.base_failed).any()
    assert quality_rules(docs, labels.limit(0)).where("kept <> (not base_failed)").count() == 0
    assert quality_rules(empty, labels).count() == 0
    assert statistics(b"a b c a b c")[4] == 6


def test_quality_learns_from_every_labelled_row(spark):
    """Bad rows that come last in the order of a hash, behind 20,000 good ones."""
    from skyledger.llm.quality import best_cut, edges, rates

    ids = spark.range(20_200).select(F.col("id").alias("doc_id"), (F.row_number().over(Window.orderBy(F.desc(F.xxhash64("id")))) > 100).cast("int").alias("quality"))
    word = lambda k: F.concat(F.when(F.col("quality") == 0, "#$%A1").otherwise("w"), F.pmod(F.xxhash64("doc_id", k), F.lit(5000)))
    rows = ids.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), word), " ")).localCheckpoint()
    kept = quality_rules(rows.select("doc_id", "text"), rows.select("doc_id", "quality")).join(rows, "doc_id").groupBy("quality", "kept").count().collect()
    kept = {(r.quality, r.kept): r["count"] for r in kept}
    assert kept.get((0, True), 0) == 0 and kept[1, True] >= 0.99 * 20_100
    rng = np.random.default_rng(4)
    score, good, times = np.round(rng.random(300), 2), rng.random(300) < 0.8, rng.integers(1, 9, 300)
    assert best_cut(score, good, 0.9, times) == best_cut(np.repeat(score, times), np.repeat(good, times), 0.9)
    stats = rows.where("doc_id < 500").select("doc_id", "text")
    stats = rule_statistics(stats, "doc_id")
    low, high = edges(stats, 0.1, 0.9)
    want = np.quantile(rates(stats.toPandas()), [0.1, 0.9], axis=0)
    assert np.allclose([low, high], want, rtol=0.01, atol=1e-9)


def test_isolation_forest_finds_what_stands_apart():
    rng = np.random.default_rng(9)
    usual, odd = rng.normal(0, 1, (2000, 5)), rng.normal(7, 1, (20, 5))
    f = IsolationForest(usual, np.concatenate([usual, odd]))
    assert f.score(odd).min() > np.quantile(f.score(usual), 0.99)


def test_toxicity(spark, docs, labels, rows, empty):
    rng = np.random.default_rng(10)
    made = [(i, " ".join(rng.choice(WORDS, 30)) + (" you stupid grobian" if i % 3 == 0 else " dear all"), "en", "s", 1, "", "") for i in range(300)]
    df = spark.createDataFrame(made, SCHEMA)
    marked = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = toxicity(df, marked).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got[got.held_out].predicted == (got[got.held_out].doc_id % 3 == 0)).mean() > 0.95
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    plain = toxicity(docs, labels.limit(0))
    assert plain.count() == len(rows) and toxicity(empty, labels).count() == 0


def test_lm(docs, rows, empty):
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10 == 0 for r in rows]
    tokens = [[*t.encode().lower().split(), b""] for _, t in text_of(rows)]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    got = lm_scores(docs).toPandas()
    want = defaultdict(list)
    for r, t, h in zip(rows, tokens, held, strict=True):
        want[r[0]].append((h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)))
    assert len(got) == len(rows)
    for r in got.itertuples():
        w = want[None if pd.isna(r.doc_id) else int(r.doc_id)][0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))
        assert r.score < 0 and math.isfinite(r.score)
    assert got.score.sum() > got.base_score.sum()
    assert lm_scores(empty).count() == 0


def test_lm_gives_proper_probabilities():
    from skyledger.llm.lm import UNITS, LogBilinear

    rng = np.random.default_rng(11)
    m = LogBilinear(rng.integers(0, (UNITS + 1) ** 2 * UNITS, 5000), np.ones(5000), steps=20)
    assert np.allclose((10.0 ** m.table().astype(float)).sum(1), 1, atol=1e-4)


def test_lm_scores_follow_the_plain_sum(spark):
    """Every token's probability from the model's vectors and the counts, one by one; over the whole vocabulary they add up to 1."""
    from skyledger.llm import lm

    rng = np.random.default_rng(12)
    words = [f"{a}{b}{c}" for a in "abcde" for b in "xyz" for c in ("ing", "ed", "er", "o", "um")] + [f"w{i}ing" for i in range(90)]
    rows = [(i, " ".join(rng.choice(words, 30, p=np.arange(len(words), 0, -1) / sum(range(len(words) + 1))))) for i in range(80)]
    learnt = [t.encode().split() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in learnt for w in [*t, b""])
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    known = lm.Vocabulary(lm.word_counts(lm.with_text(texts.where(lm.crc32_mod(F.col("doc_id"), 10) != 0))))
    runs = Counter()
    for t in learnt:
        unit = np.append(known.read(t)[1], 0)
        runs.update((lm.contexts(unit) * lm.UNITS + unit).tolist())
    code = np.array(sorted(runs))
    model = lm.LogBilinear(code, np.array([runs[k] for k in code], float))
    units = [b"", *[w for w, _ in sorted(counts.items(), key=lambda p: (-p[1], p[0])) if w][: lm.WORD_UNITS - 1]]

    def log10p(word, one, two):
        h = model.r[0][one].astype(float) @ model.c[0] + model.r[1][two].astype(float) @ model.c[1]
        s = model.q.astype(float) @ h + model.b
        s -= np.log(np.exp(s).sum())
        if word in units:
            return s[units.index(word)] / math.log(10)
        unit = known.class_of(word)
        mates = [w for w in counts if w not in units and known.class_of(w) == unit]
        return s[unit] / math.log(10) + math.log10((counts[word] + 0.1) / (sum(counts[w] for w in mates) + 0.1 * (len(mates) + 1)))

    of = lambda w: units.index(w) if w in units else known.class_of(w)
    got = {r.doc_id: r.score for r in lm_scores(texts).collect()}
    for i, t in rows[:12]:
        own = [*t.encode().split(), b""]
        before = [lm.UNITS, lm.UNITS, *map(of, own)]
        assert abs(got[i] - sum(log10p(w, before[k + 1], before[k]) for k, w in enumerate(own))) < 1e-3 * len(own)
    total = sum(10 ** log10p(w, of(b"axing"), of(b"eyo")) for w in counts)
    assert 0.9 < total < 1 + 1e-6  # what is left is kept for unknown words
