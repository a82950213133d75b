"""The pipeline's stages against brute force on the smallest tables."""

import numpy as np
import pytest

import corpus_pipeline as P
from skyledger.llm.near_dedup import keep_one
from skyledger.llm.quality import base_failed, quality_rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, f) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        f(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.toPandas(), after.toPandas()))
        docs = after
    return out


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def first_of_groups(texts, ids, least=0.8):
    sets, own = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            short, long = sorted((len(sets[i]), len(sets[j])))
            if short >= least * long and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                own[a] = b
    least_id = {}
    for i, d in enumerate(ids):
        least_id[find(i)] = min(d, least_id.get(find(i), d))
    return set(least_id.values())


def test_columns_stay(stages):
    for _, before, after in stages[:-1]:
        assert list(before.columns) == list(after.columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(spark, stages):
    _, before, after = stages[0]
    judged = quality_rules(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(after.doc_id) == {r.doc_id for r in judged.where("kept").collect()}
    failed = {r.doc_id for r in judged.where(base_failed()).collect()}
    assert failed and not failed & set(after.doc_id) and len(after) > 0.5 * len(before)


def test_toxicity_stage(spark, stages):
    _, before, after = stages[1]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").toxic
    clean = [i for i in before.doc_id if labels.get(i) == 0]
    assert len(set(clean) - set(after.doc_id)) <= 0.1 * len(clean)


def test_near_duplicate_stage(stages):
    _, before, after = stages[2]
    want = first_of_groups(before.text, before.doc_id)
    got = set(after.doc_id)
    assert len(got) == len(after)
    assert got == want  # the links are exact, whatever proposes them


def test_mixing_stage(stages):
    _, before, after = stages[3]
    words = lambda d: d.text.map(lambda t: len((t or "").encode().split()))
    assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() <= 2
    assert words(after).sum() <= 1.5 * words(before).sum() and words(after).sum() >= 1.5 * words(before).sum() - words(before).max()


def test_packing_stage(stages):
    _, before, after = stages[4]
    assert after.groupby("sequence_id").length.sum().max() <= 2048
    assert sorted(after[after.piece == 0].doc_id) == sorted(before.doc_id)
    part = after.sort_values(["sequence_id", "offset"])
    assert (part.groupby("sequence_id").length.cumsum() - part.length == part.offset).all()
    assert after.sequence_id.nunique() <= np.ceil(after.length.sum() / 2048) * 1.05 + 1


def test_awkward_rows(spark):
    rows = [
        (1, "a b c d e f g h i j k l m n o p q r s t"), (2, "a b c d e f g h i j k l m n o p q r s t"), (3, None), (4, ""), (5, "   "), (None, "a b c d e f g h i j k l m n o p q r s t"),
        (6, "something else altogether, with other words in it, and more of them still"), (6, "something else altogether, with other words in it, and more of them still"), (7, "word " * 30_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(df).collect()) == [1, 3, 6, 7]
    assert keep_one(df.limit(0)).count() == 0


def test_big_families_lose_what_is_near_a_leader(spark, monkeypatch):
    from skyledger.llm import near_dedup

    monkeypatch.setattr(near_dedup, "PAIRED", 8)
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 400)]
    rows = []
    for i in range(30):
        w = list(base)
        w[rng.integers(0, 400)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"w{k}" for k in rng.integers(0, 10**6, 300))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(df).collect()) == [0, *range(100, 120)]


def test_odd_column_names_pass_through(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(80)), "s", 1, 2)], "doc_id long, text string, source string, `n words` int, copies int")
    assert P.mixture(spark, df, SF).columns == df.columns
    assert P.quality(spark, df, SF).columns == df.columns


def edited(rng, base, n, mark):
    """The words with ``n`` of them changed."""
    w = list(base)
    for k, at in enumerate(rng.choice(len(w), n, replace=False)):
        w[at] = f"{mark}-{k}"
    return w


def kept_and_wanted(spark, texts):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id for r in keep_one(df).collect()}, first_of_groups([" ".join(w) for w in texts], range(len(texts)))


def test_copies_of_an_original_that_is_no_leader(spark):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 400)]
    got, want = kept_and_wanted(spark, [*[edited(rng, base, 7, f"x{i}") for i in range(150)], base])
    assert got == want == {0}


@pytest.mark.parametrize("paired", [4, 64])
def test_chain_whose_ends_are_not_near(spark, monkeypatch, paired):
    from skyledger.llm import near_dedup

    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    rng = np.random.default_rng(2)
    w = [f"w{k}" for k in rng.integers(0, 10**6, 400)]
    texts = [list(w)]
    for i in range(1, 25):  # each is near its neighbours alone
        w[16 * i - 8] = f"x{i}-0"
        w[16 * i - 2] = f"x{i}-1"
        w[16 * i + 4] = f"x{i}-2"
        texts.append(list(w))
    got, want = kept_and_wanted(spark, texts)
    assert got == want == {0}


def test_passages_added_and_blocks_replaced(spark):
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{k}" for k in rng.zipf(1.3, n) % 10**6]
    texts = []
    for _ in range(60):
        base, block = words(400), words(70)
        texts += [base, base + block, words(400)]
        texts += [texts[-1][:180] + words(30) + texts[-1][210:]]
    got, want = kept_and_wanted(spark, texts)
    assert got == want and len(want) < 150


def test_near_copies_without_ids(spark):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 300)]
    df = spark.createDataFrame([(None, " ".join(w)) for w in (base, edited(rng, base, 1, "x"), edited(rng, base, 1, "y"))], "doc_id long, text string")
    assert keep_one(df).count() == 1
