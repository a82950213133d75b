"""Keep one document of each near-duplicate group: SimHash links most of them, exact prefixes the rest.

The vantage-point trees over the SimHash of a text's distinct words, at seven bits, propose families, and what is near a
leader of its family is linked at once. Texts of one similarity of shingles can lie further apart, so a prefix-filter
join over the shingles then finds all other pairs, and the exact Jaccard similarity decides. Shingles are hashed anew in each
pass over the texts; only those of texts that are compared are ever written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import durable, release, runs, schema_with, tidy, trim, with_text
from skyledger.llm.components import components
from skyledger.llm.simhash import fingerprints, simhash_components

#: Families in which more than PAIRED texts are near no leader get a further one, up to ROUNDS; this changes the work and not the links.
PAIRED, ROUNDS = 64, 10
#: Shingles of leaders that may be broadcast (8 bytes each).
HELD = 2_000_000
#: Leaders that may be broadcast, texts of a shingle that one tile holds, texts in the sample and shingles told to be common.
FEW, TILE, SAMPLED, COMMON = 1000, 1000, 4000, 200_000
#: Keys that may be broadcast (16 bytes each and some overhead).
SMALL = 1_000_000
#: Pairs of one shingle that are joined with their sets one by one at most, and texts of a block where there are more.
LONE, BLOCK = 4, 128
#: Odd factors that join word hashes to a shingle's and mix its bits.
JOIN, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def bounded(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its row count has been checked to be small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``row, hash`` of every shingle of the lower-cased words, repeats included, in order of rows.

    Each different word is hashed once, and a shingle's hash is made of its words'. Fewer words than a shingle has, or
    none, are one shingle.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    words = lists.flatten().dictionary_encode()
    known = words.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
    which = words.indices.to_numpy()
    if len(known):  # an empty word stands before leading white space
        real = np.fromiter((w != b"" for w in known), bool, len(known))[which]
        row, which = row[real], which[real]
    h, n = of_word[which], np.bincount(row, minlength=len(texts))
    span = np.minimum(np.maximum(n, 1), width)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))  # words from here to the text's end
    start = left >= span[row]
    code = np.zeros(len(h), np.uint64)
    for k in range(width):
        used = np.minimum(np.arange(len(h)) + k, len(h) - 1)
        code = np.where(k < span[row], code * JOIN + h[used], code) if (n < width).any() else code * JOIN + h[used]
    empty = np.flatnonzero(n == 0)
    code = np.append(code[start], np.zeros(len(empty), np.uint64))
    code = (code ^ (code >> np.uint64(29))) * MIX
    code ^= code >> np.uint64(32)
    row = np.append(row[start], empty)
    if len(empty):
        order = np.argsort(row, kind="stable")
        row, code = row[order], code[order]
    return row, code.view(np.int64)


def shingle_sets(docs: DataFrame, width: int, *keep: str) -> DataFrame:
    """The kept columns and ``shingles``: sorted hashes of the distinct shingles of each text."""
    schema = schema_with(docs, keep, "shingles array<long>")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows, texts in runs(batches):
            row, code = shingle_hashes(texts, width)
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            new = np.append(True, (np.diff(row) != 0) | (np.diff(code) != 0)) if len(row) else np.zeros(0, bool)
            ends = np.append(0, np.cumsum(np.bincount(row[new], minlength=len(texts))))
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[new]))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], sets], names=[*rows.schema.names[:-1], "shingles"])
        trim()

    return with_text(docs, *keep).mapInArrow(measure, schema)


def similarity(x: str, y: str) -> Column:
    """Exact Jaccard similarity of two columns of distinct values."""
    shared = F.size(F.array_intersect(x, y))
    return shared / (F.size(x) + F.size(y) - shared)


@tidy
def leader_links(sets: DataFrame, least: float) -> DataFrame:
    """Edges ``a, b`` of texts near a leader of their family. They only save work: exact_links finds what they miss.

    sets: ``id, family, doc_id, copy, shingles``.
    """
    near, edges = sets, []
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "copy")
    for _ in range(ROUNDS):
        leaders = durable(near.groupBy("family").agg(F.min_by(F.struct("id", "shingles"), order).alias("lead")))
        size = leaders.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("lead.shingles")), F.lit(0)).alias("held")).first()
        few = F.broadcast(leaders) if size.n <= FEW and size.held <= HELD else leaders
        close = similarity("shingles", "lead.shingles") >= least
        compared = durable(near.join(few, "family").select("id", "family", close.alias("close"), F.col("lead.id").alias("head")))
        edges.append(compared.where("close and id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))
        left = compared.where("not close").select("id", "family")
        many = durable(left.groupBy("family").agg(F.count("*").alias("n")).where(f"n > {PAIRED}").select("family"))
        if many.isEmpty():
            break
        near = sets.join(bounded(durable(left.join(bounded(many), "family", "left_semi").select("id"))), "id", "left_semi")
    return reduce(DataFrame.unionByName, edges)


def rooted(edges: DataFrame) -> DataFrame:
    """``id, root`` of texts with an edge."""
    return components(edges).select(F.col("node").alias("id"), "root")


def common_shingles(texts: DataFrame, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample share, sorted, and how common they are. They decide the order in which
    shingles are looked at, and so the work; any order finds the same pairs."""
    part = max(1, count // SAMPLED)
    sets = shingle_sets(texts.where(F.pmod(F.xxhash64("id"), F.lit(part)) == 0), width)
    shared = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").count()
    found = shared.where("count > 2").orderBy(F.desc("count"), "shingle").limit(COMMON).toPandas().sort_values("shingle")
    return found["shingle"].to_numpy(np.int64), np.log2(found["count"].to_numpy(np.float64)).astype(np.int64)


def prefixes(texts: DataFrame, width: int, least: float, count: int) -> DataFrame:
    """``shingle, id, spot, apart``: the first shingles of each text's set in one order for all, rare ones first.

    Two sets of similarity ``least`` share one of the first n - ceil(least * n) + 1. spot: n, the set's size, and the
    shingle's place, 32 bits each; apart: the root's bits that are not the id's, which is 0 for most and so packs well.
    """
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, width, count))  # COMMON bounds it

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        shared, level = common.value
        for rows, texts in runs(batches):
            row, code = shingle_hashes(texts, width)
            rank = np.zeros(len(code), np.int64)
            if len(shared):
                near = np.minimum(np.searchsorted(shared, code), len(shared) - 1)
                rank = np.where(shared[near] == code, level[near], 0)
            order = np.lexsort((code, rank, row))
            row, code = row[order], code[order]
            new = np.append(True, (np.diff(row) != 0) | (np.diff(code) != 0)) if len(row) else np.zeros(0, bool)
            row, code = row[new], code[new]
            n = np.bincount(row, minlength=len(texts))
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = at < (n - np.ceil(least * n - 1e-9) + 1)[row]
            of = row[first]
            spot = (n[of].astype(np.int64) << 32) | at[first]
            columns = [pa.array(code[first]), rows.column(0).take(pa.array(of)), pa.array(spot), rows.column(1).take(pa.array(of))]
            yield pa.RecordBatch.from_arrays(columns, names=["shingle", "id", "spot", "apart"])
        trim()

    return with_text(texts, "id", "apart").mapInArrow(cut, "shingle long, id long, spot long, apart long")


def meetings(texts: DataFrame, width: int, least: float, count: int) -> DataFrame:
    """``a, b, na, nb, i, j, shingle``: a row for each pair of texts of different roots and each shingle of both prefixes at which they can still have a similarity of ``least``.

    texts: ``id, apart, text``. Prefixes are shuffled once, by shingle, and both uses of them read that. Sizes bound the
    similarity, and so do the shared shingles of both prefixes with what can follow the last of them. What comes before a shingle and in no
    text of another root can't be shared: where many texts have a passage in common, this drops most of their pairs before they are made.
    A shingle of very many texts is dealt to tiles.
    """
    first = prefixes(texts, width, least, count).repartition("shingle")
    root = F.col("id").bitwiseXOR(F.col("apart"))
    keys = first.groupBy("shingle").agg(F.count("*").alias("texts"), F.min(root).alias("low"), F.max(root).alias("high"), F.max("spot").alias("spot"))
    # spot is asked for here as well so that both uses of the shuffle read the same columns, and it is made once
    keys = keys.where("low <> high and spot >= 0").select("shingle", F.ceil(F.col("texts") / TILE).cast("int").alias("tiles"))
    hits = first.join(keys.hint("merge"), "shingle").select("shingle", "id", root.alias("root"), F.shiftright("spot", 32).cast("int").alias("n"), F.col("spot").bitwiseAND(0xFFFFFFFF).cast("int").alias("at"), "tiles")
    upto = F.row_number().over(W.partitionBy("id").orderBy("at"))  # shingles of the text's prefix up to here that other roots have
    hits = durable(hits.withColumn("upto", upto))
    one = hits.select("shingle", F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("tile"), F.col("id").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("at").alias("i"), F.col("upto").alias("ua"))
    other = hits.select("shingle", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("at").alias("j"), F.col("upto").alias("ub"))
    sized = f"a < b and ra <> rb and least(na, nb) >= {least!r}D * greatest(na, nb) - 1e-6D"
    return one.join(other, ["shingle", "tile"]).where(f"{sized} and least(ua, ub) + least(na - i - 1, nb - j - 1) >= {least / (1 + least)!r}D * (na + nb) - 1e-6D")


@tidy
def candidates(texts: DataFrame, width: int, least: float, count: int) -> DataFrame:
    """``a, b, shared, by``: all pairs of texts ``id, apart, text`` of different roots that can have a similarity of ``least``."""
    met = meetings(texts, width, least, count)
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.min("shingle").alias("by"))
    return pairs.where(f"shared + least(na - i - 1, nb - j - 1) >= {least / (1 + least)!r}D * (na + nb) - 1e-6D").select("a", "b", "shared", "by")


def similar_pairs(pairs: pa.Table, sets: pa.Table, least: float) -> pa.Table:
    """The pairs ``a, b`` of one tile whose sets ``id, shingles`` (sorted) have a similarity of ``least`` or more."""
    lists = sets["shingles"].combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    place = {i: k for k, i in enumerate(sets["id"].to_pylist())}
    held = lambda i: flat[ends[place[i]] : ends[place[i] + 1]]
    near = np.zeros(len(pairs), bool)
    for k, (a, b) in enumerate(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)):
        x, y = sorted((held(a), held(b)), key=len)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        shared = int((y[at] == x).sum())
        near[k] = shared >= least * (len(x) + len(y) - shared) - 1e-9
    return pairs.select(["a", "b"]).filter(pa.array(near))


def of_pairs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows whose ``id`` is in one of the pairs ``a, b``, so that no others are read further or shuffled."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return rows.join(bounded(durable(ids)), "id", "left_semi")


def parity_bits(row: np.ndarray, code: np.ndarray, texts: int) -> pa.Array:
    """For each text a bitmap in which each of its distinct shingles has flipped one bit, as 64-bit words; about one bit a shingle, a power of two at least 64."""
    n = np.bincount(row, minlength=texts)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    place = (ends - bits)[row] + (code.view(np.uint64) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    flipped = (np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)
    words = np.packbits(flipped, bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends // 64), pa.int32()), pa.array(words))


def parity_maps(texts: DataFrame, width: int) -> DataFrame:
    """``id, n, bits``: the number of distinct shingles of each text ``id, text``, and its parity bitmap (see ``parity_bits``)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows, texts in runs(batches):
            row, code = shingle_hashes(texts, width)
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            new = np.append(True, (np.diff(row) != 0) | (np.diff(code) != 0)) if len(row) else np.zeros(0, bool)
            row, code = row[new], code[new]
            counts = pa.array(np.bincount(row, minlength=len(texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), counts, parity_bits(row, code, len(texts))], names=["id", "n", "bits"])
        trim()

    return with_text(texts, "id").mapInArrow(measure, "id long, n long, bits array<long>")


def folded(bits: Column, size: Column) -> Column:
    """A bitmap of ``size`` words, or of twice as many, as one of ``size``: both halves are laid over each other."""
    halves = F.zip_with(F.slice(bits, 1, size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > size, halves).otherwise(bits)


def possible(pairs: DataFrame, maps: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``a, b, ...`` that can have a similarity of ``least``, told by bitmaps alone.

    A shingle of one set alone flips one bit of one bitmap, so that bitmaps differ in no more bits than sets in shingles, also when a larger one is folded. Nothing near is lost,
    and of pairs that are not near few are left. Sizes of such pairs differ by less than a factor of two, so one fold is enough.
    """
    met = pairs.join(maps.toDF("a", "na", "x"), "a").join(maps.toDF("b", "nb", "y"), "b")
    size = F.least(F.size("x"), F.size("y"))
    differ = F.zip_with(folded(F.col("x"), size), folded(F.col("y"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    apart = F.aggregate(differ, F.lit(0).cast("long"), lambda t, x: t + x)
    total = F.col("na") + F.col("nb")
    return met.where(((total - apart) / 2 >= least / (1 + least) * total - 1e-6) & (F.abs(F.col("na") - F.col("nb")) <= (1 - least) * F.greatest("na", "nb") + 1e-6)).select(*pairs.columns)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs ``a, b, by`` that have a similarity of ``least`` or more.

    by: a shingle of both texts. Where one brings many pairs together, its texts are dealt to blocks and each pair of
    blocks is a tile, to which each set goes once and not with each of its pairs. Other pairs meet their sets by joins.
    """
    pairs = durable(pairs)
    tiles = F.ceil(F.sqrt(2.0 * F.count("*")) / BLOCK).cast("int")
    hot = durable(pairs.groupBy("by").agg(F.count("*").alias("n"), tiles.alias("tiles")).where(f"n > {LONE}").select("by", "tiles"))
    told = pairs.join(bounded(hot), "by", "left")
    lone = durable(told.where("tiles is null").select("a", "b"))
    own = of_pairs(lone, sets).select("id", "shingles")
    lone = lone.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").where(similarity("x", "y") >= least).select("a", "b")
    block = lambda c: F.pmod(F.xxhash64(c), F.col("tiles")).cast("int")
    dealt = durable(told.where("tiles is not null").select("by", block("a").alias("p"), block("b").alias("q"), "a", "b"))
    key = ["by", "p", "q"]
    needed = durable(dealt.select(*key, F.explode(F.array("a", "b")).alias("id")).distinct()).join(of_pairs(dealt, sets).select("id", "shingles"), "id")
    both = dealt.groupBy(*key).cogroup(needed.groupBy(*key)).applyInArrow(lambda p, s: similar_pairs(p, s, least), "a long, b long")
    return durable(lone.unionByName(both))


@tidy
def exact_links(texts: DataFrame, width: int, least: float, count: int) -> DataFrame:
    """Edges ``a, b`` that connect, with those behind the roots, whatever a similarity of ``least`` connects.

    texts: ``id, apart, text``. Bitmaps leave few of the candidate pairs, and only their texts' sets are made. The partner with most shingles in common is tried first; then
    all pairs whose ends are still apart.
    """
    met = candidates(texts, width, least, count)
    maps = durable(parity_maps(of_pairs(met, texts), width))
    pairs = durable(possible(met, maps, least))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared", "by"))
    best = durable(both.groupBy("a").agg(F.max_by(F.struct("b", "by"), F.struct("shared", "b")).alias("r")).select("a", "r.*"))
    sets = durable(shingle_sets(of_pairs(pairs, texts), width, "id", "apart"))
    sure = verified(best.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("by").alias("by")), sets, least)
    roots = sets.select("id", F.col("id").bitwiseXOR(F.col("apart")).alias("root"))
    old = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    merged = rooted(sure.join(old[0], "a").join(old[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    now = durable(roots.join(bounded(merged.toDF("root", "top")), "root", "left").select("id", F.coalesce("top", "root").alias("root")))
    apart = pairs.join(now.toDF("a", "ra"), "a").join(now.toDF("b", "rb"), "b").where("ra <> rb").select("a", "b", "by")
    return sure.unionByName(verified(apart, sets, least))


def numbered(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Add ``id``, a number of the text ``copy``, to docs: a hash, or another where two texts have one hash.

    texts: ``copy`` of each different text. Of n texts about n * n / 2 ** 65 pairs share a hash: a short list at any size.
    """
    twins = texts.select("copy", F.xxhash64("copy").alias("h"))
    twins = durable(twins.join(twins.groupBy("h").count().where("count > 1"), "h").select("copy", F.xxhash64("copy", F.lit("again")).alias("other")))
    if twins.isEmpty():
        return docs.withColumn("id", F.xxhash64("copy"))
    return docs.join(bounded(twins), "copy", "left").withColumn("id", F.coalesce("other", F.xxhash64("copy"))).drop("other")


@tidy
def near_groups(docs: DataFrame, width: int = 5, least: float = 0.8, bits: int = 7) -> DataFrame:
    """``copy, first`` of texts that have near-duplicates: the key of a text and of its group's first text.

    docs: ``doc_id, copy`` (the key of a text) and ``text``.
    """
    texts = durable(fingerprints(docs, 1, True, "doc_id", "copy")).groupBy("copy").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp"), F.count("*").alias("times"))
    found = durable(simhash_components(durable(texts), bits).select("copy", "doc_id", F.col("root").alias("family"), "times"))
    many = found.groupBy("family").agg(F.count("*").alias("n")).where("n > 1")
    members = durable(numbered(found.join(many, "family").select("copy", "family"), found))
    # each text once: most rows are no copies, so that the list of those that are is short beside the texts
    repeated = durable(found.where("times > 1").select("copy", F.col("doc_id").alias("_own"), F.lit(True).alias("_again")))
    told = docs.join(bounded(repeated), "copy", "left")
    again = durable(told.where(F.col("_again") & F.col("_own").eqNullSafe(F.col("doc_id"))).dropDuplicates(["copy"]))
    once = numbered(told.where("_again is null").unionByName(again).select("copy", "doc_id", "text"), found)
    sets = durable(shingle_sets(once.join(bounded(members.select("copy", "family")), "copy"), width, "id", "family", "doc_id", "copy"))
    close = leader_links(sets, least)
    told_roots = bounded(rooted(close).select("id", F.col("root").bitwiseXOR(F.col("id")).alias("apart")))
    rest = once.join(told_roots, "id", "left").select("id", F.coalesce("apart", F.lit(0)).cast("long").alias("apart"), "text")
    linked = rooted(close.unionByName(exact_links(rest, width, least, found.count())))
    named = durable(numbered(found.select("copy", "doc_id"), found).join(bounded(linked), "id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "copy")
    first = named.groupBy("root").agg(F.min_by("copy", order).alias("first"))
    return named.join(first, "root").select("copy", "first")


def row_key() -> Column:
    return F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_copy")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8, bits: int = 7) -> DataFrame:
    """The rows of ``docs`` without exact and near copies: of each group the row of least doc_id stays.

    Two texts are near if ``width``-word shingles have a Jaccard similarity of ``least`` or more; groups are
    what such links connect, at any size. Null and empty texts are copies of each other. Rows equal in id and text count once. Null ids come last.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.md5(text.cast("binary")).alias("_copy"), F.struct("*").alias("_all"))
    near = near_groups(docs.select("doc_id", text.alias("text"), F.md5(text.cast("binary")).alias("copy")), width, least, bits)
    listed = stays_or_goes(keyed.select("doc_id", "_copy"), near)
    marked = keyed.withColumn("_key", row_key()).join(bounded(listed), "_key", "left")
    firsts = marked.where("_stays").dropDuplicates(["_key"])
    return marked.where("_stays is null").unionByName(firsts).select("_all.*")


@tidy
def stays_or_goes(keyed: DataFrame, near: DataFrame) -> DataFrame:
    """``_key, _stays`` of rows whose group has several; most rows are no copies, so that the list is short beside the texts."""
    rows = durable(keyed)
    grouped = rows.join(near.withColumnRenamed("copy", "_copy"), "_copy", "left").withColumn("group", F.coalesce("first", "_copy"))
    best = grouped.groupBy("group").agg(F.min_by(F.struct("doc_id", "_copy"), F.struct(F.col("doc_id").isNull(), "doc_id", "_copy")).alias("best"), F.count("*").alias("n"))
    alone = grouped.join(best.where("n > 1"), "group").select("doc_id", "_copy", "best").distinct()
    stays = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best._copy") == F.col("_copy"))
    return alone.select(row_key().alias("_key"), stays.alias("_stays"))
