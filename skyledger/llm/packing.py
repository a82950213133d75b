"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import CACHES, durable, release, runs, trim, with_text
from skyledger.llm.token_counts import CACHE_CHARS, load

#: Pieces that one packing task takes. Each task wastes less than a sequence's tail or so, which
#: is under one sequence in thousands.
GROUP_PIECES = 40_000
#: Bytes of texts that are encoded at once; words that a worker keeps, and bytes of them.
RUN_BYTES, KEPT_WORDS, KEPT_BYTES = 2 << 20, 400_000, 32 << 20
#: Units that the model is given in one line.
UNITS_A_LINE = 128
#: The tokenizer's pattern, for lower-case words of the printable ASCII and the Latin letters up to U+017F, but for the dotted capital I,
#: and its mark of a unit's last token.
UNITS, UNIT_END = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+"), "</w>"
#: What words must not hold to be cut by that pattern: other characters, and what may start a special token.
HARD, WHITE = re.compile(r"[^!-~À-ÖØ-öø-įı-ſ]|<\|"), re.compile(rb"[ \t-\r]")


def runs_at(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places start, start + 1, ... of each run, one after the other, and where each run ends among them."""
    ends = np.cumsum(lengths)
    spots = np.repeat(starts - (ends - lengths), lengths)
    spots += np.arange(len(spots))
    return spots, ends


class WordIds:
    """Token ids of words, kept by the Python worker in flat arrays.

    The tokenizer drops white space and never joins characters across it, so words encode alone: a run of texts is cut
    into words and its different words are looked up, each once. What is not kept yet is encoded. For words of
    printable ASCII and Latin letters the tokenizer's normaliser does no more than lower-casing and its pattern is ``UNITS``,
    so their units go to its model many at a time; the token that ends a unit is told by its suffix. All other words go
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = load(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[k for t, k in names.items() if t.endswith(UNIT_END)]] = True
        self.empty()

    def empty(self) -> None:
        self.words, self.ids = pa.array([], pa.binary()), np.zeros(0, np.uint32)
        self.starts, self.lengths, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    @classmethod
    def of(cls, path: str) -> WordIds:
        if ("ids", path) not in CACHES:
            release()
            CACHES["ids", path] = cls(path)
            trim()  # reading the vocabulary takes more than keeping it
        return CACHES["ids", path]

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of units without white space, which the model is given in lines of many, and their numbers."""
        lines = [" ".join(units[i : i + UNITS_A_LINE]) for i in range(0, len(units), UNITS_A_LINE)]
        found = self.model.encode_batch_fast(lines, add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.uint32)
        lengths = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(lengths) != len(units):
            raise ValueError("the tokenizer does not mark the ends of units")
        return ids, lengths

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of any words, by the whole tokenizer, and their numbers."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def place(self, words: pa.Array) -> np.ndarray:
        """Where different words stand in the kept arrays; new ones are encoded and added."""
        at = pa.compute.fill_null(pa.compute.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            missing = words.take(pa.array(new))
            ids, lengths = self.fresh(missing)
            at[new] = len(self.words) + np.arange(len(new))
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(lengths) - lengths)
            self.lengths, self.uses = np.append(self.lengths, lengths), np.append(self.uses, np.zeros(len(new), np.int64))
            self.ids, self.words = np.append(self.ids, ids), pa.concat_arrays([self.words, missing])
        return at

    def fresh(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of new words in a row, and their numbers."""
        listed = [w.decode("utf-8", "replace") for w in words.to_numpy(zero_copy_only=False)]
        simple = np.fromiter((w != "" and not HARD.search(w) for w in listed), bool, len(listed))
        lengths = np.zeros(len(listed), np.int64)
        whole, lengths[~simple] = self.encode_words([listed[k] for k in np.flatnonzero(~simple)])
        lines = UNITS.sub(r"\g<0> ", "\n".join([listed[k] for k in np.flatnonzero(simple)]).lower())
        parts = [x.count(" ") for x in lines.split("\n")] if lines else []
        units = pa.array(lines.split(), pa.string()).dictionary_encode()
        ids, numbers = self.encode_units(units.dictionary.to_pylist())
        which = units.indices.to_numpy()
        spots, ends = runs_at((np.cumsum(numbers) - numbers)[which], numbers[which])
        lengths[simple] = np.diff(np.append(0, ends)[np.append(0, np.cumsum(parts, dtype=np.int64))])
        out, of_simple = np.empty(lengths.sum(), np.uint32), np.repeat(simple, lengths)
        out[of_simple], out[~of_simple] = ids[spots], whole
        return out, lengths

    def shrink(self) -> None:
        """Keep the half that is used most, when the bound is reached."""
        if len(self.words) <= KEPT_WORDS and self.words.nbytes + self.ids.nbytes <= KEPT_BYTES:
            return
        short = np.flatnonzero(pa.compute.binary_length(self.words).to_numpy() <= CACHE_CHARS)
        kept = np.sort(short[np.argsort(-self.uses[short], kind="stable")[: KEPT_WORDS // 2]])
        spots, ends = runs_at(self.starts[kept], self.lengths[kept])
        self.words, self.ids = self.words.take(pa.array(kept)), self.ids[spots]
        self.uses, self.lengths = self.uses[kept], self.lengths[kept]
        self.starts = ends - self.lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (binary) in one array, and where each text's ids start and end."""
        self.shrink()
        words = pa.compute.ascii_split_whitespace(texts.view(pa.string()))
        flat = words.flatten().dictionary_encode()
        which = flat.indices.to_numpy()
        known = self.place(flat.dictionary.view(pa.binary()))
        self.uses[known] += np.bincount(which, minlength=len(known))
        at = known[which]
        spots, ends = runs_at(self.starts[at], self.lengths[at])
        return self.ids[spots], np.append(0, ends)[np.append(0, np.cumsum(pa.compute.list_value_length(words).to_numpy()))]

    def encode_long(self, text: bytes) -> np.ndarray:
        """The ids of one text, which is cut where white space stands."""
        out, start = [np.zeros(0, np.uint32)], 0
        while start < len(text):
            gap = WHITE.search(text, start + RUN_BYTES)
            stop = gap.start() if gap else len(text)
            out.append(self.encode(pa.array([text[start:stop]], pa.binary()))[0])
            start = stop
        return np.concatenate(out)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and then ``end_id``, cut into
    pieces of ``capacity`` only where it is longer than that. Texts are read once; ids stay in the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = WordIds.of(tokenizer_path), np.array([end_id], np.uint32)
        for rows, texts in runs(batches, most=RUN_BYTES):
            if len(texts) == 1 and len(texts[0].as_py()) > RUN_BYTES:
                ids = coder.encode_long(texts[0].as_py())
                edges = np.array([0, len(ids)])
            else:
                ids, edges = coder.encode(texts)
            ids, edges = ids.astype("<u4"), edges.tolist()
            out = []
            for doc_id, a, b in zip(rows.column(0).to_pylist(), edges, edges[1:], strict=False):
                own = np.append(ids[a:b], end).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    out.append((doc_id, k, at, len(part), zlib.crc32(part)))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        trim()

    rows = with_text(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """A segment tree over remaining capacities 0..capacity: a leaf counts the open bins with just
    that much room, an inner node the bins below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of the tightest bin that holds ``length``: climb from the
        leaf to the first right neighbour with open bins, then go down on its left."""
        count, i = self.count, length + self.size
        while not count[i]:
            while i & 1:
                i >>= 1
            if i <= 1:
                return None
            i += 1
        while i < self.size:
            i *= 2
            i += not count[i]
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.bins[room].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; the lengths come in falling order and are at least 1."""
    tree, opened = OpenBins(capacity), 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        found = tree.take(n)
        if found is None:
            found = capacity, opened
            opened += 1
        room, where[k] = found
        offset[k] = capacity - room
        if room > n:
            tree.put(room - n, int(where[k]))
    return where, offset


def pack(parts: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id, offset``. Pieces are dealt by hash into groups of about ``group_pieces``; each
    group is packed by itself, best fit decreasing, and numbers its sequences under its own prefix."""
    parts = durable(parts)
    groups = max(1, -(-parts.count() // group_pieces))
    group = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))

    def run(rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "ids_crc32"))]
        rows = rows.sort_by(order)
        where, offset = best_fit(rows["length"].to_numpy(), capacity)
        prefix = rows["pack_group"][0].as_py() << 32
        return rows.select(names).append_column("sequence_id", pa.array(prefix + where)).append_column("offset", pa.array(offset))

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return parts.select(*names, group.alias("pack_group")).groupBy("pack_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    A null or empty text is one piece: the end id alone. Equal rows are packed each. A null doc_id is
    kept. Lengths never exceed ``capacity``; a table without rows gives none.
    """
    return pack(pieces(docs, tokenizer_path, capacity), capacity)
