"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so the packing is planned over
the counts of each length, a table no larger than the capacity whatever the
corpus, and then every piece is dealt its place by its rank among the pieces of
its length:

* pieces above one third of the capacity: at most two share a sequence, so the
  longest takes the longest partner that fits (large-item matching);
* shorter ones, in falling length, go where the gap left is smallest (best fit).
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.storage import materialize

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Parts of words that each of a worker's two generations of memory holds.
CACHED_WORDS = 400_000
#: Pieces of one length are ranked in groups of about so many.
RANK_GROUP = 100_000


# ---- tokens ------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: ASCII signs that end a word as tokens of their own; an apostrophe or the signs of a special token are not among them.
_TRAILING = ".,!?;:%$#&*)\"-"


class _Memory(dict):
    """A dictionary in two generations: what was not used while one filled up is forgotten."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.before = size, {}

    def unknown(self, keys: list[str]) -> list[str]:
        """Those of ``keys`` that neither generation knows; the others are in the young one afterwards."""
        if len(self) > self.size:
            self.before = dict(self)
            self.clear()
        out = []
        for key in keys:
            if key not in self:
                value = self.before.get(key)
                if value is None:
                    out.append(key)
                else:
                    self[key] = value
        return out


class WordIds:
    """Token ids of texts, by word.

    The tokenizer never joins characters across white space, and it lower-cases
    and splits letters from signs, so a text's ids are those of its words' parts
    in order. Words of many texts are told apart at once; the tokenizer encodes
    only parts that the worker has not met of late.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        self.tokenizer, self.memory = _tokenizer(path), _Memory(cached_words)

    def ids(self, texts: pa.Array) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers; null is empty."""
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        told = words.flatten().dictionary_encode()
        values = self._word_ids(told.dictionary)
        order, bounds = told.indices.to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()
        return [b"".join(map(values.__getitem__, order[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:])]

    def _word_ids(self, words: pa.Array) -> list[bytes]:
        cores, signs = word_parts(words)
        parts = pa.concat_arrays([cores, signs]).dictionary_encode()
        names = parts.dictionary.to_pylist()
        self._encode(self.memory.unknown(names))
        known = [self.memory[name] for name in names]
        order = parts.indices.to_numpy().tolist()
        return [known[a] + known[b] for a, b in zip(order[: len(cores)], order[len(cores) :])]

    def _encode(self, parts: list[str], at_once: int = 512) -> None:
        """Encode many parts as one text; where a token begins tells which part it is of."""
        for begin in range(0, len(parts), at_once):
            some = parts[begin : begin + at_once]
            encoding = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(encoding.ids, dtype="<u4")
            starts = np.array([s for s, _ in encoding.offsets], dtype=np.int64)
            ends = np.cumsum([len(p) + 1 for p in some])
            bounds = np.searchsorted(starts, ends).tolist()
            for part, a, b in zip(some, [0, *bounds], bounds):
                self.memory[part] = ids[a:b].tobytes()


def word_parts(words: pa.Array, most_signs: int = 6) -> tuple[pa.Array, pa.Array]:
    """Words as cores and trailing signs that the tokenizer treats alike, alone or together."""
    cores = pc.utf8_rtrim(words, characters=_TRAILING)
    n_signs = pc.subtract(pc.binary_length(words), pc.binary_length(cores))
    # The one letter that lower-casing turns into a letter and a mark, which would join the signs, is left alone.
    letter = pc.and_(pc.match_substring_regex(cores, r"[\pL0-9]$"), pc.invert(pc.ends_with(cores, "\u0130")))
    apart = pc.and_(letter, pc.less_equal(n_signs, most_signs))
    cores, signs = pc.if_else(apart, cores, words), pa.scalar("", words.type)
    for n in range(1, most_signs + 1):
        signs = pc.if_else(pc.and_(apart, pc.equal(n_signs, n)), pc.utf8_slice_codeunits(words, start=-n), signs)
    plain = pc.and_(pc.string_is_ascii(cores), pc.invert(pc.match_substring(cores, "<|")))
    return pc.if_else(plain, pc.ascii_lower(cores), cores), signs


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def tokenise(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: a document's ids and a final END_ID, cut every ``capacity`` ids."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch, rows = whole.slice(at, 4096), []
                for doc_id, ids in zip(batch.column(0).to_pylist(), words.ids(batch.column(1))):
                    ids += END_ID.to_bytes(4, "little")
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE_TYPES)], names)

    return documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(cut, PIECES)


# ---- the plan ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Placement:
    """Pieces ``rank_from`` .. of one length: ``per_sequence`` each into consecutive sequences from ``sequence`` on, at ``offset``."""

    length: int
    rank_from: int
    n: int
    per_sequence: int
    sequence: int
    offset: int


@dataclass
class _Open:
    """``n`` sequences from ``first`` on, each filled up to ``fill``."""

    first: int
    n: int
    fill: int


class _Plan:
    def __init__(self, counts: Mapping[int, int], capacity: int):
        self.capacity, self.left = capacity, {k: n for k, n in counts.items() if n > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.placements: list[Placement] = []
        self.sequences = 0
        self.gaps: list[int] = []  # sorted, of the runs below
        self.runs: dict[int, list[_Open]] = {}

    def place(self, length: int, n: int, per_sequence: int, run_first: int, offset: int) -> None:
        self.placements.append(Placement(length, self.used[length], n, per_sequence, run_first, offset))
        self.used[length] += n
        self.left[length] -= n

    def open(self, first: int, n: int, fill: int) -> None:
        gap = self.capacity - fill
        if n and gap:
            if gap not in self.runs:
                insort(self.gaps, gap)
            self.runs.setdefault(gap, []).append(_Open(first, n, fill))

    def take(self, gap: int) -> _Open:
        run = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.gaps.remove(gap)
        return run


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Where the pieces of each length go. Work and result depend on the number of lengths, not of pieces."""
    p = _Plan(counts, capacity)
    large = sorted(k for k in p.left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1  # the longest partner that fits
        b = large[at] if at >= 0 else 0
        n = p.left[a] // 2 if a == b else min(p.left[a], p.left[b]) if b else p.left[a]
        if a == b and not n:  # the last of its length
            at = at - 1
            b = large[at] if at >= 0 else 0
            n = 1
        first = p.sequences
        p.sequences += n
        p.place(a, n, 1, first, 0)
        if b:
            p.place(b, n, 1, first, a)
        p.open(first, n, a + b)
        large = [k for k in large if p.left[k]]
    for length in sorted((k for k in p.left if 3 * k <= capacity), reverse=True):
        while p.left[length]:
            at = bisect_left(p.gaps, length)
            if at == len(p.gaps):
                n = -(-p.left[length] // (capacity // length))
                p.open(p.sequences, n, 0)
                p.sequences += n
                continue
            run = p.take(p.gaps[at])
            each = (capacity - run.fill) // length
            full = min(run.n, p.left[length] // each)
            if full:
                p.place(length, full * each, each, run.first, run.fill)
                p.open(run.first, full, run.fill + each * length)
            part = p.left[length] if full < run.n else 0
            if part:
                p.place(length, part, part, run.first + full, run.fill)
                p.open(run.first + full, 1, run.fill + part * length)
            rest = full + bool(part)
            p.open(run.first + rest, run.n - rest, run.fill)
    return p.placements


def n_sequences(placements: list[Placement]) -> int:
    return max((x.sequence + -(-x.n // x.per_sequence) for x in placements), default=0)


# ---- dealing places ----------------------------------------------------------------------------


def pack(pieces: DataFrame, capacity: int = CAPACITY, rank_group: int = RANK_GROUP) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length, ...), which should be a written table.

    Pieces of a length are ranked in groups by a hash, and the groups follow one
    another, so a length that a third of all pieces share is ranked by many
    tasks. Only counts by length, at most ``capacity`` rows, reach the driver.
    Sizes of groups grow with the data: they are joined where the ranks are.
    """
    spark = pieces.sparkSession
    n = pieces.count()
    group = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(16, n // rank_group + 1))).cast("int")
    grouped = pieces.withColumn("_group", group)
    sizes = grouped.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    sizes = materialize(sizes)
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    placements = plan(counts, capacity)
    in_order = Window.partitionBy("length").orderBy("_group")
    before = sizes.withColumn("_before", F.sum("_n").over(in_order) - F.col("_n")).drop("_n")
    within = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = grouped.withColumn("_rank", F.row_number().over(within) - 1).join(before.hint("shuffle_hash"), ["length", "_group"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    rows = [(x.length, x.rank_from, x.rank_from + x.n, x.per_sequence, x.sequence, x.offset) for x in placements]
    places = spark.createDataFrame(rows, "length long, _from long, _to long, _each long, _sequence long, _offset long")
    # At most a few placements per length: bounded by the capacity alone.
    placed = ranked.join(F.broadcast(places), "length").where("_rank >= _from AND _rank < _to")
    turn = F.col("_rank") - F.col("_from")
    return placed.select(
        *(c for c in pieces.columns),
        (F.col("_sequence") + F.floor(turn / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(turn, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack all ``documents`` (doc_id, text); a row per piece.

    A null or empty text is the END_ID alone. Null and repeated doc_ids are
    packed like others; other columns are left out; an empty table gives no
    rows.
    """
    return pack(materialize(tokenise(documents, vocabulary, capacity)), capacity)
