"""Phrases of words that stand together more often than by chance, per language.

Texts are cut into pieces at sentence signs and line ends, and pieces into
words. All phrases of 1 to ``max_n`` words become rows and are counted per
language; a phrase that is often enough is scored at its weakest cut by exact
Decimal arithmetic, phrases that live mostly inside a longer one go, and each
language keeps its best.

A phrase cannot be more frequent than its parts. So the rows of one length are
first counted by a 64-bit hash, a number of 8 bytes each, and only for phrases
both of whose shorter parts passed; phrases whose hash is frequent are then
counted as texts. Hashes only decide what is counted, never a count: a collision
lets a rare phrase through, and the count of its text drops it. Tasks add up
what a block of texts repeats before anything is shuffled.

Null and empty texts have no words, a null language is ``und``. A very long text
is one block in its task (temporaries of some 40 times its bytes). Repeated rows
count each time, ties are broken by the phrase's bytes, an empty table gives an
empty one, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm import bitmap, textkit
from packetloom.llm.textkit import U64
from packetloom.storage import materialize

#: Signs that end a piece, and blanks between its words.
STOPS = np.zeros(256, dtype=bool)
STOPS[[*b".,;:!?", 10, 11, 12, 13]] = True
WORD = ~STOPS
WORD[[32, 9]] = False
UNKNOWN = "und"
LEAST, MAX_N, BEST = 10, 3, 2000
#: A phrase goes if a longer one has at least this share of its occurrences, in hundredths.
SHARE = 50
_COUNTS = "lang string, size int, phrase string, count long"


def _language_seed(lang: str) -> np.uint64:
    return textkit.words_of([lang.encode()], np.ones(256, dtype=bool), False).hashes.sum(dtype=U64) if lang else U64(0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, textkit.Words, np.ndarray]]:
    """(language, words, piece of each word) of texts of one language that stand in a batch together."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        texts = textkit.column_bytes(batch.column(0))
        for lang in dict.fromkeys(langs.tolist()):
            own = [texts[i] for i in np.flatnonzero(langs == lang).tolist()]
            for begin, end in textkit.chunks(own):
                words = textkit.words_of(own[begin:end], WORD, True)
                if len(words.starts):
                    yield lang, words, np.cumsum(STOPS[words.data])[words.starts]


def _inside(words: textkit.Words, piece: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each position on are of one piece of one text."""
    count = len(piece) - n + 1
    return textkit.gram_inside(words.doc, n) & (piece[:count] == piece[n - 1 :]) if count > 0 else np.zeros(0, dtype=bool)


def _hashes(words: textkit.Words, n: int, lang: str) -> np.ndarray:
    return textkit.mix64(textkit.gram_hashes(words.hashes, n) + _language_seed(lang))


def _places(lang: str, words: textkit.Words, piece: np.ndarray, n: int, parts: np.ndarray | None) -> np.ndarray:
    """Where n words begin that may be frequent, as both their parts of n - 1 words are."""
    inside = _inside(words, piece, n)
    if parts is not None and len(inside):
        known = bitmap.contains(parts, _hashes(words, n - 1, lang))
        inside &= known[: len(inside)] & known[1 : len(inside) + 1]
    return np.flatnonzero(inside)


def _texts(words: textkit.Words, at: np.ndarray, n: int) -> pa.Array:
    """The phrases of n words from positions ``at`` on, joined by one space."""
    data = np.append(words.data, np.uint8(32))
    begins = np.full((len(at), 2 * n - 1), len(data) - 1, dtype=np.int64)
    sizes = np.ones_like(begins)
    for k in range(n):
        begins[:, 2 * k], sizes[:, 2 * k] = words.starts[at + k], (words.ends - words.starts)[at + k]
    begins, flat = begins.ravel(), sizes.ravel()
    ends = np.cumsum(flat)
    letters = data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - flat), flat)]
    offsets = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])


def _read(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))


def _gram_hashes(documents: DataFrame, n: int, parts: np.ndarray) -> DataFrame:
    """(hash, count) of phrases of n words, added up by block."""
    shared = documents.sparkSession.sparkContext.broadcast(parts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, piece in _blocks(batches):
            at = _places(lang, words, piece, n, shared.value)
            hashes, counts = np.unique(_hashes(words, n, lang)[at], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts, pa.int64())], ["hash", "count"])

    return _read(documents).mapInArrow(rows, "hash long, count long")


def _gram_texts(documents: DataFrame, sieves: dict[int, np.ndarray | None]) -> DataFrame:
    """(lang, size, phrase, count), added up by block, of the phrases whose hashes pass the sieve of their size."""
    shared = documents.sparkSession.sparkContext.broadcast(sieves)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, piece in _blocks(batches):
            for n, sieve in shared.value.items():
                at = _places(lang, words, piece, n, None)
                if sieve is not None:
                    at = at[bitmap.contains(sieve, _hashes(words, n, lang)[at])]
                found = pc.value_counts(_texts(words, at, n))
                size = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array(np.full(size, n), pa.int32()), found.field("values"), found.field("counts")], ["lang", "size", "phrase", "count"]
                )

    return _read(documents).mapInArrow(rows, _COUNTS)


def _word_hashes(counted: DataFrame) -> DataFrame:
    """The hashes of words as ``_hashes`` makes them for phrases of one word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, _ in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(words, 1, lang).view(np.int64))], ["hash"])

    return counted.select("phrase", "lang").mapInArrow(rows, "hash long")


def _sieve(hashes: DataFrame) -> np.ndarray:
    return bitmap.build(hashes, "hash", bitmap.bits_for(max(hashes.count(), 1)))


def phrase_counts(documents: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, count) of all phrases of at most ``max_n`` words seen ``least`` times, and (lang, n), the words of each language."""
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("count").alias("count"))
    words = materialize(total(_gram_texts(documents, {1: None}), "lang", "size", "phrase"))
    frequent = words.where(F.col("count") >= least)
    sieves: dict[int, np.ndarray] = {}
    passed = _word_hashes(frequent)
    for n in range(2, max_n + 1):
        passed = materialize(total(_gram_hashes(documents, n, _sieve(passed)), "hash").where(F.col("count") >= least).select("hash"))
        sieves[n] = _sieve(passed)
    longer = total(_gram_texts(documents, sieves), "lang", "size", "phrase").where(F.col("count") >= least)
    return materialize(frequent.unionByName(longer)), words.groupBy("lang").agg(F.sum("count").alias("n"))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, size, phrase, a, l, r, score) of the phrases of several words, at the cut with the lowest score."""
    whole = counts.where("size > 1").select("lang", "size", "phrase", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    first = F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("cut")), " ")
    rest = F.array_join(F.slice(F.split("phrase", " "), F.col("cut") + 1, F.col("size")), " ")
    cuts = whole.withColumns({"first": first, "rest": rest})
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("count").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r"))
    number = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (number("a") * number("a")), number("l") * number("r"))
    cut = F.struct(score.alias("score"), "cut", "l", "r")
    best = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).groupBy("lang", "size", "phrase", "a").agg(F.min(cut).alias("cut"))
    return best.select("lang", "size", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _outer_counts(counts: DataFrame) -> DataFrame:
    """(lang, phrase, outer): the count of the most frequent phrase that adds one word to ``phrase``.

    Any longer phrase around it holds one of these, which is at least as frequent.
    """
    split = F.split("phrase", " ")
    ends = F.array(F.array_join(F.slice(split, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(split, F.lit(2), F.col("size") - 1), " "))
    return counts.where("size > 2").select("lang", F.explode(ends).alias("phrase"), "count").groupBy("lang", "phrase").agg(F.max("count").alias("outer"))


def mine(documents: DataFrame, max_n: int = MAX_N, least: int = LEAST, best: int = BEST, share: int = SHARE) -> DataFrame:
    """The ``best`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(documents, max_n, least)
    outer = _outer_counts(counts)
    held = (F.col("c.lang") == F.col("o.lang")) & (F.col("c.phrase") == F.col("o.phrase")) & (100 * F.col("outer") >= share * F.col("a"))
    kept = scored(counts).alias("c").join(outer.alias("o"), held, "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), starts AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0
), grams AS (
  SELECT lang, 1 AS size, w[i] AS phrase FROM starts
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM starts WHERE i + 1 <= len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM starts WHERE i + 2 <= len(w)
), f AS (
  SELECT lang, size, phrase, string_split(phrase, ' ') AS parts, count(*) AS c FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(c)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT * FROM f WHERE size > 1 AND c >= 10
), cuts AS (
  SELECT lang, phrase, c, size, 1 AS k, parts[1] AS first, array_to_string(parts[2:], ' ') AS rest FROM candidates
  UNION ALL SELECT lang, phrase, c, size, 2, parts[1] || ' ' || parts[2], parts[3] FROM candidates WHERE size = 3
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.c AS a, l.c AS l, r.c AS r, ((1000000::HUGEINT * cuts.c * cuts.c) // (l.c::HUGEINT * r.c))::BIGINT AS score,
    row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (1000000::HUGEINT * cuts.c * cuts.c) // (l.c::HUGEINT * r.c), k) AS nth
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = cuts.first JOIN f r ON r.lang = cuts.lang AND r.phrase = cuts.rest
), longer AS (
  SELECT lang, phrase, max(c) AS c FROM (
    SELECT lang, parts[1] || ' ' || parts[2] AS phrase, c FROM candidates WHERE size = 3
    UNION ALL SELECT lang, parts[2] || ' ' || parts[3], c FROM candidates WHERE size = 3
  ) GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE nth = 1 AND (o.c IS NULL OR 100 * o.c < 50 * s.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""
