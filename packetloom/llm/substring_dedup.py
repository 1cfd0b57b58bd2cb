"""Removal of long passages that earlier documents already have.

Windows of 50 words are compared through super-k-mers: consecutive windows that
share a minimiser (the least 6-word gram in a window, by hash) travel as one
packed string to the minimiser's bucket, where windows are cut out again and
counted as they are, word by word. Equal windows have equal minimisers, so none
is missed.

Two things keep the traffic small and even. Grams that many documents share
order after all others, so that a common line does not become the minimiser of
every window that holds it. And only super-k-mers whose minimiser occurs in two
documents travel; a bitmap of fixed size sorts out most others beforehand.
A bucket of very many different strings is not counted by its task: its windows
go on as rows, by their own hashes, and are counted by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm import bitmap, textkit
from packetloom.storage import materialize

WINDOW = 50
GRAM = 6
#: Slots that count grams; a slot is common if it holds more than this share of all words' grams.
SLOTS = 1 << 20
COMMON_SHARE = 1 / 50_000
#: Windows of a bucket's different strings that its task sorts itself, and rows that it gives out at a time.
CROWD, ROWS = 1 << 17, 20_000


# ---- super-k-mers ------------------------------------------------------------------------------


def _words(texts: list[bytes]) -> Iterator[tuple[int, textkit.Words]]:
    """Words of texts whose words are joined by one space, so that slices of the data are packed strings."""
    for begin, end in textkit.chunks(texts):
        yield begin, textkit.words_of([b" ".join(t.split()) for t in texts[begin:end]], textkit.NOT_SPACE, lower=False)


def _runs(words: textkit.Words, common: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers: first window, last window, minimiser."""
    hashes = textkit.gram_hashes(words.hashes, gram)
    if len(words.hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, textkit.U64)
    last = common[hashes & textkit.U64(SLOTS - 1)].astype(textkit.U64) << textkit.U64(63)
    least = textkit.sliding_min(hashes >> textkit.U64(1) | last, window - gram + 1)
    at = np.flatnonzero(textkit.gram_inside(words.doc, window))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]])
    first = at[new]
    ends = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else first
    return first, ends, least[first]


def common_grams(documents: DataFrame, gram: int = GRAM, share: float = COMMON_SHARE) -> np.ndarray:
    """Which of SLOTS slots hold a common gram. Only the order of minimisers, so the balance, depends on it.

    Every batch reports the slots that are common in it; at most 1 / ``share``
    slots can be common overall, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, n = np.zeros(SLOTS, dtype=np.int64), 0
            texts = textkit.column_bytes(batch.column(0))
            for begin, end in textkit.chunks(texts):
                words = textkit.words_of(texts[begin:end], textkit.NOT_SPACE, lower=False)
                hashes = textkit.gram_hashes(words.hashes, gram)[textkit.gram_inside(words.doc, gram)]
                counts += np.bincount((hashes & textkit.U64(SLOTS - 1)).view(np.int64), minlength=SLOTS)
                n += len(hashes)
            slots = np.flatnonzero(counts > max(4, n * share / 2))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1)), pa.array(np.append(counts[slots], n))], ["slot", "n"])

    sums = documents.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    sums = materialize(sums)
    total = sums.where("slot = -1").agg(F.sum("n")).first()[0] or 0
    common = np.zeros(SLOTS, dtype=bool)
    found = sums.where((F.col("slot") >= 0) & (F.col("n") > max(8, total * share))).select("slot").toPandas()
    common[found["slot"].to_numpy(dtype=np.int64)] = True
    return common


def minimisers(documents: DataFrame, common, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(minimiser, doc_id) of every super-k-mer; ``common`` is a broadcast table of slots."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), textkit.column_bytes(batch.column(1))
            for begin, end in textkit.chunks(texts):
                words = textkit.words_of(texts[begin:end], textkit.NOT_SPACE, lower=False)
                first, _, least = _runs(words, common.value, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(least.view(np.int64)), pa.array(ids[begin + words.doc[first]].astype(np.int64))], ["minimiser", "doc_id"])

    return documents.select("doc_id", "text").mapInArrow(find, "minimiser long, doc_id long")


_SUPER = "minimiser long, doc_id long, version long, start int, windows int, digest binary, packed binary"
_SUPER_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def super_kmers(documents: DataFrame, common, repeated, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Super-k-mers whose minimiser passes ``repeated``, a broadcast bitmap, as packed strings."""
    names = [x.split()[0] for x in _SUPER.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for begin, words in _words(textkit.column_bytes(batch.column(1))):
                first, last, least = _runs(words, common.value, window, gram)
                pick = bitmap.contains(repeated.value, least)
                rows, data = [], words.data.tobytes() if pick.any() else b""
                for a, b, m in zip(first[pick].tolist(), last[pick].tolist(), least[pick].view(np.int64).tolist()):
                    packed, d = data[words.starts[a] : words.ends[b + window - 1]], int(words.doc[a])
                    rows.append((m, ids[begin + d], versions[begin + d], a - int(words.first[d]), b - a + 1, hashlib.blake2b(packed, digest_size=16).digest(), packed))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, _SUPER_TYPES)], names)

    return documents.select("doc_id", "text", "version").mapInArrow(find, _SUPER)


# ---- buckets -----------------------------------------------------------------------------------

#: Runs of windows with the first document that has them; or, with a ``window``, one window that is still to be counted, of documents from first to last.
_FIRSTS = "digest binary, run_from int, run_to int, first_doc long, last_doc long, window binary"


def _window_slices(packed: bytes, window: int) -> Iterator[bytes]:
    ends = [i for i, c in enumerate(packed) if c == 32]
    begin, ends = 0, [*ends, len(packed)]
    for i in range(len(ends) - window + 1):
        yield packed[begin : ends[i + window - 1]]
        begin = ends[i] + 1


def _bucket_firsts(group: list[tuple[bytes, bytes, int, int]], window: int) -> Iterator[tuple[bytes, int, int, int, int, None]]:
    """Runs of windows, by packed string, with the first document that has them, where it is not the string's last one.

    All windows of the bucket are sorted; equal ones stand together, the first document's ahead.
    """
    cut = sorted((w, row[2], g, i) for g, row in enumerate(group) for i, w in enumerate(_window_slices(row[1], window)))
    firsts: list[list[tuple[int, int]]] = [[] for _ in group]
    held = first = None
    for w, own, g, i in cut:
        if w != held:
            held, first = w, own
        firsts[g].append((i, first))
    for (digest, _, _, last), places in zip(group, firsts):
        places.sort()
        begin = 0
        for k in range(1, len(places) + 1):
            if k == len(places) or places[k][1] != places[begin][1]:
                if places[begin][1] < last:
                    yield digest, begin, k, places[begin][1], last, None
                begin = k


def count_windows(packed: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """For distinct super-k-mers (minimiser, digest, packed, windows, first, last): runs of windows (digest, run_from, run_to, first_doc) that an earlier document has.

    Strings are dealt by minimiser. A bucket whose strings have up to ``crowd``
    windows is sorted by its task; the windows of a larger one, be it of many
    strings or of one long one, are passed on as they are cut.
    """
    names = [x.split()[0] for x in _FIRSTS.split(", ")]
    types = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names)

        held, group, out = None, [], []
        for batch in batches:
            for minimiser, size, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if minimiser != held:
                    out += _bucket_firsts(group, window)
                    held, group = minimiser, []
                if size <= crowd:
                    group.append(tuple(row))
                else:
                    digest, text, first, last = row
                    for i, w in enumerate(_window_slices(text, window)):
                        out.append((digest, i, i + 1, first, last, hashlib.blake2b(w, digest_size=16).digest()))
                        if len(out) > ROWS:
                            yield flush(out)
                            out = []
                if len(out) > ROWS:
                    yield flush(out)
                    out = []
        yield flush([*out, *_bucket_firsts(group, window)])

    bucket = Window.partitionBy("minimiser")
    dealt = packed.select("minimiser", "digest", "packed", "first", "last", "windows").withColumn("size", F.sum("windows").over(bucket))
    counted = materialize(dealt.select("minimiser", "size", "digest", "packed", "first", "last").mapInArrow(count, _FIRSTS))
    done, still = counted.where("window IS NULL").select("digest", "run_from", "run_to", "first_doc"), counted.where("window IS NOT NULL")
    firsts = still.groupBy("window").agg(F.min("first_doc").alias("least"))
    open_windows = still.join(firsts, "window").where("least < last_doc").select("digest", "run_from", "run_to", F.col("least").alias("first_doc"))
    return done.union(open_windows)


# ---- the operator ------------------------------------------------------------------------------


def removable_spans(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(doc_id, version, begin, end): word spans, ends exclusive, that windows of smaller doc_ids cover."""
    context = documents.sparkSession.sparkContext
    common = context.broadcast(common_grams(documents, gram))
    seen = minimisers(documents, common, window, gram).groupBy("minimiser").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    repeated = materialize(seen.where("first < last").select("minimiser"))
    sieve = context.broadcast(bitmap.build(repeated, "minimiser", bitmap.bits_for(repeated.count())))
    found = materialize(super_kmers(documents, common, sieve, window, gram))
    distinct = found.groupBy("minimiser", "digest", "packed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("windows").alias("windows"))
    firsts = count_windows(distinct, window, crowd)
    met = found.select("digest", "doc_id", "version", "start").join(firsts, "digest").where("first_doc < doc_id")
    return met.select("doc_id", "version", (F.col("start") + F.col("run_from")).alias("begin"), (F.col("start") + F.col("run_to") + (window - 1)).alias("end"))


def keep_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    """A text's word count and the words that no span covers."""
    words = text.split()
    kept, at = [], 0
    for begin, end in sorted(spans):
        kept += words[at : max(begin, at)]
        at = max(at, end)
    return len(words), kept + words[at:]


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Remove from every text the words of windows that also start in a document with a smaller doc_id.

    Returns a row per row of ``documents`` (doc_id, text) with the kept words.
    Windows are judged on the input. Null and empty texts have no words; texts of
    fewer than ``window`` words, rows without doc_id, and repeats inside one
    document or between rows of the same doc_id lose nothing; other columns are
    left out. A text is held whole in its task, with temporaries of some 40 times
    its bytes.
    """
    own = documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", "xxhash64(text) AS version")
    spans = removable_spans(own.where("doc_id IS NOT NULL AND text IS NOT NULL"), window, gram, crowd)
    by_document = spans.groupBy("doc_id", "version").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), textkit.column_bytes(batch.column(1)), batch.column(2).to_pylist()):
                n, kept = keep_words(text, [(s["begin"], s["end"]) for s in found or ()])
                joined = b" ".join(kept)
                rows.append((doc_id, n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names)

    return own.join(by_document, ["doc_id", "version"], "left").select("doc_id", "text", "spans").mapInArrow(keep, _RESULT)


#: DuckDB SQL: every window as text, its first document, and the positions that a later document's windows cover.
ORACLE_SQL = f"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(words[i : i + {WINDOW - 1}], ' ')) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first_doc FROM win) WHERE first_doc < doc_id),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM late),
gone AS (SELECT doc_id, list(p) AS ps FROM covered GROUP BY doc_id),
kept AS (
  SELECT doc_id, words, coalesce(len(ps), 0) AS n_removed,
         list_transform(list_filter(range(1, len(words) + 1), lambda p: ps IS NULL OR NOT list_contains(ps, p)), lambda p: words[p]) AS ks
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256
FROM kept"""
