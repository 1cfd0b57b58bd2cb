"""Benchmark decontamination by winnowing.

Each 10-word window keeps the smallest hash of its 5-word grams as fingerprint.
Equal windows keep equal fingerprints, so every span that a document shares with
a benchmark item meets in the join of fingerprints; a hit is then extended to
the windows around it, which are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm import bitmap, textkit
from packetloom.storage import materialize

SPAN = 10
GRAM = 5

_WINDOWS = "item_id string, span int, window string, fingerprint long"
_DOCUMENTS = "doc_id long, version long, n_words long, hits array<struct<fingerprint:bigint,first:int,span:int,context:string>>"
_HITS = pa.list_(pa.struct([("fingerprint", pa.int64()), ("first", pa.int32()), ("span", pa.int32()), ("context", pa.string())]))


def window_fingerprints(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each ``span`` words their smallest gram hash; spans shorter than SPAN are one gram, apart from those of other lengths."""
    if span < SPAN:
        return textkit.mix64(textkit.gram_hashes(hashes, span) + np.uint64(span))
    return textkit.sliding_min(textkit.gram_hashes(hashes, GRAM), span - GRAM + 1)


def _words(texts: list[bytes]) -> Iterator[tuple[int, textkit.Words]]:
    for begin, end in textkit.chunks(texts):
        yield begin, textkit.words_of(texts[begin:end], textkit.ALNUM, lower=True)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """A row per window of each item: its words, joined by a space, and its fingerprint."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for begin, words in _words(textkit.column_bytes(batch.column(1))):
                for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                    if a < b:
                        span = min(SPAN, b - a)
                        for k, f in enumerate(window_fingerprints(words.hashes[a:b], span).view(np.int64).tolist()):
                            rows.append((ids[begin + i], span, words.text(a + k, a + k + span).decode(), f))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["item_id", "span", "window", "fingerprint"])

    return benchmark.selectExpr("CAST(item_id AS STRING) AS item_id", "text").where("item_id IS NOT NULL").mapInArrow(find, _WINDOWS)


def document_fingerprints(documents: DataFrame, sieve, spans: list[int]) -> DataFrame:
    """A row per document: its word count and the fingerprints that pass the sieve.

    ``sieve`` is a broadcast bitmap of the items' fingerprints. Consecutive
    windows with the same fingerprint are one hit, which carries their words.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        for batch in batches:
            counts, hits = [], []
            for _, words in _words(textkit.column_bytes(batch.column(1))):
                n = np.diff(words.first)
                counts.append(n)
                found: list[list[tuple]] = [[] for _ in n]
                for span in spans:
                    prints = window_fingerprints(words.hashes, span)
                    inside = textkit.gram_inside(words.doc, span)
                    at = np.flatnonzero(inside & bitmap.contains(bits, prints)) if len(prints) else np.zeros(0, dtype=np.int64)
                    # A run goes on where the next window has the same fingerprint and is of the same document.
                    new = np.ones(len(at), dtype=bool)
                    new[1:] = (np.diff(at) != 1) | (prints[at[1:]] != prints[at[:-1]]) | (words.doc[at[1:]] != words.doc[at[:-1]])
                    runs = np.flatnonzero(new)
                    for a, b in zip(at[runs].tolist(), at[np.append(runs[1:], len(at)) - 1].tolist() if len(at) else []):
                        d = int(words.doc[a])
                        found[d].append((int(prints[a : a + 1].view(np.int64)[0]), a - int(words.first[d]), span, words.text(a, b + span).decode()))
                hits += [[dict(zip(("fingerprint", "first", "span", "context"), h)) for h in f] for f in found]
            n_words = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(hits, _HITS)], ["doc_id", "version", "n_words", "hits"])

    return documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text", "xxhash64(text) AS version").mapInArrow(find, _DOCUMENTS)


def _covered(hits: DataFrame) -> DataFrame:
    """Words of each document that some window covers: the windows' union, from left to right."""
    end = F.col("start") + F.col("span")
    earlier = Window.partitionBy("_row").orderBy("start", "span").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(earlier), F.lit(0))))
    return hits.select("_row", "start", "span").distinct().select("_row", new.alias("new")).groupBy("_row").agg(F.sum("new").cast("long").alias("n_hit"))


def _items_digest(ids: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.array_sort(ids)).cast("binary"), 256)


def find_contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Compare all of ``documents`` (doc_id, text) with all of ``benchmark`` (item_id, text); a row per document row.

    Words are runs of letters and digits, A-Z lower-cased. Items of fewer than
    SPAN words are one window. A null or empty text has no words and no hits;
    items without id or words are left out; equal items all count; rows with the
    same doc_id are judged each on its own text, told apart by ``version``, a hash
    of the text; other columns are left out.
    """
    spark = documents.sparkSession
    windows = materialize(item_windows(benchmark))
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())
    told = materialize(windows.groupBy("window", "span", "fingerprint").agg(F.count("*").alias("n_items")).withColumn("window_id", F.monotonically_increasing_id()))
    prints = told.select("fingerprint").distinct()
    sieve = spark.sparkContext.broadcast(bitmap.build(prints, "fingerprint", bitmap.bits_for(told.count())))
    read = materialize(document_fingerprints(documents, sieve, spans).withColumn("_row", F.monotonically_increasing_id()))

    met = read.select("_row", F.inline("hits")).join(prints, "fingerprint", "left_semi")
    words = F.split("context", " ")
    starts = F.sequence(F.lit(0), F.size(words) - F.col("span"))
    around = F.transform(starts, lambda j: F.struct((F.col("first") + j).alias("start"), F.array_join(F.slice(words, j + 1, F.col("span")), " ").alias("window")))
    hits = materialize(met.select("_row", "span", F.inline(around)).join(told, ["window", "span"]).select("_row", "start", "span", "window_id"))
    of_window = windows.join(told.select("window", "span", "window_id"), ["window", "span"]).select("window_id", "item_id").distinct()
    items = hits.select("_row", "window_id").distinct().join(of_window, "window_id").select("_row", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("_row").agg(F.count("*").alias("n_items"), F.collect_list("item").alias("items"))
    judged = read.select("_row", "doc_id", "version", "n_words").join(_covered(hits), "_row", "left").join(items, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return judged.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        _items_digest(F.coalesce("items", F.array().cast("array<string>"))).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "version",
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the rows that hold a window of ``benchmark``; all columns stay."""
    found = find_contamination(documents, benchmark).where("contaminated").select(F.col("doc_id").alias("_doc_id"), F.col("version").alias("_version")).distinct()
    same = documents["doc_id"].eqNullSafe(found["_doc_id"]) & F.xxhash64(documents["text"]).eqNullSafe(found["_version"])
    return documents.join(found, same, "left_anti")


#: DuckDB SQL: words with positions, windows as text, an equi-join, and the positions that any window covers.
ORACLE_SQL = f"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item_spans AS (SELECT item_id, w, least({SPAN}, len(w)) AS span FROM item_words WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, span, array_to_string(w[i : i + span - 1], ' ') AS win
  FROM (SELECT item_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM item_spans)),
spans AS (SELECT DISTINCT span FROM item_spans),
doc_windows AS (
  SELECT doc_id, span, i, array_to_string(w[i : i + span - 1], ' ') AS win
  FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM doc_words, spans WHERE len(w) >= span)),
hits AS (SELECT d.doc_id, d.i, d.span, t.item_id FROM doc_windows d JOIN item_windows t ON d.span = t.span AND d.win = t.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""
