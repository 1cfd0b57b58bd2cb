"""Near-duplicate documents by SuperMinHash, banding, exact checks and union-find.

Every shingle orders all registers by a permutation of its own and offers the
j-th register a value between j and j + 1. A register's least offer is its
minimum; ranks of one shingle differ between registers, which makes estimates
vary less than independent hashes do, and once all registers of a document are
filled, later ranks need not be drawn.

Equal texts are grouped first, so a group of copies passes on as one document.
Band keys are shuffled once, as (key, document); bands that one document alone
has end there, and all that follows works on the shared ones. Bands with very
many documents are dealt to several parts. The documents of a part are compared
with its pivot, exactly, on their full sets, a document with the pivots of most
of its bands; the pivot is the document whose bands are the most crowded, so of
many edited copies one near their common origin. Bands whose documents do not
end up in one component are then compared across components and parts, so no
link that the bands propose is lost, and no pair within a component is drawn up.
There an upper bound rules out most documents and pairs before they meet:
shingles that no other document at hand has cannot be common, and of the rest
two documents have at most the smaller number in common in each of several
classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm import bitmap, textkit
from packetloom.llm.components import connected_components
from packetloom.storage import materialize

#: Words of a shingle where the caller names no other number.
SHINGLE = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A pair at the threshold shares none of the bands with probability (1 - 0.8**7)**48, about 1e-5.
BANDS, ROWS = 48, 7
#: Registers: a prime, so that any step through them is a permutation.
REGISTERS = 337
SKETCH_WORDS = 5
#: Lowest bits of SKETCH_WORDS * 64 registers: at the threshold a tenth of them differs; this is six deviations more.
MOST_DIFFERENT = 64
#: The same for the first word alone, five deviations, as a first sieve of pairs.
MOST_DIFFERENT_MARK = 19
#: Pivots that a document is compared with at first; the bands of the others are looked at again across components.
FIRST_PIVOTS = 3
#: Slots that count band keys, to find crowded ones; a task names the slots in which it has so many keys itself.
SLOTS, LEAST_OF_TASK = 1 << 20, 16
#: Documents of a part of a crowded band; more where the mean of all slots is an eighth of this.
PART = 1 << 12

#: Classes of shingles, by the upper bits of their hashes.
CLASS_BITS = 5
CLASSES = 1 << CLASS_BITS
#: Bits in which the shingles of a class are counted; larger sets are not bounded by class.
COUNT_BITS = 16

_EMPTY = np.iinfo(np.uint64).max
_SIGNED = "doc_id long, version long, n_shingles long, digest binary, bands array<bigint>, sketch array<bigint>, classes array<int>"


def super_minhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (n_docs, registers) of sets of 64-bit elements; ``doc`` says whose each element is.

    An element's permutation is a random start and a random step modulo the
    prime number of registers. Values hold the rank in their upper bits. A
    document takes part in round j only while it has unfilled registers.
    """
    out = np.full(n_docs * registers, _EMPTY, dtype=np.uint64)
    draw = textkit.mix64(elements ^ np.uint64(0xA0761D6478BD642F))
    at = (draw >> np.uint64(32)).astype(np.int64) % registers
    step = 1 + (draw & np.uint64(0xFFFFFFFF)).astype(np.int64) % (registers - 1)
    base = doc.astype(np.int64) * registers
    for rank in range(registers):
        unfilled = out == _EMPTY
        active = unfilled.reshape(n_docs, registers).any(axis=1)[doc]
        if not active.any():
            break
        if not active.all():
            elements, doc, at, step, base = (x[active] for x in (elements, doc, at, step, base))
        places = base + at
        use = unfilled[places]
        value = textkit.mix64(elements[use] + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(12) | np.uint64(rank << 52)
        np.minimum.at(out, places[use], value)
        at += step
        at[at >= registers] -= registers
    return out.reshape(n_docs, registers)


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key per band, different between bands."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(rows):
        keys = textkit.mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return keys.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """The lowest bit of the first registers, as 64-bit words."""
    bits = (signatures[:, : SKETCH_WORDS * 64] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def sign(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Size of the shingle set, digest of the words, band keys, sketch and shingles by class of every document.

    ``version`` is a hash of the text, which tells rows of one doc_id apart. A text without words has no digest, one of fewer than ``shingle`` words no bands:
    its set meets no other text's.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textkit.column_bytes(batch.column(2))
            for begin, end in textkit.chunks(texts):
                yield _sign_chunk(batch.slice(begin, end - begin).columns[:2], texts[begin:end], shingle)

    return documents.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(find, _SIGNED)


def _sign_chunk(ids: list[pa.Array], texts: list[bytes], shingle: int) -> pa.RecordBatch:
    words = textkit.words_of(texts, textkit.NOT_SPACE, lower=True)
    n_words = np.diff(words.first)
    grams = textkit.gram_hashes(words.hashes, shingle)
    sets = [np.unique(grams[a : b - shingle + 1]) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()) if b - a >= shingle]
    sizes = np.minimum(n_words, 1)
    long = np.flatnonzero(n_words >= shingle)
    bands: list = [None] * len(texts)
    marks: list = [None] * len(texts)
    classes: list = [None] * len(texts)
    if sets:
        sizes[long] = [len(s) for s in sets]
        elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes[long])
        signatures = super_minhash(elements, owner, len(sets))
        by_class = np.bincount(owner * CLASSES + (elements >> np.uint64(64 - CLASS_BITS)).astype(np.int64), minlength=len(sets) * CLASSES).astype(np.int32).reshape(-1, CLASSES)
        for i, keys, mark, counts in zip(long.tolist(), band_keys(signatures), sketches(signatures), by_class):
            bands[i], marks[i], classes[i] = keys, mark, counts
    digests = [hashlib.blake2b(b" ".join(_lower(t).split()), digest_size=16).digest() if n else None for t, n in zip(texts, n_words.tolist())]
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [*ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(marks, longs), pa.array(classes, pa.list_(pa.int32()))],
        ["doc_id", "version", "n_shingles", "digest", "bands", "sketch", "classes"],
    )


def _lower(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z alone


def similar(a: bytes, b: bytes, shingle: int = SHINGLE, percent: int = PERCENT) -> bool:
    """Whether the full shingle sets of two texts are similar enough; compares words, not hashes."""
    numbers: dict[bytes, int] = {}
    sets = []
    for text in (a, b):
        words = _lower(text).split()
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
        sets.append(ids)
    if min(map(len, sets)) < shingle:
        return len(sets[0]) == len(sets[1]) > 0 and bool((sets[0] == sets[1]).all())
    grams = []
    for ids in sets:
        key = np.zeros(len(ids) - shingle + 1, dtype=np.int64)
        if len(numbers) < 1 << 63 // shingle:
            for k in range(shingle):
                key = key * len(numbers) + ids[k : k + len(key)]
            grams.append(np.unique(key))
        else:
            grams.append({tuple(ids[k : k + shingle].tolist()) for k in range(len(key))})
    if isinstance(grams[0], set):
        common, sizes = len(grams[0] & grams[1]), sum(map(len, grams))
    else:
        common, sizes = len(np.intersect1d(*grams, assume_unique=True)), len(grams[0]) + len(grams[1])
    return 100 * common >= percent * (sizes - common)


def _confirm(pairs: DataFrame, shingle: int) -> DataFrame:
    """Pairs (a, b, text_a, text_b) that are links, checked on the full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = textkit.column_bytes(batch.column(2)), textkit.column_bytes(batch.column(3))
            keep = pa.array([similar(x, y, shingle) for x, y in zip(a, b)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def _sizes_fit(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _sketches_fit(s: str, t: str) -> Column:
    different = F.lit(0)
    for i in range(SKETCH_WORDS):
        different = different + F.bit_count(F.col(s)[i].bitwiseXOR(F.col(t)[i]))
    return different <= MOST_DIFFERENT


def _marks_fit(s: str, t: str) -> Column:
    return F.bit_count(F.col(s).bitwiseXOR(F.col(t))) <= MOST_DIFFERENT_MARK


def _classes_fit(n: Column, m: Column) -> Column:
    """Whether two sets can be similar enough if each class has at most its smaller number in common."""
    most = F.aggregate(F.zip_with("classes_a", "classes_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return 100 * most >= PERCENT * (n + m - most)


def _texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ``ids``; a bitmap of fixed size keeps most others out of the shuffle."""
    hashed = ids.select(F.xxhash64("doc_id").alias("h"))
    sieve = documents.sparkSession.sparkContext.broadcast(bitmap.build(hashed, "h", bitmap.bits_for(ids.count())))

    @F.pandas_udf("boolean")
    def may_matter(h: pd.Series) -> pd.Series:
        return pd.Series(bitmap.contains(sieve.value, h.to_numpy(dtype=np.int64).view(np.uint64)))

    out = materialize(documents.where(may_matter(F.xxhash64("doc_id"))).join(ids, "doc_id").select("doc_id", "text"))
    sieve.unpersist()
    return out


def _links(pairs: DataFrame, signed: DataFrame, documents: DataFrame, shingle: int) -> DataFrame:
    """The links among candidate ``pairs`` (a, b): sketches first, then the texts."""
    marks = signed.select("a", "sketch")
    near = pairs.join(marks.toDF("a", "sketch_a"), "a").join(marks.toDF("b", "sketch_b"), "b")
    near = materialize(near.where(_sketches_fit("sketch_a", "sketch_b")).select("a", "b"))
    ids = materialize(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct())
    texts = _texts(documents, ids)
    return materialize(_confirm(near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b"), shingle))


def _crowded_slots(first: DataFrame) -> np.ndarray:
    """Into how many parts the band keys of each of SLOTS slots are dealt: 1 but for crowded ones.

    Each task names the slots in which it has many keys itself, so hardly a row is
    shuffled; a key of a third of all documents is crowded in some task. At most
    SLOTS / 8 rows reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            slots, n = np.unique(batch.column(0).flatten().to_numpy() & (SLOTS - 1), return_counts=True)
            counts[slots] += n
        many = np.flatnonzero(counts >= LEAST_OF_TASK)
        yield pa.RecordBatch.from_arrays([pa.array(many), pa.array(counts[many])], ["slot", "count"])

    most = max(PART, 8 * (1 + first.count() * BANDS // SLOTS))
    counted = first.select("bands").mapInArrow(count, "slot long, count long").groupBy("slot").agg(F.sum("count").alias("count"))
    crowded = counted.where(F.col("count") > most).toArrow()
    parts = np.ones(SLOTS, dtype=np.int32)
    parts[crowded["slot"].to_numpy()] = -(-crowded["count"].to_numpy() // most)
    return parts


def _shared_bands(first: DataFrame) -> DataFrame:
    """(key, part, a, size): the bands that several documents of ``first`` (a, bands) have; the rows of a part number ``size``.

    Parts of crowded bands are numbered from 1, all others are 0.
    """
    crowded = first.sparkSession.sparkContext.broadcast(_crowded_slots(first))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, a = batch.column(1).flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
            parts = crowded.value[keys & (SLOTS - 1)]
            of = textkit.mix64((keys ^ a * 0x61C88647).view(np.uint64)) % parts.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.where(parts > 1, of.astype(np.int32) + 1, 0).astype(np.int32)), pa.array(a)], ["key", "part", "a"])

    rows = first.select("a", "bands").mapInArrow(deal, "key long, part int, a long")
    sized = rows.withColumn("size", F.count("*").over(Window.partitionBy("key", "part")))
    out = materialize(sized.where("size > 1 OR part > 0"))
    crowded.unpersist()
    return out


def _nearest_pivots(shared: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b): each document with the pivots of most of its bands; a pivot is the document of a part with the most crowded bands."""
    crowds = shared.groupBy("a").agg(F.sum("size").alias("crowd"))
    members = shared.select("key", "part", "a").join(crowds.join(first.select("a", "n", F.col("sketch")[0].alias("mark")), "a"), "a")
    best = F.max(F.struct("crowd", (-F.col("a")).alias("x"), F.col("n").alias("m"), F.col("mark").alias("mark_b"))).over(Window.partitionBy("key", "part"))
    met = members.withColumn("p", best).select("a", "n", "mark", (-F.col("p.x")).alias("b"), "p.m", "p.mark_b")
    may = (F.col("a") != F.col("b")) & _sizes_fit(F.col("n"), F.col("m")) & _marks_fit("mark", "mark_b")
    counted = met.where(may).groupBy("a", "b").agg(F.count("*").alias("bands"))
    # A document has at most as many pivots as bands.
    ranked = counted.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("bands", (-F.col("b")).alias("x"))), asc=False).alias("pivots"))
    return ranked.select("a", F.explode(F.slice("pivots", 1, FIRST_PIVOTS)).alias("p")).select("a", (-F.col("p.x")).alias("b"))


def _own_shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """(a, own_classes): how many shingles of each of ``texts`` no other of them has, by class; no row if all are shared.

    A shingle that several texts of a chunk have is sent once, without a text.
    The counts of four classes are summed in one long.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), textkit.column_bytes(batch.column(1))
            for begin, end in textkit.chunks(texts):
                words = textkit.words_of(texts[begin:end], textkit.NOT_SPACE, lower=True)
                inside = textkit.gram_inside(words.doc, shingle)
                grams, doc = textkit.gram_hashes(words.hashes, shingle)[inside], words.doc[: len(inside)][inside]
                order = np.argsort(grams, kind="stable")
                grams, doc = grams[order], doc[order]
                firsts = np.flatnonzero(np.diff(grams, prepend=~grams[:1]) != 0)
                # Texts are in order within a run of equal grams.
                several = doc[firsts] != doc[np.append(firsts[1:], len(grams)) - 1] if len(grams) else np.zeros(0, dtype=bool)
                owner = pa.array(ids[begin + doc[firsts]].astype(np.int64), mask=several)
                yield pa.RecordBatch.from_arrays([pa.array(grams[firsts].view(np.int64)), owner], ["shingle", "a"])

    rows = texts.select("doc_id", "text").mapInArrow(find, "shingle long, a long")
    # Chunks have merged their rows; merging tasks' rows before the shuffle would make them wider and hardly fewer.
    alone = rows.repartition("shingle").groupBy("shingle").agg(F.count("*").alias("chunks"), F.max("a").alias("a")).where("chunks = 1 AND a IS NOT NULL")
    of, each = F.shiftrightunsigned("shingle", 64 - CLASS_BITS).cast("int"), 64 // COUNT_BITS
    one = F.call_function("shiftleft", F.lit(1).cast("long"), of % each * COUNT_BITS)
    packed = alone.groupBy("a").agg(*(F.try_sum(F.when(F.floor(of / each) == k, one).otherwise(0)).alias(f"p{k}") for k in range(CLASSES // each)))
    part = lambda k: F.shiftrightunsigned(f"p{k // each}", k % each * COUNT_BITS).bitwiseAND((1 << COUNT_BITS) - 1).cast("int")
    return packed.select("a", F.array(*map(part, range(CLASSES))).alias("own_classes"))


def _cross_pairs(first: DataFrame, shared: DataFrame, components: DataFrame, documents: DataFrame, shingle: int) -> DataFrame:
    """Pairs of one band but of different components, each with one side outside the band's largest component.

    A pair shares at most the smaller number of shingles that are not its
    documents' own, which bounds its similarity. The bound rules out documents
    first; only those left are drawn up by band.
    """
    named = shared.select("key", "a").join(components.toDF("a", "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    named = materialize(named)
    open_keys = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    open_bands = materialize(named.join(open_keys, "key"))
    ids = materialize(open_bands.select("a").distinct())
    own = _own_shingles(_texts(documents, ids.select(F.col("a").alias("doc_id"))), shingle)
    # Of a doc_id with several texts it is not known which of them has a shingle.
    known = F.col("own_classes").isNotNull() & (F.col("n") < 1 << COUNT_BITS - 1) & (F.count("*").over(Window.partitionBy("a")) == 1)
    less = F.zip_with("classes", "own_classes", lambda x, y: x - y)
    left = first.select("a", "n", "classes", F.col("sketch")[0].alias("mark")).join(ids, "a").join(own, "a", "left").withColumn("_known", known)
    left = left.withColumns({"shared": F.when(F.col("_known"), F.col("n") - F.aggregate("own_classes", F.lit(0), lambda x, y: x + y)).otherwise(F.col("n")), "classes": F.when(F.col("_known"), less).otherwise(F.col("classes"))})
    # No partner of fitting size could make up for more shingles of its own.
    left = left.where(100 * F.col("shared") >= PERCENT * F.col("n")).select("a", "n", "mark", "shared", F.col("classes").alias("classes_a"))
    there = materialize(open_bands.join(left, "a"))
    sizes = there.groupBy("key", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    there = materialize(there.join(largest.select("key", F.col("largest.component").alias("largest")), "key"))
    outside = there.where("component <> largest").select("key", F.col("a").alias("b"), F.col("n").alias("m"), F.col("mark").alias("mark_b"), F.col("shared").alias("shared_b"), F.col("component").alias("other"), F.col("classes_a").alias("classes_b"))
    most = F.least("shared", "shared_b")
    may = (F.col("component") != F.col("other")) & _marks_fit("mark", "mark_b") & (100 * most >= PERCENT * (F.col("n") + F.col("m") - most)) & _classes_fit(F.col("n"), F.col("m"))
    # Two that are both outside would come twice.
    once = (F.col("component") == F.col("largest")) | (F.col("a") < F.col("b"))
    return there.join(outside, "key").where(once & may).select("a", "b").distinct()


def group_near_duplicates(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``documents`` (doc_id, text).

    A component holds the documents that links connect; its id is its smallest
    doc_id, and that document is kept. Texts are compared by shingles of
    ``shingle`` words between ASCII white space, A-Z lower-cased. Null, empty or
    blank texts are linked with nothing. Rows without doc_id are linked with
    nothing, have no component and are kept. Different texts of one doc_id are
    judged each by itself. A text is held whole in its task, with temporaries of
    some 40 times its bytes. Other columns are left out; an empty table gives no rows.
    """
    out = _grouped(documents, shingle)
    return out.drop("version")


def _grouped(documents: DataFrame, shingle: int) -> DataFrame:
    documents = documents.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    signed = materialize(sign(documents, shingle))
    known = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    copies = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("first_id")))
    first = known.join(copies.toDF("digest", "doc_id"), ["digest", "doc_id"], "left_semi").where("bands IS NOT NULL")
    first = materialize(first.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), "bands", "sketch", "classes").dropDuplicates(["a", "n", "bands"]))

    shared = _shared_bands(first)
    nearest = _nearest_pivots(shared, first)
    links = _links(nearest, first, documents, shingle)
    crossing = _links(_cross_pairs(first, shared, materialize(connected_components(links)), documents, shingle), first, documents, shingle)
    components = connected_components(links.union(crossing))

    named = copies.join(components.toDF("first_id", "component"), "first_id", "left")
    named = materialize(named.select("digest", F.coalesce("component", "first_id").alias("component")))
    out = signed.select("doc_id", "version", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "version", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def remove_near_duplicates(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``documents`` with one document of each component; all columns stay.

    Rows without doc_id stay, and so do all equal rows of a document that is kept.
    Of a doc_id with several texts those go whose component another document stands for.
    """
    dropped = _grouped(documents, shingle).where("NOT kept").select(F.col("doc_id").alias("_dropped"), F.col("version").alias("_version")).distinct()
    return documents.join(dropped, (documents["doc_id"] == dropped["_dropped"]) & (F.xxhash64(documents["text"]) == dropped["_version"]), "left_anti")
