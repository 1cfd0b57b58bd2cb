"""Byte-level BPE by Spark's higher-order functions, to ids and back.

A text is cut by the tokenizer's pattern into words. For one word all
substrings that are tokens are looked up, sorted by rank and place, and folded
over the edges between its bytes: a token is made where both its ends are still
edges, and fills those between them. No merge has crossed its ends then, so its
own bytes have merged as they do alone, to the two pieces that it is made of.
Edges are bits of a number, in words of over 62 bytes marks in a string. Tables
are literals, arrays of small maps that a hash of the key chooses from: ranks by
token, and by the first four bytes, or fewer, what tokens begin with them.

The most frequent words of the corpus (``HEAD`` of them, so the literal has a
bound) are folded once and looked up; rarer ones are folded where they stand.
Which way a word takes changes no id. No row of a text is shuffled, only counts
of words.

Null and empty texts have no ids. Very long texts are one array in their task;
the time for one word grows with the square of its bytes (a memory copy for
each merge). Repeated rows are encoded alike, an empty table gives an empty
one, and all columns of the input stay, but one that is called as the new one
is replaced.

The rank file must hold every byte and only tokens that merges can reach, as
files trained by merging do; ``unreachable`` tells those that are not.
"""

from __future__ import annotations

import base64
import json

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.storage import materialize

VOCABULARY = "byte_bpe_50k.tiktoken"
#: White space of Unicode, where Java's own class has ASCII only.
PATTERN = public_tokenizers.PATTERN.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}")
#: Words whose ids are kept in a literal, and characters of a plan's text.
HEAD, PLAN_TEXT = 1 << 17, 1 << 16
#: Bits of a candidate that hold its length, and its place; a token is shorter than 2 to the first.
_LENGTH_BITS, _PLACE_BITS = 10, 31
#: Bytes that tell which tokens begin with them.
_PREFIX = 4
#: Bytes of a word whose edges are bits of one number.
_BITS = 62
#: Bytes as text, a character for each.
_ONE_BYTE = "ISO-8859-1"

Ranks = dict[bytes, int]


def read_ranks(path: str) -> Ranks:
    """Tokens and their ranks, which are their ids, from a file of lines (base64, rank)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if missing := [i for i in range(256) if bytes([i]) not in ranks]:
        raise ValueError(f"no token for byte {missing[0]}")
    if max(map(len, ranks)) >= 1 << _LENGTH_BITS or max(ranks.values()) >= 1 << 20:
        raise ValueError("tokens or ranks are too long")
    return ranks


def unreachable(ranks: Ranks) -> list[bytes]:
    """Tokens that merging their own bytes by rank does not give."""

    def merged(token: bytes) -> int:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return len(parts)

    return [token for token in ranks if merged(token) > 1]


def _text(data: bytes) -> str:
    return data.decode(_ONE_BYTE)


def _literal_map(keys: DataFrame, kind: str):
    """A literal made of ``keys`` (key, value), and a function from it and a key's column to the key's value or null.

    A plan has the literal once for each place that names it, so one that is used more than once must be bound.
    The number of hash buckets follows that of the keys. All keys reach the driver.
    """
    spark = keys.sparkSession
    # A plan's text shows its literals; Spark keeps such texts, so they are cut unless the session has a limit of its own.
    if int(spark.conf.get("spark.sql.maxPlanStringLength", "0")) > PLAN_TEXT:
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    rows = keys.withColumn("_hash", F.hash("key")).select("_hash", "key", "value").toArrow()
    buckets = 1 << max(rows.num_rows - 1, 15).bit_length()
    maps: list[dict] = [{} for _ in range(buckets)]
    for batch in rows.to_batches(max_chunksize=8192):
        for place, key, value in zip(*(c.to_pylist() for c in batch.columns)):
            maps[place & (buckets - 1)][key] = value
    literal = F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), f"array<map<string,{kind}>>")
    return literal, lambda table, key: F.element_at(F.get(table, F.hash(key).bitwiseAND(F.lit(buckets - 1))), key)


def _table(spark: SparkSession, entries: dict, kind: pa.DataType) -> DataFrame:
    return spark.createDataFrame(pa.table({"key": pa.array(entries.keys(), pa.string()), "value": pa.array(entries.values(), kind)}))


def _candidate(rank: int, length: int) -> int:
    """A token in one number: rank, place (0) and length."""
    return rank << _PLACE_BITS + _LENGTH_BITS | length


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the end of a fold over nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def _starts(ranks: Ranks) -> dict[str, list[int]]:
    """What begins with up to ``_PREFIX`` bytes: the candidates among them, and as negative numbers the lengths of longer tokens."""
    longer: dict[bytes, set[int]] = {}
    for token in ranks:
        for k in range(2, min(len(token), _PREFIX) + 1):
            longer.setdefault(token[:k], set()).update([len(token)] if k == _PREFIX < len(token) else [])
    return {_text(p): [_candidate(ranks[p[:n]], n) for n in range(2, len(p) + 1) if p[:n] in ranks] + [-n for n in sorted(more)] for p, more in longer.items()}


def _encoder(df: DataFrame, ranks: Ranks):
    """A function from a word's column to its array of ids."""
    spark = df.sparkSession
    rank_table, rank_in = _literal_map(_table(spark, {_text(token): rank for token, rank in ranks.items()}, pa.int32()), "int")
    starts_table, starts_in = _literal_map(_table(spark, _starts(ranks), pa.list_(pa.int64())), "array<bigint>")
    shift_left, low = (lambda x, bits: F.call_function("shiftleft", x, bits)), (1 << _LENGTH_BITS) - 1
    nothing, zero, one, two = F.array().cast("array<bigint>"), *(F.lit(i).cast("long") for i in range(3))
    mark, zeros = F.lit(b"1"), F.lit(b"0" * max(map(len, ranks)))

    def low_of(candidate: Column) -> Column:
        return candidate.bitwiseAND(F.lit(low)).cast("int")

    def place_of(candidate: Column) -> Column:
        return F.shiftright(candidate, _LENGTH_BITS).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")

    def merge_bits(filled: Column, candidate: Column) -> Column:
        """Edges that are filled are bits; low bits of a candidate are its end."""
        at, end = place_of(candidate), low_of(candidate)
        free = F.getbit(filled, at).bitwiseOR(F.getbit(filled, end)) == 0
        return F.when(free, filled.bitwiseOR(shift_left(one, end) - shift_left(two, at))).otherwise(filled)

    def merge_bytes(marks: Column, candidate: Column) -> Column:
        """Edges that are not filled are marks of a byte; low bits of a candidate are its length."""
        at, length = place_of(candidate), low_of(candidate)
        free = (F.substring(marks, at + 1, F.lit(1)) == mark) & (F.substring(marks, at + length + 1, F.lit(1)) == mark)
        return F.when(free, F.overlay(marks, F.substring(zeros, F.lit(1), length - 1), at + 2)).otherwise(marks)

    def encode(word: Column) -> Column:
        return _let(rank_table, lambda r: _let(starts_table, lambda s: _let(F.decode(word.cast("binary"), _ONE_BYTE), lambda text: encode_text(text, r, s))))

    def encode_text(text: Column, rank_map: Column, starts_map: Column) -> Column:
        """Ids of a word that has a character for each byte."""
        size = F.length(text)
        rank_of, starts_of = (lambda key: rank_in(rank_map, key)), (lambda key: starts_in(starts_map, key))
        places = F.sequence(F.lit(0), size)

        def candidates(step: int) -> Column:
            """Sorted by rank, then place; nulls first. ``step`` is what a byte adds to a candidate's number."""

            def at_start(place: Column, i: Column) -> Column:
                def longer(length: Column) -> Column:
                    # A key that the word's end cuts is a candidate once more, which changes nothing.
                    return _let(F.substring(text, i + 1, length), lambda k: shift_left(rank_of(k).cast("long"), F.lit(_PLACE_BITS + _LENGTH_BITS)) + F.length(k))

                known = lambda start: F.coalesce(starts_of(start), *(starts_of(F.substring(start, 1, k)) for k in range(_PREFIX - 1, 1, -1)), nothing)
                return F.transform(_let(F.substring(text, i + 1, F.lit(_PREFIX)), known), lambda c: F.when(c > 0, c).otherwise(longer((-c).cast("int"))) + place)

            first = F.transform(F.sequence(zero, (size - 2) * F.lit(step).cast("long"), F.lit(step).cast("long")), at_start)
            return F.when(size > 1, F.sort_array(F.flatten(first))).otherwise(nothing)

        def pieces(edges: Column) -> Column:
            return F.transform(F.slice(edges, F.lit(1), F.size(edges) - 1), lambda at, k: _let(F.substring(text, at + 1, F.get(edges, k + 1) - at), rank_of))

        short = _let(F.aggregate(candidates(low + 2), zero, merge_bits), lambda filled: F.filter(places, lambda i: F.getbit(filled, i) == 0))
        long = _let(F.aggregate(candidates(low + 1), F.repeat(F.lit("1"), size + 1).cast("binary"), merge_bytes), lambda m: F.filter(places, lambda i: F.substring(m, i + 1, F.lit(1)) == mark))
        return _let(F.when(size <= _BITS, short).otherwise(long), pieces)

    return encode


def words(text: Column) -> Column:
    """The pattern's matches in a text, in order; none of a null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def encode(documents: DataFrame, path: str, text: str = "text", ids: str = "ids", head: int = HEAD) -> DataFrame:
    """Add ``ids``, the array of token ids of ``text`` by the rank file at ``path``.

    ``head`` is the number of words kept in a literal; it changes the time, not the result.
    """
    encoder = _encoder(documents, read_ranks(path))
    counts = documents.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").count()
    frequent = counts.where("count > 1").orderBy(F.desc("count"), "word").limit(head)
    known = materialize(materialize(frequent).select(F.col("word").alias("key"), encoder(F.col("word")).alias("value")))
    ids_table, ids_in = _literal_map(known, "array<int>")
    # One fold for a word: a case that an optimizer could copy would be folded twice.
    return documents.withColumn(ids, F.flatten(F.transform(words(F.col(text)), lambda word: F.coalesce(ids_in(ids_table, word), encoder(word)))))


def decode(ids: Column, path: str) -> Column:
    """The bytes of an array of ids: the binary pieces, one after another. An unknown id gives null, as a null array does."""
    ranks = read_ranks(path)
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    found = F.transform(ids, lambda i: F.get(literal, i))
    whole = ~F.exists(found, lambda p: p.isNull()) if None in pieces else (F.size(ids) == 0) | ((F.array_min(ids) >= 0) & (F.array_max(ids) < len(pieces)))
    return F.when(whole, F.unhex(F.array_join(found, "")))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """A row per document: doc_id, the number of its ids, and SHA-256 of the ids and of the bytes that they decode to."""
    encoded = encode(documents, path)
    hashed = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hashed.alias("ids_sha256"), F.sha2(decode(F.col("ids"), path), 256).alias("decoded_sha256"))
