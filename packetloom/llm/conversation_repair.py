"""Repair of a conversation's structure by the cheapest edits, found by Dial's shortest paths.

A legal conversation is empty or has, after a system turn or none, pairs of a
user's and an assistant's turn. A row may be kept (cost 0), given the role that
is due (3) or deleted (4); a turn without text may be inserted anywhere (3); a
row whose text is cut off adds 3 if it stays. Blank and duplicate rows must go.
Of the cheapest edits those with the least string of initials (D, I, K, R) are
taken.

A conversation is a graph of (rows done, state), with small integer costs. Its
rows are cut into chunks. Each chunk becomes a 4 x 4 matrix of distances between
its states by Dial's bucket queue; a pass over the matrices of a conversation
from its end gives the distance to the goal behind each chunk; with it, each
chunk's distances are found once more and tight arcs are walked, least initial
first, from each of four states; a pass from the front picks one. So no task
holds a long conversation: rows are put in order by ranges, chunks are dealt
freely, and the two passes and the last one, which applies the edits, stream.
The last one reads a whole conversation one row at a time, as its hash must.

Rows are taken by turn (nulls first), then role and digest of the text; equal
rows are interchangeable. A null role or text counts as one space, an other
role than the three can only be changed or deleted. A null conv_id is a
conversation of its own. An empty table gives an empty one; other columns are
not read. A text is held whole while its row is written.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packetloom.storage import materialize

#: Rows of a chunk.
CHUNK = 512
RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: States: nothing yet, after a system turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = range(4)
#: Kinds of roles: s, u, a, others; the state that a row of each leads to.
_NEXT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
#: The turn that is due in a state.
_DUE = (USER, USER, ASSISTANT, USER)
_BEFORE = {due: [q for q in _STATES if _DUE[q] == due] for due in (USER, ASSISTANT)}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Faults of a row, in the order in which they count.
_FINE, _TRUNCATED, _BLANK, _DUPLICATE = range(4)
_FAR = 1 << 60
_GOAL = (0, _FAR, _FAR, 0)


def _code(letter: str) -> tuple[int, int]:
    """(kind of role, fault) of a row's letter, from ``a`` on."""
    value = ord(letter) - 97
    return value & 3, value >> 2


def distances(codes: str, after: tuple[int, ...]) -> list[int]:
    """The distance to the goal from (rows done, state), at 4 * rows + state, if behind the rows it is ``after``.

    Dial: nodes wait in a bucket for each distance; the buckets are emptied in order.
    """
    out = [_FAR] * (4 * len(codes) + 4)
    base, last = min(after), 4 * len(codes)
    buckets: list[list[int]] = [[]]

    def reach(node: int, distance: int) -> None:
        if distance < out[node]:
            out[node] = distance
            while len(buckets) <= distance - base:
                buckets.append([])
            buckets[distance - base].append(node)

    for q in _STATES:
        if after[q] < _FAR:
            reach(last + q, after[q])
    for level, bucket in enumerate(buckets):  # grows while it is read
        distance = base + level
        for node in bucket:
            if out[node] != distance:
                continue
            row, state = node >> 2, node & 3
            due_before = _BEFORE.get(state, ())
            for q in due_before:
                reach(4 * row + q, distance + INSERT)
            if row:
                kind, fault = _code(codes[row - 1])
                reach(node - 4, distance + DELETE)
                if fault <= _TRUNCATED:
                    stay = distance + CUT * fault
                    for q in _STATES:
                        if _NEXT.get((q, kind)) == state:
                            reach(4 * row - 4 + q, stay)
                    for q in due_before:
                        reach(4 * row - 4 + q, stay + RETYPE)
    return out


def walk(codes: str, out: list[int], state: int, last: bool) -> tuple[str, int]:
    """The edits from ``state`` along tight arcs, least initial first, and the state behind them.

    D, K: delete, keep; U, A: give the role; u, a: insert. Turns that are inserted
    behind the last row belong to the ``last`` chunk.
    """
    edits, row = [], 0
    while row < len(codes) or (last and out[4 * row + state]):
        here, due = out[4 * row + state], _DUE[state]
        kind, fault = _code(codes[row]) if row < len(codes) else (3, _BLANK)
        stay, to = CUT * fault, _NEXT.get((state, kind))
        if row < len(codes) and out[4 * row + 4 + state] + DELETE == here:
            edits.append("D")
            row += 1
        elif out[4 * row + due] + INSERT == here:
            edits.append("ua"[due == ASSISTANT])
            state = due
        elif fault <= _TRUNCATED and to is not None and out[4 * row + 4 + to] + stay == here:
            edits.append("K")
            row, state = row + 1, to
        else:
            edits.append("UA"[due == ASSISTANT])
            row, state = row + 1, due
    return "".join(edits), state


@lru_cache(maxsize=4096)
def matrix(codes: str) -> tuple[int, ...]:
    """Distances from each state before the rows to each one behind them, at 4 * from + to."""
    columns = [distances(codes, tuple(0 if q == to else _FAR for q in _STATES)) for to in _STATES]
    return tuple(columns[to][at] for at in _STATES for to in _STATES)


# ---- rows and chunks ---------------------------------------------------------------------------


def _plain(conversations: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))


def damage(conversations: DataFrame) -> DataFrame:
    """Faults for a test of repairs, chosen by crc32 of ``conv_id:turn``: a row in 20 each is dropped, emptied, cut off, repeated, or given to the user."""
    rows = _plain(conversations)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(name.cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    made = rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy"))
    return made.drop("_copy")


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


_ORDER = ("conv_id", "turn", "role", "digest")


def _numbered(conversations: DataFrame) -> DataFrame:
    """Rows without texts, in order: ``part`` is a range of rows, ``place`` a row's number there."""
    ending = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    kind = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    rows = _plain(conversations).select(
        "conv_id", "turn", "role", _digest().alias("digest"), F.when(F.col("role") == "", 3).otherwise(kind).alias("kind"),
        F.when(ending == "", _BLANK).when(~ending.isin(".", "!", "?"), _TRUNCATED).otherwise(_FINE).alias("fault"), F.monotonically_increasing_id().alias("_salt"),
    )
    key = rows.schema["conv_id"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64())], [*batch.schema.names, "part", "place"]
            )
            place += n

    ordered = rows.repartitionByRange(*_ORDER, "_salt").sortWithinPartitions(*_ORDER, "_salt").drop("_salt")
    return materialize(ordered.mapInArrow(number, f"conv_id {key}, turn {rows.schema['turn'].dataType.simpleString()}, role string, digest binary, kind int, fault int, part int, place long"))


def _chunks(numbered: DataFrame) -> DataFrame:
    """A row per chunk: where it is, the order of its first row, and a letter for each of its rows."""
    firsts = numbered.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("part", "place")).alias("at")).select("at.part", "at.place", F.lit(True).alias("_first"))
    joined = numbered.join(firsts, ["part", "place"], "left")
    fault = F.when((F.col("fault") != _BLANK) & F.col("_first").isNull(), _DUPLICATE).otherwise(F.col("fault"))
    letter = F.struct("place", F.chr((97 + F.col("kind") + 4 * fault).cast("long")).alias("letter"))
    chunk = F.floor(F.col("place") / CHUNK).alias("chunk")
    grouped = joined.groupBy("conv_id", "part", chunk).agg(F.array_sort(F.collect_list(letter)).alias("rows"), F.min(F.struct("place", "turn", "role", "digest")).alias("head"))
    return grouped.select("conv_id", "part", "chunk", "head.turn", "head.role", "head.digest", F.array_join("rows.letter", "").alias("codes"))


def _each(df: DataFrame, made: dict[str, str], make: Callable[[], Callable[[dict], tuple]]) -> DataFrame:
    """Add columns ``made`` (name to type) by a function of a row; ``make`` is called once a task, so it may keep a state."""
    out = StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in made.items())).fields])
    types = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            values = [one(row) for row in batch.to_pylist()]
            added = [pa.array([v[i] for v in values], types[kind]) for i, kind in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *made])

    return df.mapInArrow(rows, out)


def _from_the_end() -> Callable[[dict], tuple]:
    """Distances behind a chunk and before it, over chunks from the last to the first."""
    held: list = [None, None]

    def one(row: dict) -> tuple:
        if held[0] != (row["conv_id"],):
            held[:] = [(row["conv_id"],), list(_GOAL)]
        after = held[1]
        held[1] = [min(_FAR, min(row["matrix"][4 * at + to] + after[to] for to in _STATES)) for at in _STATES]
        return after, held[1]

    return one


def _walks() -> Callable[[dict], tuple]:
    """Edits and the state behind them from each state before a chunk."""

    @lru_cache(maxsize=4096)
    def four(codes: str, after: tuple[int, ...]) -> tuple[list[str], list[int]]:
        out = distances(codes, after)
        walked = [walk(codes, out, q, after == _GOAL) if out[q] < _FAR else ("", q) for q in _STATES]
        return [w[0] for w in walked], [w[1] for w in walked]

    return lambda row: four(row["codes"], tuple(row["after"]))


def _from_the_front() -> Callable[[dict], tuple]:
    """A chunk's edits, the cost (with the first chunk) and what is counted, over chunks in order."""
    held: list = [None, START, None]

    def one(row: dict) -> tuple:
        begun = held[0] != (row["conv_id"],)
        if begun:
            held[:] = [(row["conv_id"],), START, None]
        state, kinds = held[1], [_code(c)[0] for c in row["codes"]]
        faults = [_code(c)[1] for c in row["codes"]]
        pairs = zip([held[2], *kinds], kinds)
        held[1:] = row["states"][state], kinds[-1]
        illegal = sum(p not in ((0, 1), (1, 2), (2, 1)) for p in pairs if p[0] is not None)
        return row["walks"][state], row["before"][START] if begun else 0, faults.count(_BLANK), faults.count(_DUPLICATE), faults.count(_TRUNCATED), illegal

    return one


_COUNTED = ("cost", "blank", "duplicate", "truncated", "illegal")


def find_edits(conversations: DataFrame) -> DataFrame:
    """A row per chunk of rows: conv_id, part, chunk, turn, role, digest (of its first row), edits (letters as in ``walk``), cost, and counts of faults."""
    chunks = _each(_chunks(_numbered(conversations)), {"matrix": "array<long>"}, lambda: lambda row: (list(matrix(row["codes"])),))
    backwards = chunks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("chunk"))
    measured = materialize(_each(backwards, {"after": "array<long>", "before": "array<long>"}, _from_the_end).drop("matrix"))
    walked = _each(measured.repartition("conv_id", "part", "chunk"), {"walks": "array<string>", "states": "array<long>"}, _walks)
    forwards = walked.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    chosen = _each(forwards, {"edits": "string", **dict.fromkeys(_COUNTED, "long")}, _from_the_front)
    return materialize(chosen.select("conv_id", "part", "chunk", "turn", "role", "digest", "edits", *_COUNTED))


def audits(edits: DataFrame) -> DataFrame:
    """A row per conversation: the initials of its edits, their cost, and its faults."""
    letters = F.translate("edits", "UAua", "RRII").alias("letters")
    pieces = F.array_sort(F.collect_list(F.struct("part", "chunk", letters)))
    return edits.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in _COUNTED), pieces.alias("p")).select("conv_id", *_COUNTED, F.array_join("p.letters", "").alias("audit"))


def repair(conversations: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text; a conversation's rows stand in one task, in order."""
    own = _plain(conversations).select("conv_id", "turn", "role", _digest().alias("digest"), F.lit(1).alias("row"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("chunk"), "text")
    plan = edits.select("conv_id", "turn", "role", "digest", F.lit(0).alias("row"), "part", "chunk", F.col("edits").alias("text"))
    key = own.schema["conv_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, edits, place, kind = None, deque(), 0, None
        out: list[tuple] = []

        def write(role: str, text: str) -> None:
            nonlocal place
            out.append((held[0], place, role, text))
            place += 1

        def inserted() -> None:
            """Write the turns that are inserted next."""
            while edits and edits[0] in "ua":
                write("user" if edits.popleft() == "u" else "assistant", "")

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 4
            made = [pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())]
            out.clear()
            return pa.RecordBatch.from_arrays(made, ["conv_id", "place", "role", "text"])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, role, is_row, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "row", "text"))):
                if held != (conv_id,):
                    if held:
                        inserted()
                    held, place = (conv_id,), 0
                    edits.clear()
                if not is_row:
                    edits.extend(text)
                    continue
                inserted()
                edit = edits.popleft()
                if edit != "D":
                    write({"U": "user", "A": "assistant"}.get(edit, role), text)
            yield batch_of()
        if held:
            inserted()
            yield batch_of()

    merged = own.unionByName(plan).repartition("conv_id").sortWithinPartitions(*_ORDER, "row", "part", "chunk")
    return merged.mapInArrow(apply, f"conv_id {key}, place long, role string, text string")


def _hashes(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, of rows as ``repair`` gives them."""
    key = repaired.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha, kind, done = None, None, None, []
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held != (conv_id,):
                    if held:
                        done.append((held[0], sha.hexdigest()))
                    held, sha = (conv_id,), hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], ["conv_id", "repaired_sha256"])
                done = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], kind), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(hashed, f"conv_id {key}, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per conv_id of ``conversations``: gaps between turns, faults, cost, audit and a hash of its repaired ``rows``."""
    edits = find_edits(rows)
    gap = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    parts = conversations.select("conv_id").distinct()
    for more in (rows.groupBy("conv_id").agg(gap.alias("gaps")), audits(edits), _hashes(repair(rows, edits))):
        parts = parts.unionByName(more, allowMissingColumns=True)
    empty = hashlib.sha256(b"").hexdigest()
    numbers = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return parts.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))
