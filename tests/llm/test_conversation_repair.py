"""Conversation repair against a dynamic program over (cost, initials)."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from packetloom.llm import conversation_repair as R
from packetloom.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        yield from [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)


def best_edits(rows):
    """(cost, initials, repaired rows) of the least of all edits."""
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    far = (1 << 60, "", ())
    after = {"": (0, "", ()), "s": far, "u": far, "a": (0, "", ())}

    def with_inserts(found):
        for _ in range(4):
            for q in states:
                cost, initials, out = found[due[q]]
                found[q] = min(found[q], (cost + 3, "I" + initials, ((names[due[q]], ""), *out)))
        return found

    after = with_inserts(after)
    for role, text, fault in reversed(rows):
        now = {}
        for q in states:
            options = [(after[q][0] + 4, "D" + after[q][1], after[q][2])]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if to := states[q].get(role[:1] or "?"):
                    options.append((after[to][0] + more, "K" + after[to][1], ((role, text), *after[to][2])))
                to = due[q]
                options.append((after[to][0] + more + 3, "R" + after[to][1], ((names[to], text), *after[to][2])))
            now[q] = min(options)
        after = with_inserts(now)
    return after[""]


def brute(original, rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for conv in {r[0] for r in original}:
        taken, seen, judged = sorted(groups[conv]), set(), []
        for _, _, role, _, text in taken:
            shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            judged.append((role, text, "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t[1] for t in taken if t[0]]
        cost, initials, repaired = best_edits(judged) if taken else (0, "", ())
        illegal = sum((a[0][:1] or "?") + (b[0][:1] or "?") not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        faults = [sum(j[2] == f for j in judged) for f in ("blank", "duplicate", "truncated")]
        text = "\n".join(f"{role}:{text}" for role, text in repaired)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults, illegal, cost, initials, hashlib.sha256(text.encode()).hexdigest())
    return out


def reported(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def test_query_on_all_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert reported(queries.op12_conversation_repair(spark, SF)) == brute(rows, list(damaged(rows)))


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_against_a_dynamic_program(spark, monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    rng = random.Random(chunk)
    texts = ["Yes.", "No!", "cut", "  ", "", None, "What? \n\t", "é…", "long " * 500 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "u"]
    rows = [
        (conv, rng.choice([None, *range(12)]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1])[0], rng.choice(texts) if rng.random() < 0.4 else f"{rng.random()}{rng.choice('.?x')}")
        for conv in [*range(40), None] for _ in range(rng.choice([1, 2, 5, 14]))
    ]
    rows += [(99, 1, "user", "Same."), *[(98, 2, "user", "Again.")] * 40, (97, 0, "system", "Rules."), (97, 1, "user", "Hi.")]
    rows += [(96, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert reported(R.report(df, R.damage(df))) == brute(rows, list(damaged(rows)))


def test_repaired_rows_are_legal_and_in_order(spark):
    df = spark.createDataFrame([(1, 2, "assistant", "B."), (1, 1, "user", "A."), (1, 3, "tool", "C."), (2, 1, "system", "S.")], SCHEMA)
    edits = R.find_edits(df)
    assert {r.conv_id: (r.audit, r.cost) for r in R.audits(edits).collect()} == {1: ("KKD", 4), 2: ("D", 4)}
    assert [tuple(r) for r in R.repair(df, edits).orderBy("conv_id", "place").collect()] == [(1, 0, "user", "A."), (1, 1, "assistant", "B.")]


def test_dropped_rows_empty_tables_and_other_columns(spark):
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, dropped, "user", "Gone.", "x", 1)], SCHEMA + ", digest string, part int")
    assert reported(R.report(df, R.damage(df))) == {5: (0, 0, 0, 0, 0, 0, "", EMPTY)}
    assert R.report(df.where("false"), R.damage(df.where("false"))).count() == 0
