"""Scores and candidates of pairs in literal cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from packetloom.operators import matching, scoring
from packetloom.storage import materialize


def test_scores_are_rounded_as_doubles(spark):
    """0.575 * 100 is less than 57.5 and 0.545 * 100 more than 54.5; the shift takes away the part that 0.9896875 lacks."""
    df = spark.createDataFrame([(0.575, "0.57"), (0.545, "0.55"), (0.125, "0.12"), (0.375, "0.38")], "x double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", scoring._two(F.col("x"))).collect())
    cases = [0.9896874999999999, 0.0000005, 0.5, 2 / 3]
    got = [r.got for r in spark.createDataFrame([(c,) for c in cases], "x double").select(scoring.rounded(F.col("x"), 6).alias("got")).collect()]
    assert got == [math.floor(c * 1e6 + 0.5) / 1e6 for c in cases]


def _random_connections(spark, name, seed, shift):
    """Connections of two ports that share values, numbers and stamps now and then: few and many values, with and without options and stamps."""
    rng, rows = random.Random(seed), []
    for i in range(140):
        ids = sorted({rng.randrange(0 if rng.random() < 0.3 else 1, 60) for _ in range(rng.choice([1, 2, 3, 4, 6, 9]))})
        options, isn = rng.choice([("", 0), ("", rng.randrange(6)), ("mss", rng.randrange(6)), ("ws", rng.randrange(6))])
        stamps = rng.choice([("", ""), (str(rng.randrange(8)), "0"), ("", str(rng.randrange(8)))])
        first, count = rng.randrange(3000), rng.choice([1, 3, 9])
        rows.append((
            i + shift, f"10.0.{name}.{i}", rng.choice([1000, 1001]), "10.9.9.9", rng.choice([80, 443]), rng.random() < 0.5, options, isn, rng.randrange(4), *stamps, rng.choice(["", "x", "y"]), rng.choice(["", "x"]),
            rng.choice(["C:1 S:2", "C:1 S:2 C:3", "C:9"]), rng.random() < 0.2, ids, ids[:2], ids[2:], rng.choice([0, 60, 64]), rng.choice([0, 100, 128]), first, first + rng.choice([0, 500, 9000]), count,
        ))
    return spark.createDataFrame(rows, (
        "stream_id long, client_ip string, client_port int, server_ip string, server_port int, has_syn boolean, syn_options string, client_isn long, server_isn long, tsval string, tsecr string, client_md5 string, server_md5 string, "
        "length_signature string, header_only boolean, ipids array<int>, client_ipids array<int>, server_ipids array<int>, client_ttl int, server_ttl int, first_ms long, last_ms long, packet_count long"
    ))


@pytest.mark.parametrize("few", [16, 3])
def test_pairs_in_large_buckets_meet_by_what_is_rare(spark, monkeypatch, few):
    """All pairs that value by value would be accepted are, though far fewer are looked at."""
    monkeypatch.setattr(matching, "FEW_IDS", few)
    a, b = (materialize(_random_connections(spark, *x)) for x in (("1", 1, 0), ("2", 2, 1000)))
    met, every = matching.likely(a, b, matching.PORT), matching.candidates(a, b, matching.PORT)
    looked, there = ({(r.id_a, r.id_b): (r.ids, r.any_ids) for r in x.collect()} for x in (met, every))
    assert all(looked[k] == there[k] for k in looked.keys() & there.keys()) and met.count() == len(looked) and len(looked) < len(there)
    for second_chance in (False, True):
        got = {tuple(r) for r in matching.scored(a, b, matching.PORT, second_chance=second_chance).collect()}
        monkeypatch.setattr(matching, "likely", matching.candidates)
        want = {tuple(r) for r in matching.scored(a, b, matching.PORT, second_chance=second_chance).collect()}
        monkeypatch.undo()
        monkeypatch.setattr(matching, "FEW_IDS", few)
        assert got == want and {r[4] for r in want} >= {"features", "microflow"}
