"""Connections of a packet stream: their state is kept by group."""

import os
import random

import pandas as pd

from packetloom.streaming import sessions

PACKET = "capture_id string, stream_id long, time_ms long, flags int, frame_len long"


def _plain(batches, idle, late):
    """Connection by connection: each batch sees the watermark that the batches before it have left."""
    held, out, newest = {}, [], 0
    for rows in [*batches, []]:
        watermark = max(newest - late, 0)
        kept = [r for r in rows if r[2] >= watermark]
        touched = {r[:2] for r in kept}
        for key in [k for k in held if k not in touched and held[k][1] + idle < watermark]:
            out.append((*key, *held.pop(key), False))
        for r in sorted(kept, key=lambda r: r[2]):
            first, last, n, size = held.pop(r[:2], (r[2], r[2], 0, 0))
            now = (min(first, r[2]), max(last, r[2]), n + 1, size + r[4])
            if r[3] & 5:
                out.append((*r[:2], *now, True))
            else:
                held[r[:2]] = now
        newest = max([newest, *(r[2] for r in rows)])
    return sorted(out)


def test_streams_of_one_group_are_told_apart(spark, tmp_path):
    """As many streams as ever share a state end, go on and time out as they would alone, and Python is called by group."""
    rng, at = random.Random(5), tmp_path / "in"
    at.mkdir()
    batches = []
    for i in range(4):
        times = rng.sample(range(i * 400_000, i * 400_000 + 300_000), 120)
        batches.append([(rng.choice("AB"), rng.randrange(30) + (i * 7 if rng.random() < 0.5 else 0), t, rng.choice([2, 16, 24, 16, 17, 4]), rng.randrange(40, 90)) for t in times])
        pd.DataFrame(batches[-1], columns=[c.split()[0] for c in PACKET.split(", ")]).astype({"flags": "int32"}).to_parquet(at / f"{i}.parquet")
        os.utime(at / f"{i}.parquet", (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(str(at))
    got = sessions.run_available(sessions.stateful_connections(stream, idle_ms=300_000, late="1 minute", groups=2))
    want = _plain(batches, 300_000, 60_000)
    assert sorted(tuple(r) for r in got.collect()) == want and {r[-1] for r in want} == {True, False}
