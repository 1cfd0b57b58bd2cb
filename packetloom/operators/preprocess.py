"""Capture to capture: time alignment, duplicate removal, one-way streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.connections import ranks
from packetloom.storage import materialize

WRAP = 1 << 32
STREAM = ("capture_id", "stream_id")
#: What stands for a frame's bytes where the frame itself is not kept.
CONTENT = ("src_ip", "dst_ip", "src_port", "dst_port", "ip_id", "seq", "ack", "flags", "len")


def common_range(captures: Sequence[DataFrame]) -> DataFrame:
    """One row: the latest first and the earliest last time of the captures."""
    ranges = [c.agg(F.min("time_ms").alias("first"), F.max("time_ms").alias("last")) for c in captures]
    return reduce(DataFrame.union, ranges).agg(F.max("first").alias("range_start"), F.min("last").alias("range_end"))


def align_times(captures: Sequence[DataFrame]) -> list[DataFrame]:
    """Each capture within the range that all share, ends included; empty if there is none.

    The range is found once: it is written, or each capture would read all again.
    """
    bounds = F.broadcast(materialize(common_range(captures)))
    return [c.join(bounds, F.col("time_ms").between(F.col("range_start"), F.col("range_end"))).drop("range_start", "range_end") for c in captures]


def crop(packets: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Packets within the range, ends included."""
    return packets.where(F.col("time_ms").between(start_ms, end_ms))


#: Places of a capture that are compared together; more than any window.
BLOCK = 1 << 16


def remove_duplicates(packets: DataFrame, content: Sequence[str], order: Sequence[str] = ("time_ms", "stream_id", "frame_number"), window: int = 5) -> DataFrame:
    """Drop a packet whose content one of the ``window`` - 1 packets before it in the same capture has.

    Places come from counts of ranges of the order, not from one sorted capture.
    Equal contents then meet within blocks of places, into which the last packets
    of the block before are copied, so a content that fills a capture is split.
    """
    if not 0 < window <= BLOCK:
        raise ValueError(f"window must be within 1 and {BLOCK}")
    placed = ranks(packets, list(order), "_place", ["capture_id"])
    digest = F.unhex(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in content))))
    block = F.floor(F.col("_place") / BLOCK)
    # The copies only serve as predecessors.
    copied = F.when(F.col("_place") % BLOCK >= BLOCK - (window - 1), F.array(F.struct(block.alias("_block"), F.lit(True).alias("_own")), F.struct((block + 1).alias("_block"), F.lit(False).alias("_own")))).otherwise(F.array(F.struct(block.alias("_block"), F.lit(True).alias("_own"))))
    dealt = placed.withColumn("_digest", digest).select("*", F.inline(copied))
    gap = F.col("_place") - F.lag("_place").over(Window.partitionBy("capture_id", "_digest", "_block").orderBy("_place"))
    return dealt.withColumn("_gap", gap).where(F.col("_own") & (F.col("_gap").isNull() | (F.col("_gap") >= window))).drop("_place", "_gap", "_digest", "_block", "_own")


def crop_and_remove_duplicates(packets: DataFrame, start_ms: int, end_ms: int, content: Sequence[str], **by) -> DataFrame:
    """Both steps as one plan: the range reaches the scan."""
    return remove_duplicates(crop(packets, start_ms, end_ms), content, **by)


def one_way_streams(packets: DataFrame, threshold: int = 20) -> DataFrame:
    """Streams with packets of one direction only, whose acknowledgements still grow by more than ``threshold`` in all.

    The other side must have sent data that the capture lacks. Growth is modulo
    2**32, and at least one packet without payload must acknowledge more than the
    packet before it.
    """
    order = Window.partitionBy(*STREAM).orderBy("frame_number")
    acks = packets.where(F.col("ack") > 0).withColumn("_before", F.lag("ack").over(order))
    grown = acks.groupBy(*STREAM).agg(
        F.min_by("ack", "frame_number").alias("first_ack"), F.max_by("ack", "frame_number").alias("last_ack"),
        F.bool_or((F.col("len") == 0) & (F.col("ack") > F.col("_before"))).alias("pure"),
    )
    ways = packets.groupBy(*STREAM).agg(F.count_distinct("src_ip", "src_port").alias("ways"), F.count("*").alias("packets"))
    delta = F.pmod(F.col("last_ack") - F.col("first_ack"), F.lit(WRAP))
    return ways.where("ways = 1").join(grown, list(STREAM)).where(F.coalesce("pure", F.lit(False)) & (delta > threshold)).select(*STREAM, "packets", delta.alias("ack_delta"))


def remove_one_way(packets: DataFrame, threshold: int = 20) -> DataFrame:
    return packets.join(one_way_streams(packets, threshold).select(*STREAM), list(STREAM), "left_anti")


Step = Callable[[Sequence[DataFrame]], list[DataFrame]]
STEPS: dict[str, Step] = {
    "time-align": align_times,
    "dedup": lambda captures: [remove_duplicates(c, CONTENT) for c in captures],
    "oneway": lambda captures: [remove_one_way(c) for c in captures],
}


def preprocess(captures: Sequence[DataFrame], steps: Sequence[str] = tuple(STEPS)) -> list[DataFrame]:
    """Run steps in order; as many captures come out as went in.

    What a step leaves is written, since the next one reads it several times.
    """
    if unknown := [s for s in steps if s not in STEPS]:
        raise ValueError(f"unknown steps: {', '.join(unknown)}")
    return reduce(lambda captures, step: [materialize(c) for c in STEPS[step](captures)], steps, list(captures))
