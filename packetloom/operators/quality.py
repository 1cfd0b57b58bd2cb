"""Transport quality of streams and services: retransmission, loss and what they cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import packets as P

COUNTERS = ("retransmission", "duplicate_ack", "lost_segment", "ack_lost")


#: Frames of a block: a stream's frames of a block are looked at by one task.
BLOCK = 1 << 16


def _signed(x: Column, bits: int = 32) -> Column:
    """``x`` modulo 2**bits as a number of both signs: the shorter way between two serial numbers."""
    half = 1 << (bits - 1)
    return F.pmod(x + half, F.lit(1 << bits)) - half


def _block_carries(placed: DataFrame, block: list[str]) -> DataFrame:
    """What each block of a stream needs from the blocks before it, a row per block.

    For each direction, ``f`` and ``b``: ``base``, the number of its first packet
    here counted on since the stream began; ``most``, how far it has got before;
    and its last acknowledgement.
    """
    sides = {"f": F.col("_forward"), "b": ~F.col("_forward")}
    split = placed.withColumns({f"_{c}_{d}": F.when(of, F.col(c)) for d, of in sides.items() for c in ("seq", "ack", "_rel", "_end", "frame_number")})
    made = []
    for d in sides:
        seq, ack, rel, end, frame = (f"_{c}_{d}" for c in ("seq", "ack", "_rel", "_end", "frame_number"))
        made += [F.min_by(seq, frame).alias(f"{d}_first"), F.max_by(seq, frame).alias(f"{d}_last"), F.max_by(rel, frame).alias(f"{d}_moved"), F.max(end).alias(f"{d}_far"), F.max_by(ack, frame).alias(f"{d}_ack")]
    blocks = split.groupBy(*block).agg(*made)
    here = Window.partitionBy(*block[:-1]).orderBy(block[-1])
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    held = lambda c: F.last(c, ignorenulls=True).over(before)
    steps = blocks.withColumns({f"{d}_step": F.coalesce(held(f"{d}_moved") + _signed(F.col(f"{d}_first") - held(f"{d}_last")), F.lit(0)) for d in sides})
    begun = {f"{d}_base": F.first(f"{d}_first", ignorenulls=True).over(here) + F.sum(F.when(F.col(f"{d}_first").isNotNull(), F.col(f"{d}_step"))).over(here) for d in sides}
    based = steps.withColumns(begun)
    out = based.withColumns({f"{d}_most": F.max(F.col(f"{d}_base") + F.col(f"{d}_far")).over(before) for d in sides} | {f"{d}_acked": held(f"{d}_ack") for d in sides})
    return out.select(*block, *(f"{d}_{c}" for d in sides for c in ("base", "most", "acked")))


def with_tcp_analysis(packets: DataFrame) -> DataFrame:
    """Packets with the COUNTERS and ``keep_alive`` as flags, derived from sequence and acknowledgement numbers.

    A packet is a keep-alive if it carries at most one byte, neither SYN, FIN nor
    RST, and begins one before its sender's next number; else a retransmission if
    it carries data, a SYN or a FIN and ends no further than its sender has got
    before; it follows a lost segment if it begins beyond that; it is a duplicate
    acknowledgement if it carries nothing and repeats its sender's last one; and it
    acknowledges what was not captured if it names more than the other side was
    seen to send.

    Numbers are of 32 bits: each direction's are counted on by the shorter way from
    one packet to its next, so a stream may wrap as often as it likes. A stream is
    looked at in blocks of BLOCK frames, and what a block needs from those before
    it is one row, so a stream of a third of all packets is no task's own.
    """
    block = ["capture_id", "stream_id", "_block"]
    inside = Window.partitionBy(*block).orderBy("frame_number")
    own = Window.partitionBy(*block, "_forward").orderBy("frame_number")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    marks = F.col("flags").bitwiseAND(P.SYN | P.FIN) != 0
    counts = (F.col("len") > 0) | marks
    forward = (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port")))
    placed = packets.withColumns({"_forward": forward, "_block": F.floor(F.col("frame_number") / BLOCK)})
    placed = placed.withColumn("_step", F.coalesce(_signed(F.col("seq") - F.lag("seq").over(own)), F.lit(0))).withColumn("_rel", F.sum("_step").over(own))
    placed = placed.withColumn("_end", F.when(counts, F.col("_rel") + F.col("len") + marks.cast("int")))
    seen = placed.withColumns({
        "_own": F.max("_end").over(before(own)), "_f": F.max(F.when(F.col("_forward"), F.col("_end"))).over(before(inside)), "_b": F.max(F.when(~F.col("_forward"), F.col("_end"))).over(before(inside)), "_last_ack": F.lag("ack").over(own),
    })
    side = lambda c, other=False: F.when(F.col("_forward") != F.lit(other), F.col(f"f_{c}")).otherwise(F.col(f"b_{c}"))
    base, sent = side("base"), F.greatest(side("most"), side("base") + F.col("_own"))
    other_in_block = F.when(F.col("_forward"), F.col("_b")).otherwise(F.col("_f"))
    got = F.greatest(side("most", True), side("base", True) + other_in_block)
    begin, end = base + F.col("_rel"), base + F.col("_end")
    acked = F.col("flags").bitwiseAND(P.ACK) != 0
    reset = P.has(F.col("flags"), P.RST)
    plain = (F.col("len") == 0) & acked & ~marks & ~reset
    last_ack = F.coalesce("_last_ack", side("acked"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    keep_alive = flag((F.col("len") <= 1) & ~marks & ~reset & (begin == sent - 1))
    judged = seen.join(_block_carries(placed, block), block).withColumns({
        "keep_alive": keep_alive, "retransmission": flag(counts & (end <= sent)) & ~keep_alive, "duplicate_ack": flag(plain & (F.col("ack") == last_ack)) & ~keep_alive,
        "lost_segment": flag(counts & ~P.has(F.col("flags"), P.SYN) & (begin > sent)), "ack_lost": flag(acked & (_signed(F.col("ack") - got) > 0)),
    })
    return judged.select(*packets.columns, *COUNTERS, "keep_alive")


STREAM = ("capture_id", "stream_id")


def by_stream(packets: DataFrame) -> DataFrame:
    """Counters of each direction of a capture's streams; the client is who sent the first captured packet.

    Packets are counted by sender before a stream's senders are told apart.
    """
    ends = packets.groupBy(*STREAM, "src_ip", "src_port").agg(F.count("*").alias("packets"), *(F.count_if(F.col(x)).alias(x) for x in COUNTERS), F.min("frame_number").alias("_seen"))
    fields = ("packets", *COUNTERS)
    of_all = [F.sum(x).alias(f"_all_{x}") for x in fields]
    grouped = ends.groupBy(*STREAM).agg(F.min_by(F.struct(*fields), "_seen").alias("_client"), *of_all)
    sides = [F.col(f"_client.{x}").alias(f"client_{x}") for x in fields] + [(F.col(f"_all_{x}") - F.col(f"_client.{x}")).alias(f"server_{x}") for x in fields]
    return grouped.select(*STREAM, *sides)


def by_service(packets: DataFrame, services: DataFrame) -> DataFrame:
    """Counters of each listed service (ip, port): the destination is looked up first.

    Packets are counted by their ends before services are looked up, so neither
    join reads packets and the list may be of any size.
    """
    known = services.select("ip", "port").where("port IS NOT NULL").distinct()
    fields = ("packets", *COUNTERS)
    ends = packets.groupBy("src_ip", "src_port", "dst_ip", "dst_port").agg(F.count("*").alias("packets"), *(F.count_if(F.col(x)).alias(x) for x in COUNTERS))
    to = ends.join(known.select(F.col("ip").alias("dst_ip"), F.col("port").alias("dst_port"), F.lit(True).alias("_to")), ["dst_ip", "dst_port"], "left")
    both = to.join(known.select(F.col("ip").alias("src_ip"), F.col("port").alias("src_port"), F.lit(True).alias("_from")), ["src_ip", "src_port"], "left")
    service = F.when(F.col("_to"), F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))).when(F.col("_from"), F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")))
    kept = both.withColumn("_service", service).where("_service IS NOT NULL")
    side = {"client": F.coalesce(F.col("_to"), F.lit(False)), "server": F.col("_to").isNull()}
    summed = [F.sum(F.when(c, F.col(x)).otherwise(0)).alias(f"{s}_{x}") for s, c in side.items() for x in fields]
    return kept.groupBy(F.col("_service.ip").alias("ip"), F.col("_service.port").alias("port")).agg(*summed)


def with_rates(counted: DataFrame) -> DataFrame:
    """Percentages of packets, loss net of what the other side saw acknowledged, and a score: 100 less the weighted means of both directions."""
    out = counted
    for s, other in (("client", "server"), ("server", "client")):
        rate = lambda x, s=s: F.when(F.col(f"{s}_packets") > 0, 100.0 * x / F.col(f"{s}_packets")).otherwise(0.0)
        real = F.greatest(F.lit(0), F.col(f"{s}_lost_segment") - F.col(f"{other}_ack_lost"))
        out = out.withColumns({f"{s}_retransmission_rate": F.round(rate(F.col(f"{s}_retransmission")), 6), f"{s}_duplicate_ack_rate": F.round(rate(F.col(f"{s}_duplicate_ack")), 6), f"{s}_real_loss_rate": F.round(rate(real), 6)})
    mean = lambda x: (F.col(f"client_{x}_rate") + F.col(f"server_{x}_rate")) / 2
    cost = 0.4 * mean("retransmission") + 0.3 * mean("duplicate_ack") + 0.3 * mean("real_loss")
    traffic = F.col("client_packets") + F.col("server_packets") > 0
    return out.withColumn("score", F.round(F.when(traffic, F.greatest(F.lit(0.0), 100 - cost)).otherwise(100.0), 4))


def worst_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` matched pairs whose worse side scores lowest; streams without counters score 100. A top-k report."""
    score = lambda x, own: x.select(F.col("stream_id").alias(own), F.col("score").alias(f"score_{own[-1]}"))
    scored = pairs.join(score(a, "id_a"), "id_a", "left").join(score(b, "id_b"), "id_b", "left").fillna(100.0, ["score_a", "score_b"])
    return scored.withColumn("score", F.least("score_a", "score_b")).orderBy("score", "id_a", "id_b").limit(n)


def service_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Scores of services at both points; a service that one point lacks scores 100 there."""
    side = lambda x, s: x.select("ip", "port", F.col("score").alias(f"score_{s}"))
    return side(a, "a").join(side(b, "b"), ["ip", "port"], "full_outer").fillna(100.0, ["score_a", "score_b"])
