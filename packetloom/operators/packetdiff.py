"""Packet by packet comparison of matched streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.flowhash import flow_hash
from packetloom.functions.packets import flag_change_text, flag_text, nanoseconds

COMPARED = ("flags", "seq", "ack", "len")


def paired_packets(a: DataFrame, b: DataFrame, pairs: DataFrame, direction_aware: bool = False) -> DataFrame:
    """Full outer join of the packets of matched streams: the k-th packet with an identification value meets the k-th.

    ``pairs`` has id_a and id_b. With ``direction_aware`` the sender's port is
    part of the key, so ids that both directions use are kept apart.
    """
    extra = ["src_port"] if direction_aware else []

    def numbered(packets: DataFrame, own: str, name: str) -> DataFrame:
        order = Window.partitionBy("id_a", "id_b", "ip_id", *extra).orderBy("frame_number")
        rows = packets.join(pairs, packets["stream_id"] == pairs[own]).withColumn("k", F.row_number().over(order))
        return rows.select("id_a", "id_b", "ip_id", *extra, "k", F.struct("frame_number", "time_ms", *COMPARED).alias(name))

    keys = ["id_a", "id_b", "ip_id", *extra, "k"]
    return numbered(a, "id_a", "a").join(numbered(b, "id_b", "b"), keys, "full_outer")


def differences(paired: DataFrame) -> DataFrame:
    """Long-format rows: what differs between paired packets, and identification values seen on one side only."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    text = lambda side, c: (flag_text(F.col(f"{side}.{c}")) if c == "flags" else F.col(f"{side}.{c}").cast("string"))
    kinds: list[tuple[Column, str, Column, Column]] = [(both & (F.col(f"a.{c}") != F.col(f"b.{c}")), c, text("a", c), text("b", c)) for c in COMPARED]
    first = F.col("k") == 1
    kinds.append((first & F.col("b").isNull(), "only_in_a", F.col("ip_id").cast("string"), F.lit("N/A")))
    kinds.append((first & F.col("a").isNull(), "only_in_b", F.lit("N/A"), F.col("ip_id").cast("string")))
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("diff_type"), x.alias("value_a"), y.alias("value_b"))) for c, k, x, y in kinds)))
    return paired.select("id_a", "id_b", "ip_id", "k", F.inline(found))


def diff_summary(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("id_a", "id_b", "diff_type").agg(F.count("*").alias("count"))


def flag_changes(diffs: DataFrame) -> DataFrame:
    """How often each change of flags occurs, for each pair of streams."""
    return diffs.where("diff_type = 'flags'").groupBy("id_a", "id_b", "value_a", "value_b").agg(F.count("*").alias("count"))


def flow_view(paired: DataFrame) -> DataFrame:
    """Paired packets with a status and the time since the pair's first packet."""
    unequal = F.concat_ws(",", *(F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(c)) for c in COMPARED))
    status = F.when(F.col("b").isNull(), "ONLY_IN_A").when(F.col("a").isNull(), "ONLY_IN_B").when(unequal == "", "MATCH").otherwise(F.concat(F.lit("DIFF("), unequal, F.lit(")")))
    time = F.least("a.time_ms", "b.time_ms")
    first = F.min(time).over(Window.partitionBy("id_a", "id_b"))
    return paired.select("id_a", "id_b", "ip_id", "k", F.col("a.frame_number").alias("frame_a"), F.col("b.frame_number").alias("frame_b"), (time - first).alias("offset_ms"), status.alias("status"))


#: Examples that a group of differences shows.
EXAMPLES = 10


def diff_groups(paired: DataFrame) -> DataFrame:
    """A row per stream of side A, whatever number of streams it is matched with: when its packets begin and end (ns), how many pairs differ in flags and in sequence numbers, the most frequent change of flags, and the first examples of both.

    Examples are the first by frame; each kind is ranked within its stream, and
    only these reach a list.
    """
    keys = ["id_a"]
    both = paired.where("a IS NOT NULL AND b IS NOT NULL")
    times = paired.where("a IS NOT NULL").groupBy(*keys).agg(F.count_distinct("id_b").alias("streams_b"), nanoseconds(F.min("a.time_ms") / 1000).alias("first_ns"), nanoseconds(F.max("a.time_ms") / 1000).alias("last_ns"))
    frames = F.concat(F.lit("Frame "), F.col("a.frame_number").cast("string"), F.lit("->"), F.col("b.frame_number").cast("string"))
    out = times
    for kind, text in (("flags", frames), ("seq", F.concat(frames, F.lit(": "), F.col("a.seq").cast("string"), F.lit("->"), F.col("b.seq").cast("string")))):
        unequal = both.where(F.col(f"a.{kind}") != F.col(f"b.{kind}"))
        counted = unequal.groupBy(*keys).agg(F.count("*").alias(f"{kind}_differences"))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("a.frame_number", "b.frame_number", "id_b"))
        shown = unequal.select(*keys, place.alias("_k"), text.alias("_text")).where(F.col("_k") <= EXAMPLES)
        listed = shown.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_text"))), lambda x: x["_text"]), "; ").alias("_examples"))
        more = F.when(F.col(f"{kind}_differences") > EXAMPLES, F.concat(F.lit("; ... and "), (F.col(f"{kind}_differences") - EXAMPLES).cast("string"), F.lit(" more"))).otherwise("")
        part = counted.join(listed, keys).select(*keys, f"{kind}_differences", F.concat("_examples", more).alias(f"{kind}_examples"))
        out = out.join(part, keys, "left")
    changed = both.where("a.flags <> b.flags").groupBy(*keys, F.col("a.flags").alias("_from"), F.col("b.flags").alias("_to")).agg(F.count("*").alias("_n"), F.min("a.frame_number").alias("_seen"))
    most = changed.groupBy(*keys).agg(F.max_by(F.struct("_from", "_to"), F.struct("_n", -F.col("_seen"))).alias("_c")).select(*keys, flag_change_text(F.col("_c._from"), F.col("_c._to")).alias("flag_change"))
    zero = {f"{k}_differences": F.coalesce(f"{k}_differences", F.lit(0)) for k in ("flags", "seq")} | {f"{k}_examples": F.coalesce(f"{k}_examples", F.lit("")) for k in ("flags", "seq")}
    return out.join(most, keys, "left").withColumns(zero)


def stream_extra(groups: DataFrame, connections: DataFrame, pcap_id: int = 0) -> DataFrame:
    """Groups of differences as rows of the database's table of streams: with the capture's number and the flow hash of side A's connection.

    Fixed values: the table's column names, and its arrow between frames.
    """
    ends = connections.select(F.col("stream_id").alias("id_a"), flow_hash(F.col("client_ip"), F.col("server_ip"), F.col("client_port"), F.col("server_port"))["flow_hash"].alias("flow_hash"))
    arrows = lambda c: F.regexp_replace(c, "->", "\u2192")
    return groups.join(ends, "id_a").select(
        F.lit(pcap_id).alias("pcap_id"), "flow_hash", F.col("first_ns").alias("first_time"), F.col("last_ns").alias("last_time"), F.col("flags_differences").cast("bigint").alias("tcp_flags_different_cnt"), F.col("flag_change").alias("tcp_flags_different_type"),
        arrows("flags_examples").alias("tcp_flags_different_text"), F.col("seq_differences").cast("bigint").alias("seq_num_different_cnt"), arrows("seq_examples").alias("seq_num_different_text"),
    )
