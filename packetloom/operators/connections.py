"""Connections from packets: one grouped row with roles, handshake, shape and identification values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import packets as P
from packetloom.storage import materialize

#: Packets that the length signature shows.
SIGNATURE_PACKETS = 20
FIVE_TUPLE = ("capture_id", "protocol", "ip_1", "port_1", "ip_2", "port_2")


_ENDS = ("src_ip", "src_port", "dst_ip", "dst_port")
#: What a connection's row needs of its SYNs, of its SYN-ACKs and of its first packet.
_SYN = ("frame_number", *_ENDS, "seq", "options", "tsval", "tsecr", "ip_id", "time_ms")
_SYN_ACK = ("frame_number", *_ENDS, "seq", "ip_id", "time_ms")
_FIRST = (*_ENDS, "tsval", "tsecr", "ip_id", "time_ms", "protocol")


def _halves(packets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Packets grouped by key, sender (1: the lesser address, 2) and TTL: partial sums before the shuffle, so a hot connection is a few rows a task."""
    side = F.when(F.col("src_ip") <= F.col("dst_ip"), 1).otherwise(2)
    flags = F.col("flags")
    payload = (F.col("len") > 0) & (F.col("payload") != "")
    return packets.withColumn("_side", side).groupBy(*key, "_side", "ttl").agg(
        # Only handshake packets are listed; a connection has a few.
        F.collect_list(F.when(P.is_syn(flags), F.struct(*_SYN))).alias("syns"), F.collect_list(F.when(P.is_syn_ack(flags), F.struct(*_SYN_ACK))).alias("acks"),
        F.min_by(F.struct(*_FIRST), "frame_number").alias("first"), F.min("frame_number").alias("seen"),
        F.bool_and(F.col("len") == 0).alias("header_only"),
        F.min(F.when(payload, F.struct("frame_number", "payload"))).alias("payload"),
        F.collect_set(F.when(F.col("ip_id") != 0, F.col("ip_id"))).alias("ids"),
        F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"), F.count("*").alias("n"),
        F.sum(F.when(F.col("frame_len") > 0, F.col("frame_len")).otherwise(0)).cast("long").alias("bytes"),
    )


def _with_ends(grouped: DataFrame) -> DataFrame:
    """Add the handshake's packets and which end is the client.

    The last SYN up to the first frame by which both a SYN and a SYN-ACK were
    seen names the client; else the SYN-ACK's sender is the server; else the
    first packet's sender is the client.
    """
    frames = lambda c: F.array_min(F.transform(c, lambda p: p.frame_number))
    upto = F.when((F.size("syns") > 0) & (F.size("acks") > 0), F.greatest(frames("syns"), frames("acks"))).otherwise(F.lit(2**62))
    last = lambda c: F.array_max(F.filter(c, lambda p: p.frame_number <= F.col("_upto")))
    seen = grouped.withColumn("_upto", upto).withColumns({"_syn": last("syns"), "_syn_ack": last("acks")}).drop("_upto", "syns", "acks")
    of = lambda p: F.struct(*(F.col(f"{p}.{c}") for c in _ENDS))
    turned = F.struct(F.col("_syn_ack.dst_ip").alias("src_ip"), F.col("_syn_ack.dst_port").alias("src_port"), F.col("_syn_ack.src_ip").alias("dst_ip"), F.col("_syn_ack.src_port").alias("dst_port"))
    ends = F.when(F.col("_syn").isNotNull(), of("_syn")).when(F.col("_syn_ack").isNotNull(), turned).otherwise(of("_first"))
    return seen.withColumn("_ends", ends).withColumns({"client_ip": F.col("_ends.src_ip"), "client_port": F.col("_ends.src_port"), "server_ip": F.col("_ends.dst_ip"), "server_port": F.col("_ends.dst_port")}).drop("_ends")


def _signatures(packets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Senders' sides and lengths of a connection's first packets; the rank's limit is applied before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy("frame_number"))
    first = packets.withColumn("_place", place).where(F.col("_place") <= SIGNATURE_PACKETS)
    token = F.struct(F.col("_place").alias("p"), F.when(F.col("src_ip") <= F.col("dst_ip"), 1).otherwise(2).alias("side"), F.col("len").cast("string").alias("len"))
    return first.groupBy(*key).agg(F.array_sort(F.collect_list(token)).alias("_tokens"))


def build_connections(packets: DataFrame, key: Sequence[str] = ("capture_id", "stream_id")) -> DataFrame:
    """A row per connection.

    Packets are summed by sender and TTL before they are shuffled; only a
    connection's first packets, handshake and distinct identification values
    reach its row.
    """
    of_side = lambda side, column: F.when(F.col("_side") == side, F.col(column))
    merged = lambda condition: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(condition, F.col("ids"))))))
    rank = F.struct("n", -F.col("seen"))
    both = {}
    for k in (1, 2):
        here = F.col("_side") == k
        both |= {f"_payload_{k}": F.min(of_side(k, "payload")).payload, f"_ids_{k}": merged(here), f"_ttl_{k}": F.max_by(F.when(here & (F.col("ttl") > 0), F.col("ttl")), F.when(here & (F.col("ttl") > 0), rank))}
    # Signatures are joined before the sums, which then need no exchange of their own.
    grouped = _halves(packets, key).join(_signatures(packets, key), list(key)).groupBy(*key).agg(
        F.flatten(F.collect_list("syns")).alias("syns"), F.flatten(F.collect_list("acks")).alias("acks"), F.min_by("first", "seen").alias("_first"),
        F.bool_and("header_only").alias("header_only"), merged(F.lit(True)).alias("_ids"), *(c.alias(n) for n, c in both.items()),
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("n").alias("packet_count"), F.sum("bytes").alias("total_bytes"), F.any_value("_tokens").alias("_tokens"),
    )
    ended = _with_ends(grouped)
    # Two ends of one address are not told apart: all is the client's.
    client_side = F.when(F.col("client_ip") <= F.col("server_ip"), 1).otherwise(2)
    alike = F.col("client_ip") == F.col("server_ip")
    client = lambda name: F.when(client_side == 1, F.col(f"_{name}_1")).otherwise(F.col(f"_{name}_2"))
    server = lambda name, if_alike: F.when(alike, if_alike).when(client_side == 1, F.col(f"_{name}_2")).otherwise(F.col(f"_{name}_1"))
    syn, syn_ack = F.col("_syn"), F.col("_syn_ack")
    first_id = F.coalesce(F.when(syn.isNotNull(), syn.ip_id).when(syn_ack.isNotNull(), syn_ack.ip_id), F.col("_first.ip_id"))
    signature = F.array_join(F.transform("_tokens", lambda t: F.concat(F.when(t.side == client_side, "C:").otherwise("S:"), t.len)), " ")
    none = F.lit(None)
    return ended.select(
        *key, F.col("_first.protocol").alias("protocol_number"), "client_ip", "client_port", "server_ip", "server_port",
        (syn.isNotNull() | syn_ack.isNotNull()).alias("has_syn"), F.coalesce(syn.options, F.lit("")).alias("syn_options"),
        F.coalesce(syn.seq, F.lit(0)).alias("client_isn"), F.coalesce(syn_ack.seq, F.lit(0)).alias("server_isn"),
        F.coalesce(syn.time_ms, syn_ack.time_ms, F.col("_first.time_ms")).alias("syn_ms"),
        F.when(syn.isNotNull(), syn.tsval).otherwise(F.col("_first.tsval")).alias("tsval"), F.when(syn.isNotNull(), syn.tsecr).otherwise(F.col("_first.tsecr")).alias("tsecr"),
        F.when(F.col("header_only"), "").otherwise(P.payload_md5(client("payload"))).alias("client_md5"),
        F.when(F.col("header_only"), "").otherwise(P.payload_md5(server("payload", none))).alias("server_md5"),
        signature.alias("length_signature"), "header_only",
        F.when(F.size("_ids") > 0, F.col("_ids")).otherwise(F.array(first_id)).alias("ipids"), client("ids").alias("client_ipids"), server("ids", F.col("_ids")).alias("server_ipids"),
        F.coalesce(client("ttl"), F.lit(0)).alias("client_ttl"), F.coalesce(server("ttl", none), F.lit(0)).alias("server_ttl"),
        "first_ms", "last_ms", "packet_count", "total_bytes",
    )


def with_five_tuple(packets: DataFrame) -> DataFrame:
    """Add the canonical ends, so packets can be grouped by FIVE_TUPLE where there are no stream ids."""
    low, high = P.canonical_ends(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    return packets.withColumns({"ip_1": low.ip, "port_1": low.port, "ip_2": high.ip, "port_2": high.port})


def build_connections_by_tuple(packets: DataFrame, reused_apart: bool = False) -> DataFrame:
    """Connections of packets without stream ids; the id is a stable 64-bit hash of the canonical 5-tuple.

    All that used a tuple is one connection. With ``reused_apart`` the packets'
    stream ids, within which frames are numbered, tell uses of a tuple apart and are kept.
    """
    if reused_apart:
        return build_connections(with_five_tuple(packets), (*FIVE_TUPLE, "stream_id"))
    built = build_connections(with_five_tuple(packets), FIVE_TUPLE)
    return built.withColumn("stream_id", F.xxhash64(*FIVE_TUPLE))


#: Server ports whose connections a sample always keeps.
SPECIAL_PORTS = (20, 21, 22, 23, 25, 53, 80, 110, 143, 443, 3306, 5432, 6379, 27017)
STRATA = 10


def is_protected(special_ports: Sequence[int] = SPECIAL_PORTS) -> Column:
    return F.col("header_only") | F.col("server_port").isin(list(special_ports))


def sample_connections(connections: DataFrame, threshold: int = 1000, rate: float = 0.5, special_ports: Sequence[int] = SPECIAL_PORTS) -> DataFrame:
    """Keep all of few connections; of many, the protected ones (header-only, special server ports) and an even sample of the rest.

    The rest is ordered by time and cut into strata of equal size, the last of
    which takes the remainder; each gives connections at a fixed step until
    ``rate`` of all is reached. The order is a single global one, so ranks come
    from counts per time bucket, not from one sorted partition.
    """
    if threshold <= 0 or not 0 < rate <= 1:
        raise ValueError("threshold must be positive and rate within (0, 1]")
    if connections.count() <= threshold:
        return connections
    rest = connections.where(~is_protected(special_ports))
    n = rest.count()
    if not n:
        return connections
    target, strata = max(1, int(n * rate)), min(STRATA, n)
    size, taken = n // strata, 0
    picked = F.lit(False)
    rank = F.col("_rank")
    for i in range(strata):
        begin, length = i * size, size if i < strata - 1 else n - i * size
        step = max(1, length // max(1, length * target // n))
        here = min(-(-length // step), target - taken)
        taken += here
        picked = picked | (rank.between(begin, begin + length - 1) & ((rank - begin) % step == 0) & (rank - begin < here * step))
    sampled = ranks(rest, ["syn_ms", "stream_id"], "_rank").where(picked).drop("_rank")
    return connections.where(is_protected(special_ports)).unionByName(sampled)


def sampling_statistics(connections: DataFrame, sampled: DataFrame, special_ports: Sequence[int] = SPECIAL_PORTS) -> DataFrame:
    """One row: connections before and after sampling, how many of those kept are protected, and the share left out."""
    kept = sampled.agg(F.count("*").alias("sampled"), F.count_if(is_protected(special_ports)).alias("protected"))
    counts = connections.agg(F.count("*").alias("original")).crossJoin(kept)
    rate = F.when(F.col("original") > 0, 1 - F.col("sampled") / F.col("original")).otherwise(0.0)
    return counts.select("original", "sampled", "protected", (F.col("sampled") - F.col("protected")).alias("regular"), F.round(rate, 6).alias("reduction_rate"))


def ranks(df: DataFrame, order: Sequence[str], name: str, within: Sequence[str] = ()) -> DataFrame:
    """Add each row's place, from 0, in a global order, or in that of each group of ``within``, without bringing all rows to one task.

    One exchange deals rows into ranges, as many as the data's size asks for; they
    are sorted there, numbered, and written once. What stands before a range comes
    from a count for each range and group, a table that the join may broadcast if
    it is small. Rows that ``order`` does not tell apart stand in one range.
    """
    by = [*within, *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = materialize(ranged.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    keys = [*within, "_range"]
    counts = dealt.groupBy(*keys).agg(F.min("_row").alias("_first"), F.count("*").alias("_count"))
    before = F.sum("_count").over(Window.partitionBy(*within).orderBy("_range")) - F.col("_count")
    starts = materialize(counts.withColumn("_start", before - F.col("_first")).drop("_count", "_first"))
    same = F.col("d._range") == F.col("s._range")
    for c in within:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}"))
    return dealt.alias("d").join(starts.alias("s"), same).select(*(F.col(f"d.{c}") for c in df.columns), (F.col("_row") + F.col("_start")).alias(name))
