"""Endpoints and services of matched connections, and where capture points stand between client and server."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.packets import canonical_ends, hops
from packetloom.operators.roles import lesser_confidence, mean_confidence, udp_server

A_FIRST, B_FIRST, SAME, UNKNOWN = "A_CLOSER_TO_CLIENT", "B_CLOSER_TO_CLIENT", "SAME_POSITION", "UNKNOWN"
#: The TTLs that hosts start with.
INITIAL_TTLS = (64, 128, 255)
_ENDPOINT = ("client_ip", "server_ip", "server_port", "protocol_number")
#: What the statistics need of a connection.
NEEDED = [*_ENDPOINT, "client_ttl", "server_ttl", "total_bytes"]
TTLS = ("client_ttl_a", "server_ttl_a", "client_ttl_b", "server_ttl_b")


def modes(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seen: str) -> DataFrame:
    """The most frequent value of each column, nulls apart, by ``keys``: among equals the one with the least ``seen``, then the greatest.

    Values are counted before they are compared, so a hot group reaches its task as a row per value.
    """
    values = F.inline(F.array(*(F.struct(F.lit(c).alias("_which"), F.col(c).alias("_value")) for c in columns)))
    counted = df.select(*keys, F.col(seen).alias("_seen"), values).where("_value IS NOT NULL").groupBy(*keys, "_which", "_value").agg(F.count("*").alias("_n"), F.min("_seen").alias("_seen"))
    rank = F.struct("_n", -F.col("_seen"), "_value")
    return counted.groupBy(*keys).agg(*(F.max_by(F.when(F.col("_which") == c, F.col("_value")), F.when(F.col("_which") == c, rank)).alias(c) for c in columns))


HOPS = tuple(t.replace("ttl", "hops") for t in TTLS)


def endpoint_stats(matches: DataFrame) -> DataFrame:
    """Matched connections by the endpoints of both sides: number, mean score, bytes, modal TTLs and modal hops. No TTL seen: null.

    If the connections have a server_confidence, the mean of each match's lesser one is added.
    """
    rated = "server_confidence" in matches.schema["a"].dataType.names
    flat = matches.select(
        "id_a", "score", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in _ENDPOINT),
        *(F.when(F.col(f"{s}.{side}_ttl") > 0, F.col(f"{s}.{side}_ttl")).alias(f"{side}_ttl_{s}") for s in "ab" for side in ("client", "server")), *(F.col(f"{s}.total_bytes").alias(f"bytes_{s}") for s in "ab"),
        *([lesser_confidence(F.col("a.server_confidence"), F.col("b.server_confidence")).alias("_confidence")] if rated else []),
    )
    flat = flat.withColumns({h: hops(F.col(t)) for t, h in zip(TTLS, HOPS)})
    keys = [f"{c}_{s}" for s in "ab" for c in _ENDPOINT]
    # In millionths, so the mean does not depend on the order of the sum.
    points = F.sum(F.round(F.col("score") * 1_000_000).cast("long"))
    mean = F.floor((2 * points + F.count("*")) / (2 * F.count("*"))) / 1_000_000
    confidence = [mean_confidence(F.col("_confidence")).alias("confidence")] if rated else []
    grouped = flat.groupBy(*keys).agg(F.count("*").alias("count"), mean.alias("avg_score"), F.sum("bytes_a").alias("bytes_a"), F.sum("bytes_b").alias("bytes_b"), *confidence)
    return grouped.join(modes(flat, keys, [*TTLS, *HOPS], "id_a"), keys, "left").select(*grouped.columns, *TTLS, *HOPS)


def capture_order(ca: Column, sa: Column, cb: Column, sb: Column) -> Column:
    """Which capture point is nearer to the client, from hops to client and server at both; null if that cannot be told.

    A point without hops to the server and the other without hops to the client
    stand on both sides of a device that ends connections.
    """
    known = ca.isNotNull() & sa.isNotNull() & cb.isNotNull() & sb.isNotNull()
    ended = (ca - cb) != (sa - sb)
    return F.when(
        known,
        F.when(ended & (ca == 0) & (sb == 0), "BA").when(ended & (cb == 0) & (sa == 0), "AB").when(ca < cb, "AB").when(cb < ca, "BA").when(sa > sb, "AB").when(sb > sa, "BA"),
    )


def position(ca: Column, sa: Column, cb: Column, sb: Column) -> Column:
    """The label of ``capture_order`` in reports."""
    order = capture_order(ca, sa, cb, sb)
    return F.when(order == "AB", A_FIRST).when(order == "BA", B_FIRST).when((ca == cb) & (sa == sb), SAME).otherwise(UNKNOWN)


def node_position(endpoints: DataFrame) -> Column:
    """The position in graph nodes: untouched initial TTLs on opposite sides decide, else hops to the server. Null hops count as equal."""
    first = {c: F.coalesce(F.col(c).isin(*INITIAL_TTLS), F.lit(False)) for c in TTLS}
    behind = first["client_ttl_a"] & first["server_ttl_b"] & ~first["server_ttl_a"] & ~first["client_ttl_b"]
    before = first["server_ttl_a"] & first["client_ttl_b"] & ~first["client_ttl_a"] & ~first["server_ttl_b"]
    further = F.col("server_hops_a") - F.col("server_hops_b")
    return F.when(behind, B_FIRST).when(before, A_FIRST).when(further > 0, A_FIRST).when(further < 0, B_FIRST).otherwise(SAME)


def service_stats(endpoints: DataFrame) -> DataFrame:
    """Services (server port and protocol of side A) with their connections and the addresses of both sides."""
    return endpoints.groupBy(F.col("server_port_a").alias("server_port"), F.col("protocol_number_a").alias("protocol_number")).agg(
        F.sum("count").alias("connections"), F.count("*").alias("endpoint_pairs"),
        *(F.array_sort(F.collect_set(f"{c}_{s}")).alias(f"{c}s_{s}") for s in "ab" for c in ("client_ip", "server_ip")),
    )


def group_ids(services: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Add group_id: the id that ``known`` (server_port, group_id) gives, else numbers from one above by port.

    Numbers are dense over all services; a service is a port, so there are at most
    65 536 times the number of protocols, whatever the traffic.
    """
    if known is None:
        return services.withColumn("group_id", F.row_number().over(Window.orderBy("server_port", "protocol_number")))
    named = services.join(F.broadcast(known.select("server_port", "group_id")), "server_port", "left")
    most = F.coalesce(F.max("group_id").over(Window.partitionBy()), F.lit(0))
    new = F.row_number().over(Window.partitionBy(F.col("group_id").isNull()).orderBy("server_port", "protocol_number"))
    return named.withColumn("_most", most).withColumn("_new", new).withColumn("group_id", F.coalesce("group_id", F.col("_most") + F.col("_new"))).drop("_most", "_new")


def single_services(connections: DataFrame) -> DataFrame:
    """Services of one capture: clients, servers and the upper median of hops on either side."""
    with_hops = connections.withColumns({f"_{t}": F.when(F.col(t) > 0, hops(F.col(t))) for t in ("client_ttl", "server_ttl")})
    counted = with_hops.groupBy("server_port", "protocol_number").agg(F.count("*").alias("connections"), F.count_distinct("client_ip").alias("clients"), F.count_distinct("server_ip").alias("servers"))
    out = counted
    for t in ("client_ttl", "server_ttl"):
        out = out.join(_upper_median(with_hops, ["server_port", "protocol_number"], f"_{t}", t.replace("ttl", "hops")), ["server_port", "protocol_number"], "left")
    return out


def _upper_median(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Hops have at most 256 values: they are counted by value, and the median is read off the running counts."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    placed = counts.withColumns({"_upto": F.sum("_n").over(whole.orderBy(column)), "_total": F.sum("_n").over(whole)})
    # The value at place total div 2, counted from 0.
    return placed.where(F.col("_upto") > F.floor(F.col("_total") / 2)).groupBy(*keys).agg(F.min(column).alias(name))


def _number(ip: Column) -> Column:
    """A text that orders IPv4 addresses by their numbers."""
    return F.array_join(F.transform(F.split(ip, r"\."), lambda x: F.lpad(x, 3, "0")), ".")


def udp_flows(packets: DataFrame) -> DataFrame:
    """UDP flows by canonical 5-tuple with the packets of each side and which end serves; of equal ports the greater address does.

    Packets without ports are left out.
    """
    rows = _udp_sides(packets)
    first = F.col("side") == 1
    flows = rows.groupBy("ip_1", "port_1", "ip_2", "port_2").agg(F.count("*").alias("packets"), F.count_if(first).alias("packets_1"), F.count_if(~first).alias("packets_2"))
    return _with_server(flows)


def _udp_sides(packets: DataFrame) -> DataFrame:
    known = packets.where("src_port > 0 AND dst_port > 0")
    low, high = canonical_ends(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    ends = known.withColumns({"ip_1": low.ip, "port_1": low.port, "ip_2": high.ip, "port_2": high.port})
    return ends.withColumn("side", F.when((F.col("src_ip") == F.col("ip_1")) & (F.col("src_port") == F.col("port_1")), 1).otherwise(2))


def _with_server(flows: DataFrame) -> DataFrame:
    greater = F.when(_number(F.col("ip_1")) >= _number(F.col("ip_2")), 1).otherwise(2)
    serves = F.when(F.col("port_1") == F.col("port_2"), greater).otherwise(udp_server())
    pick = lambda c, one: F.when(serves == (1 if one else 2), F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    return flows.withColumns({"server_side": serves, "server_ip": pick("ip", True), "server_port": pick("port", True), "client_ip": pick("ip", False), "client_port": pick("port", False)})


def udp_services(packets: DataFrame, seen: str = "frame_number") -> DataFrame:
    """UDP services by server port: flows, packets, clients, servers and the modal hops of either side (null where no TTL was seen)."""
    flows = udp_flows(packets).groupBy("server_port").agg(F.count("*").alias("flows"), F.sum("packets").alias("packets"), F.count_distinct("client_ip").alias("clients"), F.count_distinct("server_ip").alias("servers"))
    sides = _with_server(_udp_sides(packets))
    far = F.when(F.col("ttl") > 0, hops(F.col("ttl")))
    own = sides.withColumns({"client_hops": F.when(F.col("side") != F.col("server_side"), far), "server_hops": F.when(F.col("side") == F.col("server_side"), far)})
    return flows.join(modes(own, ["server_port"], ["client_hops", "server_hops"], seen), "server_port", "left")


def unreachable_events(rows: DataFrame) -> DataFrame:
    """ICMP unreachable packets from comma-joined header lists: types, codes, protocols, sources, targets, ttls, tcp_ports, udp_ports.

    Kept are rows with a type 3 whose quoted TCP or UDP packet came from the
    outer one's target. Lists of ports start with the outer packet's if there are two.
    """
    parts = lambda c: F.split(F.coalesce(c, F.lit("")), ",")
    place = lambda name, *values: F.array_min(F.transform(F.array(*map(F.lit, values)), lambda v: F.nullif(F.array_position(parts("protocols"), v), F.lit(0))))
    at = lambda c, i: F.nullif(F.try_element_at(parts(c), i.cast("int")), F.lit(""))
    port = lambda c: F.coalesce(F.try_element_at(parts(c), F.when(F.size(parts(c)) > 1, 2).otherwise(1)).try_cast("int"), F.lit(0))
    found = rows.where(F.array_contains(parts("types"), "3")).withColumns({"_outer": place("outer", "1"), "_inner": place("inner", "6", "17")}).where("_outer IS NOT NULL AND _inner IS NOT NULL")
    kept = found.select(
        at("sources", F.col("_inner")).alias("client_ip"), at("sources", F.col("_outer")).alias("reporter_ip"), at("targets", F.col("_outer")).alias("reported_to"), F.coalesce(F.try_element_at(parts("codes"), F.lit(-1)).try_cast("int"), F.lit(0)).alias("code"),
        at("targets", F.col("_inner")).alias("inner_dst"), at("protocols", F.col("_inner")).cast("int").alias("protocol"), F.when(port("tcp_ports") > 0, port("tcp_ports")).otherwise(port("udp_ports")).alias("dst_port"),
        at("ttls", F.col("_outer")).try_cast("int").alias("ttl"), F.col("frame_number"),
    )
    return kept.where("reported_to = client_ip AND inner_dst IS NOT NULL")


_UNREACHABLE = ("client_ip", "reporter_ip", "code", "inner_dst", "protocol", "dst_port")


def unreachable_services(events: DataFrame) -> DataFrame:
    """Unreachable services by client, reporter, code and quoted target: how often, to whom mostly, and how far the reporter mostly is."""
    grouped = events.groupBy(*_UNREACHABLE).agg(F.count("*").alias("count"))
    far = events.withColumn("hops_from_reporter", F.when(F.col("ttl") > 0, hops(F.col("ttl"))))
    named = modes(far.select(*_UNREACHABLE, "frame_number", F.col("reported_to").alias("reported_to_ip")), _UNREACHABLE, ["reported_to_ip"], "frame_number")
    out = grouped
    for more in (named, modes(far, _UNREACHABLE, ["hops_from_reporter"], "frame_number")):
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"m.{k}")) for k in _UNREACHABLE]
        on = same[0]
        for x in same[1:]:
            on = on & x
        out = out.alias("o").join(more.alias("m"), on, "left").select("o.*", *(F.col(f"m.{c}") for c in more.columns if c not in _UNREACHABLE))
    return out


def in_report_order(unreachable: DataFrame) -> DataFrame:
    """The order in which a report lists unreachable services."""
    return unreachable.orderBy("client_ip", "inner_dst", "protocol", "dst_port", "code", "reporter_ip")
