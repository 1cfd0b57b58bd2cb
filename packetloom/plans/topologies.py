"""Queries on server roles, endpoints, services, positions and sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.operators import graph as G
from packetloom.operators import matching as M
from packetloom.operators import roles as R
from packetloom.operators import topology as T
from packetloom.operators.connections import build_connections
from packetloom.plans import sql
from packetloom.plans.flows import _MANY_SQL, _both
from packetloom.sources import reports
from packetloom.sources.testbed import UDP_ROWS, packet_view
from packetloom.storage import materialize, shared_dir, table
from packetloom.streaming import sessions as S


def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (x.withColumn("server_confidence", F.expr(_CONFIDENCE)) for x in _both(spark, sf_dir))
    return T.endpoint_stats(M.attach(M.one_to_many(a, b), a, b, [*T.NEEDED, "server_confidence"]))


#: Confidences as role detection would give them.
_CONFIDENCE = "CASE (stream_id + packet_count) % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'VERY_LOW' ELSE 'odd' END"


def endpoint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _endpoints(spark, sf_dir)


_KEYS = [f"{c}_{s}" for s in "ab" for c in ("client_ip", "server_ip", "server_port", "protocol_number")]
_HOP = lambda t: f"CASE WHEN {t} <= 0 THEN NULL WHEN {t} <= 64 THEN 64 - {t} WHEN {t} <= 128 THEN 128 - {t} ELSE 255 - {t} END"
_CONF = lambda s: f"CASE ({s}.stream_id + {s}.packet_count) % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 0 END"
_MODAL = [*T.TTLS, *T.HOPS]
_ENDPOINTS_SQL = _MANY_SQL + f""",
e0 AS (SELECT id_a, score, {", ".join(f"{k[-1]}.{k[:-2]} AS {k}" for k in _KEYS)}, {", ".join(f"CASE WHEN {t[-1]}.{t[:-2]} > 0 THEN {t[-1]}.{t[:-2]} END AS {t}" for t in T.TTLS)}, a.total_bytes AS ba, b.total_bytes AS bb, least({_CONF("a")}, {_CONF("b")}) AS conf FROM va),
ef AS (SELECT *, {", ".join(f"{_HOP(t)} AS {h}" for t, h in zip(T.TTLS, T.HOPS))} FROM e0),
eg AS (SELECT {", ".join(_KEYS)}, count(*) AS count, floor((2 * sum(CAST(round(score * 1000000) AS BIGINT)) + count(*)) / (2 * count(*))) / 1000000 AS avg_score, CAST(sum(ba) AS BIGINT) AS bytes_a, CAST(sum(bb) AS BIGINT) AS bytes_b,
       CASE WHEN avg(conf) >= 3.5 THEN 'HIGH' WHEN avg(conf) >= 2.5 THEN 'MEDIUM' WHEN avg(conf) >= 1.5 THEN 'LOW' WHEN avg(conf) >= 0.5 THEN 'VERY_LOW' ELSE 'UNKNOWN' END AS confidence FROM ef GROUP BY {", ".join(_KEYS)}),
{", ".join(f"""m{i} AS (SELECT {", ".join(_KEYS)}, {t} FROM (SELECT {", ".join(_KEYS)}, {t}, count(*) AS n, min(id_a) AS seen FROM ef WHERE {t} IS NOT NULL GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY {", ".join(_KEYS)} ORDER BY n DESC, seen, {t} DESC) = 1)""" for i, t in enumerate(_MODAL))},
es AS (SELECT * FROM eg {" ".join(f"LEFT JOIN m{i} USING ({', '.join(_KEYS)})" for i in range(len(_MODAL)))})"""


def endpoint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint pairs in the order of a report, numbered: the most frequent first, ties by their ends."""
    return _numbered(_endpoints(spark, sf_dir)).select("group_id", *_KEYS, "count")


def _numbered(endpoints: DataFrame) -> DataFrame:
    order = [F.desc("count"), *_KEYS]
    # Rows are grouped pairs of endpoints; their number is the report's own.
    return endpoints.withColumn("group_id", F.row_number().over(Window.orderBy(*order)))


_NUMBERED = f"SELECT *, row_number() OVER (ORDER BY count DESC, {', '.join(_KEYS)}) AS group_id FROM es"
_REPORT_SQL = _ENDPOINTS_SQL + f" SELECT group_id, {', '.join(_KEYS)}, count FROM ({_NUMBERED})"


def _flat_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("net_area", F.array_join(F.col("net_area").cast("array<string>"), ","))


def endpoint_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_nodes(G.endpoint_nodes(_numbered(_endpoints(spark, sf_dir)), 3, 4))


def _node_sql(source: str, pcap: int, kind: int, area: str = "''", ip: str = "NULL", port: str = "NULL", proto: str = "NULL", streams: str = "0", size: str = "0", name: str = "''", where: str = "true") -> str:
    return f"SELECT CAST({pcap} AS INT) AS pcap_id, CAST(group_id AS INT) AS group_id, CAST({ip} AS VARCHAR) AS ip, CAST({port} AS INT) AS port, CAST({proto} AS INT) AS proto, {kind} AS node_type, false AS is_capture, {area} AS net_area, CAST({streams} AS BIGINT) AS stream_cnt, CAST({size} AS BIGINT) AS pktlen, {name} AS display_name FROM {source} WHERE {where}"


_POSITION = """CASE WHEN i_client_ttl_a AND i_server_ttl_b AND NOT i_server_ttl_a AND NOT i_client_ttl_b THEN 'B_CLOSER_TO_CLIENT' WHEN i_server_ttl_a AND i_client_ttl_b AND NOT i_client_ttl_a AND NOT i_server_ttl_b THEN 'A_CLOSER_TO_CLIENT'
            WHEN server_hops_a > server_hops_b THEN 'A_CLOSER_TO_CLIENT' WHEN server_hops_a < server_hops_b THEN 'B_CLOSER_TO_CLIENT' ELSE 'SAME_POSITION' END"""
_INITIAL = ", ".join(f"coalesce({t} IN (64, 128, 255), false) AS i_{t}" for t in T.TTLS)
_placed = lambda source: f"(SELECT *, {_POSITION} AS place FROM (SELECT *, {_INITIAL} FROM {source}))"


def _sides(source: str, servers, clients, named: bool) -> str:
    """All nodes of both captures, given the sources of server and client rows."""
    out = []
    for s, own, other in (("a", 3, 4), ("b", 4, 3)):
        ahead, behind = ("A_CLOSER_TO_CLIENT", "B_CLOSER_TO_CLIENT") if s == "a" else ("B_CLOSER_TO_CLIENT", "A_CLOSER_TO_CLIENT")
        text = lambda h, w: f"'Network Device ({w}, ' || {h} || ' hops)'" if named else "''"
        out += [
            _node_sql(clients(s)[0], own, 1, f"CASE WHEN place = '{behind}' THEN '{other}' ELSE '' END", clients(s)[1]),
            _node_sql(source, own, 1001, name=text(f"client_hops_{s}", "Client-Capture"), where=f"client_hops_{s} > 0 AND place <> '{behind}'"),
            _node_sql(servers(s)[0], own, 2, f"CASE WHEN place = '{ahead}' THEN '{other}' ELSE '' END", *servers(s)[1:]),
            _node_sql(source, own, 1002, name=text(f"server_hops_{s}", "Capture-Server"), where=f"server_hops_{s} > 0 AND place <> '{ahead}'"),
        ]
    return " UNION ALL ".join(out)


_ENDPOINT_NODES_SQL = _ENDPOINTS_SQL + f""",
np AS (SELECT * FROM {_placed(f"({_NUMBERED})")})
{_sides("np", lambda s: ("np", f"server_ip_{s}", f"server_port_{s}", f"protocol_number_{s}", "count", f"bytes_{s}"), lambda s: ("np", f"client_ip_{s}"), True)}"""


def service_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    endpoints = materialize(_endpoints(spark, sf_dir))
    return _flat_nodes(G.service_nodes(endpoints, T.group_ids(T.service_stats(endpoints)), 3, 4))


_FIRST_ORDER = "count DESC, client_ip_a, server_ip_a, client_ip_b, server_ip_b, server_port_b"
_SERVICE_NODES_SQL = _ENDPOINTS_SQL + f""",
gi AS (SELECT server_port_a AS sp, protocol_number_a AS pn, row_number() OVER (ORDER BY server_port_a, protocol_number_a) AS group_id, sum(count) AS streams, sum(bytes_a) AS ba, sum(bytes_b) AS bb FROM es GROUP BY 1, 2),
fp AS (SELECT * FROM es QUALIFY row_number() OVER (PARTITION BY server_port_a, protocol_number_a ORDER BY {_FIRST_ORDER}) = 1),
sp AS (SELECT * FROM {_placed("(SELECT fp.*, group_id, streams, ba, bb FROM fp JOIN gi ON sp = server_port_a AND pn = protocol_number_a)")}),
{", ".join(f"""nc{s} AS (SELECT group_id, place, x.ip FROM sp JOIN (SELECT DISTINCT server_port_a AS p, protocol_number_a AS n, client_ip_{s} AS ip FROM es) x ON x.p = server_port_a AND x.n = protocol_number_a),
nv{s} AS (SELECT group_id, place, x.ip, x.port, protocol_number_a AS pn, streams, ba, bb FROM sp JOIN (SELECT server_port_a AS p, protocol_number_a AS n, server_ip_{s} AS ip, server_port_{s} AS port FROM es QUALIFY row_number() OVER (PARTITION BY server_port_a, protocol_number_a, server_ip_{s} ORDER BY {_FIRST_ORDER}) = 1) x ON x.p = server_port_a AND x.n = protocol_number_a)""" for s in "ab")}
{_sides("sp", lambda s: (f"nv{s}", "ip", "port", "pn", "streams", f"b{s}"), lambda s: (f"nc{s}", "ip"), False)}"""


def service_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of every endpoint pair, whether its points are balanced, and its service's addresses as a report lists them."""
    e = materialize(_endpoints(spark, sf_dir))
    hops = {h: F.col(h) for h in T.HOPS}
    lists = e.groupBy("server_port_a", "protocol_number_a").agg(G.address_list(F.collect_set("client_ip_a")).alias("clients"), G.server_list(F.collect_set("server_ip_a"), F.collect_set("server_port_a")).alias("servers"))
    order = T.capture_order(*(hops[h] for h in T.HOPS))
    return e.join(lists, ["server_port_a", "protocol_number_a"]).select(*_KEYS, G.dual_path(order, hops).alias("path"), G.is_balanced(hops).alias("balanced"), G.position_text(hops["client_hops_a"], hops["server_hops_a"]).alias("position_a"), "clients", "servers")


_ORDER = """CASE WHEN ca IS NULL OR sa IS NULL OR cb IS NULL OR sb IS NULL THEN NULL WHEN ca - cb <> sa - sb AND ca = 0 AND sb = 0 THEN 'BA' WHEN ca - cb <> sa - sb AND cb = 0 AND sa = 0 THEN 'AB'
         WHEN ca < cb THEN 'AB' WHEN cb < ca THEN 'BA' WHEN sa > sb THEN 'AB' WHEN sb > sa THEN 'BA' END"""
_PATHS_SQL = _ENDPOINTS_SQL + f""",
h AS (SELECT *, client_hops_a AS ca, server_hops_a AS sa, client_hops_b AS cb, server_hops_b AS sb FROM es),
o AS (SELECT *, coalesce({_ORDER} = 'BA', false) AS t FROM h),
d AS (SELECT *, CASE WHEN t THEN cb ELSE ca END AS c1, CASE WHEN t THEN ca ELSE cb END AS c2, CASE WHEN t THEN sb ELSE sa END AS s1, CASE WHEN t THEN sa ELSE sb END AS s2 FROM o),
l AS (SELECT server_port_a, protocol_number_a, list_sort(list(DISTINCT client_ip_a)) AS lc, list_sort(list(DISTINCT server_ip_a)) AS ls FROM es GROUP BY 1, 2)
SELECT {", ".join(_KEYS)}, 'Client' || CASE WHEN c1 > 0 THEN ' ->[Network Device]-> ' ELSE ' -> ' END || 'Capture Point ' || CASE WHEN t THEN 'B' ELSE 'A' END || CASE WHEN coalesce(c1 <> c2 OR s1 <> s2, false) THEN ' ->[Network Device]-> ' ELSE ' -> ' END
       || 'Capture Point ' || CASE WHEN t THEN 'A' ELSE 'B' END || CASE WHEN s2 > 0 THEN ' ->[Network Device]-> ' ELSE ' -> ' END || 'Server' AS path, abs(ca - cb) = abs(sa - sb) AS balanced,
       CASE WHEN ca IS NOT NULL AND sa IS NOT NULL THEN ca || ' hops away from the client and ' || sa || ' hops away from the server' WHEN ca IS NOT NULL THEN ca || ' hops away from the client; server TTL data unavailable' WHEN sa IS NOT NULL THEN sa || ' hops away from the server; client TTL data unavailable' ELSE 'no TTL data available' END AS position_a,
       array_to_string(lc[:3], ', ') || CASE WHEN len(lc) > 3 THEN ', ... (' || len(lc) || ' total)' ELSE '' END AS clients, array_to_string(ls[:3], ', ') || CASE WHEN len(ls) > 3 THEN ', ... (' || len(ls) || ' total)' ELSE '' END || ':' || server_port_a AS servers
FROM d JOIN l USING (server_port_a, protocol_number_a)"""


def topology_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing matched: the services of either capture for itself."""
    a, b = (T.single_services(x) for x in _both(spark, sf_dir))
    nothing = a.selectExpr("server_port", "protocol_number", *(f"CAST(NULL AS INT) AS {h}" for h in T.HOPS)).limit(0)
    return G.describe_services(nothing, [("A", a), ("B", b)])


def service_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = T.group_ids(T.service_stats(_endpoints(spark, sf_dir)))
    return services.withColumns({f"{c}s_{s}": F.array_join(f"{c}s_{s}", ",") for s in "ab" for c in ("client_ip", "server_ip")})


_SERVICES_SQL = _ENDPOINTS_SQL + f"""
SELECT server_port_a AS server_port, protocol_number_a AS protocol_number, CAST(sum(count) AS BIGINT) AS connections, count(*) AS endpoint_pairs,
       {", ".join(f"string_agg(DISTINCT {c}_{s}, ',' ORDER BY {c}_{s}) AS {c}s_{s}" for s in "ab" for c in ("client_ip", "server_ip"))},
       row_number() OVER (ORDER BY server_port_a, protocol_number_a) AS group_id
FROM es GROUP BY 1, 2"""


def capture_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _endpoints(spark, sf_dir)
    hops = [F.col(t.replace("ttl", "hops")) for t in T.TTLS]
    return e.select(*_KEYS, T.capture_order(*hops).alias("capture_order"), T.position(*hops).alias("position"), T.node_position(e).alias("node_position"))


_POSITIONS_SQL = _ENDPOINTS_SQL + f""",
h AS (SELECT *, client_hops_a AS ca, server_hops_a AS sa, client_hops_b AS cb, server_hops_b AS sb FROM es), o AS (SELECT *, {_ORDER} AS capture_order, {_INITIAL} FROM h)
SELECT {", ".join(_KEYS)}, capture_order, CASE WHEN capture_order = 'AB' THEN 'A_CLOSER_TO_CLIENT' WHEN capture_order = 'BA' THEN 'B_CLOSER_TO_CLIENT' WHEN ca = cb AND sa = sb THEN 'SAME_POSITION' ELSE 'UNKNOWN' END AS position, {_POSITION} AS node_position
FROM o"""


def _role_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections whose ports and handshakes leave every rule something to decide."""
    built = build_connections(packet_view(spark, sf_dir, "capture_a"))
    third = F.col("stream_id") % 3 == 0
    turned = built.withColumns({"server_port": F.when(F.col("server_port") == 443, 9443).when(third, F.col("server_port") + 20000).otherwise(F.col("server_port")), "syn_options": F.when(F.col("stream_id") % 7 == 0, F.col("syn_options")).otherwise("")})
    return turned.select("capture_id", "stream_id", "client_ip", "client_port", "server_ip", "server_port", "syn_options")


def role_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = spark.createDataFrame([("192.168.1.4", 9443), ("10.0.3.3", None)], "ip string, port int")
    return R.detect_roles(_role_input(spark, sf_dir), services)


_LISTED = lambda s: f"(({s}_ip = '192.168.1.4' AND {s}_port = 9443) OR {s}_ip = '10.0.3.3')"
_IN = lambda s, ports: f"{s}_port IN ({', '.join(map(str, ports))})"
_WAY = lambda f: f"CASE WHEN ({f('server')}) AND NOT ({f('client')}) THEN 'keep' WHEN ({f('client')}) AND NOT ({f('server')}) THEN 'swap' END"
_ROLES_SQL = f"""
WITH {sql.connections("capture_a", "c")},
i AS (SELECT capture_id, stream_id, client_ip, client_port, server_ip, CAST(CASE WHEN server_port = 443 THEN 9443 WHEN stream_id % 3 = 0 THEN server_port + 20000 ELSE server_port END AS INT) AS server_port, CASE WHEN stream_id % 7 = 0 THEN syn_options ELSE '' END AS syn_options FROM c),
d AS (SELECT server_ip AS ip, server_port AS port, client_ip AS peer, client_port AS pp FROM i UNION SELECT client_ip, client_port, server_ip, server_port FROM i),
be AS (SELECT ip, port, count(DISTINCT peer) AS peers, count(DISTINCT pp) AS pps FROM d GROUP BY 1, 2), bp AS (SELECT port, count(DISTINCT ip) AS hosts FROM d GROUP BY 1),
j AS (SELECT i.*, se.peers AS s_peers, se.pps AS s_pps, sp.hosts AS s_hosts, ce.peers AS c_peers, ce.pps AS c_pps, cp.hosts AS c_hosts FROM i
      LEFT JOIN be se ON se.ip = server_ip AND se.port = server_port LEFT JOIN be ce ON ce.ip = client_ip AND ce.port = client_port LEFT JOIN bp sp ON sp.port = server_port LEFT JOIN bp cp ON cp.port = client_port),
w AS (SELECT *, {_WAY(_LISTED)} AS w1, CASE WHEN syn_options <> '' THEN 'keep' END AS w2, {_WAY(lambda s: _IN(s, R.WELL_KNOWN_PORTS))} AS w3, {_WAY(lambda s: _IN(s, R.DATABASE_PORTS))} AS w4, {_WAY(lambda s: f"{s}_port < 1024")} AS w5,
        {_WAY(lambda s: f"{s[0]}_peers >= 2")} AS w6, {_WAY(lambda s: f"{s[0]}_hosts >= 2")} AS w7, {_WAY(lambda s: f"{s[0]}_pps >= 2")} AS w8,
        CASE WHEN s_peers >= 3 * c_peers THEN 'keep' WHEN c_peers >= 3 * s_peers THEN 'swap' END AS w9, CASE WHEN server_port < client_port THEN 'keep' ELSE 'swap' END AS w0 FROM j),
v AS (SELECT *, coalesce(w1, w2, w3, w4, w5, w6, w7, w8, w9, w0) = 'swap' AS sw,
        CASE WHEN coalesce(w1, w2, w3, w4, w5, w6, w7, w8, w9, w0) = 'swap' THEN '_SWAPPED' ELSE '' END AS t, coalesce(w6 = w7, false) AS reused,
        CASE WHEN coalesce(w1, w2, w3, w4, w5, w6, w7, w8, w9, w0) = 'swap' THEN c_peers || 'v' || s_peers ELSE s_peers || 'v' || c_peers END AS pv,
        CASE WHEN coalesce(w1, w2, w3, w4, w5, w6, w7, w8, w9, w0) = 'swap' THEN c_peers ELSE s_peers END AS p, CASE WHEN coalesce(w1, w2, w3, w4, w5, w6, w7, w8, w9, w0) = 'swap' THEN c_hosts ELSE s_hosts END AS h,
        CASE WHEN coalesce(w1, w2, w3, w4, w5, w6, w7, w8, w9, w0) = 'swap' THEN c_pps ELSE s_pps END AS q, CASE WHEN coalesce(w1, w2, w3, w4, w5, w6, w7, w8, w9, w0) = 'swap' THEN client_port ELSE server_port END AS sp FROM w)
SELECT capture_id, stream_id, CASE WHEN sw THEN server_ip ELSE client_ip END AS client_ip, CASE WHEN sw THEN server_port ELSE client_port END AS client_port, CASE WHEN sw THEN client_ip ELSE server_ip END AS server_ip, CASE WHEN sw THEN client_port ELSE server_port END AS server_port, syn_options,
       CASE WHEN w1 IS NOT NULL OR w2 IS NOT NULL OR w3 IS NOT NULL THEN 'HIGH' WHEN w4 IS NOT NULL OR w5 IS NOT NULL THEN 'MEDIUM' WHEN w6 IS NOT NULL THEN CASE WHEN reused OR p >= 5 THEN 'HIGH' ELSE 'MEDIUM' END WHEN coalesce(w7, w8, w9) IS NOT NULL THEN 'MEDIUM' ELSE 'VERY_LOW' END AS server_confidence,
       CASE WHEN w1 IS NOT NULL THEN 'SERVICE_LIST' || t WHEN w2 IS NOT NULL THEN 'SYN_PACKET' WHEN coalesce(w3, w4, w5) IS NOT NULL THEN 'PORT_HEURISTIC' || t
            WHEN w6 IS NOT NULL THEN CASE WHEN reused THEN 'CARDINALITY_PORT_REUSE' || t || '_' || pv || '_P' || h ELSE 'CARDINALITY' || t || '_' || pv END WHEN w7 IS NOT NULL THEN 'PORT_REUSE' || t || '_' || h || 'servers_on_port' || sp
            WHEN w8 IS NOT NULL THEN 'PORT_STABILITY' || t || '_' || q || 'peer_ports' WHEN w9 IS NOT NULL THEN 'CARDINALITY_RATIO' || t || '_' || pv ELSE 'FALLBACK_PORT_COMPARISON' || t END AS server_method
FROM v"""


def single_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.single_services(build_connections(packet_view(spark, sf_dir, "capture_b")))


_HOPS = _HOP
_SINGLE_SQL = f"""
WITH {sql.connections("capture_b", "c")},
h AS (SELECT *, {_HOPS("client_ttl")} AS ch, {_HOPS("server_ttl")} AS sh FROM c),
l AS (SELECT server_port, protocol_number, count(*) AS connections, count(DISTINCT client_ip) AS clients, count(DISTINCT server_ip) AS servers, list_sort(list(ch) FILTER (WHERE ch IS NOT NULL)) AS c, list_sort(list(sh) FILTER (WHERE sh IS NOT NULL)) AS s FROM h GROUP BY 1, 2)
SELECT server_port, protocol_number, connections, clients, servers, c[len(c) // 2 + 1] AS client_hops, s[len(s) // 2 + 1] AS server_hops FROM l"""

def _single_part(view: str, label: str) -> str:
    return f"""(WITH {sql.connections(view, "c")}, h AS (SELECT *, {_HOPS("client_ttl")} AS ch, {_HOPS("server_ttl")} AS sh FROM c),
l AS (SELECT server_port, protocol_number, list_sort(list(ch) FILTER (WHERE ch IS NOT NULL)) AS c, list_sort(list(sh) FILTER (WHERE sh IS NOT NULL)) AS s FROM h GROUP BY 1, 2), m AS (SELECT server_port, protocol_number, c[len(c) // 2 + 1] AS ca, s[len(s) // 2 + 1] AS sa FROM l)
SELECT '{label}' AS capture, server_port, protocol_number, 'Client' || CASE WHEN ca > 0 THEN ' ->[Network Device]-> ' ELSE ' -> ' END || 'Capture Point {label}' || CASE WHEN sa > 0 THEN ' ->[Network Device]-> ' ELSE ' -> ' END || 'Server' AS path,
       CASE WHEN ca IS NOT NULL AND sa IS NOT NULL THEN ca || ' hops away from the client and ' || sa || ' hops away from the server' WHEN ca IS NOT NULL THEN ca || ' hops away from the client; server TTL data unavailable' WHEN sa IS NOT NULL THEN sa || ' hops away from the server; client TTL data unavailable' ELSE 'no TTL data available' END AS description FROM m)"""


_FALLBACK_SQL = f"SELECT * FROM {_single_part('capture_a', 'A')} UNION ALL SELECT * FROM {_single_part('capture_b', 'B')}"


def _datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*UDP_ROWS, "event_id AS frame_number", "CAST(60 + event_id % 9 AS INT) AS ttl")


def udp_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.udp_services(_datagrams(spark, sf_dir))


_KNOWN_UDP = ", ".join(map(str, R.UDP_PORTS))
_UDP_SQL = f"""
WITH p AS (SELECT {", ".join(UDP_ROWS).replace("STRING", "VARCHAR")}, event_id, CAST(60 + event_id % 9 AS INT) AS ttl FROM events),
c AS (SELECT *, (src_ip, src_port) <= (dst_ip, dst_port) AS f FROM p WHERE src_port > 0 AND dst_port > 0),
q AS (SELECT CASE WHEN f THEN src_ip ELSE dst_ip END AS i1, CASE WHEN f THEN src_port ELSE dst_port END AS p1, CASE WHEN f THEN dst_ip ELSE src_ip END AS i2, CASE WHEN f THEN dst_port ELSE src_port END AS p2, CASE WHEN f THEN 1 ELSE 2 END AS side, ttl, event_id FROM c),
s AS (SELECT *, CASE WHEN p1 = p2 THEN CASE WHEN i1 >= i2 THEN 1 ELSE 2 END WHEN p1 IN ({_KNOWN_UDP}) AND p2 NOT IN ({_KNOWN_UDP}) THEN 1 WHEN p2 IN ({_KNOWN_UDP}) AND p1 NOT IN ({_KNOWN_UDP}) THEN 2 WHEN p1 <= p2 THEN 1 ELSE 2 END AS w FROM q),
t AS (SELECT *, CASE WHEN w = 1 THEN p1 ELSE p2 END AS server_port, CASE WHEN w = 1 THEN i2 ELSE i1 END AS cl, CASE WHEN w = 1 THEN i1 ELSE i2 END AS sv, {_HOP("ttl")} AS far FROM s),
g AS (SELECT server_port, count(DISTINCT (i1, p1, i2, p2)) AS flows, count(*) AS packets, count(DISTINCT cl) AS clients, count(DISTINCT sv) AS servers FROM t GROUP BY 1),
m AS (SELECT server_port, side = w AS served, far FROM t GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY server_port, side = w ORDER BY count(*) DESC, min(event_id), far DESC) = 1)
SELECT g.*, c.far AS client_hops, v.far AS server_hops FROM g LEFT JOIN m c ON c.server_port = g.server_port AND NOT c.served LEFT JOIN m v ON v.server_port = g.server_port AND v.served"""

_ICMP = (
    "CASE event_id % 4 WHEN 0 THEN '11' WHEN 1 THEN '3,3' ELSE '3' END AS types", "CAST(event_id % 5 AS STRING) || ',' || CAST(event_id % 3 AS STRING) AS codes",
    "CASE event_id % 8 WHEN 7 THEN '47,' ELSE '' END || '1,' || CASE event_id % 7 WHEN 0 THEN '1' WHEN 1 THEN '6' ELSE '17' END AS protocols",
    "CASE event_id % 8 WHEN 7 THEN '9.9.9.9,' ELSE '' END || '10.1.0.' || CAST(user_id % 5 AS STRING) || ',10.2.0.' || CAST(user_id % 20 AS STRING) AS sources",
    "CASE event_id % 8 WHEN 7 THEN '9.9.9.8,' ELSE '' END || '10.2.0.' || CAST((user_id + CASE event_id % 6 WHEN 0 THEN 1 ELSE 0 END) % 20 AS STRING) || ',10.3.0.' || CAST(user_id % 9 AS STRING) AS targets",
    "CASE event_id % 8 WHEN 7 THEN '1,' ELSE '' END || CAST(240 + event_id % 16 AS STRING) || ',64' AS ttls",
    "CASE event_id % 7 WHEN 1 THEN CASE event_id % 2 WHEN 0 THEN '9,' ELSE '' END || CAST(50 + user_id % 4 AS STRING) ELSE '' END AS tcp_ports", "CASE event_id % 7 WHEN 1 THEN '' ELSE CAST(500 + user_id % 3 AS STRING) END AS udp_ports", "event_id AS frame_number",
)


def icmp_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.in_report_order(T.unreachable_services(T.unreachable_events(table(spark, sf_dir, "events").selectExpr(*_ICMP))))


#: From quoted packets ``k`` on.
ICMP_TAIL = f"""
e AS (SELECT *, {_HOP("ttl")} AS far FROM k WHERE reported_to = client_ip AND inner_dst <> ''),
g AS (SELECT client_ip, reporter_ip, code, inner_dst, protocol, dst_port, count(*) AS count FROM e GROUP BY ALL),
t AS (SELECT client_ip, reporter_ip, code, inner_dst, protocol, dst_port, reported_to AS reported_to_ip FROM e GROUP BY 1, 2, 3, 4, 5, 6, 7 QUALIFY row_number() OVER (PARTITION BY client_ip, reporter_ip, code, inner_dst, protocol, dst_port ORDER BY count(*) DESC, min(frame_number), e.reported_to DESC) = 1),
h AS (SELECT client_ip, reporter_ip, code, inner_dst, protocol, dst_port, far AS hops_from_reporter FROM e WHERE far IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7 QUALIFY row_number() OVER (PARTITION BY client_ip, reporter_ip, code, inner_dst, protocol, dst_port ORDER BY count(*) DESC, min(frame_number), e.far DESC) = 1)
SELECT * FROM g LEFT JOIN t USING (client_ip, reporter_ip, code, inner_dst, protocol, dst_port) LEFT JOIN h USING (client_ip, reporter_ip, code, inner_dst, protocol, dst_port)"""
_ICMP_SQL = f"""
WITH r AS (SELECT {", ".join(_ICMP).replace("STRING", "VARCHAR")} FROM events),
l AS (SELECT *, string_split(protocols, ',') AS pl, string_split(sources, ',') AS sl, string_split(targets, ',') AS tl, string_split(ttls, ',') AS hl, string_split(tcp_ports, ',') AS tp, string_split(udp_ports, ',') AS up FROM r WHERE list_contains(string_split(types, ','), '3')),
i AS (SELECT *, list_position(pl, '1') AS o, list_min(list_filter([list_position(pl, '6'), list_position(pl, '17')], lambda x: x > 0)) AS n FROM l),
k AS (SELECT sl[n] AS client_ip, sl[o] AS reporter_ip, tl[o] AS reported_to, CAST(string_split(codes, ',')[-1] AS INT) AS code, tl[n] AS inner_dst, CAST(pl[n] AS INT) AS protocol, CAST(hl[o] AS INT) AS ttl, frame_number,
             coalesce(nullif(TRY_CAST(tp[CASE WHEN len(tp) > 1 THEN 2 ELSE 1 END] AS INT), 0), TRY_CAST(up[CASE WHEN len(up) > 1 THEN 2 ELSE 1 END] AS INT), 0) AS dst_port FROM i WHERE o > 0 AND n > 0),
{ICMP_TAIL}"""


def streaming_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, from the events as a stream of files (a stream's source is a folder)."""
    source, events = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}", table(spark, sf_dir, "events")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source).selectExpr("user_id", "CAST(ts AS TIMESTAMP) AS t")
    done = S.run_available(S.sessions(stream, ["user_id"], "t"), "complete")
    return done.select("user_id", "packets", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


_SESSIONS_SQL = """
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 1800000000, true) AS starts FROM e),
n AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS packets, min(t) AS first_us, max(t) AS last_us FROM n GROUP BY user_id, k"""

def streaming_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections of capture A as a stream of files: those that FIN or RST ended, and those idle for long once the stream's time has moved on."""
    source, packets = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}", packet_view(spark, sf_dir, "capture_a").select("capture_id", "stream_id", "time_ms", "flags", "frame_len")
    packets.write.parquet(source)
    return S.run_available(S.stateful_connections(spark.readStream.schema(packets.schema).parquet(source)))


_STREAMED_SQL = f"""
WITH p AS (SELECT *, (flags & 5) <> 0 AS ends FROM {sql.duckdb_view("capture_a")}),
n AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY stream_id ORDER BY time_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM p),
s AS (SELECT capture_id, stream_id, k, min(time_ms) AS first_ms, max(time_ms) AS last_ms, count(*) AS packet_count, CAST(sum(frame_len) AS BIGINT) AS total_bytes, bool_or(ends) AS ended FROM n GROUP BY ALL)
SELECT * EXCLUDE (k) FROM s WHERE ended OR last_ms + 600000 < (SELECT max(time_ms) - 600000 FROM p)"""


def _written(df: DataFrame, column: str, name: str) -> str:
    """A text file of a column's lines in the shared folder."""
    at = f"{shared_dir(df.sparkSession)}/{name}/{uuid.uuid4().hex}"
    df.select(column).coalesce(1).write.text(at)
    return at


def report_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches printed as a report's table and read back from it."""
    a, b = _both(spark, sf_dir)
    m = M.attach(M.one_to_many(a, b), a, b, ["client_ip", "client_port", "server_ip", "server_port"])
    end = lambda s, c: F.concat(F.col(f"{s}.{c}_ip"), F.lit(":"), F.col(f"{s}.{c}_port").cast("string"))
    lines = m.select(F.concat_ws("  ", F.col("id_a").cast("string"), F.col("id_a").cast("string"), end("a", "client"), end("a", "server"), F.col("id_b").cast("string"), end("b", "client"), end("b", "server"), F.format_string("%.2f", F.bround("score", 2))).alias("line"))
    heading = spark.createDataFrame([("No.  Stream A  Client A  Server A  Stream B  Client B  Server B  Conf",), ("-" * 40,)], "line string")
    return reports.read_matched_connections(spark, _written(heading.union(lines), "line", "reports"))


_REPORT_PAIRS_SQL = _MANY_SQL + """
SELECT id_a AS pair_id, id_a, a.client_ip || ':' || a.client_port || ' <-> ' || a.server_ip || ':' || a.server_port AS connection_a, id_b, b.client_ip || ':' || b.client_port || ' <-> ' || b.server_ip || ':' || b.server_port AS connection_b, round_even(score, 2) AS score FROM va"""


def listed_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services named in a text, and those of a service list, by how they were named."""
    ends = packet_view(spark, sf_dir, "capture_a").where("flags = 18").selectExpr("concat('see ', src_ip, ':', src_port, ', or ', src_ip, ':', src_port + 1) AS line", "concat(src_ip, ':', CASE WHEN src_port = 443 THEN '*' ELSE CAST(src_port AS STRING) END) AS entry")
    named = reports.read_services(spark, _written(ends, "line", "topologies")).select("ip", "port", F.lit("text").alias("source"))
    return named.union(reports.read_service_list(spark, _written(ends, "entry", "services")).select("ip", "port", F.lit("list").alias("source")))


_LISTED_SQL = f"""
WITH e AS (SELECT src_ip, src_port FROM {sql.duckdb_view("capture_a")} WHERE flags = 18)
SELECT DISTINCT src_ip AS ip, src_port AS port, 'text' AS source FROM e UNION SELECT src_ip, src_port + 1, 'text' FROM e UNION SELECT src_ip, CASE WHEN src_port = 443 THEN NULL ELSE src_port END, 'list' FROM e"""


def grouped_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services with the groups that a map gives some of them."""
    groups = reports.read_group_map(spark, _written(spark.createDataFrame([('{"443": 7, "3306": 2}',)], "line string"), "line", "groups"))
    return T.group_ids(T.service_stats(_endpoints(spark, sf_dir)), groups).select("server_port", "protocol_number", "connections", "group_id")


_GROUPED_SQL = _ENDPOINTS_SQL + """,
g AS (SELECT server_port_a AS server_port, protocol_number_a AS protocol_number, CAST(sum(count) AS BIGINT) AS connections, CASE server_port_a WHEN 443 THEN 7 WHEN 3306 THEN 2 END AS known FROM es GROUP BY 1, 2)
SELECT server_port, protocol_number, connections, CASE WHEN known IS NOT NULL THEN known ELSE 7 + row_number() OVER (PARTITION BY known IS NULL ORDER BY server_port, protocol_number) END AS group_id FROM g"""

QUERIES = {
    f.__name__: f
    for f in (
        endpoint_stats, endpoint_report, endpoint_nodes, service_nodes, service_paths, topology_fallback, service_stats, capture_positions, role_detection, single_services, udp_services, icmp_unreachable, streaming_sessions, streaming_connections, report_pairs, listed_services, grouped_services,
    )
}
ORACLES = {
    "endpoint_stats": _ENDPOINTS_SQL + " SELECT * FROM es", "endpoint_report": _REPORT_SQL, "endpoint_nodes": _ENDPOINT_NODES_SQL, "service_nodes": _SERVICE_NODES_SQL, "service_paths": _PATHS_SQL, "topology_fallback": _FALLBACK_SQL,
    "service_stats": _SERVICES_SQL, "capture_positions": _POSITIONS_SQL, "role_detection": _ROLES_SQL, "single_services": _SINGLE_SQL, "udp_services": _UDP_SQL, "icmp_unreachable": _ICMP_SQL, "streaming_sessions": _SESSIONS_SQL, "streaming_connections": _STREAMED_SQL, "report_pairs": _REPORT_PAIRS_SQL, "listed_services": _LISTED_SQL, "grouped_services": _GROUPED_SQL,
}
