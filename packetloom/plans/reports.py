"""Queries of the analysis modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import packets as P
from packetloom.operators import modules as M
from packetloom.operators import protocols as R
from packetloom.operators.connections import build_connections
from packetloom.plans import sql
from packetloom.sources.testbed import UDP_ROWS, duckdb_view, packet_view
from packetloom.storage import table

_PK = duckdb_view("packets")


def conversations_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.conversations(packet_view(spark, sf_dir))


def conversations_tcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.conversations(packet_view(spark, sf_dir), ("ip", "port"))


def _conversations_sql(ends: tuple[str, ...], source: str = _PK) -> str:
    src, dst = ", ".join(f"src_{e}" for e in ends), ", ".join(f"dst_{e}" for e in ends)
    low = ", ".join(f"CASE WHEN fwd THEN src_{e} ELSE dst_{e} END AS {e}_a, CASE WHEN fwd THEN dst_{e} ELSE src_{e} END AS {e}_b" for e in ends)
    return f"""
SELECT {low}, count(*) FILTER (WHERE fwd) AS frames_ab, CAST(coalesce(sum(frame_len) FILTER (WHERE fwd), 0) AS BIGINT) AS bytes_ab,
       count(*) FILTER (WHERE NOT fwd) AS frames_ba, CAST(coalesce(sum(frame_len) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS bytes_ba,
       count(*) AS frames, CAST(sum(frame_len) AS BIGINT) AS bytes, min(time_ms) AS start_ms, max(time_ms) - min(time_ms) AS duration_ms
FROM (SELECT *, ({src}) <= ({dst}) AS fwd FROM {source}) GROUP BY {", ".join(str(i + 1) for i in range(2 * len(ends)))}"""


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hosts(packet_view(spark, sf_dir))


_HOSTS_SQL = f"""
WITH p AS (SELECT * FROM {_PK}), r AS (SELECT src_ip AS ip, 1 AS sent, frame_len FROM p UNION ALL SELECT dst_ip, 0, frame_len FROM p)
SELECT ip, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes, count(*) FILTER (WHERE sent = 1) AS tx_packets, CAST(coalesce(sum(frame_len) FILTER (WHERE sent = 1), 0) AS BIGINT) AS tx_bytes,
       count(*) FILTER (WHERE sent = 0) AS rx_packets, CAST(coalesce(sum(frame_len) FILTER (WHERE sent = 0), 0) AS BIGINT) AS rx_bytes
FROM r GROUP BY ip"""

_APP = "CASE WHEN least(src_port, dst_port) = 443 OR greatest(src_port, dst_port) = 443 THEN 'tls' WHEN src_port = 80 OR dst_port = 80 THEN 'http' ELSE 'data' END"


def protocol_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = packet_view(spark, sf_dir).selectExpr("frame_len", "'eth' AS l2", "'ip' AS l3", "'tcp' AS l4", f"{_APP} AS l5")
    return M.protocol_hierarchy(packets, ("l2", "l3", "l4", "l5"))


_HIERARCHY_SQL = f"""
WITH p AS (SELECT frame_len, {_APP} AS l5 FROM {_PK})
SELECT path, count(*) AS frames, CAST(sum(frame_len) AS BIGINT) AS bytes
FROM (SELECT frame_len, unnest(['eth', 'eth:ip', 'eth:ip:tcp', 'eth:ip:tcp:' || l5]) AS path FROM p) GROUP BY path"""


def source_ttl_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tree(packet_view(spark, sf_dir), ("src_ip", "ttl", "dst_ip"))


def destination_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tree(packet_view(spark, sf_dir), ("dst_ip", "protocol", "dst_port"))


def _tree_sql(levels: tuple[str, ...]) -> str:
    names = ", ".join(levels)
    return f"""
WITH p AS (SELECT time_ms, {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in levels)} FROM {_PK}), t AS (SELECT max(time_ms) - min(time_ms) AS span, count(*) AS total FROM p),
g AS (SELECT {names}, CAST(GROUPING({names}) AS INT) AS level_mask, count(*) AS count FROM p GROUP BY ROLLUP ({names}))
SELECT {names}, level_mask, count, round(CASE WHEN span > 0 THEN count / span ELSE 0 END, 9) AS rate_ms, round(100.0 * count / total, 4) AS percent FROM g, t"""


def zero_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.zero_windows(packet_view(spark, sf_dir).withColumn("window", F.col("len") % 7), "window")


_ZERO_SQL = f"""
SELECT src_ip, src_port, dst_ip, dst_port, count(*) AS count, CASE WHEN count(*) >= 50 THEN 'High' WHEN count(*) >= 10 THEN 'Medium' ELSE 'Low' END AS severity
FROM {_PK} WHERE len % 7 = 0 GROUP BY 1, 2, 3, 4"""


def tcp_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.durations(build_connections(packet_view(spark, sf_dir)).withColumns({"first_ms": F.col("first_ms") * 60, "last_ms": F.col("last_ms") * 60}))


_DURATIONS_SQL = f"""
WITH c AS (SELECT (max(time_ms) - min(time_ms)) * 60 / 1000 AS s FROM {_PK} GROUP BY stream_id),
b AS (SELECT CASE WHEN s < 1 THEN '<1s' WHEN s < 5 THEN '1-5s' WHEN s < 10 THEN '5-10s' WHEN s < 30 THEN '10-30s' WHEN s < 60 THEN '30-60s' ELSE '>=60s' END AS bucket, count(*) AS count FROM c GROUP BY 1)
SELECT bucket, count, round(100.0 * count / sum(count) OVER (), 4) AS share, CASE WHEN bucket IN ('30-60s', '>=60s') THEN 'High' WHEN bucket = '10-30s' THEN 'Medium' ELSE 'Low' END AS severity FROM b"""


def tcp_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.completeness(M.completeness_of_streams(packet_view(spark, sf_dir), ["stream_id"]))


_COMPLETENESS_SQL = f"""
WITH s AS (SELECT bool_or((flags & 18) = 2) AS c, bool_or((flags & 18) = 18) AS sv, bool_or((flags & 18) = 16) AS a, bool_or(len > 0) AS d, bool_or((flags & 4) <> 0) AS r, bool_or((flags & 1) <> 0) AS fi FROM {_PK} GROUP BY stream_id)
SELECT CASE WHEN c AND sv AND a THEN 'Complete' WHEN c AND a THEN 'Established' WHEN c THEN 'Half-open' ELSE 'Unknown' END AS status, CASE WHEN d THEN 'WITH_DATA' ELSE 'NO_DATA' END || CASE WHEN e THEN '_CLOSED' ELSE '' END AS data, flags, count(*) AS count,
       CASE WHEN NOT c THEN 'High' WHEN NOT a THEN 'High' WHEN NOT sv OR NOT d THEN 'Medium' ELSE 'Low' END AS severity
FROM (SELECT *, (CASE WHEN r THEN 'R' ELSE '-' END) || (CASE WHEN fi THEN 'F' ELSE '-' END) || (CASE WHEN d THEN 'D' ELSE '-' END) || (CASE WHEN a THEN 'A' ELSE '-' END) || (CASE WHEN sv THEN 'S' ELSE '-' END) || (CASE WHEN c THEN 'S' ELSE '-' END) AS flags, r OR fi AS e FROM s) GROUP BY 1, 2, 3, 5"""

#: Application rows from pages and events: the digest of an id picks a code.
_HTTP = (
    "CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END ELSE '' END AS method",
    "CASE WHEN page_id % 3 = 0 THEN '' ELSE CAST(200 + 100 * (page_id % 4) + page_id % 5 AS STRING) END AS code",
    "CASE page_id % 4 WHEN 0 THEN 'application/json; charset=utf-8' WHEN 1 THEN 'text/xml' WHEN 2 THEN 'application/soap+xml' ELSE 'Application/JSON' END AS content_type",
    "length(html) AS size", "'src' || CAST(page_id % 9 AS STRING) AS src",
)


def http_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.code_counts(table(spark, sf_dir, "pages").selectExpr(*_HTTP).where("code <> ''"), ["code"], M.http_status_severity(), ["src"])


_CODES_SQL = """
SELECT {code}, count(*) AS count, count(DISTINCT {conn}) AS connections, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share, {rating} AS severity FROM ({rows}) GROUP BY {code}"""
_HTTP_ROWS = f"SELECT {', '.join(_HTTP)} FROM pages".replace("STRING", "VARCHAR")


def http_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.http_tree(table(spark, sf_dir, "pages").selectExpr(*_HTTP))


_HTTP_TREE_SQL = f"""
SELECT kind, class, code, CAST(GROUPING(kind, class, code) AS INT) AS level_mask, count(*) AS count
FROM (SELECT CASE WHEN method <> '' THEN 'request' ELSE 'response' END AS kind, CASE WHEN method <> '' THEN method ELSE code[1] || 'xx' END AS class, CASE WHEN method = '' THEN code ELSE '-' END AS code FROM ({_HTTP_ROWS}))
GROUP BY ROLLUP (kind, class, code)"""


def data_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.data_transfers(packet_view(spark, sf_dir).withColumn("len", F.col("len") * 300))


_TRANSFERS_SQL = f"""
WITH g AS (SELECT stream_id, CAST(sum(len * 300) AS BIGINT) AS bytes, CAST(sum(frame_len) AS BIGINT) AS bytes_with_headers, count(*) AS packets, max(time_ms) - min(time_ms) AS duration_ms FROM {_PK} GROUP BY 1),
r AS (SELECT *, CASE WHEN duration_ms > 0 THEN bytes * CAST(1000.0 AS DOUBLE) / duration_ms END AS raw FROM g),
t AS (SELECT * EXCLUDE (raw), round(raw, 6) AS rate, CASE WHEN bytes < 10240 THEN 'Low' WHEN raw IS NULL THEN 'Medium' WHEN raw < 51200 THEN 'High' WHEN raw < 204800 THEN 'Medium' ELSE 'Low' END AS severity FROM r)"""
_RANK = "CASE severity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END"


def data_transfer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.size_ranges(data_transfers(spark, sf_dir), "bytes")


_TRANSFER_SIZES_SQL = _TRANSFERS_SQL + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS range, count(*) FILTER (WHERE bytes >= {low} AND bytes < {high}) AS count, round(100.0 * count(*) FILTER (WHERE bytes >= {low} AND bytes < {high}) / count(*), 4) AS percent FROM t"
    for n, low, high in (("< 1KB", 0, 1024), ("1KB - 10KB", 1024, 10240), ("10KB - 100KB", 10240, 102400), ("100KB - 1MB", 102400, 1048576), ("> 1MB", 1048576, 2**62))
)


def data_transfers_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.worst_streams(data_transfers(spark, sf_dir), "bytes")


_TRANSFERS_WORST_SQL = _TRANSFERS_SQL + f" SELECT * FROM t ORDER BY {_RANK}, bytes DESC, stream_id LIMIT 5"


def ttl_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bursts(packet_view(spark, sf_dir), ("src_ip", "ttl"))


_BURSTS_SQL = f"""
WITH c AS (SELECT src_ip, ttl, time_ms, count(*) AS n FROM {_PK} GROUP BY ALL),
b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY src_ip, ttl ORDER BY time_ms RANGE BETWEEN CURRENT ROW AND 99 FOLLOWING) AS BIGINT) AS here FROM c)
SELECT src_ip, ttl, here AS burst, time_ms AS burst_start_ms FROM b QUALIFY row_number() OVER (PARTITION BY src_ip, ttl ORDER BY here DESC, time_ms) = 1"""


def zero_windows_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.worst_zero_windows(zero_windows(spark, sf_dir))


_ZERO_WORST_SQL = f"SELECT * FROM ({_ZERO_SQL}) ORDER BY {_RANK}, count DESC, src_ip, src_port, dst_ip, dst_port LIMIT 5"


def zero_window_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.severity_totals(zero_windows(spark, sf_dir))


_ZERO_TOTALS_SQL = f"SELECT x.s AS severity, count(y.severity) AS groups FROM (SELECT unnest(['High', 'Medium', 'Low']) AS s) x LEFT JOIN ({_ZERO_SQL}) y ON x.s = y.severity GROUP BY 1"


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = build_connections(packet_view(spark, sf_dir)).withColumns({"first_ms": F.col("first_ms") * 60, "last_ms": F.col("last_ms") * 60})
    ends = {"src_ip": "client_ip", "src_port": "client_port", "dst_ip": "server_ip", "dst_port": "server_port"}
    return built.select(M.duration_bucket((F.col("last_ms") - F.col("first_ms")) / 1000).alias("bucket"), *(F.col(c).alias(n) for n, c in ends.items()))


def duration_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three connections of each bucket, evenly spaced in their order."""
    return R.with_samples(_timed(spark, sf_dir), ["bucket"], R.connection())


_DURATION_SAMPLES_SQL = f"""
WITH {sql.connections("packets", "c")},
b AS (SELECT DISTINCT CASE WHEN s < 1 THEN '<1s' WHEN s < 5 THEN '1-5s' WHEN s < 10 THEN '5-10s' WHEN s < 30 THEN '10-30s' WHEN s < 60 THEN '30-60s' ELSE '>=60s' END AS bucket, item
      FROM (SELECT (last_ms - first_ms) * 60 / 1000 AS s, client_ip || ':' || client_port || ' -> ' || server_ip || ':' || server_port AS item FROM c)),
p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY item) - 1 AS place, count(*) OVER (PARTITION BY bucket) AS n FROM b)
SELECT bucket, string_agg(item, '; ' ORDER BY place) AS samples FROM p WHERE n <= 3 OR place IN (0, CAST(round_even((n - 1) / 2, 0) AS BIGINT), n - 1) GROUP BY 1"""


def dns_service_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries paired with answers of the same id between the same ends."""
    low, high = P.canonical_ends(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    rows = packet_view(spark, sf_dir).selectExpr("*", "ip_id % 3 AS dns_id", "CASE WHEN frame_number % 2 = 1 THEN 'query' ELSE 'response' END AS kind")
    keyed = rows.withColumns({"ip_1": low.ip, "port_1": low.port, "ip_2": high.ip, "port_2": high.port})
    return M.request_response_times(keyed, ["dns_id", "ip_1", "port_1", "ip_2", "port_2"])


_DNS_KEY = "dns_id, ip_1, port_1, ip_2, port_2"
_DNS_SQL = f"""
WITH p AS (SELECT ip_id % 3 AS dns_id, CASE WHEN f THEN src_ip ELSE dst_ip END AS ip_1, CASE WHEN f THEN src_port ELSE dst_port END AS port_1, CASE WHEN f THEN dst_ip ELSE src_ip END AS ip_2, CASE WHEN f THEN dst_port ELSE src_port END AS port_2, frame_number, time_ms,
             CASE WHEN frame_number % 2 = 1 THEN 'query' ELSE 'response' END AS kind FROM (SELECT *, (src_ip, src_port) <= (dst_ip, dst_port) AS f FROM {_PK})),
x AS (SELECT *, count(*) FILTER (WHERE kind = 'query') OVER w AS q, sum(CASE WHEN kind = 'query' THEN -1 ELSE 1 END) OVER w AS ahead FROM p WINDOW w AS (PARTITION BY {_DNS_KEY} ORDER BY time_ms, frame_number)),
y AS (SELECT *, greatest(max(ahead) OVER (PARTITION BY {_DNS_KEY} ORDER BY time_ms, frame_number), 0) AS idle FROM x),
z AS (SELECT *, idle > coalesce(lag(idle) OVER (PARTITION BY {_DNS_KEY} ORDER BY time_ms, frame_number), 0) AS lone FROM y)
SELECT {", ".join("a." + c for c in _DNS_KEY.split(", "))}, a.frame_number, r.time_ms IS NOT NULL AS answered, r.time_ms - a.time_ms AS service_ms
FROM z a LEFT JOIN (SELECT {_DNS_KEY}, q + ahead - idle AS nth, time_ms FROM z WHERE kind = 'response' AND NOT lone) r ON {" AND ".join(f"a.{c} = r.{c}" for c in _DNS_KEY.split(", "))} AND a.q = r.nth
WHERE a.kind = 'query'"""


def udp_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grouping over datagrams: events as asker and answerer."""
    return M.conversations(table(spark, sf_dir, "events").selectExpr(*UDP_ROWS, "CAST(60 + event_id % 900 AS BIGINT) AS frame_len", "event_id * 3 AS time_ms"), ("ip", "port"))


_UDP_CONVERSATIONS_SQL = _conversations_sql(("ip", "port"), "(SELECT " + ", ".join(UDP_ROWS).replace("STRING", "VARCHAR") + ", CAST(60 + event_id % 900 AS BIGINT) AS frame_len, event_id * 3 AS time_ms FROM events)")


def sampled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sample_items(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 25)


_SAMPLE_SQL = """
WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders), i AS (SELECT DISTINCT CAST(round_even(k * (n - 1) / 24, 0) AS BIGINT) AS place FROM (SELECT unnest(range(25)) AS k, max(n) AS n FROM o))
SELECT o_orderkey, o_custkey FROM o JOIN i USING (place)"""

QUERIES = {
    f.__name__: f
    for f in (
        conversations_ip, conversations_tcp, udp_conversations, hosts, protocol_hierarchy, source_ttl_tree, destination_tree, ttl_bursts, zero_windows, zero_windows_worst, zero_window_severities, tcp_durations, duration_samples, tcp_completeness,
        http_responses, http_tree, data_transfers, data_transfer_sizes, data_transfers_worst, dns_service_times, sampled_orders,
    )
}
ORACLES = {
    "conversations_ip": _conversations_sql(("ip",)), "conversations_tcp": _conversations_sql(("ip", "port")), "udp_conversations": _UDP_CONVERSATIONS_SQL, "hosts": _HOSTS_SQL, "protocol_hierarchy": _HIERARCHY_SQL,
    "source_ttl_tree": _tree_sql(("src_ip", "ttl", "dst_ip")), "destination_tree": _tree_sql(("dst_ip", "protocol", "dst_port")), "ttl_bursts": _BURSTS_SQL, "zero_windows": _ZERO_SQL, "zero_windows_worst": _ZERO_WORST_SQL, "zero_window_severities": _ZERO_TOTALS_SQL,
    "tcp_durations": _DURATIONS_SQL, "duration_samples": _DURATION_SAMPLES_SQL, "tcp_completeness": _COMPLETENESS_SQL,
    "http_responses": _CODES_SQL.format(code="code", conn="src", rating="CASE WHEN CAST(code AS INT) >= 500 THEN 'High' WHEN CAST(code AS INT) BETWEEN 400 AND 499 THEN 'Medium' ELSE 'Low' END", rows=_HTTP_ROWS + " WHERE page_id % 3 <> 0"),
    "http_tree": _HTTP_TREE_SQL, "data_transfers": _TRANSFERS_SQL + " SELECT * FROM t", "data_transfer_sizes": _TRANSFER_SIZES_SQL, "data_transfers_worst": _TRANSFERS_WORST_SQL,
    "dns_service_times": _DNS_SQL, "sampled_orders": _SAMPLE_SQL,
}
