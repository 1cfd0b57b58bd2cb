"""Packet tables made from the bench tables, with one SQL text for Spark and DuckDB.

An order is a TCP connection and its line items are the packets, alternately
from client and server. Capture B sees the same connections at a second point:
other packets are missing, one client in three is behind a source NAT, hosts
are two hops further on, and stream ids and clocks are its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.storage import table

#: All packets of all connections.
BASE = """
WITH base AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice, l.l_quantity, l.l_returnflag, coalesce(o.o_custkey, 0) AS custkey,
         row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_shipdate, l.l_linenumber, l.l_partkey, l.l_suppkey) AS frame_number,
         count(*) OVER (PARTITION BY l.l_orderkey) AS n_frames
  FROM {lineitem} l LEFT JOIN {orders} o ON l.l_orderkey = o.o_orderkey),
pk AS (
  SELECT l_orderkey AS stream_id, CAST(frame_number AS BIGINT) AS frame_number,
         CAST({days} AS BIGINT) * 1000 + CAST(frame_number AS BIGINT) * 7 AS time_ms,
         6 AS protocol, (frame_number % 2 = 1) AS from_client,
         '10.0.' || CAST(custkey % 7 AS STRING) || '.' || CAST(custkey % 200 AS STRING) AS client_ip,
         CAST(1024 + l_orderkey % 60000 AS INT) AS client_port,
         '192.168.1.' || CAST(l_orderkey % 9 AS STRING) AS server_ip,
         CAST(CASE l_orderkey % 5 WHEN 0 THEN 443 WHEN 1 THEN 80 WHEN 2 THEN 3306 WHEN 3 THEN 8080 ELSE 9000 END AS INT) AS server_port,
         CAST(CASE WHEN frame_number = 1 THEN CASE WHEN l_orderkey % 11 = 0 THEN 24 ELSE 2 END WHEN frame_number = 2 THEN 18 WHEN frame_number = n_frames THEN 17 ELSE 24 END AS INT) AS flags,
         CAST(floor(l_extendedprice * 100) AS BIGINT) AS seq,
         CAST(l_partkey * 1000 + frame_number * 10 AS BIGINT) AS ack,
         CAST(CASE WHEN frame_number <= 2 THEN 0 ELSE l_quantity END AS INT) AS len,
         CAST((l_partkey * 31 + l_suppkey * 7 + l_linenumber) % 65536 AS INT) AS ip_id,
         CAST(CASE WHEN frame_number % 2 = 1 THEN 64 - custkey % 5 ELSE 128 - l_orderkey % 3 END AS INT) AS ttl,
         CASE WHEN frame_number <= 2 THEN 'mss=1460;ws=' || CAST(custkey % 4 AS STRING) || ';sack=1;ts=1' ELSE '' END AS options,
         CASE WHEN custkey % 6 = 0 THEN '' ELSE CAST(custkey * 7 + frame_number AS STRING) END AS tsval,
         CASE WHEN frame_number = 1 THEN '0' ELSE CAST(custkey * 7 + frame_number - 1 AS STRING) END AS tsecr,
         CASE WHEN frame_number <= 2 OR l_quantity < 5 THEN '' ELSE md5(CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)) END AS payload,
         (l_partkey % 17 = 0) AS retransmission, (l_suppkey % 13 = 0) AS duplicate_ack, (l_partkey % 23 = 0) AS lost_segment, (l_suppkey % 19 = 0) AS ack_lost,
         l_partkey, l_suppkey
  FROM base)"""

_DIRECTED = """
  SELECT {capture} AS capture_id, stream_id{shift} AS stream_id, frame_number, time_ms + {late} AS time_ms, protocol,
         CASE WHEN from_client THEN {client} ELSE server_ip END AS src_ip, CASE WHEN from_client THEN server_ip ELSE {client} END AS dst_ip,
         CASE WHEN from_client THEN client_port ELSE server_port END AS src_port, CASE WHEN from_client THEN server_port ELSE client_port END AS dst_port,
         flags, seq, ack, len, len + 54 AS frame_len, ip_id, ttl - {hops} AS ttl, options, tsval, tsecr, payload,
         retransmission, duplicate_ack, lost_segment, ack_lost
  FROM pk WHERE {seen}"""

PACKETS = BASE + _DIRECTED.format(capture="'A'", shift="", late=0, client="client_ip", hops=0, seen="true")
CAPTURE_A = BASE + _DIRECTED.format(capture="'A'", shift="", late=0, client="client_ip", hops=0, seen="(l_partkey + frame_number) % 10 <> 0")
#: Sources of each third customer are rewritten; 172.16 keeps the last two parts, so they stay apart.
CAPTURE_B = BASE + _DIRECTED.format(
    capture="'B'", shift=" + 1000000", late=1, hops=2, seen="(l_suppkey + frame_number) % 9 <> 0",
    client="(CASE WHEN CAST(split_part(client_ip, '.', 4) AS INT) % 3 = 0 THEN '172.16.' || split_part(client_ip, '.', 3) || '.' || split_part(client_ip, '.', 4) ELSE client_ip END)",
)
_VIEWS = {"packets": PACKETS, "capture_a": CAPTURE_A, "capture_b": CAPTURE_B}
_SPARK_DAYS = "datediff(CAST(l_shipdate AS DATE), DATE '1992-01-01')"
_DUCKDB_DAYS = "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"


#: Events as datagrams: an asker and an answerer, some towards known ports.
UDP_ROWS = (
    "CASE WHEN event_id % 2 = 0 THEN '10.9.0.' || CAST(user_id % 50 AS STRING) ELSE '10.8.0.' || CAST(user_id % 4 AS STRING) END AS src_ip",
    "CASE WHEN event_id % 2 = 0 THEN '10.8.0.' || CAST(user_id % 4 AS STRING) ELSE '10.9.0.' || CAST(user_id % 50 AS STRING) END AS dst_ip",
    "CAST(CASE WHEN event_id % 2 = 0 THEN 1024 + user_id % 500 ELSE CASE user_id % 3 WHEN 0 THEN 53 WHEN 1 THEN 1812 ELSE 700 END END AS INT) AS src_port",
    "CAST(CASE WHEN event_id % 2 = 0 THEN CASE user_id % 3 WHEN 0 THEN 53 WHEN 1 THEN 1812 ELSE 700 END ELSE 1024 + user_id % 500 END AS INT) AS dst_port",
)


def packet_view(spark: SparkSession, sf_dir: str, view: str = "packets") -> DataFrame:
    """``packets``, ``capture_a`` or ``capture_b`` over the bench tables."""
    text = _VIEWS[view].replace("{days}", _SPARK_DAYS)
    return spark.sql(text, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders"))


def duckdb_view(view: str) -> str:
    """The same table as a DuckDB sub-query."""
    return "(" + _VIEWS[view].replace("{days}", _DUCKDB_DAYS).replace("{lineitem}", "lineitem").replace("{orders}", "orders") + ")"


def as_frames(packets: DataFrame) -> DataFrame:
    """Add each packet's ``frame``: Ethernet, IPv4 and TCP headers and as many zeros as its data is long; checksums are zero."""
    number = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    address = lambda x: F.array_join(F.transform(F.split(x, r"\."), lambda p: F.lpad(F.hex(p.cast("int")), 2, "0")), "")
    text = F.concat(
        F.lit("00" * 12 + "0800" + "4500"), number(F.col("len") + 40, 2), number(F.col("ip_id"), 2), F.lit("0000"), number(F.col("ttl"), 1), F.lit("06" + "0000"), address("src_ip"), address("dst_ip"),
        number(F.col("src_port"), 2), number(F.col("dst_port"), 2), number(F.col("seq"), 4), number(F.col("ack"), 4), F.lit("50"), number(F.col("flags"), 1), F.lit("0400" + "0000" + "0000"), F.repeat(F.lit("00"), F.col("len")),
    )
    return packets.withColumns({"frame": F.unhex(text), "time_ns": F.col("time_ms") * 1_000_000})


def as_datagrams(rows: DataFrame) -> DataFrame:
    """Add ``frame``: Ethernet and IPv4 headers around ``data``, the hexadecimal bytes of an IP payload of the row's ``protocol``."""
    number = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    address = lambda x: F.array_join(F.transform(F.split(x, r"\."), lambda p: F.lpad(F.hex(p.cast("int")), 2, "0")), "")
    size = 20 + F.length("data") / 2
    text = F.concat(F.lit("00" * 12 + "0800" + "4500"), number(size.cast("int"), 2), F.lit("00000000"), number(F.col("ttl"), 1), number(F.col("protocol"), 1), F.lit("0000"), address("src_ip"), address("dst_ip"), F.col("data"))
    return rows.withColumns({"frame": F.unhex(text), "frame_len": (14 + size).cast("int")})
