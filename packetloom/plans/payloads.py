"""Queries on fields above the transport header: frames are written to capture files and read from their bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import dissect, topology
from packetloom.plans.topologies import ICMP_TAIL
from packetloom.sources import pcap
from packetloom.sources.testbed import UDP_ROWS, as_datagrams
from packetloom.storage import shared_dir, table

_SPLIT = 1 << 21


def _through_files(rows: DataFrame, columns: list[str], protocol: int) -> DataFrame:
    """Rows with ``protocol``, ends, ttl, ``data`` and ``time_ns``, written as a capture file and read again."""
    folder = f"{shared_dir(rows.sparkSession)}/captures/{uuid.uuid4().hex}"
    pcap.write_captures(as_datagrams(rows.withColumn("protocol", F.lit(protocol))).withColumn("capture_id", F.lit("A")), folder)
    return pcap.read_captures(rows.sparkSession, folder, columns, split_bytes=_SPLIT, protocol=protocol)


_UDP = {"src_ip": 0, "dst_ip": 1, "src_port": 2, "dst_port": 3}
#: A DNS message for each datagram of port 53: a name of three labels, once in eleven one that refers to itself.
_DNS_ROWS = (*UDP_ROWS, "event_id", "CAST(floor(event_id / 2) AS BIGINT) % 65536 AS dns_id", "event_id % 2 AS answer", "'h' || CAST(user_id AS STRING) AS host")


def capture_file_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNS messages from the bytes of datagrams."""
    rows = table(spark, sf_dir, "events").selectExpr(*_DNS_ROWS).where("src_port = 53 OR dst_port = 53")
    hex_of = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    label = lambda x: F.concat(hex_of(F.length(x), 1), F.hex(x.cast("binary")))
    name = F.when(F.col("event_id") % 11 == 0, F.lit("C00C")).otherwise(F.concat(label(F.col("host")), label(F.lit("mail")), label(F.lit("example")), F.lit("00")))
    flags = F.when(F.col("answer") == 0, F.lit("0100")).when(F.col("event_id") % 7 == 0, F.lit("8183")).otherwise(F.lit("8180"))
    reply = F.when(F.col("answer") == 1, F.lit("C00C0001000100000E1000040A000001")).otherwise("")
    message = F.concat(hex_of(F.col("dns_id"), 2), flags, F.lit("0001"), hex_of(F.col("answer"), 2), F.lit("00000000"), name, F.lit("00010001"), reply)
    data = F.concat(hex_of(F.col("src_port"), 2), hex_of(F.col("dst_port"), 2), hex_of((F.length("message") / 2 + 8).cast("int"), 2), F.lit("0000"), F.col("message"))
    made = rows.withColumn("message", message).select(*_UDP, F.lit(64).alias("ttl"), (F.col("event_id") * 1000).alias("time_ns"), data.alias("data"))
    read = _through_files(made, ["time_ns", "protocol", *_UDP, "body"], 17)
    return dissect.dns_messages(read).drop("protocol")


_DNS_SQL = f"""
SELECT event_id * 1000 AS time_ns, src_ip, dst_ip, src_port, dst_port, dns_id, CASE answer WHEN 0 THEN 'query' ELSE 'response' END AS kind, CASE WHEN answer = 1 AND event_id % 7 = 0 THEN 3 ELSE 0 END AS rcode, answer AS answers,
       CASE WHEN event_id % 11 <> 0 THEN host || '.mail.example' END AS name, CASE WHEN event_id % 11 <> 0 THEN 1 END AS query_type
FROM (SELECT {", ".join(_DNS_ROWS).replace("STRING", "VARCHAR")} FROM events) WHERE src_port = 53 OR dst_port = 53"""

#: A client hello for each order, in two segments around 2**32: some the later one first, some followed by a copy of other bytes.
_HELLO_ROWS = (
    "o_orderkey", "'10.' || CAST(o_orderkey % 200 AS STRING) || '.' || CAST(CAST(floor(o_orderkey / 200) AS BIGINT) % 250 AS STRING) || '.' || CAST(CAST(floor(o_orderkey / 50000) AS BIGINT) % 250 AS STRING) AS src_ip", "'192.168.7.1' AS dst_ip",
    "CAST(1024 + o_orderkey % 60000 AS INT) AS src_port", "443 AS dst_port", "md5(CAST(o_orderkey AS STRING)) || md5(CAST(o_orderkey + 1 AS STRING)) AS random", "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE md5(CAST(-o_orderkey AS STRING)) END AS session_id",
)


def capture_file_hellos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client hellos from the bytes of reassembled streams."""
    hex_of = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    rows = table(spark, sf_dir, "orders").selectExpr(*_HELLO_ROWS)
    hello = F.concat(F.lit("0303"), F.col("random"), hex_of(F.length("session_id") / 2, 1), F.col("session_id"), F.lit("000213010100"))
    framed = F.concat(F.lit("16030100"), hex_of((F.length("h") / 2 + 4).cast("int"), 1), F.lit("0100"), hex_of((F.length("h") / 2).cast("int"), 2), F.col("h"))
    whole = rows.withColumn("h", hello).withColumn("bytes", framed)
    # (order in time, offset, bytes, flags); the SYN takes one number.
    two = F.col("o_orderkey") % 3 == 0
    segment = lambda t, at, part, flags: F.struct(t.alias("t"), F.lit(at).alias("at"), part.alias("part"), F.lit(flags).alias("flags"))
    copy = F.when(F.col("o_orderkey") % 4 == 0, F.repeat(F.lit("00"), F.lit(90))).otherwise("")
    parts = F.array(
        segment(F.lit(0), -1, F.lit(""), 2), segment(F.when(two, 2).otherwise(1), 0, F.substring("bytes", 1, 60), 16),
        segment(F.when(two, 1).otherwise(2), 30, F.substring(F.col("bytes"), F.lit(61), F.length("bytes")), 24), segment(F.lit(3), 0, copy, 16),
    )
    sent = whole.select("*", F.explode(parts).alias("p"))
    seq = F.pmod(F.lit(4_294_967_280).cast("long") + F.col("o_orderkey") % 20 + F.col("p.at"), F.lit(1 << 32).cast("long"))
    data = F.concat(hex_of(F.col("src_port"), 2), hex_of(F.col("dst_port"), 2), hex_of(seq, 4), F.lit("0000000050"), hex_of(F.col("p.flags"), 1), F.lit("040000000000"), F.col("p.part"))
    made = sent.select(*_UDP, F.lit(64).alias("ttl"), (F.col("o_orderkey") * 1000 + F.col("p.t")).alias("time_ns"), data.alias("data"))
    columns = ["capture_id", "file_offset", "protocol", *_UDP, "flags", "seq", "body"]
    return dissect.client_hellos(pcap.connections_input(_through_files(made, columns, 6))).select("src_ip", "src_port", "dst_ip", "dst_port", "random", "session_id")


_HELLOS_SQL = f"SELECT * EXCLUDE (o_orderkey) FROM (SELECT {', '.join(_HELLO_ROWS).replace('STRING', 'VARCHAR')} FROM orders)"

#: An unreachable target for each event, quoted whole or, once in five, from another sender.
_ICMP_ROWS = (
    "event_id", "'10.7.0.' || CAST(event_id % 3 AS STRING) AS src_ip", "'10.9.0.' || CAST(user_id % 50 AS STRING) AS dst_ip", "CAST(event_id % 4 AS INT) AS code", "CASE WHEN event_id % 5 = 0 THEN '10.9.9.9' ELSE '10.9.0.' || CAST(user_id % 50 AS STRING) END AS quoted_src",
    "'10.8.0.' || CAST(user_id % 4 AS STRING) AS quoted_dst", "CAST(CASE WHEN event_id % 2 = 0 THEN 17 ELSE 6 END AS INT) AS quoted_protocol", "CAST(CASE user_id % 3 WHEN 0 THEN 53 ELSE 700 END AS INT) AS quoted_port", "CAST(CASE event_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 120 ELSE 250 END AS INT) AS ttl",
)


def capture_file_unreachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreachable services from the headers that ICMP errors quote."""
    hex_of = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    address = lambda x: F.array_join(F.transform(F.split(x, r"\."), lambda p: F.lpad(F.hex(p.cast("int")), 2, "0")), "")
    quoted = F.concat(F.lit("4500001C0000000040"), hex_of(F.col("quoted_protocol"), 1), F.lit("0000"), address("quoted_src"), address("quoted_dst"), F.lit("C350"), hex_of(F.col("quoted_port"), 2), F.lit("00080000"))
    data = F.concat(F.lit("03"), hex_of(F.col("code"), 1), F.lit("000000000000"), quoted)
    made = table(spark, sf_dir, "events").selectExpr(*_ICMP_ROWS).select("src_ip", "dst_ip", "ttl", (F.col("event_id") * 1000).alias("time_ns"), data.alias("data"))
    columns = ["capture_id", "file_offset", "protocol", "src_ip", "dst_ip", "ttl", "icmp_type", "icmp_code", "quoted_protocol", "quoted_src_ip", "quoted_dst_ip", "quoted_src_port", "quoted_dst_port"]
    return topology.unreachable_services(dissect.unreachable_events(pcap.with_frame_numbers(_through_files(made, columns, 1))))


_UNREACHABLE_SQL = f"""
WITH k AS (SELECT quoted_src AS client_ip, src_ip AS reporter_ip, dst_ip AS reported_to, code, quoted_dst AS inner_dst, quoted_protocol AS protocol, quoted_port AS dst_port, ttl, row_number() OVER (ORDER BY event_id) AS frame_number
           FROM (SELECT {", ".join(_ICMP_ROWS).replace("STRING", "VARCHAR")} FROM events)),
{ICMP_TAIL}"""

QUERIES = {f.__name__: f for f in (capture_file_dns, capture_file_hellos, capture_file_unreachable)}
ORACLES = {"capture_file_dns": _DNS_SQL, "capture_file_hellos": _HELLOS_SQL, "capture_file_unreachable": _UNREACHABLE_SQL}
