"""Fields above the transport header, read from the bytes of captured packets.

The packets are those of ``sources.pcap.read_captures``: ``body`` is what was
captured of a segment's or datagram's data, and ICMP errors bring the addresses
of the packet that they quote. A message that is cut or malformed gives no
fields, never a wrong one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import packets as P
from packetloom.operators.quality import _signed as signed

#: ICMP's type for unreachable targets, ports of DNS and of its multicast form, TLS's types of records and handshakes.
UNREACHABLE = 3
DNS_PORTS = (53, 5353)
_HANDSHAKE, _CLIENT_HELLO = 22, 1
#: Bytes of a stream's begin in which a client hello is looked for: one record of the greatest size.
HELLO_BYTES = 5 + (1 << 14)
#: Jumps within a name, and letters of a name, beyond which a DNS message is refused.
_MOST_JUMPS, _MOST_NAME = 64, 255


def unreachable_events(packets: DataFrame) -> DataFrame:
    """ICMP packets that report an unreachable target: client and target of the quoted packet, who reports it and how far away.

    Kept are quoted TCP and UDP packets that came from the outer one's target.
    """
    quoted = packets.where((F.col("icmp_type") == UNREACHABLE) & (F.col("protocol") == 1) & F.col("quoted_protocol").isin(6, 17))
    return quoted.where("dst_ip = quoted_src_ip AND quoted_dst_ip IS NOT NULL").select(
        F.col("quoted_src_ip").alias("client_ip"), F.col("src_ip").alias("reporter_ip"), F.col("dst_ip").alias("reported_to"), F.col("icmp_code").alias("code"), F.col("quoted_dst_ip").alias("inner_dst"),
        F.col("quoted_protocol").alias("protocol"), F.coalesce("quoted_dst_port", F.lit(0)).alias("dst_port"), "ttl", "frame_number",
    )


# ---- DNS ---------------------------------------------------------------------------------------


def _dns_name(message: bytes, at: int) -> tuple[str | None, int]:
    """The name at an offset and the offset behind it; None for one that is cut, too long or jumps forward or around."""
    labels, size, end, jumps = [], 0, None, 0
    while at < len(message):
        length = message[at]
        if length & 0xC0 == 0xC0:
            to = (length & 0x3F) << 8 | message[at + 1] if at + 1 < len(message) else at
            end = at + 2 if end is None else end
            jumps += 1
            # A name may only refer to what stands before it, so each jump goes back.
            if to >= at or jumps > _MOST_JUMPS:
                return None, end
            at = to
        elif length & 0xC0:
            return None, at
        elif length == 0:
            return ".".join(labels), at + 1 if end is None else end
        else:
            label = message[at + 1 : at + 1 + length]
            size += length + 1
            if len(label) < length or size > _MOST_NAME:
                return None, at
            labels.append("".join(chr(b) if 33 <= b <= 126 and b not in (46, 92) else f"\\{b:03d}" for b in label))
            at += 1 + length
    return None, at


def parse_dns(message: bytes | None) -> tuple[int, str, int, int, str | None, int | None] | None:
    """(id, kind, rcode, answers, name, type) of a message; name and type are those of its first question."""
    if not message or len(message) < 12:
        return None
    number, flags, questions, answers = struct.unpack(">HHHH", message[:8])
    if flags >> 11 & 15 not in (0, 1, 2, 4, 5) or questions > 64:
        return None
    name, at = _dns_name(message, 12) if questions else (None, 12)
    asked = struct.unpack(">H", message[at : at + 2])[0] if name is not None and at + 4 <= len(message) else None
    return number, "response" if flags >> 15 else "query", flags & 15, answers, name if asked is not None else None, asked


def _parsed(df: DataFrame, column: str, fields: str, parse: Callable[[object], tuple | None]) -> DataFrame:
    """Put ``fields`` of each row's ``column`` in its place; rows that parse to nothing are left out."""
    names, types = zip(*(f.split() for f in fields.split(", ")))
    kept = [c for c in df.columns if c != column]
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in kept) + ", " + fields
    arrow = {"int": pa.int32(), "string": pa.string()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            there = pa.array([f is not None for f in found])
            held = [f for f in found if f is not None]
            made = [pa.array([f[i] for f in held], arrow[t]) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).filter(there) for c in kept), *made], [*kept, *names])

    return df.mapInArrow(rows, schema)


def dns_messages(packets: DataFrame) -> DataFrame:
    """DNS messages in datagrams from or to DNS_PORTS: the packet's columns with dns_id, kind, rcode, answers, name and query_type for its ``body``."""
    there = (F.col("protocol") == 17) & (F.col("src_port").isin(*DNS_PORTS) | F.col("dst_port").isin(*DNS_PORTS))
    return _parsed(packets.where(there), "body", "dns_id int, kind string, rcode int, answers int, name string, query_type int", parse_dns)


# ---- the begin of a stream ---------------------------------------------------------------------


def assemble(segments: list[dict]) -> bytes:
    """The bytes from offset 0 to the first gap; of bytes that came twice the first copy counts."""
    out, have, end = bytearray(), bytearray(), 0
    for s in sorted(segments, key=lambda s: s["frame"]):
        end = max(end, s["at"] + len(s["data"]))
        out.extend(bytes(end - len(out)))
        have.extend(bytes(end - len(have)))
        for i, b in enumerate(s["data"], s["at"]):
            if not have[i]:
                out[i], have[i] = b, 1
    gap = have.find(0)
    return bytes(out if gap < 0 else out[:gap])


def stream_begins(packets: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` bytes that each side of a stream sent, as segments: capture_id, stream_id, the ends, frame_number and flags of the first, and a list ``segments``.

    Offsets count from the sender's SYN, or its first packet, by the shorter way
    around 2**32. Segments behind the limit and copies are left out before
    anything is collected, so a list holds about ``limit`` bytes.
    """
    ends = ["capture_id", "stream_id", "src_ip", "src_port", "dst_ip", "dst_port"]
    way = Window.partitionBy(*ends).orderBy("frame_number")
    syn = F.col("flags").bitwiseAND(P.SYN) != 0
    begin: Column = F.coalesce(F.first(F.when(syn, F.col("seq") + 1), ignorenulls=True).over(way), F.first("seq").over(way))
    placed = packets.withColumn("_at", signed(F.col("seq") + syn.cast("int") - begin)).where((F.octet_length("body") > 0) & F.col("_at").between(0, limit - 1))
    cut = placed.select(*ends, "frame_number", "flags", "_at", F.substring("body", F.lit(1), (F.lit(limit) - F.col("_at")).cast("int")).alias("_data"))
    once = cut.groupBy(*ends, "_at", F.octet_length("_data").alias("_size")).agg(F.min_by(F.struct("_data", "flags"), "frame_number").alias("_s"), F.min("frame_number").alias("frame"))
    segment = F.struct(F.col("_at").alias("at"), "frame", F.col("_s._data").alias("data"))
    return once.groupBy(*ends).agg(F.min("frame").alias("frame_number"), F.min_by("_s.flags", "frame").alias("flags"), F.collect_list(segment).alias("segments"))


def parse_hello(begin: bytes) -> tuple[str, str] | None:
    """(random, session id) in hexadecimal of a client hello, which may be cut into several records."""
    handshake, at = b"", 0
    while at + 5 <= len(begin) and len(handshake) < 71:
        kind, major, size = begin[at], begin[at + 1], struct.unpack(">H", begin[at + 3 : at + 5])[0]
        if kind != _HANDSHAKE or major != 3 or not size:
            break
        handshake += begin[at + 5 : at + 5 + size]
        at += 5 + size
    if len(handshake) < 39 or handshake[0] != _CLIENT_HELLO or handshake[38] > 32 or len(handshake) < 39 + handshake[38]:
        return None
    return handshake[6:38].hex(), handshake[39 : 39 + handshake[38]].hex()


def client_hellos(packets: DataFrame, limit: int = HELLO_BYTES) -> DataFrame:
    """Client hellos at the begin of streams, as ``sources.scans.client_hellos`` has them from a field table."""
    found = _parsed(stream_begins(packets, limit), "segments", "random string, session_id string", lambda segments: parse_hello(assemble(segments)))
    return found.select("capture_id", "stream_id", "frame_number", "src_ip", "src_port", "dst_ip", "dst_port", "flags", "random", "session_id")
