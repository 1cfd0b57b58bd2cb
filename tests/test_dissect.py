"""Fields above the transport header, from literal bytes."""

import random
import struct

import pytest

from packetloom.operators import dissect
from packetloom.operators.connections import ranks

HEAD = struct.pack(">HHHHHH", 7, 0x8183, 1, 2, 0, 0)
QUESTION = b"\x03www\x07example\x00"


def test_dns_messages():
    asked = struct.pack(">HH", 28, 1)
    assert dissect.parse_dns(HEAD + QUESTION + asked) == (7, "response", 3, 2, "www.example", 28)
    assert dissect.parse_dns(struct.pack(">HHHHHH", 9, 0x0100, 1, 0, 0, 0) + b"\x00" + asked) == (9, "query", 0, 0, "", 28)
    # A name that goes on where the message's own header reads as a label: id 0x0161, then a zero.
    back = struct.pack(">HHHHHH", 0x0161, 0x0000, 1, 0, 0, 0) + b"\x01b\xc0\x00" + asked
    assert dissect.parse_dns(back) == (0x0161, "query", 0, 0, "b.a", 28)
    assert dissect.parse_dns(HEAD + b"\x02a.\x00" + asked)[4] == "a\\046"


@pytest.mark.parametrize("name", [b"\xc0\x0c", b"\x01a\xc0\x0c", b"\xc0\x0e\xc0\x0c", b"\xc0\xff", b"\xc0", b"\x40abc\x00", b"\x09short", b"\x3f" * 400, b""])
def test_names_that_loop_or_break_off_are_refused(name):
    assert dissect.parse_dns(HEAD + name + struct.pack(">HH", 1, 1)) == (7, "response", 3, 2, None, None)


def test_what_is_no_dns_message():
    assert dissect.parse_dns(None) is dissect.parse_dns(b"") is dissect.parse_dns(HEAD[:11]) is None
    assert dissect.parse_dns(struct.pack(">HHHHHH", 1, 0x7800, 1, 0, 0, 0)) is None
    rng = random.Random(3)
    for _ in range(3000):
        dissect.parse_dns(rng.randbytes(rng.randint(0, 60)))
        dissect.parse_hello(rng.randbytes(rng.randint(0, 90)))


def hello(session=b"s" * 32, records=1):
    body = b"\x03\x03" + bytes(range(32)) + bytes([len(session)]) + session + b"\x00\x02\x13\x01\x01\x00"
    message = b"\x01" + struct.pack(">I", len(body))[1:] + body
    size = -(-len(message) // records)
    return b"".join(b"\x16\x03\x01" + struct.pack(">H", len(message[i : i + size])) + message[i : i + size] for i in range(0, len(message), size))


def test_client_hellos():
    random_of = bytes(range(32)).hex()
    assert dissect.parse_hello(hello()) == (random_of, (b"s" * 32).hex())
    assert dissect.parse_hello(hello(b"", 5)) == (random_of, "")
    assert dissect.parse_hello(hello(records=40)) == (random_of, (b"s" * 32).hex())
    for bad in (hello()[:60], b"\x17" + hello()[1:], hello()[:5] + b"\x02" + hello()[6:], b"GET / HTTP/1.1\r\n", b"", hello(b"x" * 33)):
        assert dissect.parse_hello(bad) is None


def test_segments_are_put_in_order_and_first_copies_count():
    part = lambda at, frame, data: {"at": at, "frame": frame, "data": data}
    assert dissect.assemble([part(3, 1, b"def"), part(0, 2, b"abc")]) == b"abcdef"
    assert dissect.assemble([part(0, 1, b"abcd"), part(2, 2, b"XXef")]) == b"abcdef"
    assert dissect.assemble([part(0, 1, b"ab"), part(3, 2, b"d")]) == b"ab"
    assert dissect.assemble([part(1, 1, b"b")]) == b"" and dissect.assemble([]) == b""


def test_hellos_of_streams_that_wrap(spark):
    data, ends = hello(), ("10.0.0.1", 40000, "10.0.0.2", 443)
    first = 4_294_967_260
    rows = [("A", 1, 1, *ends, 2, first - 1, None), ("A", 1, 2, *ends, 24, (first + 50) % (1 << 32), data[50:]), ("A", 1, 3, *ends, 16, first, data[:50]), ("A", 1, 4, *ends, 16, first, b"\0" * 60)]
    rows += [("A", 2, 5, *ends, 16, 77, data[:50]), ("A", 2, 6, *ends, 16, 128, data[51:]), ("A", 3, 7, *ends, 16, 5, data + b"\x16" * 20_000), ("A", 4, 8, *ends, 16, 5, b"")]
    df = spark.createDataFrame(rows, "capture_id string, stream_id long, frame_number long, src_ip string, src_port int, dst_ip string, dst_port int, flags int, seq long, body binary")
    assert sorted((r.stream_id, r.frame_number, r.flags, r.session_id) for r in dissect.client_hellos(df).collect()) == [(1, 2, 24, (b"s" * 32).hex()), (3, 7, 16, (b"s" * 32).hex())]
    assert dissect.client_hellos(df.limit(0)).count() == 0


def test_unreachable_targets_of_quoted_headers(spark):
    fields = "frame_number long, protocol int, src_ip string, dst_ip string, ttl int, icmp_type int, icmp_code int, quoted_protocol int, quoted_src_ip string, quoted_dst_ip string, quoted_src_port int, quoted_dst_port int"
    rows = [(1, 1, "r", "c", 60, 3, 3, 17, "c", "s", 9, 53), (2, 1, "r", "c", 60, 11, 0, 17, "c", "s", 9, 53), (3, 1, "r", "x", 60, 3, 1, 6, "c", "s", 9, 80), (4, 1, "r", "c", 60, 3, 1, 6, "c", "s", None, None), (5, 1, "r", "c", 60, 3, 1, 1, "c", "s", None, None)]
    got = dissect.unreachable_events(spark.createDataFrame(rows, fields)).orderBy("frame_number").collect()
    assert [(r.frame_number, r.client_ip, r.reporter_ip, r.code, r.inner_dst, r.protocol, r.dst_port) for r in got] == [(1, "c", "r", 3, "s", 17, 53), (4, "c", "r", 1, "s", 6, 0)]


def test_places_in_groups_with_nulls_and_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(5)]), i, 0) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, i long, _row int").repartition(5)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for within in ([], ["g"]):
        got = {r.i: r.place for r in ranks(df, ["x", "i"], "place", within).collect()}
        groups = [rows] if not within else [[r for r in rows if r[0] == g] for g in ("a", "b", None)]
        assert got == {r[2]: n for group in groups for n, r in enumerate(sorted(group, key=key))}
    assert ranks(df.limit(0), ["x"], "place").count() == 0
