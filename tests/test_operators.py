"""Small literal cases of roles, positions, assignment and streams."""

import ipaddress

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.functions.flowhash import flow_hash
from packetloom.functions import flowhash, packets
from packetloom.operators import graph, matching, modules, packetdiff, preprocess, quality, roles, topology
from packetloom.streaming import sessions

CONNECTION = "capture_id string, stream_id long, client_ip string, client_port int, server_ip string, server_port int, syn_options string"


def test_known_port_of_the_client_turns_the_ends(spark):
    df = spark.createDataFrame([("A", 1, "1.1.1.1", 443, "2.2.2.2", 50001, ""), ("A", 2, "3.3.3.3", 50002, "4.4.4.4", 60000, "mss"), ("A", 3, "5.5.5.5", 5, "6.6.6.6", 5, "")], CONNECTION)
    got = {r.stream_id: r for r in roles.detect_roles(df).collect()}
    assert (got[1].server_ip, got[1].server_port, got[1].server_confidence, got[1].server_method) == ("1.1.1.1", 443, "HIGH", "PORT_HEURISTIC_SWAPPED")
    assert (got[2].server_port, got[2].server_method) == (60000, "SYN_PACKET")
    assert (got[3].server_ip, got[3].server_method) == ("5.5.5.5", "FALLBACK_PORT_COMPARISON_SWAPPED"), "equal ports are exchanged"


def test_services_of_any_port(spark):
    df = spark.createDataFrame([("A", 1, "9.9.9.9", 7000, "2.2.2.2", 443, "mss")], CONNECTION)
    listed = spark.createDataFrame([("9.9.9.9", None)], "ip string, port int")
    row = roles.detect_roles(df, listed).first()
    assert (row.server_ip, row.server_method, row.server_confidence) == ("9.9.9.9", "SERVICE_LIST_SWAPPED", "HIGH")


def test_no_connections(spark):
    assert roles.detect_roles(spark.createDataFrame([], CONNECTION)).count() == 0


def test_capture_order(spark):
    cases = [(0, 3, 2, 1, "AB"), (2, 1, 0, 3, "BA"), (1, 1, 1, 1, None), (1, None, 2, 0, None), (0, 2, 1, 0, "BA"), (1, 4, 1, 2, "AB")]
    df = spark.createDataFrame(cases, "ca int, sa int, cb int, sb int, want string")
    for r in df.withColumn("got", topology.capture_order(*map(F.col, ("ca", "sa", "cb", "sb")))).collect():
        assert r.got == r.want, r


def test_group_ids_follow_known_ones(spark):
    services = spark.createDataFrame([(80, 6), (443, 6), (53, 17)], "server_port int, protocol_number int")
    known = spark.createDataFrame([(443, 7)], "server_port int, group_id int")
    assert {r.server_port: r.group_id for r in topology.group_ids(services, known).collect()} == {443: 7, 53: 8, 80: 9}
    assert {r.server_port: r.group_id for r in topology.group_ids(services).collect()} == {53: 1, 80: 2, 443: 3}


def test_assignment_is_greedy(spark):
    rows = [(i, 100 + j, ((i * 7 + j * 5) % 4) / 4, (i + j) % 5 == 0, "features", "") for i in range(12) for j in range(9) if (i + 2 * j) % 3]
    got = {(r.id_a, r.id_b) for r in matching.assign(spark.createDataFrame(rows, "id_a long, id_b long, score double, forced boolean, kind string, evidence string")).collect()}
    want, used_a, used_b = set(), set(), set()
    for a, b, *_ in sorted(rows, key=lambda r: (r[3], r[2], -r[0], -r[1]), reverse=True):
        if a not in used_a and b not in used_b:
            want.add((a, b))
            used_a.add(a)
            used_b.add(b)
    assert got == want


def test_connections_end_in_a_stream(spark, tmp_path):
    rows = [("A", 1, 1000, 2, 60), ("A", 1, 2000, 17, 40), ("A", 2, 1500, 2, 60), ("A", 2, 1600, 24, 100), ("A", 1, 9000, 2, 60)]
    schema = "capture_id string, stream_id long, time_ms long, flags int, frame_len long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ended = sessions.run_available(sessions.stateful_connections(stream)).collect()
    assert [(r.stream_id, r.first_ms, r.last_ms, r.packet_count, r.total_bytes, r.ended) for r in ended if r.ended] == [(1, 1000, 2000, 2, 100, True)]


PAIR = {
    "capture_id": "A", "stream_id": 1, "client_ip": "10.0.0.1", "client_port": 40000, "server_ip": "10.0.0.2", "server_port": 443, "has_syn": False, "syn_options": "", "client_isn": 0, "server_isn": 0, "tsval": "", "tsecr": "",
    "client_md5": "", "server_md5": "", "length_signature": "C:100 S:200 C:50", "header_only": False, "ipids": list(range(1, 21)), "client_ipids": list(range(1, 11)), "server_ipids": list(range(11, 21)), "client_ttl": 64, "server_ttl": 64,
    "first_ms": 0, "last_ms": 60_000, "packet_count": 40,
}
TYPES = (
    "capture_id string, stream_id long, client_ip string, client_port int, server_ip string, server_port int, has_syn boolean, syn_options string, client_isn long, server_isn long, tsval string, tsecr string, client_md5 string, server_md5 string,"
    " length_signature string, header_only boolean, ipids array<int>, client_ipids array<int>, server_ipids array<int>, client_ttl int, server_ttl int, first_ms long, last_ms long, packet_count long"
)


def match_one(spark, a=None, b=None, **by):
    frames = [spark.createDataFrame([tuple((PAIR | {"stream_id": i} | (x or {}))[c.split()[0]] for c in TYPES.split(", ") for c in [c.strip()])] if x is not None else [], TYPES) for i, x in ((1, a or {}), (2, b or {}))]
    return [(r.kind, r.score, r.forced, r.evidence) for r in matching.scored(*frames, **by).collect()]


def test_a_shut_gate_leaves_a_strong_pair_to_its_score(spark):
    assert match_one(spark) == [("features", 1.0, True, "shape(1.00) ipid*(n=20,r=1.00,j=1.00)")]
    # 5 s apart: the common values force nothing, the score still accepts.
    late = {"first_ms": 65_000, "last_ms": 90_000}
    assert match_one(spark, b=late) == [("features", 1.0, False, "shape(1.00) ipid(n=20,r=1.00,j=1.00)")]
    # Values of one direction alone ask for more of both.
    one_sided = {"server_ipids": [], "ipids": list(range(1, 11)), "client_ipids": list(range(1, 11))}
    assert match_one(spark, one_sided, one_sided)[0][2] is True
    wider = one_sided | {"ipids": list(range(1, 16)), "client_ipids": list(range(1, 16))}
    assert match_one(spark, one_sided, wider) == [("features", 1.0, False, "shape(1.00) ipid(n=10,r=1.00,j=0.67)")]
    options = {"syn_options": "mss=1460", "client_isn": 7, "server_isn": 9}
    other_port = match_one(spark, options, options | {"client_port": 40001})
    assert other_port[0][2] is False and other_port[0][1] == 1.0


def test_sequence_numbers_count_as_they_are_in_features(spark):
    options = {"syn_options": "mss=1460", "client_isn": 7, "server_isn": 0}
    # 0.25 + 0.12 + 0.06 + 0.08 + 0.16 of as much: an unseen server number on both sides is equal.
    assert match_one(spark, options, options)[0][3] == "synopt isnC isnS shape(1.00) ipid*(n=20,r=1.00,j=1.00)"


def test_short_flows_without_options_match_on_what_they_have(spark):
    short = {"ipids": [5], "client_ipids": [5], "server_ipids": [], "packet_count": 2, "last_ms": 10}
    assert match_one(spark, short, short) == [("microflow", 1.0, False, "micro ttl shape(1.00) ipid(1)")]
    # TTLs far apart: 0.10 of 0.20.
    assert match_one(spark, short, short | {"client_ttl": 128, "server_ttl": 128}) == []
    # The client's are far apart, the server's are close.
    assert match_one(spark, short, short | {"client_ttl": 128})[0][0] == "microflow"
    assert match_one(spark, short, short | {"client_port": 1, "server_port": 2}) == []
    zero = {"ipids": [0], "client_ipids": []}
    assert match_one(spark, short | zero, short | zero)[0][0] == "microflow"
    # 0.3 + 0.3 + 0.1 + 0.1 of 1.0, added in order, is less than 0.8.
    full = short | {"syn_options": "mss", "client_isn": 3, "tsval": "1"}
    assert match_one(spark, full, full | {"tsval": "2"}) == []


def test_handshakes_match_across_addresses(spark):
    a = {"ipids": [1], "client_ipids": [1], "server_ipids": [], "syn_options": "mss=1460", "client_isn": 77, "server_isn": 78, "packet_count": 30}
    b = a | {"ipids": [2], "client_ipids": [2], "client_ip": "172.16.0.1"}
    assert match_one(spark, a, b, strategy=matching.PORT) == [("handshake", 1.0, False, "nat2 synopt isnC isnS shape(1.00) ttl")]
    assert match_one(spark, a, b | {"first_ms": 130_000, "last_ms": 140_000}, strategy=matching.PORT) == []
    clamped = {"syn_options": "mss=1380", "ipids": [1, 9, 11], "packet_count": 3}
    assert match_one(spark, a | {"ipids": [1, 9], "packet_count": 3, "length_signature": "C:0"}, b | clamped | {"length_signature": "S:0"}, strategy=matching.PORT)[0][3].endswith("ipid(2) micro-isnC-ipid")


def test_bucket_follows_the_addresses_that_both_have(spark):
    rows = lambda *ends: spark.createDataFrame([(c, s, p) for c, s, p in ends], "client_ip string, server_ip string, server_port int")
    a = rows(("c1", "s1", 443))
    assert matching.choose_bucket(a, rows(("c1", "s1", 443))) == matching.SERVER
    assert matching.choose_bucket(a, rows(("x", "s1", 443))) == matching.PORT
    assert matching.choose_bucket(a, rows(("c1", "x", 443))) == matching.PORT
    assert matching.choose_bucket(a, rows(("x", "y", 443))) == matching.PORT


def test_behavior_meets_by_classes_of_any_likeness(spark):
    import itertools
    import random

    r = random.Random(3)
    flows = [{"stream_id": i, "first_ms": (f := r.randrange(1000)), "last_ms": f + r.choice([0, 5, 50, 400, 3000]) * r.randrange(1, 4), "packet_count": r.randrange(1, 9), "total_bytes": r.choice([0, 60, 900, 70_000]) * r.randrange(1, 3)} for i in range(40)]
    schema = "stream_id long, client_ip string, server_ip string, server_port int, first_ms long, last_ms long, packet_count long, total_bytes long"
    df = spark.createDataFrame([(f["stream_id"], "c", "s", 1, f["first_ms"], f["last_ms"], f["packet_count"], f["total_bytes"]) for f in flows], schema)

    def like(x, y):
        return 1.0 if x <= 0 and y <= 0 else 0.0 if x <= 0 or y <= 0 else min(x, y) / max(x, y)

    for threshold in (0.6, 0.9):
        got = {(x.id_a, x.id_b): x.score for x in matching.behavioral(df, df, threshold=threshold).collect()}
        want = {}
        for x, y in itertools.product(flows, flows):
            dx, dy = x["last_ms"] - x["first_ms"], y["last_ms"] - y["first_ms"]
            s = 0.4 * like(dx, dy) + 0.3 * like(dx / max(x["packet_count"] - 1, 1), dy / max(y["packet_count"] - 1, 1)) + 0.3 * like(x["total_bytes"], y["total_bytes"])
            if s >= threshold:
                want[x["stream_id"], y["stream_id"]] = round(s, 6)
        assert got == want


def test_confidences(spark):
    rows = spark.createDataFrame([("HIGH", "LOW"), ("MEDIUM", "HIGH"), ("odd", "HIGH")], "a string, b string")
    assert [r[0] for r in rows.select(roles.lesser_confidence(F.col("a"), F.col("b"))).collect()] == ["LOW", "MEDIUM", "UNKNOWN"]
    assert rows.agg(roles.mean_confidence(F.col("a")), roles.mean_confidence(F.col("b"))).first()[:] == ("LOW", "MEDIUM")
    assert rows.limit(0).agg(roles.mean_confidence(F.col("a"))).first()[0] == "UNKNOWN"


def plain_siphash(data):
    """SipHash-1-3 with a zero key, word by word."""
    mask = (1 << 64) - 1
    v = [0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573]

    def turn(x, b):
        return (x << b | x >> (64 - b)) & mask

    def step():
        v[0] = (v[0] + v[1]) & mask
        v[1] = turn(v[1], 13) ^ v[0]
        v[0] = turn(v[0], 32)
        v[2] = (v[2] + v[3]) & mask
        v[3] = turn(v[3], 16) ^ v[2]
        v[0] = (v[0] + v[3]) & mask
        v[3] = turn(v[3], 21) ^ v[0]
        v[2] = (v[2] + v[1]) & mask
        v[1] = turn(v[1], 17) ^ v[2]
        v[2] = turn(v[2], 32)

    whole = len(data) // 8 * 8
    words = [int.from_bytes(data[i : i + 8], "little") for i in range(0, whole, 8)] + [int.from_bytes(data[whole:], "little") | (len(data) & 255) << 56]
    for w in words:
        v[3] ^= w
        step()
        v[0] ^= w
    v[2] ^= 0xFF
    for _ in range(3):
        step()
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def test_flow_hashes_agree_with_plain_ones(spark):
    rng = np.random.default_rng(1)
    for n in (0, 5, 8, 53, 77):
        records = rng.integers(0, 256, (3, n), dtype=np.uint8)
        assert flowhash.siphash13(records).tolist() == [plain_siphash(r.tobytes()) for r in records]
    flows = [("10.0.0.1", "10.0.0.2", 1000, 443), ("10.0.0.2", "10.0.0.1", 443, 1000), ("10.0.0.9", "10.0.0.10", 80, 80), ("10.0.0.10", "10.0.0.9", 80, 80), ("::1", "fe80::2", 5, 1280), ("no ip", "10.0.0.1", 1, 2), (None, "10.0.0.1", 1, 2)]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(flows)], "i int, s string, d string, sp int, dp int")
    flow = flowhash.flow_hash(F.col("s"), F.col("d"), F.col("sp"), F.col("dp"))
    got = {r.i: (r.flow_hash, r.side, r.text) for r in df.select("i", flow.alias("f")).select("i", "f.*", flowhash.flow_hash_text(F.col("f")).alias("text")).collect()}
    for i, (s, d, sp, dp) in enumerate(flows[:5]):
        swap = lambda p: int.from_bytes(p.to_bytes(2, "big"), "little")
        forward = swap(sp) > swap(dp) or (sp == dp and int(ipaddress.ip_address(s)) >= int(ipaddress.ip_address(d)))
        (a, p), (b, q) = ((s, sp), (d, dp)) if forward else ((d, dp), (s, sp))
        packed = [ipaddress.ip_address(x).packed for x in (a, b)]
        record = p.to_bytes(2, "big") + q.to_bytes(2, "big") + b"".join(bytes(8) + len(x).to_bytes(8, "little") + x for x in packed) + (1).to_bytes(8, "little") + b"\x06"
        want = plain_siphash(record)
        assert got[i][:2] == (want - (1 << 64) if want >> 63 else want, 1 if forward else 2)
        assert got[i][2] == f"{got[i][0]} ({'LHS>=RHS' if forward else 'RHS>LHS'})"
    assert got[0][0] == got[1][0] and got[2][0] == got[3][0] and got[5][:2] == got[6][:2] == (None, 0)


def test_flags_print_in_their_bits_order(spark):
    df = spark.createDataFrame([(0x11, 0x10), (0x12, 0x02), (0xC2, 0x00), (0x14, 0x11), (0x02, 0x12)], "a int, b int")
    got = df.select(packets.flag_text(F.col("a")), packets.flag_change_text(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["0x011 [FIN, ACK]", "0x012 [SYN, ACK]", "0x0c2 [SYN, ECE, CWR]", "0x014 [RST, ACK]", "0x002 [SYN]"]
    assert [r[1] for r in got] == ["ACK -> FIN+ACK (Local Side)", "SYN -> SYN+ACK (Local Side)", "SYN+ECE+CWR (Local Side) -> NONE", "FIN+ACK -> RST+ACK (Local Side)", "SYN (Local Side) -> SYN+ACK"]


def test_score_takes_the_mean_of_both_directions(spark):
    row = {"client_packets": 100, "server_packets": 50, "client_retransmission": 10, "server_retransmission": 0, "client_duplicate_ack": 4, "server_duplicate_ack": 1, "client_lost_segment": 6, "server_lost_segment": 0, "client_ack_lost": 0, "server_ack_lost": 4}
    got = quality.with_rates(spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} long" for c in row))).first()
    # Means: 5 % retransmitted, 3 % repeated, 1 % lost for good.
    assert got.score == 100 - (0.4 * 5 + 0.3 * 3 + 0.3 * 1) and got.client_real_loss_rate == 2.0


def test_flags_are_derived_from_numbers(spark):
    ends = {True: ("1.1.1.1", 5, "2.2.2.2", 80), False: ("2.2.2.2", 80, "1.1.1.1", 5)}
    rows = [
        (True, 2, 99, 0, 0), (False, 18, 499, 100, 0), (True, 16, 100, 500, 10), (True, 16, 100, 500, 10), (True, 16, 140, 500, 10),  # sent again, then a gap of 30
        (False, 16, 500, 110, 0), (False, 16, 500, 110, 0), (False, 16, 500, 200, 0), (True, 16, 150, 500, 0),
    ]
    df = spark.createDataFrame([("A", 1, i + 1, *ends[f], flags, seq, ack, n) for i, (f, flags, seq, ack, n) in enumerate(rows)], "capture_id string, stream_id long, frame_number long, src_ip string, src_port int, dst_ip string, dst_port int, flags int, seq long, ack long, len int")
    got = {r.frame_number: {c for c in quality.COUNTERS if r[c]} for r in quality.with_tcp_analysis(df).collect()}
    assert got == {1: set(), 2: set(), 3: set(), 4: {"retransmission"}, 5: {"lost_segment"}, 6: set(), 7: {"duplicate_ack"}, 8: {"ack_lost"}, 9: {"duplicate_ack"}}


PACKETS = "capture_id string, stream_id long, frame_number long, src_ip string, src_port int, dst_ip string, dst_port int, flags int, seq long, ack long, len int"
ENDS = {True: ("1.1.1.1", 5, "2.2.2.2", 80), False: ("2.2.2.2", 80, "1.1.1.1", 5)}


def judged(spark, rows):
    df = spark.createDataFrame([("A", 1, i + 1, *ENDS[f], flags, seq % (1 << 32), ack % (1 << 32), n) for i, (f, flags, seq, ack, n) in enumerate(rows)], PACKETS)
    return {r.frame_number: {c for c in (*quality.COUNTERS, "keep_alive") if r[c]} for r in quality.with_tcp_analysis(df).collect()}


@pytest.mark.parametrize("block", [1 << 16, 3, 1])
def test_streams_that_wrap_are_judged_on(spark, monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block)
    first = 4_294_967_000
    in_order = [(True, 16, first + 100 * i, 500, 100) for i in range(8)]
    assert judged(spark, in_order) == {i: set() for i in range(1, 9)}
    rows = [
        (True, 2, first - 1, 0, 0), (False, 18, 499, first, 0), (True, 16, first, 500, 200), (False, 16, 500, first + 200, 0), (True, 16, first + 200, 500, 200),  # past 2**32
        (False, 16, 500, first + 400, 0), (True, 16, first + 200, 500, 200), (True, 16, first + 500, 500, 10), (False, 16, 500, first + 400, 0), (False, 16, 500, first + 900, 0),
        (True, 16, first + 509, 500, 1), (True, 16, first + 509, 500, 0),
    ]
    assert judged(spark, rows) == {
        1: set(), 2: set(), 3: set(), 4: set(), 5: set(), 6: set(), 7: {"retransmission"}, 8: {"lost_segment"}, 9: {"duplicate_ack"}, 10: {"ack_lost"}, 11: {"keep_alive"}, 12: {"keep_alive"},
    }


def test_blocks_judge_as_one_task_would(spark, monkeypatch):
    rng = np.random.default_rng(5)
    at, rows = {True: 4_294_900_000, False: 4_294_000_000}, []
    for _ in range(1500):
        f, n = bool(rng.integers(2)), int(rng.choice([0, 1, 900]))
        seq = at[f] + int(rng.choice([0, 0, 0, 0, -900, 900, -1]))
        rows.append((f, 16, seq, at[not f] + int(rng.choice([0, 0, 5000])), n))
        at[f] = max(at[f], seq + n)
    monkeypatch.setattr(quality, "BLOCK", 1 << 20)
    whole = judged(spark, rows)
    monkeypatch.setattr(quality, "BLOCK", 64)
    assert judged(spark, rows) == whole and sum(map(bool, whole.values())) > 300


def test_media_numbers_wrap(spark):
    rows = [("a", 1, "b", 2, 7, i, i * 20, (65_530 + i) % 65_536, i * 160) for i in range(12)] + [("a", 1, "b", 2, 8, i, i * 20, (65_530 + n) % 65_536, i * 160) for i, n in enumerate([0, 1, 3, 2, 9, 8])]
    df = spark.createDataFrame(rows, "src_ip string, src_port int, dst_ip string, dst_port int, ssrc long, frame_number long, time_ms long, media_seq long, media_time long")
    assert {r.ssrc: (r.expected, r.lost) for r in modules.rtp_streams(df).collect()} == {7: (12, 0), 8: (10, 4)}


def test_responses_answer_the_oldest_open_query(spark):
    cases = {"QQR": [True, False], "RQR": [True], "QRQR": [True, True], "QQRR": [True, True], "RRQ": [False], "QRRQR": [True, True], "QQQ": [False] * 3, "R": []}
    rows = [(name, i, i * 10, {"Q": "query", "R": "response"}[c]) for name in cases for i, c in enumerate(name)]
    got = modules.request_response_times(spark.createDataFrame(rows, "id string, frame_number long, time_ms long, kind string"), ["id"]).orderBy("id", "frame_number").collect()
    assert {n: [r.answered for r in got if r.id == n] for n in cases} == cases
    assert [r.service_ms for r in got if r.id == "QQRR"] == [20, 20] and [r.service_ms for r in got if r.id == "QQR"] == [20, None]


def test_a_stream_matched_twice_is_one_group(spark):
    packet = "struct<frame_number:long,time_ms:long,flags:int,seq:long,ack:long,len:int>"
    one = lambda frame, flags: {"frame_number": frame, "time_ms": frame, "flags": flags, "seq": 1, "ack": 0, "len": 0}
    rows = [(1, 7, 5, 1, one(1, 16), one(9, 24)), (1, 8, 5, 1, one(1, 16), one(3, 24)), (2, 9, 5, 1, one(4, 16), one(4, 16))]
    got = packetdiff.diff_groups(spark.createDataFrame(rows, f"id_a long, id_b long, ip_id int, k int, a {packet}, b {packet}")).orderBy("id_a").collect()
    assert [(r.id_a, r.streams_b, r.flags_differences, r.flags_examples) for r in got] == [(1, 2, 2, "Frame 1->3; Frame 1->9"), (2, 1, 0, "")]


def test_captures_in_one_table_stay_apart(spark):
    rows = [(c, 1, i, "a" if i % 2 else "b", 1 if i % 2 else 2, False, False, False, False) for c in "AB" for i in range(1, 5 if c == "A" else 3)]
    df = spark.createDataFrame(rows, "capture_id string, stream_id long, frame_number long, src_ip string, src_port int, retransmission boolean, duplicate_ack boolean, lost_segment boolean, ack_lost boolean")
    assert {(r.capture_id, r.client_packets, r.server_packets) for r in quality.by_stream(df).collect()} == {("A", 2, 2), ("B", 1, 1)}


def test_duplicates_are_dropped_within_the_window_across_blocks(spark):
    contents = [i % 7 if i % 3 else 0 for i in range(400)]
    df = spark.createDataFrame([("A", 1, i, i, c) for i, c in enumerate(contents)] + [("B", 1, i, i, 0) for i in range(5)], "capture_id string, stream_id long, frame_number long, time_ms long, content int")
    for window, block in ((5, 1 << 16), (5, 16), (1, 16), (16, 16)):
        preprocess.BLOCK, kept = block, preprocess.BLOCK
        got = {(r.capture_id, r.frame_number) for r in preprocess.remove_duplicates(df, ("content",), window=window).collect()}
        preprocess.BLOCK = kept
        # The packet is compared with the window's other packets before it.
        want = {("A", i) for i in range(400) if contents[i] not in contents[max(0, i - window + 1) : i]} | {("B", i) for i in range(5) if window == 1 or i == 0}
        assert got == want, (window, block)


def test_voice_quality_of_known_cases(spark):
    df = spark.createDataFrame([(0.0, 0.0, "g711u"), (2.0, 30.0, "G729"), (0.0, 60.0, "opus"), (100.0, 200.0, "x"), (0.0, 10.0, "ilbc")], "loss double, jitter double, codec string")
    got = [(r.r_factor, r.rating) for r in modules.voice_quality(df).collect()]
    # 93.2 - 10; 83 - 10.8 - 5; 92 - 10 - 15 - 8; below zero; 82 - 10.
    assert got == [(83.2, "Good"), (67.2, "Poor"), (59.0, "Bad"), (0.0, "Bad"), (72.0, "Fair")]


def test_completeness_of_flag_strings(spark):
    df = spark.createDataFrame([("--DASS",), ("RFDASS",), ("---A-S",), ("-----S",), ("----S-",), ("-F---S",)], "completeness string")
    got = {r.flags: (r.status, r.data, r.severity) for r in modules.completeness(df).collect()}
    assert got == {
        "--DASS": ("Complete", "WITH_DATA", "Low"), "RFDASS": ("Complete", "WITH_DATA_CLOSED", "Low"), "---A-S": ("Established", "NO_DATA", "Medium"), "-----S": ("Half-open", "NO_DATA", "High"), "----S-": ("Unknown", "NO_DATA", "High"), "-F---S": ("Half-open", "NO_DATA_CLOSED", "High"),
    }


def test_jitter_of_long_streams(spark):
    rng = np.random.default_rng(2)
    arrivals = np.cumsum(rng.integers(0, 60, 3000))
    rows = [("a", 1, "b", 2, 7, i, int(t), i, i * 160) for i, t in enumerate(arrivals)]
    got = modules.rtp_streams(spark.createDataFrame(rows, "src_ip string, src_port int, dst_ip string, dst_port int, ssrc long, frame_number long, time_ms long, media_seq long, media_time long")).first()
    j, seen, last = 0.0, [], None
    for i, t in enumerate(arrivals):
        transit = int(t) - i * 20.0
        j += (abs(transit - last) - j) / 16 if last is not None else 0.0
        seen, last = [*seen, j], transit
    assert abs(got.jitter - sum(seen) / len(seen)) < 1e-3 and abs(got.max_jitter - max(seen)) < 1e-3 and got.lost == 0


def test_a_table_of_nodes_goes_to_a_database(spark, tmp_path):
    nodes = spark.createDataFrame([(0, "10.0.0.1", [1]), (1, None, [])], "pcap_id int, ip string, net_area array<int>")
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    for mode in ("append", "append", "overwrite"):
        graph.write_table(nodes, url, "nodes", mode)
    rows = spark.read.format("jdbc").option("url", url).option("dbtable", "nodes").load().collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == [(0, "10.0.0.1", "{1}"), (1, None, "{}")]


def test_a_batch_is_in_the_database_once(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    rows = lambda *ids: spark.createDataFrame([(i, f"ip{i}", [i]) for i in ids], "pcap_id int, ip string, net_area array<int>").repartition(3)
    kept = lambda: sorted((r.batch_id, r.pcap_id, r.ip, r.net_area) for r in spark.read.format("jdbc").option("url", url).option("dbtable", "nodes").load().collect())
    for _ in range(2):
        graph.write_batch(rows(1, 2, 3), url, "nodes", "one")
        graph.write_batch(rows(9), url, "nodes", "two")
    whole = [("one", 1, "ip1", "{1}"), ("one", 2, "ip2", "{2}"), ("one", 3, "ip3", "{3}"), ("two", 9, "ip9", "{9}")]
    assert kept() == whole
    # A job that dies after some of its rows leaves the table as it was; its next run puts them in once.
    broken = rows(4, 5).withColumn("ip", F.when(F.col("pcap_id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("ip")))
    with pytest.raises(Exception, match="lost"):
        graph.write_batch(broken, url, "nodes", "three")
    assert kept() == whole
    graph.write_batch(rows(4, 5), url, "nodes", "three")
    assert kept() == sorted([*whole, ("three", 4, "ip4", "{4}"), ("three", 5, "ip5", "{5}")])
    with pytest.raises(ValueError):
        graph.write_batch(rows(1), url, "nodes", "x'; DROP")


def test_rows_for_the_table_of_streams(spark):
    packet = "struct<frame_number:long,time_ms:long,flags:int,seq:long,ack:long,len:int>"
    one = lambda frame, flags: {"frame_number": frame, "time_ms": frame, "flags": flags, "seq": 1, "ack": 0, "len": 0}
    groups = packetdiff.diff_groups(spark.createDataFrame([(1, 7, 5, 1, one(1, 16), one(9, 24))], f"id_a long, id_b long, ip_id int, k int, a {packet}, b {packet}"))
    ends = spark.createDataFrame([(1, "10.0.0.1", "10.0.0.2", 5000, 443)], "stream_id long, client_ip string, server_ip string, client_port int, server_port int")
    row = packetdiff.stream_extra(groups, ends, 3).first()
    want = ends.select(flow_hash(F.col("server_ip"), F.col("client_ip"), F.col("server_port"), F.col("client_port"))["flow_hash"]).first()[0]
    assert tuple(row) == (3, want, 1_000_000, 1_000_000, 1, "ACK (Local Side) -> PSH+ACK", "Frame 1\u21929", 0, "")


def test_examples_of_differences_are_bounded(spark):
    ends = [(1, 2, 5, k, {"frame_number": k, "time_ms": k, "flags": 16, "seq": k, "ack": 0, "len": 0}, {"frame_number": 100 + k, "time_ms": k, "flags": 24 if k < 12 else 16, "seq": k + (k == 3), "ack": 0, "len": 0}) for k in range(1, 21)]
    packet = "struct<frame_number:long,time_ms:long,flags:int,seq:long,ack:long,len:int>"
    got = packetdiff.diff_groups(spark.createDataFrame(ends, f"id_a long, id_b long, ip_id int, k int, a {packet}, b {packet}")).first()
    assert (got.flags_differences, got.seq_differences, got.seq_examples) == (11, 1, "Frame 3->103: 3->4") and got.flags_examples.endswith("Frame 10->110; ... and 1 more")
    assert got.flag_change == "ACK (Local Side) -> PSH+ACK" and (got.first_ns, got.last_ns) == (1_000_000, 20_000_000)


def test_connections_time_out_in_a_stream(spark, tmp_path):
    """Files come one by one: a connection that fell silent is given out once the stream's time is past its limit, one that goes on is not."""
    schema = "capture_id string, stream_id long, time_ms long, flags int, frame_len long"
    batches = [[("A", 1, 500, 2, 60), ("A", 2, 1_000, 2, 60), ("A", 3, 2_000, 2, 50)], [("A", 2, 400_000, 16, 40), ("A", 3, 401_000, 4, 40), ("A", 3, 402_000, 2, 70)], [("A", 9, 1_900_000, 2, 60)], [("A", 9, 1_950_000, 16, 10)]]
    for i, rows in enumerate(batches):
        at = tmp_path / f"b{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(at))
        for part in at.glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            target = tmp_path / "in" / f"{i}.parquet"
            target.write_bytes(part.read_bytes())
            import os

            os.utime(target, (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in sessions.run_available(sessions.stateful_connections(stream, idle_ms=600_000, late="1 minute")).collect())
    assert got == [("A", 1, 500, 500, 1, 60, False), ("A", 2, 1_000, 400_000, 2, 100, False), ("A", 3, 2_000, 401_000, 2, 90, True), ("A", 3, 402_000, 402_000, 1, 70, False)]


def test_pairs_are_picked_by_their_number(spark):
    import pytest

    pairs = spark.createDataFrame([(5, 1), (2, 9), (2, 3)], "id_a long, id_b long")
    assert [[tuple(r) for r in matching.pick_pair(pairs, n).collect()] for n in (1, 2, 3, 4)] == [[(2, 3)], [(2, 9)], [(5, 1)], []]
    with pytest.raises(ValueError):
        matching.pick_pair(pairs, 0)


def test_exact_evidence_falls_back_to_tuples(spark):
    ends = "client_ip string, client_port int, server_ip string, server_port int"
    side = lambda *rows: spark.createDataFrame(list(rows), f"stream_id long, {ends}")
    a, b = side((1, "c", 5, "s", 80), (2, "c", 6, "s", 80)), side((7, "s", 80, "x", 5), (8, "x", 6, "s", 80))
    tuples = "struct<ip_1:string,port_1:int,ip_2:string,port_2:int>"
    found = spark.createDataFrame([
        (1, 7, ("c", 5, "s", 80), ("s", 80, "x", 5), "trailer", "e"),  # both streams are there
        (99, 8, ("c", 6, "s", 80), ("s", 80, "x", 6), "trailer", "e"),  # one is not: both tuples are looked up
        (99, 98, ("c", 6, "s", 80), ("n", 1, "x", 6), "trailer", "e"),
    ], f"id_a long, id_b long, tuple_a {tuples}, tuple_b {tuples}, kind string, evidence string")
    got = sorted((r.id_a, r.id_b, r.score, r.forced) for r in matching.to_connections(found, a, b).collect())
    assert got == [(1, 7, 1.0, True), (2, 8, 1.0, True)]
