"""How connections are built: what goes through exchanges."""

from pyspark.sql import functions as F

from packetloom.operators.connections import build_connections


def test_a_single_capture_is_built_in_three_exchanges(spark):
    """First packets by rank, sums by sender and TTL, and these by connection; signatures need none of their own."""
    schema = "stream_id long, frame_number long, time_ms long, protocol int, src_ip string, dst_ip string, src_port int, dst_port int, flags int, seq long, ack long, len int, frame_len int, ip_id int, ttl int, options string, tsval string, tsecr string, payload string"
    rows = [(s, f, 10 * f, 6, *(("a", "b", 1, 2) if f % 2 else ("b", "a", 2, 1)), {1: 2, 2: 18}.get(f, 16), 100 + f, 0, f, 54 + f, f, 64, "mss" if f < 3 else "", str(f), "0", "") for s in (1, 2) for f in range(1, 5)]
    packets = spark.createDataFrame(rows, schema).withColumn("capture_id", F.lit("B"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = build_connections(packets)
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3
        got = {r.stream_id: (r.client_ip, r.has_syn, r.tsval, r.client_isn, r.server_isn, r.ipids, r.length_signature, r.packet_count) for r in built.collect()}
        assert got == {s: ("a", True, "1", 101, 102, [1, 2, 3, 4], "C:1 S:2 C:3 S:4", 4) for s in (1, 2)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
