"""The same connection at two capture points: candidates, scores, assignment.

``a`` and ``b`` hold one capture each, so a stream id names a connection. Pairs
are ids until they have been judged: only what the scores need of a connection,
and no list, goes through a shuffle, and whole connections are attached to
matches alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import packets as P
from packetloom.operators import scoring as S
from packetloom.operators.connections import ranks
from packetloom.operators.roles import cardinalities, detect_roles
from packetloom.storage import materialize

SERVER, PORT, NONE = "server", "port", "none"


#: Words of evidence of matches by trailer and by client hello.
TRAILER_WORD, HELLO_WORD = "F5_TRAILER", "TLS_CLIENT_HELLO"


def choose_bucket(a: DataFrame, b: DataFrame) -> str:
    """Which key to compare connections by, from whether both captures have clients and servers in common.

    One row of flags reaches the driver.
    """
    sets = {}
    for c in ("client_ip", "server_ip"):
        left, right = a.select(c).distinct(), b.select(c).distinct()
        sets[c] = not left.join(right, c, "left_semi").isEmpty()
    if sets["client_ip"] != sets["server_ip"] or not sets["server_ip"]:
        return PORT
    return SERVER


def bucket(strategy: str) -> Column:
    """The blocking key of a connection: its pair of addresses, its server port, or nothing."""
    if strategy == SERVER:
        return F.concat_ws(":", F.least("client_ip", "server_ip"), F.greatest("client_ip", "server_ip"))
    return F.col("server_port").cast("string") if strategy == PORT else F.lit("")


def candidates(a: DataFrame, b: DataFrame, strategy: str = SERVER) -> DataFrame:
    """(id_a, id_b, ids, any_ids): pairs that some score may accept, with how many identification values both have, zero apart or not.

    All scores ask for a common port. The features need two common values. The
    score without addresses, and that of short flows with options on both sides,
    cannot be reached without the same client sequence number; other short flows
    need one common value and overlapping times. So pairs meet in one equi-join
    on (bucket, value or sequence number), not in a product of buckets; skewed
    keys are split by the adaptive plan.
    """
    port = [f"{side}_port" for side in ("client", "server")]

    def keyed(x: DataFrame, name: str) -> DataFrame:
        ids = F.transform("ipids", lambda v: F.struct(F.lit(False).alias("isn"), v.cast("long").alias("v")))
        isn = F.when((F.col("client_isn") != 0) | (F.col("syn_options") != ""), F.array(F.struct(F.lit(True).alias("isn"), F.col("client_isn").cast("long").alias("v"))))
        rest = [F.col(c).alias(f"{c}_{name}") for c in (*port, "first_ms", "last_ms", "packet_count")]
        return x.select(bucket(strategy).alias("bucket"), F.col("stream_id").alias(f"id_{name}"), *rest, F.inline(F.concat(ids, F.coalesce(isn, F.array()))))

    both_ports = [F.col(f"{p}_a") == F.col(f"{q}_b") for p in port for q in port]
    overlap = ~((F.col("last_ms_a") < F.col("first_ms_b")) | (F.col("last_ms_b") < F.col("first_ms_a")))
    short = (F.least("packet_count_a", "packet_count_b") <= S.MICRO_PACKETS) | (F.least(F.col("last_ms_a") - F.col("first_ms_a"), F.col("last_ms_b") - F.col("first_ms_b")) <= S.MICRO_MS)
    met = keyed(a, "a").join(keyed(b, "b"), ["bucket", "isn", "v"]).where(both_ports[0] | both_ports[1] | both_ports[2] | both_ports[3])
    counted = met.groupBy("id_a", "id_b").agg(F.count_if(~F.col("isn") & (F.col("v") != 0)).alias("ids"), F.count_if(~F.col("isn")).alias("any_ids"), F.bool_or("isn").alias("_isn"), F.bool_or(overlap & short).alias("_short"))
    return counted.where((F.col("ids") >= S.LEAST_COMMON_IDS) | F.col("_isn") | ((F.col("any_ids") >= 1) & F.col("_short"))).drop("_isn", "_short")


#: Connections of at most so many identification values meet by two of them at a time.
FEW_IDS = 16


def likely(a: DataFrame, b: DataFrame, strategy: str = PORT) -> DataFrame:
    """The ``candidates`` that ``scored`` may accept, in the same columns, for buckets that hold large parts of a capture.

    One common value in 65 536 is no rare thing there, so pairs that some rule
    accepts meet by what is rare. The features need two common values: pairs of
    connections with few values meet by two at once. Short flows need the same
    client sequence number if both have options, else a common time stamp, or no
    time stamps on one side. The score without addresses needs the sequence
    number. Hashes only bring pairs together; buckets, ports and values are
    compared themselves. Connections with more values are counted value by value.
    """
    few = F.size(F.array_remove("ipids", 0)) <= FEW_IDS
    (a_few, a_many), (b_few, b_many) = ((x.where(few), x.where(~few)) for x in (a, b))
    out = _counted(_met(a_few, b_few, strategy).distinct(), a_few, b_few, strategy)
    for x, y in ((a_many, b), (a_few, b_many)):
        if not (a_many if x is a_many else b_many).isEmpty():
            out = out.unionByName(candidates(x, y, strategy))
    return out


def _met(a: DataFrame, b: DataFrame, strategy: str) -> DataFrame:
    """(id_a, id_b) of connections with few values that share what some rule asks for, and maybe some more; a pair may come more than once."""
    spot = lambda kind, x: F.xxhash64(bucket(strategy), F.lit(kind), x)
    ids = F.array_sort(F.array_remove("ipids", 0))
    twos = F.flatten(F.transform(ids, lambda x, i: F.transform(F.slice(ids, i + 2, F.size(ids)), lambda y: spot(0, F.shiftleft(x.cast("long"), 32) + y))))
    isn = F.when((F.col("client_isn") != 0) | (F.col("syn_options") != ""), F.array(spot(1, F.col("client_isn").cast("long"))))
    strong = [x.select(F.col("stream_id").alias(f"id_{s}"), F.explode(F.concat(twos, F.coalesce(isn, F.array()))).alias("spot")) for s, x in (("a", a), ("b", b))]
    out = strong[0].join(strong[1], "spot").select("id_a", "id_b")

    values = F.transform("ipids", lambda v: spot(2, v.cast("long")))
    stamps = F.array_compact(F.array(F.when(F.col("tsval") != "", spot(3, F.col("tsval"))), F.when(~F.col("tsecr").isin("", "0"), spot(4, F.col("tsecr")))))
    bare = (F.col("tsval") == "") & (F.col("tsecr") == "")
    short = (F.least("packet_count_a", "packet_count_b") <= S.MICRO_PACKETS) | (F.least(F.col("last_ms_a") - F.col("first_ms_a"), F.col("last_ms_b") - F.col("first_ms_b")) <= S.MICRO_MS)
    together = ~((F.col("last_ms_a") < F.col("first_ms_b")) | (F.col("last_ms_b") < F.col("first_ms_a")))

    def timed(x: DataFrame, s: str, spots: Column) -> DataFrame:
        return x.select(F.col("stream_id").alias(f"id_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("first_ms", "last_ms", "packet_count")), (F.col("syn_options") != "").alias(f"options_{s}"), F.explode(spots).alias("spot"))

    def short_ones(x: DataFrame, y: DataFrame, spots: Column) -> DataFrame:
        return timed(x, "a", spots).join(timed(y, "b", spots), "spot").where(~(F.col("options_a") & F.col("options_b")) & short & together).select("id_a", "id_b")

    out = out.union(short_ones(a, b, stamps))
    for x, y, some in ((a.where(bare), b, a), (a.where(~bare), b.where(bare), b)):
        if not some.where(bare).isEmpty():
            out = out.union(short_ones(x, y, values))
    return out


def _counted(pairs: DataFrame, a: DataFrame, b: DataFrame, strategy: str) -> DataFrame:
    """Pairs of one bucket with a common port, with the numbers of values that both have, zero apart or not."""
    side = lambda x, s: x.select(F.col("stream_id").alias(f"id_{s}"), bucket(strategy).alias(f"bucket_{s}"), F.array("client_port", "server_port").alias(f"ports_{s}"), F.col("ipids").alias(f"ipids_{s}"))
    whole = pairs.join(side(a, "a"), "id_a").join(side(b, "b"), "id_b").where((F.col("bucket_a") == F.col("bucket_b")) & F.arrays_overlap("ports_a", "ports_b"))
    common = F.array_intersect("ipids_a", "ipids_b")
    return whole.select("id_a", "id_b", F.size(F.array_remove(common, 0)).cast("long").alias("ids"), F.size(common).cast("long").alias("any_ids"))


def with_scores(a: DataFrame, b: DataFrame, strategy: str = SERVER, pairs: DataFrame | None = None) -> DataFrame:
    """Candidates, or the ``pairs`` given of them, with all their scores: f (features), micro and nat."""
    pairs = (candidates(a, b, strategy) if pairs is None else pairs).join(S.slim(a, "a"), "id_a").join(S.slim(b, "b"), "id_b")
    # The evidence is written: its many expressions would not fit one generated method with the scores.
    judged = materialize(S.with_evidence(pairs).drop("a", "b"))
    return judged.withColumn("f", S.feature_score()).withColumn("micro", S.microflow_score()).withColumn("nat", S.nat_score())


def scored(a: DataFrame, b: DataFrame, strategy: str = SERVER, threshold: float = S.THRESHOLD, second_chance: bool = True) -> DataFrame:
    """(id_a, id_b, score, forced, kind, evidence) of valid pairs.

    Pairs with too few common values are judged as short flows, else without
    addresses; ``second_chance`` lets pairs that fail the features try the latter.
    """
    enough = F.col("any_ids") >= S.LEAST_COMMON_IDS
    by_features = enough & F.col("f.required") & ((F.col("f.score") >= threshold) | F.col("f.forced"))
    by_micro = ~enough & F.coalesce(F.col("micro.score") >= S.MICRO_ACCEPT, F.lit(False))
    by_nat = F.col("nat.accepted") & (F.lit(second_chance) | ~enough)
    pick = lambda field: F.when(by_features, F.col(f"f.{field}")).when(by_micro, F.col(f"micro.{field}")).otherwise(nat[field])
    nat = {"score": F.col("nat.raw") / F.col("nat.available"), "evidence": F.col("nat.evidence")}
    kind = F.when(by_features, "features").when(by_micro, "microflow").when(by_nat, "handshake")
    out = with_scores(a, b, strategy, None if strategy == SERVER else likely(a, b, strategy)).withColumn("kind", kind).where("kind IS NOT NULL")
    return out.select("id_a", "id_b", S.rounded(pick("score"), 6).alias("score"), (by_features & F.col("f.forced")).alias("forced"), "kind", pick("evidence").alias("evidence"))


def one_to_many(a: DataFrame, b: DataFrame, strategy: str = SERVER) -> DataFrame:
    """Every valid pair."""
    return scored(a, b, strategy, second_chance=False)


def one_to_one(a: DataFrame, b: DataFrame, strategy: str = SERVER) -> DataFrame:
    """The best pairs, each connection in one at most."""
    return assign(scored(a, b, strategy))


def attach(matches: DataFrame, a: DataFrame, b: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Matches with the connections of both sides, or some ``columns`` of them, as structs ``a`` and ``b``; pairs whose connection is not there are left out."""
    side = lambda x, name: x.select(F.col("stream_id").alias(f"id_{name}"), F.struct(*(columns or x.columns)).alias(name))
    return matches.join(side(a, "a"), "id_a").join(side(b, "b"), "id_b")


def assign(matches: DataFrame) -> DataFrame:
    """One-to-one pairs: greedily the best by (forced, score, smaller ids).

    A pair that is the best of both its connections is what the greedy order
    takes before any other pair of theirs; each round takes all such pairs and
    drops the others of the same connections. Every round takes at least the
    overall best, and only the number of pairs left reaches the driver.
    """
    columns = matches.columns
    left = materialize(matches.withColumn("rank", F.struct(F.col("forced"), F.col("score"), (-F.col("id_a")).alias("x"), (-F.col("id_b")).alias("y"))))
    taken: list[DataFrame] = []
    while not left.isEmpty():
        best_a = left.groupBy("id_a").agg(F.max("rank").alias("best_a"))
        best_b = left.groupBy("id_b").agg(F.max("rank").alias("best_b"))
        ranked = left.join(best_a, "id_a").join(best_b, "id_b")
        chosen = materialize(ranked.where("rank = best_a AND rank = best_b").select(*columns))
        taken.append(chosen)
        left = materialize(left.join(chosen.select("id_a"), "id_a", "left_anti").join(chosen.select("id_b"), "id_b", "left_anti"))
    out = taken[0] if taken else matches.limit(0)
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def statistics(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: connections, matched connections and rates of both sides, mean score, fan-out. It joins aggregates of one row each."""
    matches = materialize(matches.select("id_a", "id_b", "score"))
    per_a = matches.groupBy("id_a").agg(F.count("*").alias("fan")).agg(F.max("fan").alias("max_fan_out"), F.round(F.avg("fan"), 6).alias("avg_fan_out"))
    found = matches.agg(F.count("*").alias("pairs"), F.count_distinct("id_a").alias("matched_a"), F.count_distinct("id_b").alias("matched_b"), F.round(F.avg("score"), 6).alias("avg_score"))
    totals = a.agg(F.count("*").alias("total_a")).crossJoin(b.agg(F.count("*").alias("total_b"))).crossJoin(found).crossJoin(per_a)
    rate = lambda s: F.round(F.when(F.col(f"total_{s}") > 0, F.col(f"matched_{s}") / F.col(f"total_{s}")).otherwise(0.0), 6).alias(f"rate_{s}")
    return totals.select("*", rate("a"), rate("b"))


def swapped(c: Column) -> Column:
    """A connection with client and server exchanged."""
    out = c
    for x, y in (("client_ip", "server_ip"), ("client_port", "server_port"), ("client_isn", "server_isn"), ("client_md5", "server_md5"), ("client_ipids", "server_ipids"), ("client_ttl", "server_ttl")):
        out = out.withField(x, c[y]).withField(y, c[x])
    return out


def align_directions(matches: DataFrame) -> DataFrame:
    """Where server ports differ but cross over, exchange the roles of the side that saw no SYN, else of ``b``."""
    crossed = (S._a("server_port") != S._b("server_port")) & ((S._a("server_port") == S._b("client_port")) | (S._a("client_port") == S._b("server_port")))
    swap_a = crossed & ~S._a("has_syn") & S._b("has_syn")
    a, b = F.when(swap_a, swapped(F.col("a"))).otherwise(F.col("a")), F.when(crossed & ~swap_a, swapped(F.col("b"))).otherwise(F.col("b"))
    return matches.withColumns({"a": a, "b": b})


BEHAVIOR = ["first_ms", "last_ms", "packet_count", "total_bytes"]


def behavioral(a: DataFrame, b: DataFrame, strategy: str = SERVER, threshold: float = S.THRESHOLD, weights: tuple[float, float, float, float] = S.BEHAVIOR_WEIGHTS) -> DataFrame:
    """(id_a, id_b, score, forced, kind, evidence) of pairs of a bucket that behave alike, judged by times and sizes alone.

    A score of at least ``threshold`` needs some weighted likeness of at least
    ``threshold`` itself. Durations, paces and sizes are alike so far only if they
    stand in the same or in neighbouring classes of their logarithm; pairs meet by
    these classes, where a weight counts, or by slices of time for the overlap.
    """
    ratio_bits = -math.log2(threshold) if 0 < threshold <= 1 else None
    if ratio_bits is None or weights[0] > 0:
        classes = [("all", F.lit(0), F.array(F.lit(0)))]
    else:
        span, pace = F.col("last_ms") - F.col("first_ms"), (F.col("last_ms") - F.col("first_ms")) / F.greatest(F.col("packet_count") - 1, F.lit(1))
        width = max(ratio_bits, 1e-3) * 1.000001
        classes = []
        for name, w, x in zip(("dur", "iat", "bytes"), weights[1:], (span, pace, F.col("total_bytes"))):
            if w > 0:
                level = F.when(x > 0, F.floor(F.log2(x.cast("double")) / width)).otherwise(F.lit(-(1 << 40))).cast("long")
                classes.append((name, level, F.when(x > 0, F.array(level - 1, level, level + 1)).otherwise(F.array(level))))
    pairs = None
    for _, own, near in classes:
        left = a.select(bucket(strategy).alias("bucket"), F.col("stream_id").alias("id_a"), F.struct(*BEHAVIOR).alias("a"), F.explode(near).alias("level"))
        right = b.select(bucket(strategy).alias("bucket"), F.col("stream_id").alias("id_b"), F.struct(*BEHAVIOR).alias("b"), own.alias("level"))
        # Both sides' classes are judged before the pair leaves the join.
        met = left.join(right, ["bucket", "level"]).withColumn("s", S.behavioral_score(weights)).where(F.col("s.score") >= threshold).select("id_a", "id_b", "s")
        pairs = met if pairs is None else pairs.union(met)
    return pairs.distinct().select("id_a", "id_b", S.rounded(F.col("s.score"), 6).alias("score"), F.lit(False).alias("forced"), F.lit("behavior").alias("kind"), "s.evidence")


# ---- stages on exact evidence ------------------------------------------------------------------

PAIR = ("id_a", "id_b", "score", "forced", "kind", "evidence")


def match_trailers(snat: DataFrame, vip: DataFrame) -> DataFrame:
    """Streams whose SYN carries the other side's client as its first peer, from rows of ``sources.scans.trailers``.

    An equi-join on (ip, port); the last SYN of a stream counts. ``tuple_a`` and
    ``tuple_b`` are the canonical ends of both SYNs.
    """
    syn = lambda x: x.where(P.is_syn(F.col("flags")))
    ends = _tuple(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    peers = syn(snat).where((F.size("peer_ips") > 0) & (F.size("peer_ports") > 0)).withColumn("_tuple", ends)
    last = peers.groupBy(F.col("stream_id").alias("id_a")).agg(F.max_by(F.struct(F.col("peer_ips")[0].alias("ip"), F.col("peer_ports")[0].alias("port"), F.col("_tuple").alias("tuple_a")), "frame_number").alias("p"))
    clients = syn(vip).withColumn("_tuple", ends).groupBy(F.col("stream_id").alias("id_b")).agg(F.max_by(F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"), F.col("_tuple").alias("tuple_b")), "frame_number").alias("c"))
    met = last.select("id_a", "p.*").join(clients.select("id_b", "c.*"), ["ip", "port"])
    evidence = F.concat(F.lit(f"{TRAILER_WORD}(client="), F.col("ip"), F.lit(":"), F.col("port").cast("string"), F.lit(")"))
    return met.select("id_a", "id_b", "tuple_a", "tuple_b", F.lit("trailer").alias("kind"), evidence.alias("evidence"))


def match_hellos(a: DataFrame, b: DataFrame) -> DataFrame:
    """Streams whose first hello has the same random and session id, from rows of ``sources.scans.client_hellos``."""

    def first(x: DataFrame, s: str) -> DataFrame:
        hello = F.struct("random", "session_id", _tuple(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port")).alias(f"tuple_{s}"))
        return x.groupBy(F.col("stream_id").alias(f"id_{s}")).agg(F.min_by(hello, "frame_number").alias("h")).select(f"id_{s}", "h.*")

    met = first(a, "a").join(first(b, "b"), ["random", "session_id"])
    evidence = F.concat(F.lit(f"{HELLO_WORD}(random="), F.substring("random", 1, 16), F.lit("..., session_id="), F.substring("session_id", 1, 16), F.lit("...)"))
    return met.select("id_a", "id_b", "tuple_a", "tuple_b", F.lit("hello").alias("kind"), evidence.alias("evidence"))


def _tuple(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    low, high = P.canonical_ends(src_ip, src_port, dst_ip, dst_port)
    return F.struct(low.ip.alias("ip_1"), low.port.cast("int").alias("port_1"), high.ip.alias("ip_2"), high.port.cast("int").alias("port_2"))


def to_connections(found: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of exact evidence as matches of connections that are there: by both stream ids, else by both canonical tuples.

    Where several connections share a tuple, the one with the largest id stands for it.
    """

    def named(x: DataFrame, s: str) -> tuple[DataFrame, DataFrame]:
        tuples = x.select(_tuple(F.col("client_ip"), F.col("client_port"), F.col("server_ip"), F.col("server_port")).alias(f"tuple_{s}"), "stream_id").groupBy(f"tuple_{s}").agg(F.max("stream_id").alias(f"by_tuple_{s}"))
        return x.select(F.col("stream_id").alias(f"id_{s}"), F.col("stream_id").alias(f"by_id_{s}")), tuples

    out = found
    for s, x in (("a", a), ("b", b)):
        ids, tuples = named(x, s)
        out = out.join(ids, f"id_{s}", "left").join(tuples, f"tuple_{s}", "left")
    by_ids = F.col("by_id_a").isNotNull() & F.col("by_id_b").isNotNull()
    side = lambda s: F.when(by_ids, F.col(f"by_id_{s}")).otherwise(F.col(f"by_tuple_{s}")).alias(f"id_{s}")
    return out.select(side("a"), side("b"), F.lit(1.0).alias("score"), F.lit(True).alias("forced"), "kind", "evidence").where("id_a IS NOT NULL AND id_b IS NOT NULL")


def staged(stages: list[DataFrame], a: DataFrame, b: DataFrame, features) -> DataFrame:
    """Matches of exact stages (as ``match_trailers`` gives them), each among the connections that earlier ones left, then ``features(a, b)`` on the rest."""
    out = None
    for stage in stages:
        found = materialize(to_connections(stage, a, b))
        a = a.join(found.select(F.col("id_a").alias("stream_id")).distinct(), "stream_id", "left_anti")
        b = b.join(found.select(F.col("id_b").alias("stream_id")).distinct(), "stream_id", "left_anti")
        out = found if out is None else out.unionByName(found)
    rest = features(a, b).select(*PAIR)
    return rest if out is None else out.unionByName(rest)


def choose_stages(trailers: tuple[DataFrame, DataFrame], hellos: tuple[DataFrame, DataFrame]) -> tuple[bool, bool]:
    """Whether to match by trailers and by hellos: each only where both captures have some."""
    return tuple(not any(x.isEmpty() for x in pair) for pair in (trailers, hellos))


def match(a: DataFrame, b: DataFrame, trailers: tuple[DataFrame, DataFrame] | None = None, hellos: tuple[DataFrame, DataFrame] | None = None, strategy: str | None = None, many: bool = False, services: DataFrame | None = None) -> DataFrame:
    """Match two captures' connections in one call.

    Stages run where both captures have their evidence; without any, server roles
    are detected first. ``strategy`` None lets the addresses of both decide the bucket.
    """
    use = choose_stages(trailers, hellos) if trailers and hellos else (False, False)
    stages = [f(*rows) for used, f, rows in zip(use, (match_trailers, match_hellos), (trailers, hellos)) if used]
    if not stages:
        both_sides = cardinalities(a.select(*_ROLE).union(b.select(*_ROLE)))
        a, b = (materialize(detect_roles(x, services, both_sides).drop("server_confidence", "server_method")) for x in (a, b))
    judge = one_to_many if many else one_to_one
    return staged(stages, a, b, lambda x, y: judge(x, y, strategy or choose_bucket(x, y)))


_ROLE = ("client_ip", "client_port", "server_ip", "server_port")


def matches_of_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Saved pairs (id_a, id_b, ...) whose connections both captures have."""
    ids = lambda x, s: x.select(F.col("stream_id").alias(f"id_{s}"))
    return pairs.join(ids(a, "a"), "id_a", "left_semi").join(ids(b, "b"), "id_b", "left_semi")


def pick_pair(matches: DataFrame, number: int) -> DataFrame:
    """The match of a 1-based number in the order of ids: a report's feature."""
    if number < 1:
        raise ValueError("pairs are numbered from 1")
    return ranks(matches, ["id_a", "id_b"], "_place").where(F.col("_place") == number - 1).drop("_place")
