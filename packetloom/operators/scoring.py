"""Scores of connection pairs as native columns.

A pair has what the scores need of both connections in the structs ``a`` and
``b``. Points are doubles that are added in a fixed order, so a pair at a limit
falls on the same side wherever it is computed.
Fixed values: the weights and limits below decide which pairs count as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURE_WEIGHTS = {"synopt": 0.25, "isnC": 0.12, "isnS": 0.06, "ts": 0.10, "dataC": 0.15, "dataS": 0.08, "shape": 0.08, "ipid": 0.16}
MICROFLOW_WEIGHTS = {"synopt": 0.30, "isn": 0.30, "ts": 0.20, "ttl": 0.10, "len": 0.10}
NAT_WEIGHTS = {"synopt": 0.30, "isnC": 0.25, "isnS": 0.10, "ts": 0.15, "data": 0.05, "shape": 0.10, "ttl": 0.05}
SHAPE_SIMILAR = 0.6
LEAST_COMMON_IDS, LEAST_ID_SHARE = 2, 0.5
STRONG_IDS, STRONG_SHARE, STRONG_JACCARD, STRONG_GAP_MS = 10, 0.8, 0.25, 2000
ONE_SIDED_SHARE, ONE_SIDED_JACCARD = 0.95, 0.80
MICRO_PACKETS, MICRO_MS, MICRO_ACCEPT = 3, 2000, 0.80
NAT_GAP_MS, NAT_LEAST_EVIDENCE, NAT_ACCEPT = 60_000, 0.50, 0.85
TTL_CLOSE = 16
THRESHOLD = 0.60
#: What the scores need of a connection, besides the number of its identification values and whether each side has some.
SCORED = ("client_ip", "client_port", "server_port", "syn_options", "client_isn", "server_isn", "tsval", "tsecr", "client_md5", "server_md5", "length_signature", "header_only", "client_ttl", "server_ttl", "first_ms", "last_ms", "packet_count")


def slim(connections: DataFrame, name: str) -> DataFrame:
    """(id, struct) of what the scores need: no lists."""
    some = lambda c: (F.size(c) > 0).alias(f"some_{c}")
    fields = F.struct(*SCORED, F.size(F.array_remove("ipids", 0)).alias("n_ids"), some("client_ipids"), some("server_ipids"))
    return connections.select(F.col("stream_id").alias(f"id_{name}"), fields.alias(name))


def _a(c: str) -> Column:
    return F.col(f"a.{c}")


def _b(c: str) -> Column:
    return F.col(f"b.{c}")


def both(c: str) -> Column:
    return (_a(c) != "") & (_b(c) != "")


def either(c: str) -> Column:
    return (_a(c) != "") | (_b(c) != "")


def same(c: str) -> Column:
    return both(c) & (_a(c) == _b(c))


def same_number(c: str) -> Column:
    return (_a(c) != 0) & (_a(c) == _b(c))


def timestamps_match() -> Column:
    return same("tsval") | (same("tsecr") & (_a("tsecr") != "0"))


def has_timestamp(side: str) -> Column:
    return (F.col(f"{side}.tsval") != "") | (F.col(f"{side}.tsecr") != "")


def shape_similarity() -> Column:
    """Jaccard similarity of the sets of length tokens."""
    x, y = (F.array_distinct(F.split(c, " ")) for c in (_a("length_signature"), _b("length_signature")))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def windows_overlap() -> Column:
    return ~((_a("last_ms") < _b("first_ms")) | (_b("last_ms") < _a("first_ms")))


def time_gap_ms() -> Column:
    return F.greatest(_a("first_ms"), _b("first_ms")) - F.least(_a("last_ms"), _b("last_ms"))


def common_port() -> Column:
    return F.arrays_overlap(F.array(_a("client_port"), _a("server_port")), F.array(_b("client_port"), _b("server_port")))


def is_microflow() -> Column:
    packets = F.least(_a("packet_count"), _b("packet_count")) <= MICRO_PACKETS
    return packets | (F.least(_a("last_ms") - _a("first_ms"), _b("last_ms") - _b("first_ms")) <= MICRO_MS)


def ttl_evidence() -> tuple[Column, Column]:
    """Whether TTLs can be compared, and whether those of one side are close."""
    client, server = (_a("client_ttl") > 0) & (_b("client_ttl") > 0), (_a("server_ttl") > 0) & (_b("server_ttl") > 0)
    close = lambda c: F.abs(_a(c) - _b(c)) <= TTL_CLOSE
    return client | server, (client & close("client_ttl")) | (server & close("server_ttl"))


def with_evidence(pairs: DataFrame) -> DataFrame:
    """Add what the scores are made of as columns of their own to pairs of ``slim`` connections with ``ids`` and ``any_ids``."""
    ttl_there, ttl_close = ttl_evidence()
    least, union = F.least(_a("n_ids"), _b("n_ids")), _a("n_ids") + _b("n_ids") - F.col("ids")
    some = lambda c: _a(f"some_{c}") & _b(f"some_{c}")
    return pairs.withColumns({
        "e_share": F.when(least > 0, F.col("ids") / least).otherwise(0.0), "e_jaccard": F.when(union > 0, F.col("ids") / union).otherwise(0.0),
        "e_similar": F.when(both("length_signature"), shape_similarity()), "e_shape_there": both("length_signature"),
        "e_options": both("syn_options"), "e_some_options": either("syn_options"), "e_options_equal": same("syn_options"),
        "e_client_isn": same_number("client_isn"), "e_server_isn": same_number("server_isn"),
        "e_client_isn_as_is": _a("client_isn") == _b("client_isn"), "e_server_isn_as_is": _a("server_isn") == _b("server_isn"),
        "e_stamps": has_timestamp("a") & has_timestamp("b"), "e_some_stamps": has_timestamp("a") | has_timestamp("b"), "e_stamps_equal": timestamps_match(),
        "e_client_data": both("client_md5"), "e_client_data_equal": same("client_md5"), "e_server_data": both("server_md5"), "e_server_data_equal": same("server_md5"),
        "e_payload": ~(_a("header_only") | _b("header_only")), "e_overlap": windows_overlap(), "e_gap": time_gap_ms(), "e_micro": is_microflow(), "e_port": common_port(),
        "e_ttl": ttl_there, "e_ttl_close": ttl_close, "e_one_sided": some("client_ipids") != some("server_ipids"),
        "e_other_port": (_a("client_ip") == _b("client_ip")) & (_a("client_port") != _b("client_port")),
        "e_no_data": (_a("client_md5") == "") & (_a("server_md5") == "") & (_b("client_md5") == "") & (_b("server_md5") == ""),
    }).withColumn("e_shape", F.col("e_shape_there") & (F.col("e_similar") >= SHAPE_SIMILAR))


def _e(name: str) -> Column:
    return F.col(f"e_{name}")


Part = tuple[Column, Column, float, Column]


def _points(parts: list[Part]) -> tuple[Column, Column, list[Column]]:
    """Points won and points that could be won of (there, equal, points, name), in order, and the names of those won."""
    raw, available, names = F.lit(0.0), F.lit(0.0), []
    for there, equal, points, name in parts:
        raw, available = raw + F.when(there & equal, points).otherwise(0.0), available + F.when(there, points).otherwise(0.0)
        names.append(F.when(there & equal, name))
    return raw, available, names


def rounded(x: Column, places: int) -> Column:
    """Halves away from zero, judged on the shifted double as SQL engines do, not on its decimal digits."""
    return F.round(x * 10.0**places) / 10.0**places


def _two(x: Column) -> Column:
    """Two digits; halves of the shifted double to even."""
    return F.format_string("%.2f", F.rint(x * 100.0) / 100.0)


def _shape_name() -> Column:
    return F.concat(F.lit("shape("), _two(_e("similar")), F.lit(")"))


def feature_score() -> Column:
    """struct(raw, available, score, required, forced, evidence) of pairs with a common port.

    ``required`` is the identification rule. Many common values force a match,
    unless a gate is shut: then the pair is scored like any other.
    """
    w, name = FEATURE_WEIGHTS, F.lit
    required = (F.col("ids") >= LEAST_COMMON_IDS) & (_e("share") >= LEAST_ID_SHARE)
    strong = (F.col("ids") >= STRONG_IDS) & (_e("share") >= STRONG_SHARE) & (_e("jaccard") >= STRONG_JACCARD)
    uneven = _e("one_sided") & ((_e("share") < ONE_SIDED_SHARE) | (_e("jaccard") < ONE_SIDED_JACCARD))
    forced = required & strong & ~((_e("gap") > STRONG_GAP_MS) | (_e("options") & _e("other_port")) | uneven)
    ids = F.concat(F.when(forced, "ipid*").otherwise("ipid"), F.lit("(n="), F.col("ids").cast("string"), F.lit(",r="), _two(_e("share")), F.lit(",j="), _two(_e("jaccard")), F.lit(")"))
    raw, available, names = _points([
        (_e("options"), _e("options_equal"), w["synopt"], name("synopt")), (_e("options"), _e("client_isn_as_is"), w["isnC"], name("isnC")), (_e("options"), _e("server_isn_as_is"), w["isnS"], name("isnS")),
        (_e("some_stamps"), _e("stamps_equal"), w["ts"], name("ts")),
        (_e("payload") & _e("client_data"), _e("client_data_equal"), w["dataC"], name("dataC")), (_e("payload") & _e("server_data"), _e("server_data_equal"), w["dataS"], name("dataS")),
        (_e("shape_there"), _e("shape"), w["shape"], _shape_name()), (F.lit(True), F.lit(True), w["ipid"], ids),
    ])
    return F.struct(raw.alias("raw"), available.alias("available"), (raw / available).alias("score"), required.alias("required"), forced.alias("forced"), F.concat_ws(" ", *names).alias("evidence"))


def microflow_score() -> Column:
    """struct(score, evidence) of short flows with a common port and identification value at overlapping times; null for other pairs."""
    w, name = MICROFLOW_WEIGHTS, F.lit
    raw, available, names = _points([
        (_e("options"), _e("options_equal"), w["synopt"], name("synopt")), (_e("options"), _e("client_isn_as_is"), w["isn"], name("isnC")),
        (_e("stamps"), _e("stamps_equal"), w["ts"], name("ts")), (_e("ttl"), _e("ttl_close"), w["ttl"], name("ttl")), (_e("shape_there"), _e("shape"), w["len"], _shape_name()),
    ])
    there = _e("port") & _e("overlap") & _e("micro") & (F.col("any_ids") >= 1) & (available > 0)
    return F.when(there, F.struct((raw / available).alias("score"), F.concat_ws(" ", F.lit("micro"), *names, F.lit("ipid(1)")).alias("evidence")))


def nat_score() -> Column:
    """struct(raw, available, accepted, evidence): what does not depend on addresses."""
    w, name = NAT_WEIGHTS, F.lit
    raw, available, names = _points([
        (_e("some_options"), _e("options_equal"), w["synopt"], name("synopt")), (_e("some_options"), _e("client_isn"), w["isnC"], name("isnC")), (_e("some_options"), _e("server_isn"), w["isnS"], name("isnS")),
        (_e("some_stamps"), _e("stamps_equal"), w["ts"], name("ts")),
        (_e("client_data") | _e("server_data"), F.when(_e("client_data"), _e("client_data_equal")).otherwise(_e("server_data_equal")), w["data"], F.when(_e("client_data"), "dataC").otherwise("dataS")),
        (_e("shape_there"), _e("shape"), w["shape"], _shape_name()), (_e("ttl"), _e("ttl_close"), w["ttl"], name("ttl")),
    ])
    rich = raw / available >= NAT_ACCEPT
    handshake = _e("micro") & _e("no_data") & _e("client_isn") & (F.col("any_ids") >= LEAST_COMMON_IDS)
    ids = F.when(F.col("any_ids") > 0, F.concat(F.lit("ipid("), F.col("any_ids").cast("string"), F.lit(")")))
    accepted = _e("port") & (_e("overlap") | (_e("gap") <= NAT_GAP_MS)) & (available >= NAT_LEAST_EVIDENCE) & (rich | handshake)
    evidence = F.concat_ws(" ", F.lit("nat2"), *names, ids, F.when(~rich, "micro-isnC-ipid"))
    return F.struct(raw.alias("raw"), available.alias("available"), accepted.alias("accepted"), evidence.alias("evidence"))


def evidence_tokens(matches: DataFrame) -> DataFrame:
    """How many matches show each kind of evidence: tokens up to any bracket, with the share of all matches."""
    token = matches.select(F.explode(F.array_distinct(F.transform(F.split("evidence", " "), lambda t: F.split_part(t, F.lit("("), F.lit(1))))).alias("token"))
    total = matches.agg(F.count("*").alias("_total"))
    return token.where("token <> ''").groupBy("token").agg(F.count("*").alias("matches")).crossJoin(F.broadcast(total)).select("token", "matches", F.round(F.col("matches") / F.col("_total"), 6).alias("share"))


def ratio(x: Column, y: Column) -> Column:
    """The smaller over the larger; 1 if neither is positive, 0 if one is not."""
    return F.when((x <= 0) & (y <= 0), 1.0).when((x <= 0) | (y <= 0), 0.0).otherwise(F.least(x, y) / F.greatest(x, y))


#: Weights of the overlap of times, duration, time between packets and bytes.
BEHAVIOR_WEIGHTS = (0.0, 0.4, 0.3, 0.3)


def behavioral_score(weights: tuple[float, float, float, float] = BEHAVIOR_WEIGHTS) -> Column:
    """struct(score, evidence): likeness of two flows by times and sizes alone."""
    spans = [F.greatest(F.lit(0), F.col(f"{s}.last_ms") - F.col(f"{s}.first_ms")) for s in "ab"]
    union = F.greatest(_a("last_ms"), _b("last_ms")) - F.least(_a("first_ms"), _b("first_ms"))
    common = F.greatest(F.lit(0), F.least(_a("last_ms"), _b("last_ms")) - F.greatest(_a("first_ms"), _b("first_ms")))
    overlap = F.when(union <= 0, 1.0).otherwise(common / union)
    pace = [span / F.greatest(F.col(f"{s}.packet_count") - 1, F.lit(1)) for s, span in zip("ab", spans)]
    parts = (overlap, ratio(*spans), ratio(*pace), ratio(_a("total_bytes"), _b("total_bytes")))
    raw, total = F.lit(0.0), sum(weights)
    for w, x in zip(weights, parts):
        raw = raw + w * x
    named = [x for n, p in zip(("BEHAV(overlap=", " dur=", " iat=", " bytes="), parts) for x in (F.lit(n), _two(p))]
    return F.struct((raw / total if total > 0 else F.lit(0.0)).alias("score"), F.concat(*named, F.lit(")")).alias("evidence"))
