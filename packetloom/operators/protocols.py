"""Reports on the fields of one protocol: TLS alerts, FTP, ICMP, SIP, SSH, message queues, JSON and XML bodies, MGCP, RTCP, SDP.

Rows have a packet's frame_number, frame_len, ends and stream, and the
protocol's fields as text, empty where a packet lacks them. Every report is a
grouping with partial sums; ranked parts are top-k reports of grouped rows.
Fixed values: limits, labels and names of codes below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.modules import HIGH, LOW, MEDIUM, severity, share

#: The order in which severities are listed.
SEVERITIES = (HIGH, MEDIUM, LOW)
SIZES = (("< 1KB", 1024), ("1KB - 10KB", 10_240), ("10KB - 100KB", 102_400), ("100KB - 1MB", 1_048_576), ("> 1MB", None))
#: ICMP types that quote the packet they answer, and names of types and codes.
ICMP_ERRORS = ("3", "4", "5", "11", "12")
ICMP_NAMES = {
    "0:0": "Echo Reply", "3:0": "Net Unreachable", "3:1": "Host Unreachable", "3:2": "Protocol Unreachable", "3:3": "Port Unreachable", "3:4": "Fragmentation Needed", "3:5": "Source Route Failed", "3:6": "Net Unknown",
    "3:7": "Host Unknown", "3:9": "Net Prohibited", "3:10": "Host Prohibited", "3:13": "Communication Prohibited", "4:0": "Source Quench", "5:0": "Redirect Network", "5:1": "Redirect Host", "8:0": "Echo Request",
    "9:0": "Router Advertisement", "10:0": "Router Solicitation", "11:0": "TTL Exceeded", "11:1": "Fragment Reassembly Timeout", "12:0": "IP Header Error", "13:0": "Timestamp Request", "14:0": "Timestamp Reply",
}
IP_PROTOCOLS = {"1": "ICMP", "6": "TCP", "17": "UDP"}
MQ_COMPLETION = {"0": "Success (MQCC_OK)", "1": "Warning (MQCC_WARNING)", "2": "Failed (MQCC_FAILED)"}
RTCP_NAMES = {"200": "SR (Sender Report)", "201": "RR (Receiver Report)", "202": "SDES (Source Description)", "203": "BYE (Goodbye)", "204": "APP (Application-Defined)"}
STATUS_NAMES = {"2": "Success", "3": "Redirect", "4": "Client Error", "5": "Server Error"}
MANY_REQUESTS, FEW_REQUESTS = 1.2, 0.8
RTP_PORTS = (16_384, 32_767)


def _named(code: Column, names: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), code), otherwise)


def connection(arrow: str = " -> ") -> Column:
    end = lambda s: F.concat(F.col(f"{s}_ip"), F.lit(":"), F.col(f"{s}_port").cast("string"))
    return F.concat(end("src"), F.lit(arrow), end("dst"))


def severity_rank(column: str = "severity") -> Column:
    return F.when(F.col(column) == HIGH, 0).when(F.col(column) == MEDIUM, 1).otherwise(2)


def code_severity(code: str = "code") -> Column:
    """By the first figure: 5 is high, 4 is medium."""
    return severity(F.startswith(F.col(code), F.lit("5")), F.startswith(F.col(code), F.lit("4")))


def numeric_first(code: str = "code") -> Column:
    """Codes in the order of their numbers; those that are none come last."""
    return F.coalesce(F.col(code).try_cast("int"), F.lit(999))


def with_samples(rows: DataFrame, by: Sequence[str], item: Column, n: int = 3) -> DataFrame:
    """(by, samples): ``n`` of the distinct items of each group, evenly spaced in their order, ends included, joined by "; ".

    Places are rounded half to even. Items are made distinct before they are ranked.
    """
    group = Window.partitionBy(*by)
    placed = rows.select(*by, item.alias("_item")).distinct().withColumns({"_place": F.row_number().over(group.orderBy("_item")) - 1, "_n": F.count("*").over(group)})
    wanted = F.array(*(F.bround(k * (F.col("_n") - 1) / max(n - 1, 1), 0).cast("int") for k in range(n)))
    kept = placed.where((F.col("_n") <= n) | F.array_contains(wanted, F.col("_place")))
    return kept.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_item"))), lambda x: x["_item"]), "; ").alias("samples"))


def by_code(rows: DataFrame, by: Sequence[str], rating: Column, samples: bool = True) -> DataFrame:
    """Rows by code with their number, share, distinct connections, severity and sample connections."""
    counted = rows.groupBy(*by).agg(F.count("*").alias("count"), F.count_distinct(connection()).alias("connections"))
    rated = counted.withColumn("share", share()).withColumn("severity", rating)
    return rated.join(with_samples(rows, by, connection()), list(by)) if samples else rated


def highlights(rated: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """The ``n`` most frequent codes that are not low: a top-k report."""
    return rated.where(F.col("severity") != LOW).orderBy(F.desc("count"), *order).limit(n)


def severity_totals(rated: DataFrame) -> DataFrame:
    """How many groups have each severity; all three are listed."""
    out = rated.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    return out.select(F.inline(F.array(*(F.struct(F.lit(s).alias("severity"), F.col(s).alias("groups")) for s in SEVERITIES))))


def top_connections(rows: DataFrame, n: int = 10, arrow: str = " <-> ") -> DataFrame:
    """The ``n`` connections with most messages: a top-k report."""
    return rows.where((F.col("src_ip") != "") & (F.col("dst_ip") != "")).groupBy(connection(arrow).alias("connection")).agg(F.count("*").alias("messages")).orderBy(F.desc("messages"), "connection").limit(n)


def size_ranges(rows: DataFrame, size: str = "frame_len") -> DataFrame:
    """Messages by size, all ranges listed."""
    counted, low = [], None
    for name, high in SIZES:
        inside = F.col(size) >= (low or 0) if high is None else (F.col(size) < high) & (F.lit(True) if low is None else F.col(size) >= low)
        counted.append(F.count_if(inside).alias(name))
        low = high
    out = rows.agg(*counted, F.count("*").alias("_n"))
    pct = lambda name: F.round(F.when(F.col("_n") > 0, 100.0 * F.col(name) / F.col("_n")).otherwise(0.0), 4)
    return out.select(F.inline(F.array(*(F.struct(F.lit(name).alias("range"), F.col(f"`{name}`").alias("count"), pct(f"`{name}`").alias("percent")) for name, _ in SIZES))))


def first_ends() -> list[Column]:
    """Aggregates: the ends that a stream's first packet with both shows."""
    end = lambda s: F.concat(F.col(f"{s}_ip"), F.lit(":"), F.col(f"{s}_port").cast("string"))
    there = lambda s: F.when(F.col(f"{s}_ip") != "", F.col("frame_number"))
    return [F.coalesce(F.min_by(end(s), there(s)), F.lit("Unknown")).alias(s) for s in ("src", "dst")]


# ---- TLS, FTP, ICMP, SIP, SSH ------------------------------------------------------------------


def tls_alerts(rows: DataFrame) -> DataFrame:
    """Alerts by description (column alert)."""
    named = rows.withColumn("alert", F.when(F.col("alert") == "", "Unknown").otherwise(F.col("alert")))
    lower = F.lower("alert")
    return by_code(named, ["alert"], F.when(F.contains(lower, F.lit("fatal")) | F.contains(lower, F.lit(" handshake")), HIGH).otherwise(MEDIUM))


def ftp_responses(rows: DataFrame) -> DataFrame:
    """Responses by code and message; rows without a code are left out."""
    return by_code(rows.where("code <> ''"), ["code", "message"], code_severity())


def icmp_errors(rows: DataFrame) -> DataFrame:
    """Errors by type, code and the flow of the packet they quote (columns type, code, protocol, ends and tcp_ or udp_ ports)."""
    port = lambda s: F.coalesce(F.nullif(f"tcp_{s}_port", F.lit("")), F.nullif(f"udp_{s}_port", F.lit("")))
    kept = rows.where(F.col("type").isin(*ICMP_ERRORS)).withColumns({"_src": port("src"), "_dst": port("dst")}).where("_src IS NOT NULL AND _dst IS NOT NULL")
    protocol = _named(F.col("protocol"), IP_PROTOCOLS, F.concat(F.lit("Proto"), F.col("protocol")))
    keys = [icmp_label().alias("label"), protocol.alias("protocol"), F.concat("src_ip", F.lit(":"), "_src").alias("src"), F.concat("dst_ip", F.lit(":"), "_dst").alias("dst")]
    return kept.groupBy(*keys).agg(F.count("*").alias("count"))


def icmp_info(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("type") != "") & ~F.col("type").isin(*ICMP_ERRORS)).groupBy(icmp_label().alias("label")).agg(F.count("*").alias("count"))


def icmp_label() -> Column:
    """Such as ``[3/1] Host Unreachable``."""
    unknown = F.concat(F.lit("Type "), F.col("type"), F.lit(" Code "), F.col("code"))
    return F.concat(F.lit("["), F.col("type"), F.lit("/"), F.col("code"), F.lit("] "), _named(F.concat_ws(":", "type", "code"), ICMP_NAMES, unknown))


def sip_methods(rows: DataFrame) -> DataFrame:
    return by_code(rows.where("method <> ''"), ["method"], F.lit(LOW)).drop("severity")


def sip_responses(rows: DataFrame) -> DataFrame:
    return by_code(rows.where("code <> ''"), ["code"], code_severity())


def _ssh_severity(version: str) -> Column:
    lower = F.lower(F.coalesce(version, F.lit("")))
    return F.when(F.startswith(lower, F.lit("ssh-1")), HIGH).when(F.startswith(lower, F.lit("ssh-2")), LOW).otherwise(MEDIUM)


def ssh_streams(rows: DataFrame) -> DataFrame:
    """Streams with their packets, ends, first version and severity."""
    version = F.min_by(F.col("version"), F.when(F.col("version") != "", F.col("frame_number")))
    grouped = rows.groupBy("stream_id").agg(F.count("*").alias("packets"), *first_ends(), version.alias("version"))
    return grouped.withColumn("severity", _ssh_severity("version")).withColumn("version", F.coalesce("version", F.lit("Unknown")))


def worst_streams(streams: DataFrame, order: str = "packets", n: int = 5) -> DataFrame:
    """The ``n`` worst streams, then the largest: a top-k report."""
    return streams.orderBy(severity_rank(), F.desc(order), "stream_id").limit(n)


def ssh_versions(streams: DataFrame) -> DataFrame:
    return streams.where("version <> 'Unknown'").groupBy("version").agg(F.count("*").alias("streams"), F.min("severity").alias("severity"))


# ---- message queues ----------------------------------------------------------------------------


def mq_completions(rows: DataFrame) -> DataFrame:
    counted = rows.where("completion <> ''").groupBy("completion").agg(F.count("*").alias("count"))
    rating = F.when(F.col("completion") == "2", HIGH).when(F.col("completion") == "1", MEDIUM).otherwise(LOW)
    return counted.select("completion", "count", _named(F.col("completion"), MQ_COMPLETION, F.lit("Unknown")).alias("description"), rating.alias("severity"))


def mq_reasons(rows: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most frequent reasons: a top-k report."""
    counted = rows.where("reason <> ''").groupBy("reason").agg(F.count("*").alias("count"))
    return counted.withColumn("severity", F.when(F.col("reason") != "0", HIGH).otherwise(LOW)).orderBy(F.desc("count"), "reason").limit(n)


def mq_streams(rows: DataFrame) -> DataFrame:
    errors = F.count_if(~F.col("completion").isin("", "0"))
    grouped = rows.groupBy("stream_id").agg(F.count("*").alias("messages"), F.sum("frame_len").cast("long").alias("bytes"), errors.alias("errors"), *first_ends())
    return grouped.withColumn("severity", F.when(F.col("errors") > 0, HIGH).otherwise(LOW))


# ---- JSON and XML bodies -----------------------------------------------------------------------


def body_summary(rows: DataFrame) -> DataFrame:
    """One row: messages, requests, responses, SOAP messages and sizes (columns method, code, content_type)."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    return rows.agg(
        F.count("*").alias("messages"), F.count_if(F.col("method") != "").alias("requests"), F.count_if(F.col("code") != "").alias("responses"), F.count_if(F.contains(kind, F.lit("soap"))).alias("soap"),
        F.coalesce(F.sum("frame_len"), F.lit(0)).cast("long").alias("bytes"), F.round(F.avg("frame_len"), 4).alias("mean_bytes"),
    )


def body_methods(rows: DataFrame) -> DataFrame:
    return rows.where("method <> ''").groupBy("method").agg(F.count("*").alias("count")).withColumn("share", share())


def body_statuses(rows: DataFrame) -> DataFrame:
    counted = rows.where("code <> ''").groupBy("code").agg(F.count("*").alias("count")).withColumn("share", share())
    return counted.withColumn("status", _named(F.substring("code", 1, 1), STATUS_NAMES, F.lit("Unknown")))


def body_errors(rows: DataFrame) -> DataFrame:
    """Codes of client and server errors with sample messages, two of each, as frame@connection."""
    failed = rows.where(F.substring("code", 1, 1).isin("4", "5"))
    item = F.concat(F.lpad(F.col("frame_number").cast("string"), 12, "0"), F.lit("@"), connection())
    counted = failed.groupBy("code").agg(F.count("*").alias("count")).withColumn("severity", F.when(F.startswith(F.col("code"), F.lit("5")), HIGH).otherwise(MEDIUM))
    return counted.join(with_samples(failed, ["code"], item, 2), "code")


def content_types(rows: DataFrame) -> DataFrame:
    kind = F.trim(F.split_part("content_type", F.lit(";"), F.lit(1)))
    return rows.where("content_type <> ''").groupBy(kind.alias("content_type")).agg(F.count("*").alias("count"))


# ---- MGCP, RTCP, SDP ---------------------------------------------------------------------------


def mgcp_summary(rows: DataFrame) -> DataFrame:
    """One row: requests, responses, their sizes, and what their ratio says (columns is_request, is_response, verb, code)."""
    asked, answered = F.col("is_request") == "True", F.col("is_response") == "True"
    out = rows.agg(
        F.count_if(asked).alias("requests"), F.count_if(answered).alias("responses"), F.count_distinct(F.when(asked & (F.col("verb") != ""), F.col("verb"))).alias("verbs"), F.count_distinct(F.when(answered & (F.col("code") != ""), F.col("code"))).alias("codes"),
        F.round(F.avg(F.when(asked, F.col("frame_len"))), 4).alias("mean_request"), F.round(F.avg(F.when(answered, F.col("frame_len"))), 4).alias("mean_response"),
    )
    ratio = F.when((F.col("requests") > 0) & (F.col("responses") > 0), F.col("requests") / F.col("responses"))
    verdict = F.when(ratio > MANY_REQUESTS, "more requests than responses").when(ratio < FEW_REQUESTS, "more responses than requests").when(ratio.isNotNull(), "balanced")
    return out.withColumns({"ratio": F.round(ratio, 4), "balance": verdict})


def mgcp_verbs(rows: DataFrame) -> DataFrame:
    return by_code(rows.where("is_request = 'True' AND verb <> ''"), ["verb"], F.lit(LOW)).drop("severity")


def mgcp_codes(rows: DataFrame) -> DataFrame:
    coded = by_code(rows.where("is_response = 'True' AND code <> ''"), ["code"], code_severity())
    return coded.withColumn("status", _named(F.substring("code", 1, 1), {k: v for k, v in STATUS_NAMES.items() if k != "3"}, F.lit("Unknown")))


def mgcp_connections(rows: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` connections with most messages: a top-k report."""
    count = lambda c: F.count_if(F.col(c) == "True")
    grouped = rows.groupBy(connection().alias("connection")).agg(count("is_request").alias("requests"), count("is_response").alias("responses"))
    return grouped.where("requests + responses > 0").orderBy(F.desc(F.col("requests") + F.col("responses")), "connection").limit(n)


def _parts(rows: DataFrame, column: str, *keep: Column | str) -> DataFrame:
    return rows.select(*keep, F.explode(F.split(column, ",")).alias("part")).withColumn("part", F.trim("part")).where("part <> ''")


def rtcp_types(rows: DataFrame) -> DataFrame:
    """Packets of compound messages by type (column types)."""
    counted = _parts(rows, "types").groupBy("part").agg(F.count("*").alias("count")).withColumn("share", share())
    return counted.select(F.col("part").alias("type"), _named(F.col("part"), RTCP_NAMES, F.concat(F.lit("Unknown ("), F.col("part"), F.lit(")"))).alias("name"), "count", "share")


def rtcp_streams(rows: DataFrame, n: int = 10, types: int = 3) -> DataFrame:
    """The ``n`` streams with most messages, each with its most frequent types: a top-k report."""
    messages = rows.groupBy(connection().alias("stream")).agg(F.count("*").alias("messages")).orderBy(F.desc("messages"), "stream").limit(n)
    counted = _parts(rows, "types", connection().alias("stream")).groupBy("stream", "part").agg(F.count("*").alias("_n"))
    ranked = counted.withColumn("_k", F.row_number().over(Window.partitionBy("stream").orderBy(F.desc("_n"), "part"))).where(F.col("_k") <= types)
    named = ranked.groupBy("stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "part"))), lambda x: x["part"]), ", ").alias("types"))
    return messages.join(named, "stream", "left")


def sdp_parts(rows: DataFrame, column: str) -> DataFrame:
    """Media, transport protocols or the like by name, with their shares."""
    return _parts(rows, column).groupBy(F.col("part").alias("name")).agg(F.count("*").alias("count")).withColumn("share", share())


def sdp_codecs(rows: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most frequent formats that are no numbers: a top-k report."""
    return _parts(rows, "formats").where(~F.col("part").rlike("^[0-9]+$")).groupBy(F.col("part").alias("codec")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "codec").limit(n)


def sdp_ports(rows: DataFrame) -> DataFrame:
    """One row: ports that are offered, the range they lie in, and those in the range that is meant for media."""
    ports = _parts(rows, "ports").select(F.col("part").try_cast("int").alias("port")).where("port IS NOT NULL AND port <> 0")
    return ports.agg(F.count("*").alias("ports"), F.count_distinct("port").alias("distinct_ports"), F.min("port").alias("least"), F.max("port").alias("most"), F.count_if(F.col("port").between(*RTP_PORTS)).alias("in_media_range"))


def sdp_security(rows: DataFrame) -> DataFrame:
    """One row: offers of secure and of other media transport."""
    secure = F.contains(F.col("part"), F.lit("SAVP"))
    return _parts(rows, "protocols").agg(F.count_if(secure).alias("secure"), F.count_if(~secure & F.contains(F.col("part"), F.lit("AVP"))).alias("not_secure"), F.count("*").alias("offers"))


# ---- DNS ---------------------------------------------------------------------------------------


def dns_counts(rows: DataFrame, kinds: Sequence[str] = ("rcode", "opcode", "qtype", "qclass")) -> DataFrame:
    """Packets by each of several fields, in one pass: kind, value, count and percent of all packets."""
    total = rows.agg(F.count("*").alias("_total"))
    long = rows.select(F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds)))).where("value <> ''")
    return long.groupBy("kind", "value").agg(F.count("*").alias("count")).crossJoin(F.broadcast(total)).select("kind", "value", "count", F.round(100.0 * F.col("count") / F.col("_total"), 4).alias("percent"))


def size_statistics(rows: DataFrame, size: str = "frame_len") -> DataFrame:
    """One row: number, sum, mean and extremes of a size."""
    return rows.agg(F.count("*").alias("count"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.round(F.avg(size), 4).alias("mean"), F.min(size).alias("least"), F.max(size).alias("most"))
