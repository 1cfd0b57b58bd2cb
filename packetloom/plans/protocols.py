"""Queries of the per-protocol reports, over packets whose fields are made from their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packetloom.operators import modules as M
from packetloom.operators import protocols as R
from packetloom.sources.testbed import duckdb_view, packet_view

#: Fields that the dissector of each protocol would print, as expressions that Spark and DuckDB read alike.
_PORT = "CAST(src_port AS STRING) AS {0}_src_port, CAST(dst_port AS STRING) AS {0}_dst_port"
_FIELDS = {
    "tls": ("CASE stream_id % 5 WHEN 0 THEN 'Fatal: bad certificate' WHEN 1 THEN 'Warning: close notify' WHEN 2 THEN 'Failed handshake' WHEN 3 THEN 'Unknown CA' ELSE '' END AS alert",),
    "ftp": ("CASE WHEN len = 0 THEN '' ELSE CAST(200 + 100 * (ip_id % 4) + len % 3 AS STRING) END AS code", "CASE WHEN len % 2 = 0 THEN '' ELSE 'message ' || CAST(len % 5 AS STRING) END AS message"),
    "icmp": (
        "CASE WHEN len = 0 THEN '' ELSE CAST(ip_id % 13 AS STRING) END AS type", "CAST(len % 4 AS STRING) AS code", "CASE stream_id % 3 WHEN 0 THEN '6' WHEN 1 THEN '17' ELSE '47' END AS protocol_text",
        "CASE WHEN stream_id % 3 = 0 THEN CAST(src_port AS STRING) ELSE '' END AS tcp_src_port", "CASE WHEN stream_id % 3 = 0 THEN CAST(dst_port AS STRING) ELSE '' END AS tcp_dst_port",
        "CASE WHEN stream_id % 3 = 1 THEN CAST(src_port AS STRING) ELSE '' END AS udp_src_port", "CASE WHEN stream_id % 3 = 1 THEN CAST(dst_port AS STRING) ELSE '' END AS udp_dst_port",
    ),
    "sip": ("CASE WHEN frame_number % 2 = 1 THEN CASE ip_id % 4 WHEN 0 THEN 'INVITE' WHEN 1 THEN 'BYE' WHEN 2 THEN 'ACK' ELSE 'REGISTER' END ELSE '' END AS method", "CASE WHEN frame_number % 2 = 0 THEN CAST(100 * (1 + ip_id % 6) + len % 3 AS STRING) ELSE '' END AS code"),
    "ssh": ("CASE WHEN frame_number <= 2 THEN CASE stream_id % 6 WHEN 0 THEN 'SSH-1.5-old' WHEN 1 THEN '' WHEN 2 THEN 'dropbear' ELSE 'SSH-2.0-x' END ELSE '' END AS version",),
    "mq": ("CASE WHEN len % 3 = 0 THEN '' ELSE CAST(ip_id % 3 AS STRING) END AS completion", "CASE WHEN len % 3 = 0 THEN '' ELSE CAST(CASE WHEN ip_id % 3 = 0 THEN 0 ELSE 2000 + ip_id % 35 END AS STRING) END AS reason", "len * 3000 AS size"),
    "body": (
        "CASE WHEN frame_number % 2 = 1 THEN CASE ip_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END ELSE '' END AS method", "CASE WHEN frame_number % 2 = 0 THEN CAST(100 * (1 + ip_id % 5) + len % 3 AS STRING) ELSE '' END AS code",
        "CASE ip_id % 5 WHEN 0 THEN 'application/json; charset=utf-8' WHEN 1 THEN 'text/xml' WHEN 2 THEN 'application/soap+xml' WHEN 3 THEN 'application/json' ELSE '' END AS content_type", "len * 3000 AS size",
    ),
    "mgcp": ("CASE WHEN ip_id % 3 <> 0 THEN 'True' ELSE '' END AS is_request", "CASE WHEN ip_id % 3 = 0 THEN 'True' ELSE '' END AS is_response", "CASE len % 5 WHEN 0 THEN 'CRCX' WHEN 1 THEN 'MDCX' WHEN 2 THEN 'DLCX' WHEN 3 THEN 'RQNT' ELSE '' END AS verb", "CASE WHEN len % 7 = 0 THEN '' ELSE CAST(100 * (1 + len % 5) AS STRING) END AS code"),
    "rtcp": ("CASE ip_id % 5 WHEN 0 THEN '200,202' WHEN 1 THEN '201' WHEN 2 THEN '201, 202,203' WHEN 3 THEN '207' ELSE '' END AS types",),
    "sdp": (
        "CASE ip_id % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'audio,video' ELSE 'image' END AS media", "CASE ip_id % 4 WHEN 0 THEN 'RTP/AVP' WHEN 1 THEN 'RTP/SAVP, RTP/AVP' ELSE 'udptl' END AS protocols",
        "CASE ip_id % 4 WHEN 0 THEN '0,8,101' WHEN 1 THEN '96, opus' WHEN 2 THEN 't38' ELSE 'g729,PCMU,0' END AS formats", "CAST(ip_id AS STRING) || CASE WHEN len % 2 = 0 THEN ', 0' ELSE ',x' END AS ports",
    ),
    "dns": ("CASE ip_id % 9 WHEN 0 THEN 'NXDOMAIN' WHEN 1 THEN 'SERVFAIL' WHEN 2 THEN '' ELSE 'NOERROR' END AS rcode", "CAST(len % 2 AS STRING) AS opcode", "CASE len % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' ELSE 'MX' END AS qtype", "'IN' AS qclass"),
}
_KEPT = "capture_id, stream_id, frame_number, frame_len, src_ip, src_port, dst_ip, dst_port"


def _columns(name: str) -> list[str]:
    """Expressions of a protocol's rows: the field ``size`` stands for the frame's length, ``protocol_text`` for the protocol."""
    fields = [f.replace("protocol_text", "protocol") for f in _FIELDS[name]]
    size = next((f.split(" AS ")[0] for f in fields if f.endswith(" AS size")), None)
    kept = [f"{size} AS frame_len" if c == "frame_len" and size else c for c in _KEPT.split(", ")]
    return kept + [f for f in fields if not f.endswith(" AS size")]


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return packet_view(spark, sf_dir).selectExpr(*_columns(name))


def _sql(name: str) -> str:
    return f"(SELECT {', '.join(_columns(name)).replace('STRING', 'VARCHAR')} FROM {duckdb_view('packets')})"


_CONNECTION = "src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port"
_BOTH_WAYS = _CONNECTION.replace("->", "<->")
_SHARE = "round(100.0 * count(*) / sum(count(*)) OVER (), 4)"


def _samples(rows: str, by: str, item: str = _CONNECTION, n: int = 3) -> str:
    places = ", ".join(f"CAST(round_even({k} * (n - 1) / {max(n - 1, 1)}, 0) AS BIGINT)" for k in range(n))
    return f"""(SELECT {by}, string_agg(item, '; ' ORDER BY place) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY item) - 1 AS place, count(*) OVER (PARTITION BY {by}) AS n FROM (SELECT DISTINCT {by}, {item} AS item FROM {rows}))
 WHERE n <= {n} OR place IN ({places}) GROUP BY {by})"""


def _by_code(rows: str, by: str, rating: str | None) -> str:
    rated = f", {rating} AS severity" if rating else ""
    return f"SELECT * FROM (SELECT {by}, count(*) AS count, count(DISTINCT {_CONNECTION}) AS connections, {_SHARE} AS share{rated} FROM {rows} GROUP BY {by}) JOIN {_samples(rows, by)} USING ({by})"


def _figure(code: str = "code") -> str:
    return f"CASE WHEN starts_with({code}, '5') THEN 'High' WHEN starts_with({code}, '4') THEN 'Medium' ELSE 'Low' END"


def _case(code: str, names: dict[str, str], otherwise: str) -> str:
    return f"CASE {code} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in names.items())} ELSE {otherwise} END"


def _first_end(s: str) -> str:
    return f"coalesce(arg_min({s}_ip || ':' || {s}_port, frame_number), 'Unknown') AS {'src' if s == 'src' else 'dst'}"


_RANK = "CASE severity WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END"
_where = lambda name, condition: f"(SELECT * FROM {_sql(name)} WHERE {condition})"
_ALERTS = f"(SELECT * REPLACE (CASE WHEN alert = '' THEN 'Unknown' ELSE alert END AS alert) FROM {_sql('tls')})"
_LABEL = f"'[' || type || '/' || code || '] ' || {_case(chr(40) + 'type || chr(58) || code' + chr(41), R.ICMP_NAMES, chr(39) + 'Type ' + chr(39) + ' || type || ' + chr(39) + ' Code ' + chr(39) + ' || code')}"
_SSH_VERSION = "CASE WHEN starts_with(lower(coalesce(v, '')), 'ssh-1') THEN 'High' WHEN starts_with(lower(coalesce(v, '')), 'ssh-2') THEN 'Low' ELSE 'Medium' END"
_SSH = f"SELECT stream_id, packets, src, dst, coalesce(v, 'Unknown') AS version, {_SSH_VERSION} AS severity FROM (SELECT stream_id, count(*) AS packets, {_first_end('src')}, {_first_end('dst')}, arg_min(version, frame_number) FILTER (WHERE version <> '') AS v FROM {_sql('ssh')} GROUP BY 1)"
_MQ_STREAMS = f"SELECT *, CASE WHEN errors > 0 THEN 'High' ELSE 'Low' END AS severity FROM (SELECT stream_id, count(*) AS messages, CAST(sum(frame_len) AS BIGINT) AS bytes, count(*) FILTER (WHERE completion NOT IN ('', '0')) AS errors, {_first_end('src')}, {_first_end('dst')} FROM {_sql('mq')} GROUP BY 1)"
_ranges = [("< 1KB", "frame_len < 1024"), ("1KB - 10KB", "frame_len >= 1024 AND frame_len < 10240"), ("10KB - 100KB", "frame_len >= 10240 AND frame_len < 102400"), ("100KB - 1MB", "frame_len >= 102400 AND frame_len < 1048576"), ("> 1MB", "frame_len >= 1048576")]
_json, _xml = "content_type LIKE '%json%'", "content_type LIKE '%xml%'"


def _parts(rows: str, column: str, keep: str = "") -> str:
    return f"(SELECT * FROM (SELECT {keep} trim(unnest(string_split({column}, ','))) AS part FROM {rows}) WHERE part <> '')"


def _body_queries(kind: str, condition: str) -> dict:
    rows, sql = lambda s, d: _rows(s, d, "body").where(condition), _where("body", condition)
    status = _case("code[1]", R.STATUS_NAMES, "'Unknown'")
    return {
        f"{kind}_summary": (lambda s, d: R.body_summary(rows(s, d)), f"SELECT count(*) AS messages, count(*) FILTER (WHERE method <> '') AS requests, count(*) FILTER (WHERE code <> '') AS responses, count(*) FILTER (WHERE contains(lower(content_type), 'soap')) AS soap, CAST(coalesce(sum(frame_len), 0) AS BIGINT) AS bytes, round(avg(frame_len), 4) AS mean_bytes FROM {sql}"),
        f"{kind}_methods": (lambda s, d: R.body_methods(rows(s, d)), f"SELECT method, count(*) AS count, {_SHARE} AS share FROM {sql} WHERE method <> '' GROUP BY 1"),
        f"{kind}_statuses": (lambda s, d: R.body_statuses(rows(s, d)), f"SELECT code, count(*) AS count, {_SHARE} AS share, {status} AS status FROM {sql} WHERE code <> '' GROUP BY code"),
        f"{kind}_errors": (lambda s, d: R.body_errors(rows(s, d)), f"SELECT * FROM (SELECT code, count(*) AS count, CASE WHEN starts_with(code, '5') THEN 'High' ELSE 'Medium' END AS severity FROM {sql} WHERE code[1] IN ('4', '5') GROUP BY 1) JOIN {_samples(f'(SELECT * FROM {sql} WHERE code[1] IN (4::VARCHAR, 5::VARCHAR))', 'code', f'lpad(CAST(frame_number AS VARCHAR), 12, chr(48)) || chr(64) || {_CONNECTION}', 2)} USING (code)"),
        f"{kind}_sizes": (lambda s, d: R.size_ranges(rows(s, d)), " UNION ALL ".join(f"SELECT '{n}' AS range, count(*) FILTER (WHERE {c}) AS count, round(CASE WHEN count(*) > 0 THEN 100.0 * count(*) FILTER (WHERE {c}) / count(*) ELSE 0 END, 4) AS percent FROM {sql}" for n, c in _ranges)),
        f"{kind}_content_types": (lambda s, d: R.content_types(rows(s, d)), f"SELECT trim(split_part(content_type, ';', 1)) AS content_type, count(*) AS count FROM {sql} WHERE content_type <> '' GROUP BY 1"),
        f"{kind}_connections": (lambda s, d: R.top_connections(rows(s, d)), f"SELECT {_BOTH_WAYS} AS connection, count(*) AS messages FROM {sql} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    }


def _codes(name: str, function, condition: str, by: str, rating: str | None):
    return (lambda s, d: function(_rows(s, d, name)), _by_code(_where(name, condition) if condition else _sql(name), by, rating))


_FTP_SQL = _by_code(_where("ftp", "code <> ''"), "code, message", _figure())
_TABLE = {
    "tls_alerts": (lambda s, d: R.tls_alerts(_rows(s, d, "tls")), _by_code(_ALERTS, "alert", "CASE WHEN contains(lower(alert), 'fatal') OR contains(lower(alert), ' handshake') THEN 'High' ELSE 'Medium' END")),
    "ftp_responses": (lambda s, d: R.ftp_responses(_rows(s, d, "ftp")), _FTP_SQL),
    "ftp_highlights": (lambda s, d: R.highlights(R.ftp_responses(_rows(s, d, "ftp")), ["code", "message"]), f"SELECT * FROM ({_FTP_SQL}) WHERE severity <> 'Low' ORDER BY count DESC, code, message LIMIT 3"),
    "icmp_errors": (lambda s, d: R.icmp_errors(_rows(s, d, "icmp")), f"""
SELECT {_LABEL} AS label, {_case("protocol", R.IP_PROTOCOLS, "'Proto' || protocol")} AS protocol, src_ip || ':' || sp AS src, dst_ip || ':' || dp AS dst, count(*) AS count
FROM (SELECT *, coalesce(nullif(tcp_src_port, ''), nullif(udp_src_port, '')) AS sp, coalesce(nullif(tcp_dst_port, ''), nullif(udp_dst_port, '')) AS dp FROM {_where("icmp", "type IN ('3', '4', '5', '11', '12')")}) WHERE sp IS NOT NULL AND dp IS NOT NULL GROUP BY 1, 2, 3, 4"""),
    "icmp_info": (lambda s, d: R.icmp_info(_rows(s, d, "icmp")), f"SELECT {_LABEL} AS label, count(*) AS count FROM {_where('icmp', 'type NOT IN (chr(51), chr(52), chr(53), 11::VARCHAR, 12::VARCHAR) AND length(type) > 0')} GROUP BY 1"),
    "sip_methods": _codes("sip", R.sip_methods, "method <> ''", "method", None),
    "sip_responses": _codes("sip", R.sip_responses, "code <> ''", "code", _figure()),
    "ssh_streams": (lambda s, d: R.ssh_streams(_rows(s, d, "ssh")), _SSH),
    "ssh_worst": (lambda s, d: R.worst_streams(R.ssh_streams(_rows(s, d, "ssh"))), f"SELECT * FROM ({_SSH}) ORDER BY {_RANK}, packets DESC, stream_id LIMIT 5"),
    "ssh_versions": (lambda s, d: R.ssh_versions(R.ssh_streams(_rows(s, d, "ssh"))), f"SELECT version, count(*) AS streams, min(severity) AS severity FROM ({_SSH}) WHERE version <> 'Unknown' GROUP BY 1"),
    "ssh_severities": (lambda s, d: R.severity_totals(R.ssh_streams(_rows(s, d, "ssh"))), f"SELECT x.s AS severity, count(y.severity) AS groups FROM (SELECT unnest(['High', 'Medium', 'Low']) AS s) x LEFT JOIN ({_SSH}) y ON x.s = y.severity GROUP BY 1"),
    "mq_completions": (lambda s, d: R.mq_completions(_rows(s, d, "mq")), f"SELECT completion, count(*) AS count, {_case('completion', R.MQ_COMPLETION, chr(39) + 'Unknown' + chr(39))} AS description, CASE completion WHEN '2' THEN 'High' WHEN '1' THEN 'Medium' ELSE 'Low' END AS severity FROM {_where('mq', 'length(completion) > 0')} GROUP BY completion"),
    "mq_reasons": (lambda s, d: R.mq_reasons(_rows(s, d, "mq")), f"SELECT reason, count(*) AS count, CASE WHEN reason <> '0' THEN 'High' ELSE 'Low' END AS severity FROM {_where('mq', 'length(reason) > 0')} GROUP BY reason ORDER BY 2 DESC, 1 LIMIT 5"),
    "mq_streams": (lambda s, d: R.mq_streams(_rows(s, d, "mq")), _MQ_STREAMS),
    **_body_queries("json", _json),
    **_body_queries("xml", _xml),
    "mgcp_summary": (lambda s, d: R.mgcp_summary(_rows(s, d, "mgcp")), f"""
SELECT *, round(CASE WHEN requests > 0 AND responses > 0 THEN requests / responses END, 4) AS ratio, CASE WHEN requests = 0 OR responses = 0 THEN NULL WHEN requests / responses > 1.2 THEN 'more requests than responses' WHEN requests / responses < 0.8 THEN 'more responses than requests' ELSE 'balanced' END AS balance
FROM (SELECT count(*) FILTER (WHERE is_request = 'True') AS requests, count(*) FILTER (WHERE is_response = 'True') AS responses, count(DISTINCT CASE WHEN is_request = 'True' AND verb <> '' THEN verb END) AS verbs, count(DISTINCT CASE WHEN is_response = 'True' AND code <> '' THEN code END) AS codes,
  round(avg(frame_len) FILTER (WHERE is_request = 'True'), 4) AS mean_request, round(avg(frame_len) FILTER (WHERE is_response = 'True'), 4) AS mean_response FROM {_sql("mgcp")})"""),
    "mgcp_verbs": _codes("mgcp", R.mgcp_verbs, "is_request = 'True' AND verb <> ''", "verb", None),
    "mgcp_codes": (lambda s, d: R.mgcp_codes(_rows(s, d, "mgcp")), f"SELECT *, CASE code[1] WHEN '2' THEN 'Success' WHEN '4' THEN 'Client Error' WHEN '5' THEN 'Server Error' ELSE 'Unknown' END AS status FROM ({_by_code(_where('mgcp', 'length(is_response) > 0 AND length(code) > 0'), 'code', _figure())})"),
    "mgcp_connections": (lambda s, d: R.mgcp_connections(_rows(s, d, "mgcp")), f"SELECT {_CONNECTION} AS connection, count(*) FILTER (WHERE is_request = 'True') AS requests, count(*) FILTER (WHERE is_response = 'True') AS responses FROM {_sql('mgcp')} GROUP BY 1 ORDER BY 2 + 3 DESC, 1 LIMIT 10".replace("ORDER BY 2 + 3", "ORDER BY count(*)")),
    "rtcp_types": (lambda s, d: R.rtcp_types(_rows(s, d, "rtcp")), f"SELECT part AS type, {_case('part', R.RTCP_NAMES, chr(39) + 'Unknown (' + chr(39) + ' || part || chr(41)')} AS name, count(*) AS count, {_SHARE} AS share FROM {_parts(_sql('rtcp'), 'types')} GROUP BY part"),
    "rtcp_streams": (lambda s, d: R.rtcp_streams(_rows(s, d, "rtcp")), f"""
WITH m AS (SELECT {_CONNECTION} AS stream, count(*) AS messages FROM {_sql("rtcp")} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
p AS (SELECT stream, part, row_number() OVER (PARTITION BY stream ORDER BY count(*) DESC, part) AS k FROM {_parts(_sql("rtcp"), "types", _CONNECTION + " AS stream,")} GROUP BY 1, 2)
SELECT m.stream, messages, types FROM m LEFT JOIN (SELECT stream, string_agg(part, ', ' ORDER BY k) AS types FROM p WHERE k <= 3 GROUP BY 1) t USING (stream)"""),
    "sdp_media": (lambda s, d: R.sdp_parts(_rows(s, d, "sdp"), "media"), f"SELECT part AS name, count(*) AS count, {_SHARE} AS share FROM {_parts(_sql('sdp'), 'media')} GROUP BY 1"),
    "sdp_protocols": (lambda s, d: R.sdp_parts(_rows(s, d, "sdp"), "protocols"), f"SELECT part AS name, count(*) AS count, {_SHARE} AS share FROM {_parts(_sql('sdp'), 'protocols')} GROUP BY 1"),
    "sdp_codecs": (lambda s, d: R.sdp_codecs(_rows(s, d, "sdp")), f"SELECT part AS codec, count(*) AS count FROM {_parts(_sql('sdp'), 'formats')} WHERE NOT regexp_matches(part, '^[0-9]+$') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"),
    "sdp_ports": (lambda s, d: R.sdp_ports(_rows(s, d, "sdp")), f"SELECT count(*) AS ports, count(DISTINCT p) AS distinct_ports, min(p) AS least, max(p) AS most, count(*) FILTER (WHERE p BETWEEN 16384 AND 32767) AS in_media_range FROM (SELECT TRY_CAST(part AS INT) AS p FROM {_parts(_sql('sdp'), 'ports')}) WHERE p IS NOT NULL AND p <> 0"),
    "sdp_security": (lambda s, d: R.sdp_security(_rows(s, d, "sdp")), f"SELECT count(*) FILTER (WHERE contains(part, 'SAVP')) AS secure, count(*) FILTER (WHERE contains(part, 'AVP') AND NOT contains(part, 'SAVP')) AS not_secure, count(*) AS offers FROM {_parts(_sql('sdp'), 'protocols')}"),
    "dns_counts": (lambda s, d: R.dns_counts(_rows(s, d, "dns")), " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS value, count(*) AS count, round(100.0 * count(*) / (SELECT count(*) FROM {_sql('dns')}), 4) AS percent FROM {_sql('dns')} WHERE {k} <> '' GROUP BY 2" for k in ("rcode", "opcode", "qtype", "qclass"))),
    "dns_sizes": (lambda s, d: R.size_statistics(_rows(s, d, "dns")), f"SELECT count(*) AS count, CAST(sum(frame_len) AS BIGINT) AS bytes, round(avg(frame_len), 4) AS mean, min(frame_len) AS least, max(frame_len) AS most FROM {_sql('dns')}"),
}


# ---- voice -------------------------------------------------------------------------------------

_RTP = ("src_ip", "src_port", "dst_ip", "dst_port", "stream_id AS ssrc", "frame_number", "time_ms", "frame_number + stream_id % 2 * (frame_number // 4) AS media_seq", "frame_number * 160 AS media_time")
#: Spark's streams have 16-bit numbers and wrap, the SQL's do not.
_RTP_SPARK = tuple(x.replace("frame_number // 4", "frame_number DIV 4").replace("frame_number + stream_id % 2 *", "(65533 + frame_number + stream_id % 2 *").replace(" AS media_seq", ") % 65536 AS media_seq") for x in _RTP)
_KEY = "src_ip, src_port, dst_ip, dst_port, ssrc"


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rtp_streams(packet_view(spark, sf_dir, "capture_a").selectExpr(*_RTP_SPARK))


_RTP_SQL = f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT *, time_ms - media_time * 1000.0::DOUBLE / 8000 AS t FROM (SELECT {", ".join(_RTP)} FROM {duckdb_view("capture_a")})),
d AS MATERIALIZED (SELECT *, abs(t - lag(t) OVER w) AS d, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY {_KEY} ORDER BY frame_number)),
f AS (SELECT {_KEY}, k, 0.0::DOUBLE AS j FROM d WHERE k = 1 UNION ALL SELECT d.src_ip, d.src_port, d.dst_ip, d.dst_port, d.ssrc, d.k, f.j + (d.d - f.j) / 16 FROM f JOIN d ON d.src_ip = f.src_ip AND d.src_port = f.src_port AND d.dst_ip = f.dst_ip AND d.dst_port = f.dst_port AND d.ssrc = f.ssrc AND d.k = f.k + 1),
j AS (SELECT {_KEY}, avg(j) AS jm, max(j) AS jx FROM f GROUP BY ALL),
g AS (SELECT {_KEY}, count(*) AS packets, max(media_seq) - min(media_seq) + 1 AS expected FROM d GROUP BY ALL),
s AS (SELECT {_KEY}, packets, expected, greatest(0, expected - packets) AS lost, round(100.0::DOUBLE * greatest(0, expected - packets) / expected, 4) AS loss, round(jm + {M.HALF_UP}::DOUBLE, 5) AS jitter, round(jx + {M.HALF_UP}::DOUBLE, 5) AS max_jitter FROM g JOIN j USING ({_KEY})),
r AS (SELECT *, CASE WHEN loss > 5 OR jitter > 30 OR max_jitter > 50 THEN 'High' WHEN loss > 1 OR jitter > 20 THEN 'Medium' ELSE 'Low' END AS severity FROM s)"""
_CODEC = "CASE ssrc % 4 WHEN 0 THEN 'G729' WHEN 1 THEN 'opus' WHEN 2 THEN 'g711U' ELSE 'other' END AS codec"


def rtp_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streams(spark, sf_dir)


def rtp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rtp_summary(_streams(spark, sf_dir))


_RTP_SUMMARY_SQL = _RTP_SQL + " SELECT count(*) AS streams, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(lost) AS BIGINT) AS lost, max(max_jitter) AS peak_jitter, count(*) FILTER (WHERE severity = 'High') AS high, count(*) FILTER (WHERE severity = 'Medium') AS medium, count(*) FILTER (WHERE severity = 'Low') AS low, round(100.0::DOUBLE * sum(lost) / sum(packets), 4) AS loss FROM r"


def rtp_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.worst_streams(_streams(spark, sf_dir).withColumnRenamed("ssrc", "stream_id"), "packets")


_RTP_WORST_SQL = _RTP_SQL + f" SELECT * RENAME (ssrc AS stream_id) FROM r ORDER BY {_RANK}, packets DESC, ssrc LIMIT 5"


def voice_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.voice_quality(_streams(spark, sf_dir).selectExpr("src_ip", "src_port", "ssrc", "loss", "jitter", _CODEC))


_VOICE_SQL = _RTP_SQL + f""",
b AS (SELECT src_ip, src_port, ssrc, loss, jitter, {_CODEC} FROM r),
c AS (SELECT *, greatest(0, least(100, CASE lower(codec) WHEN 'g711u' THEN 93.2::DOUBLE WHEN 'g729' THEN 83 WHEN 'opus' THEN 92 ELSE 93.2::DOUBLE END - (10 + 40 * loss / 100)
        - CASE WHEN jitter < 20 THEN 0 WHEN jitter < 50 THEN (jitter - 20) * 0.5::DOUBLE WHEN jitter < 100 THEN 15 + (jitter - 50) * 0.8::DOUBLE ELSE 55 + (jitter - 100) END)) AS rf FROM b),
m AS (SELECT *, greatest(1, least(5, CASE WHEN rf <= 0 THEN 1 WHEN rf >= 100 THEN 4.5 ELSE 1 + 0.035::DOUBLE * rf + rf * (rf - 60) * (100 - rf) * 7e-6::DOUBLE END)) AS mo FROM c)
SELECT src_ip, src_port, ssrc, loss, jitter, codec, round(rf, 4) AS r_factor, round(mo, 4) AS mos, CASE WHEN mo >= 4.3::DOUBLE THEN 'Excellent' WHEN mo >= 4 THEN 'Good' WHEN mo >= 3.6::DOUBLE THEN 'Fair' WHEN mo >= 3.1::DOUBLE THEN 'Poor' ELSE 'Bad' END AS rating FROM m"""

QUERIES = {name: query for name, (query, _) in _TABLE.items()} | {f.__name__: f for f in (rtp_streams, rtp_summary, rtp_worst, voice_quality)}
ORACLES = {name: text for name, (_, text) in _TABLE.items()} | {"rtp_streams": _RTP_SQL + " SELECT * FROM r", "rtp_summary": _RTP_SUMMARY_SQL, "rtp_worst": _RTP_WORST_SQL, "voice_quality": _VOICE_SQL}
