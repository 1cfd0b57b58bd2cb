"""DuckDB SQL shared by the oracles: packet views and connections."""

from __future__ import annotations

from packetloom.sources.testbed import duckdb_view


def connections(view: str, prefix: str) -> str:
    """CTEs ending in ``{prefix}`` with a row per connection of a packet view."""
    p = prefix
    return f"""
{p}_pk AS (SELECT *, (flags & 2) <> 0 AND (flags & 16) = 0 AS syn, (flags & 2) <> 0 AND (flags & 16) <> 0 AS synack FROM {duckdb_view(view)}),
{p}_fp AS (SELECT stream_id, min(frame_number) FILTER (WHERE syn) AS fs, min(frame_number) FILTER (WHERE synack) AS fa FROM {p}_pk GROUP BY 1),
{p}_hs AS (
  SELECT k.stream_id,
         max(frame_number) FILTER (WHERE syn AND frame_number <= CASE WHEN fs IS NOT NULL AND fa IS NOT NULL THEN greatest(fs, fa) ELSE 4611686018427387904 END) AS syn_frame,
         max(frame_number) FILTER (WHERE synack AND frame_number <= CASE WHEN fs IS NOT NULL AND fa IS NOT NULL THEN greatest(fs, fa) ELSE 4611686018427387904 END) AS ack_frame,
         min(frame_number) AS first_frame
  FROM {p}_pk k JOIN {p}_fp f USING (stream_id) GROUP BY 1),
{p}_ro AS (
  SELECT h.stream_id, s.frame_number IS NOT NULL AS with_syn, s.frame_number IS NOT NULL OR a.frame_number IS NOT NULL AS has_syn,
         CASE WHEN s.frame_number IS NOT NULL THEN s.src_ip WHEN a.frame_number IS NOT NULL THEN a.dst_ip ELSE f.src_ip END AS client_ip,
         CASE WHEN s.frame_number IS NOT NULL THEN s.src_port WHEN a.frame_number IS NOT NULL THEN a.dst_port ELSE f.src_port END AS client_port,
         CASE WHEN s.frame_number IS NOT NULL THEN s.dst_ip WHEN a.frame_number IS NOT NULL THEN a.src_ip ELSE f.dst_ip END AS server_ip,
         CASE WHEN s.frame_number IS NOT NULL THEN s.dst_port WHEN a.frame_number IS NOT NULL THEN a.src_port ELSE f.dst_port END AS server_port,
         coalesce(s.options, '') AS syn_options, coalesce(s.seq, 0) AS client_isn, coalesce(a.seq, 0) AS server_isn, coalesce(s.time_ms, a.time_ms, f.time_ms) AS syn_ms,
         CASE WHEN s.frame_number IS NOT NULL THEN s.tsval ELSE f.tsval END AS tsval, CASE WHEN s.frame_number IS NOT NULL THEN s.tsecr ELSE f.tsecr END AS tsecr,
         coalesce(s.ip_id, a.ip_id, f.ip_id) AS first_id, f.protocol AS protocol_number
  FROM {p}_hs h LEFT JOIN {p}_pk s ON s.stream_id = h.stream_id AND s.frame_number = h.syn_frame
       LEFT JOIN {p}_pk a ON a.stream_id = h.stream_id AND a.frame_number = h.ack_frame
       JOIN {p}_pk f ON f.stream_id = h.stream_id AND f.frame_number = h.first_frame),
{p}_en AS (SELECT k.* EXCLUDE (tsval, tsecr, options), r.* EXCLUDE (stream_id), k.src_ip = r.client_ip AS fromc, row_number() OVER (PARTITION BY k.stream_id ORDER BY frame_number) AS place FROM {p}_pk k JOIN {p}_ro r USING (stream_id)),
{p}_tt AS (
  SELECT stream_id, max(CASE WHEN fromc THEN ttl END) AS client_ttl, max(CASE WHEN NOT fromc THEN ttl END) AS server_ttl FROM (
    SELECT stream_id, fromc, ttl FROM (SELECT stream_id, fromc, ttl, count(*) AS n, min(frame_number) AS seen FROM {p}_en WHERE ttl > 0 GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY stream_id, fromc ORDER BY n DESC, seen) = 1) GROUP BY 1),
{p} AS (
  SELECT '{view[-1].upper() if view != "packets" else "A"}' AS capture_id, e.stream_id, any_value(protocol_number) AS protocol_number, any_value(client_ip) AS client_ip, any_value(client_port) AS client_port,
         any_value(server_ip) AS server_ip, any_value(server_port) AS server_port, any_value(has_syn) AS has_syn, any_value(syn_options) AS syn_options,
         any_value(client_isn) AS client_isn, any_value(server_isn) AS server_isn, any_value(syn_ms) AS syn_ms, any_value(tsval) AS tsval, any_value(tsecr) AS tsecr,
         coalesce(md5(unhex(arg_min(payload, frame_number) FILTER (WHERE fromc AND len > 0 AND payload <> ''))), '') AS client_md5,
         coalesce(md5(unhex(arg_min(payload, frame_number) FILTER (WHERE NOT fromc AND len > 0 AND payload <> ''))), '') AS server_md5,
         string_agg((CASE WHEN fromc THEN 'C:' ELSE 'S:' END) || len, ' ' ORDER BY frame_number) FILTER (WHERE place <= 20) AS length_signature,
         bool_and(len = 0) AS header_only,
         coalesce(list_sort(list(DISTINCT ip_id) FILTER (WHERE ip_id <> 0)), [any_value(first_id)]) AS ipids,
         coalesce(list_sort(list(DISTINCT ip_id) FILTER (WHERE ip_id <> 0 AND fromc)), []) AS client_ipids,
         coalesce(list_sort(list(DISTINCT ip_id) FILTER (WHERE ip_id <> 0 AND src_ip = server_ip)), []) AS server_ipids,
         coalesce(any_value(t.client_ttl), 0) AS client_ttl, coalesce(any_value(t.server_ttl), 0) AS server_ttl,
         min(time_ms) AS first_ms, max(time_ms) AS last_ms, count(*) AS packet_count, CAST(sum(frame_len) FILTER (WHERE frame_len > 0) AS BIGINT) AS total_bytes
  FROM {p}_en e LEFT JOIN {p}_tt t USING (stream_id) GROUP BY e.stream_id)"""


BUCKETS = {
    "server": "least(a.client_ip, a.server_ip) = least(b.client_ip, b.server_ip) AND greatest(a.client_ip, a.server_ip) = greatest(b.client_ip, b.server_ip)",
    "port": "a.server_port = b.server_port",
}


def _sum(start: str, parts: list[tuple[str, float]]) -> str:
    """Doubles added in order."""
    out = start
    for condition, points in parts:
        out = f"({out} + CASE WHEN {condition} THEN CAST({points} AS DOUBLE) ELSE 0 END)"
    return out


def pairs(strategy: str = "server", left: str = "ca", right: str = "cb", sources: str | None = None) -> str:
    """Connections of both captures, pairs of a bucket that some score may accept, and all features of a pair as columns."""
    zero = "CAST(0 AS DOUBLE)"
    shape = "'shape(' || printf('%.2f', round_even(shape, 2)) || ')'"
    f_raw = [("opt2 AND opt_eq", 0.25), ("opt2 AND isnc_as_is", 0.12), ("opt2 AND isns_as_is", 0.06), ("ts_eq", 0.10), ("pay AND dc_eq", 0.15), ("pay AND ds_eq", 0.08), ("shape_eq", 0.08), ("true", 0.16)]
    f_avail = [("opt2", 0.25), ("opt2", 0.12), ("opt2", 0.06), ("ts_a OR ts_b", 0.10), ("pay AND dc2", 0.15), ("pay AND ds2", 0.08), ("true", 0.08), ("true", 0.16)]
    m_raw = [("opt2 AND opt_eq", 0.30), ("opt2 AND isnc_as_is", 0.30), ("ts_a AND ts_b AND ts_eq", 0.20), ("ttl2 AND ttl_eq", 0.10), ("shape_eq", 0.10)]
    m_avail = [("opt2", 0.30), ("opt2", 0.30), ("ts_a AND ts_b", 0.20), ("ttl2", 0.10), ("true", 0.10)]
    n_raw = [("opt_eq", 0.30), ("opt1 AND isnc", 0.25), ("opt1 AND isns", 0.10), ("ts_eq", 0.15), ("CASE WHEN dc2 THEN dc_eq ELSE ds_eq END", 0.05), ("shape_eq", 0.10), ("ttl_eq", 0.05)]
    n_avail = [("opt1", 0.30), ("opt1", 0.25), ("opt1", 0.10), ("ts_a OR ts_b", 0.15), ("dc2 OR ds2", 0.05), ("true", 0.10), ("ttl2", 0.05)]
    return f"""{sources or connections("capture_a", "ca") + ", " + connections("capture_b", "cb")},
pair AS (
  SELECT a.stream_id AS id_a, b.stream_id AS id_b, a, b,
         len(list_intersect(list_filter(a.ipids, lambda x: x <> 0), list_filter(b.ipids, lambda x: x <> 0))) AS n,
         least(len(list_filter(a.ipids, lambda x: x <> 0)), len(list_filter(b.ipids, lambda x: x <> 0))) AS least_ids,
         len(list_distinct(list_concat(list_filter(a.ipids, lambda x: x <> 0), list_filter(b.ipids, lambda x: x <> 0)))) AS union_ids,
         len(list_intersect(a.ipids, b.ipids)) AS n_any,
         len(list_intersect(list_distinct(string_split(a.length_signature, ' ')), list_distinct(string_split(b.length_signature, ' '))))
           / len(list_distinct(list_concat(string_split(a.length_signature, ' '), string_split(b.length_signature, ' ')))) AS shape
  FROM {left} a JOIN {right} b ON {BUCKETS[strategy]}
  WHERE a.client_port IN (b.client_port, b.server_port) OR a.server_port IN (b.client_port, b.server_port)),
ev AS (
  SELECT *, a.syn_options <> '' AND b.syn_options <> '' AS opt2, a.syn_options <> '' OR b.syn_options <> '' AS opt1,
         a.syn_options <> '' AND a.syn_options = b.syn_options AS opt_eq,
         a.client_isn <> 0 AND a.client_isn = b.client_isn AS isnc, a.server_isn <> 0 AND a.server_isn = b.server_isn AS isns,
         a.client_isn = b.client_isn AS isnc_as_is, a.server_isn = b.server_isn AS isns_as_is,
         a.tsval <> '' OR a.tsecr <> '' AS ts_a, b.tsval <> '' OR b.tsecr <> '' AS ts_b,
         (a.tsval <> '' AND a.tsval = b.tsval) OR (a.tsecr <> '' AND a.tsecr = b.tsecr AND a.tsecr <> '0') AS ts_eq,
         a.client_md5 <> '' AND b.client_md5 <> '' AS dc2, a.client_md5 <> '' AND a.client_md5 = b.client_md5 AS dc_eq,
         a.server_md5 <> '' AND b.server_md5 <> '' AS ds2, a.server_md5 <> '' AND a.server_md5 = b.server_md5 AS ds_eq,
         NOT (a.header_only OR b.header_only) AS pay, shape >= 0.6 AS shape_eq,
         CASE WHEN least_ids > 0 THEN n / least_ids ELSE 0 END AS share, CASE WHEN union_ids > 0 THEN n / union_ids ELSE 0 END AS jac,
         NOT (a.last_ms < b.first_ms OR b.last_ms < a.first_ms) AS overlap, greatest(a.first_ms, b.first_ms) - least(a.last_ms, b.last_ms) AS gap,
         least(a.packet_count, b.packet_count) <= 3 OR least(a.last_ms - a.first_ms, b.last_ms - b.first_ms) <= 2000 AS micro,
         (a.client_ttl > 0 AND b.client_ttl > 0) OR (a.server_ttl > 0 AND b.server_ttl > 0) AS ttl2,
         (a.client_ttl > 0 AND b.client_ttl > 0 AND abs(a.client_ttl - b.client_ttl) <= 16) OR (a.server_ttl > 0 AND b.server_ttl > 0 AND abs(a.server_ttl - b.server_ttl) <= 16) AS ttl_eq
  FROM pair),
sc AS (
  SELECT *, {_sum(zero, f_raw)} AS f_raw, {_sum(zero, f_avail)} AS f_avail, {_sum(zero, m_raw)} AS m_raw, {_sum(zero, m_avail)} AS m_avail, {_sum(zero, n_raw)} AS n_raw, {_sum(zero, n_avail)} AS n_avail,
         n >= 2 AND share >= 0.5 AS f_ok, n >= 10 AND share >= 0.8 AND jac >= 0.25 AND gap <= 2000 AND NOT (opt2 AND a.client_ip = b.client_ip AND a.client_port <> b.client_port)
           AND NOT ((len(a.client_ipids) > 0 AND len(b.client_ipids) > 0) <> (len(a.server_ipids) > 0 AND len(b.server_ipids) > 0) AND (share < 0.95 OR jac < 0.8)) AS open_gates
  FROM ev WHERE n >= 2 OR (isnc_as_is AND (a.client_isn <> 0 OR (a.syn_options <> '' AND b.syn_options <> ''))) OR (n_any >= 1 AND overlap AND micro)),
sv AS (
  SELECT *, f_ok AND open_gates AS forced, CASE WHEN overlap AND micro AND n_any >= 1 THEN m_raw / m_avail END AS m_score,
         (overlap OR gap <= 60000) AND n_avail >= 0.5 AND (n_raw / n_avail >= 0.85
              OR (micro AND a.client_md5 = '' AND a.server_md5 = '' AND b.client_md5 = '' AND b.server_md5 = '' AND isnc AND n_any >= 2)) AS n_ok
  FROM sc),
tx AS (
  SELECT *, concat_ws(' ', CASE WHEN opt2 AND opt_eq THEN 'synopt' END, CASE WHEN opt2 AND isnc_as_is THEN 'isnC' END, CASE WHEN opt2 AND isns_as_is THEN 'isnS' END, CASE WHEN ts_eq THEN 'ts' END, CASE WHEN pay AND dc_eq THEN 'dataC' END,
           CASE WHEN pay AND ds_eq THEN 'dataS' END, CASE WHEN shape_eq THEN {shape} END,
           CASE WHEN forced THEN 'ipid*' ELSE 'ipid' END || '(n=' || n || ',r=' || printf('%.2f', round_even(share, 2)) || ',j=' || printf('%.2f', round_even(jac, 2)) || ')') AS f_text,
         concat_ws(' ', 'micro', CASE WHEN opt2 AND opt_eq THEN 'synopt' END, CASE WHEN opt2 AND isnc_as_is THEN 'isnC' END, CASE WHEN ts_a AND ts_b AND ts_eq THEN 'ts' END, CASE WHEN ttl2 AND ttl_eq THEN 'ttl' END, CASE WHEN shape_eq THEN {shape} END, 'ipid(1)') AS m_text,
         concat_ws(' ', 'nat2', CASE WHEN opt_eq THEN 'synopt' END, CASE WHEN opt1 AND isnc THEN 'isnC' END, CASE WHEN opt1 AND isns THEN 'isnS' END, CASE WHEN ts_eq THEN 'ts' END,
           CASE WHEN dc2 AND dc_eq THEN 'dataC' WHEN NOT dc2 AND ds_eq THEN 'dataS' END, CASE WHEN shape_eq THEN {shape} END, CASE WHEN ttl_eq THEN 'ttl' END, CASE WHEN n_any > 0 THEN 'ipid(' || n_any || ')' END,
           CASE WHEN n_raw / n_avail < 0.85 THEN 'micro-isnC-ipid' END) AS n_text
  FROM sv)"""


def valid(second_chance: bool, strategy: str = "server", left: str = "ca", right: str = "cb", sources: str | None = None) -> str:
    """CTEs ending in ``va``: valid pairs with their connections, kind, score, force and evidence."""
    return f"""
WITH {pairs(strategy, left, right, sources)},
vm AS (
  SELECT *, n_any >= 2 AND f_ok AND (f_raw / f_avail >= 0.6 OR forced) AS by_f, n_any < 2 AND coalesce(m_score >= 0.8, false) AS by_m, n_ok AND ({str(second_chance).lower()} OR n_any < 2) AS by_n FROM tx),
va AS (
  SELECT id_a, id_b, a, b, CASE WHEN by_f THEN 'features' WHEN by_m THEN 'microflow' ELSE 'handshake' END AS kind,
         round(CASE WHEN by_f THEN f_raw / f_avail WHEN by_m THEN m_score ELSE n_raw / n_avail END, 6) AS score, by_f AND forced AS forced, CASE WHEN by_f THEN f_text WHEN by_m THEN m_text ELSE n_text END AS evidence
  FROM vm WHERE by_f OR by_m OR by_n)"""


def assigned(rounds: int, first: str) -> str:
    """``first`` (a chain of CTEs ending in va) and rounds of mutually best pairs, unrolled, as one union."""
    text, left = first, "va"
    for k in range(rounds):
        text += f""",
r{k} AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY forced DESC, score DESC, id_a, id_b) AS ra, row_number() OVER (PARTITION BY id_b ORDER BY forced DESC, score DESC, id_a, id_b) AS rb FROM {left}),
t{k} AS (SELECT * FROM r{k} WHERE ra = 1 AND rb = 1),
l{k} AS (SELECT * EXCLUDE (ra, rb) FROM r{k} WHERE id_a NOT IN (SELECT id_a FROM t{k}) AND id_b NOT IN (SELECT id_b FROM t{k}))"""
        left = f"l{k}"
    return text + ", best AS (" + " UNION ALL ".join(f"SELECT id_a, id_b, score, forced, kind, evidence FROM t{k}" for k in range(rounds)) + ")"
