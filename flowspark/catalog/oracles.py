"""SQL counterparts of the registered queries, for DuckDB, written independently of the plans:
distinct counts over RANGE frames, plain list aggregates, and direct comparisons."""

from __future__ import annotations

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

EVENT_FLOWS = """
flows AS (
  SELECT event_id AS seq, epoch_us(ts) AS ts_us, ts,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
         CASE event_type WHEN 'click' THEN '192.168.1.10' WHEN 'view' THEN '192.168.1.20'
              WHEN 'error' THEN '192.0.2.66' WHEN 'signup' THEN '198.51.100.130'
              WHEN 'purchase' THEN '93.184.216.34' END AS dst_ip,
         CAST(49152 + event_id % 16384 AS INTEGER) AS src_port,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS dst_port,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 < 7 THEN 'TCP'
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 < 9 THEN 'UDP' ELSE 'ICMP' END AS protocol,
         CAST(round(value * 100) AS BIGINT) AS packet_length
  FROM events)"""

LINE_FLOWS = """
flows AS (
  SELECT epoch_us(l_shipdate) AS ts_us, '10.1.0.' || l_suppkey AS src_ip,
         '192.168.2.' || (l_partkey % 4) AS dst_ip, CAST(l_partkey % 1024 AS INTEGER) AS dst_port,
         CAST(round(l_extendedprice) AS BIGINT) AS packet_length
  FROM lineitem)"""


def incident_ctes(keys: str, window_us: int, over: int, value: str | None, rows: str = "flows") -> str:
    metric = f"COUNT(DISTINCT {value})" if value else "COUNT(*)"
    return f"""
metric AS (
  SELECT DISTINCT {keys}, ts_us, m, left_us FROM (
    SELECT {keys}, ts_us, {metric} OVER w AS m, MIN(ts_us) OVER w AS left_us FROM {rows}
    WINDOW w AS (PARTITION BY {keys} ORDER BY ts_us RANGE BETWEEN {window_us} PRECEDING AND CURRENT ROW))
  WHERE m > {over}),
breaks AS (
  SELECT *, LAG(ts_us) OVER (PARTITION BY {keys} ORDER BY ts_us) AS prev FROM metric),
numbered AS (
  SELECT *, SUM(CASE WHEN prev IS NULL OR left_us - prev > {window_us} THEN 1 ELSE 0 END)
            OVER (PARTITION BY {keys} ORDER BY ts_us) AS inc FROM breaks),
inc AS (
  SELECT {keys}, MIN(left_us) AS start_us, MAX(ts_us) AS end_us, MAX(m) AS peak FROM numbered GROUP BY {keys}, inc),
inc_rows AS (
  SELECT inc.*, r.* EXCLUDE ({keys}) FROM inc JOIN {rows} r USING ({keys})
  WHERE r.ts_us BETWEEN inc.start_us AND inc.end_us)"""


def scan_sql(flows: str, window_us: int, over: int, high: int) -> str:
    keys = "src_ip, dst_ip"
    return f"""WITH {flows}, {incident_ctes(keys, window_us, over, 'dst_port')}
SELECT src_ip, dst_ip, start_us, end_us, CAST(peak AS BIGINT) AS peak, COUNT(DISTINCT dst_port) AS unique_ports,
       COUNT(*) AS events,
       array_to_string(list_slice(list_sort(list(DISTINCT dst_port)), 1, 20), ',') AS sample_ports,
       CASE WHEN COUNT(DISTINCT dst_port) >= {high} THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM inc_rows GROUP BY ALL"""


def brute_sql(flows: str, window_us: int, over: int, high: int, where: str = "TRUE") -> str:
    keys = "src_ip, dst_ip, dst_port"
    return f"""WITH {flows}, picked AS (SELECT * FROM flows WHERE {where}), {incident_ctes(keys, window_us, over, None, 'picked')}
SELECT src_ip, dst_ip, dst_port, start_us, end_us, CAST(peak AS BIGINT) AS peak, COUNT(*) AS connections,
       CASE WHEN peak >= {high} THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM inc_rows GROUP BY src_ip, dst_ip, dst_port, start_us, end_us, peak"""


DNS_PORTS = "dst_port IN (10, 20, 30, 40, 50, 53)"
DNS_SQL = f"""WITH {EVENT_FLOWS}, picked AS (SELECT * FROM flows WHERE {DNS_PORTS}),
{incident_ctes('src_ip', 72 * HOUR_US, 2, None, 'picked')}
SELECT src_ip, start_us, end_us, CAST(peak AS BIGINT) AS peak, COUNT(*) AS queries,
       CAST(SUM(packet_length) AS BIGINT) AS total_bytes,
       array_to_string(list_slice(list_sort(list(DISTINCT dst_ip)), 1, 20), ',') AS resolvers,
       COUNT(DISTINCT dst_ip) AS resolvers_count, round(SUM(packet_length) / COUNT(*), 1) AS avg_query_bytes,
       CASE WHEN peak > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM inc_rows GROUP BY src_ip, start_us, end_us, peak"""


def alert_select(kind: str, label: str, source: str, dest: str, first: str, last: str, description: str,
                 frm: str, method: str = "Rule") -> str:
    return f"""SELECT {first} AS timestamp_us, '{kind}' AS alert_type, severity,
       CAST(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS INTEGER) AS severity_rank,
       '{method}' AS method, '{label}' AS label, {source} AS source_ip, {dest} AS dest_ip,
       {description} AS description, {last} AS last_seen_us FROM {frm}"""


PEER = "CASE WHEN {n} = 1 THEN {one} ELSE {n} || ' hosts' END"
#: Seconds to a tenth; half a tenth goes up, as the microseconds say and not their nearest double.
SECS = "(((end_us - start_us + 50000) // 1000000) || '.' || (((end_us - start_us + 50000) // 100000) % 10))"

SCAN_ALERT = alert_select(
    "PORT_SCAN", "Port scan", "src_ip", "dst_ip", "start_us", "end_us",
    f"'Port scan: ' || unique_ports || ' unique ports probed in ' || {SECS} || 's (threshold >3 in 259200s)'",
    f"({scan_sql(EVENT_FLOWS, 72 * HOUR_US, 3, 5)})")
BRUTE_ALERT = alert_select(
    "BRUTE_FORCE", "Brute force", "src_ip", "dst_ip", "start_us", "end_us",
    f"'Brute force on port ' || dst_port || ': ' || connections || ' connections in ' || {SECS} || 's (peak ' || peak "
    "|| ' in 5.184e+06s, threshold >1)'",
    f"({brute_sql(LINE_FLOWS, 60 * DAY_US, 1, 3)})")
DNS_ALERT = alert_select(
    "DNS_TUNNELING", "DNS tunneling", "src_ip", PEER.format(n="resolvers_count", one="resolvers"), "start_us", "end_us",
    f"'Possible DNS tunneling: ' || queries || ' DNS queries in ' || {SECS} || 's (peak ' || peak "
    "|| ' in 259200s, threshold >2)'", f"({DNS_SQL})")

BEACON_CTES = f"""{EVENT_FLOWS},
gaps AS (SELECT *, ts_us - LAG(ts_us) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us, seq) AS g FROM flows),
kept AS (SELECT * FROM gaps WHERE g IS NULL OR g >= {HOUR_US}),
steps AS (SELECT src_ip, dst_ip, (ts_us - LAG(ts_us) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us)) / 1e6 AS step FROM kept),
stats AS (SELECT src_ip, dst_ip, COUNT(*) AS connections, avg(step) AS mean_s, stddev_pop(step) AS std_s,
                 min(step) AS min_s, max(step) AS max_s FROM steps GROUP BY src_ip, dst_ip HAVING COUNT(*) > 10),
seen AS (SELECT src_ip, dst_ip, MIN(ts_us) AS first_us, MAX(ts_us) AS last_us,
                array_to_string(list_slice(list_sort(list(DISTINCT dst_port)), 1, 10), ',') AS dst_ports,
                '[' || array_to_string(list_slice(list_sort(list(DISTINCT dst_port)), 1, 5), ', ') || ']' AS shown_ports
         FROM flows GROUP BY src_ip, dst_ip),
beacons AS (SELECT *, CASE WHEN std_s < 120000 AND connections >= 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
            FROM stats JOIN seen USING (src_ip, dst_ip) WHERE mean_s >= 5 AND std_s < 155000)"""


def off_sql(outside: str, over: int, high: int) -> str:
    return f"""WITH {EVENT_FLOWS},
off AS (SELECT * FROM flows WHERE {outside}),
busy AS (SELECT src_ip, COUNT(*) AS connections, CAST(SUM(packet_length) AS BIGINT) AS total_bytes, MIN(ts_us) AS first_us,
                MAX(ts_us) AS last_us, COUNT(DISTINCT dst_ip) AS destinations_count,
                array_to_string(list_slice(list_sort(list(DISTINCT dst_ip)), 1, 20), ',') AS destinations
         FROM off GROUP BY src_ip HAVING COUNT(*) > {over}),
hits AS (SELECT src_ip, dst_port, COUNT(*) AS n FROM off GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY n DESC, dst_port) AS r FROM hits QUALIFY r <= 5),
tops AS (SELECT src_ip, string_agg(CAST(dst_port AS VARCHAR), ',' ORDER BY r) AS top_ports,
                string_agg(CAST(n AS VARCHAR), ',' ORDER BY r) AS top_hits FROM top GROUP BY src_ip)
SELECT src_ip, connections, total_bytes, first_us, last_us, destinations_count,
       CASE WHEN connections > {high} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, destinations, top_ports, top_hits
FROM busy JOIN tops USING (src_ip)"""


OFF_SQL = off_sql("(hour(ts) < 6 OR hour(ts) >= 22)", 25, 40)
OFF_ALERT = alert_select(
    "TIME_OF_DAY_ANOMALY", "Off-hours activity", "src_ip", PEER.format(n="destinations_count", one="destinations"),
    "first_us", "last_us", "'Off-hours activity: ' || connections || ' connections during 22:00-06:00 to ' "
    "|| destinations_count || ' destination(s) (threshold >25)'", f"({OFF_SQL})")

# Feed lines made from suppliers, as in the inputs; networks as (number, prefix).
FEEDS = """
lines AS (
  SELECT 'feed_' || (s_suppkey % 2) AS source, CAST(s_suppkey % 2 AS INTEGER) AS feed_ord, s_suppkey AS ord,
         CASE WHEN s_suppkey % 11 = 0 OR s_suppkey % 13 = 0 OR s_suppkey % 17 = 0 OR s_suppkey % 19 = 0
                   OR s_suppkey % 23 = 0 THEN NULL
              WHEN s_suppkey % 5 = 0 THEN 28 + s_nationkey % 4 ELSE 32 END AS prefix,
         167772160 + s_suppkey % 256 AS addr
  FROM supplier),
nets AS (
  SELECT source, feed_ord, ord, CAST(prefix AS INTEGER) AS prefix,
         addr - addr % CAST(1 << (32 - prefix) AS BIGINT) AS lo FROM lines WHERE prefix IS NOT NULL),
feed AS (
  SELECT source, feed_ord, ord, prefix, lo, lo + CAST(1 << (32 - prefix) AS BIGINT) - 1 AS hi,
         '10.0.0.' || (lo % 256) || '/' || prefix AS entry FROM nets),
merged AS (
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY feed_ord, ord) AS r FROM feed)
  WHERE r = 1 AND entry NOT IN ('10.0.0.1/32', '10.0.0.2/32'))"""


def listed_ctes(static: list[tuple[str, int, int]], feed: bool = True) -> str:
    """``hosts``: listed addresses among the flows' endpoints, by integer bounds."""
    fixed = ", ".join(f"('{e}', {lo}, {hi}, {i})" for i, (e, lo, hi) in enumerate(static))
    feeds = """UNION ALL SELECT lo, hi, 1, prefix <> 32, CAST(feed_ord AS BIGINT) * 1000000000 + ord, source FROM merged""" if feed else ""
    return f"""
ips AS (SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows),
numbered_ips AS (
  SELECT ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
           + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS n FROM ips),
fixed(entry, lo, hi, ord) AS (VALUES {fixed}),
entries AS (SELECT lo, hi, 0 AS kind, lo <> hi AS net, CAST(ord AS BIGINT) AS ord, 'static' AS source FROM fixed {feeds}),
hosts AS (
  SELECT ip, kind = 0 AS static_hit, source FROM (
    SELECT ip, kind, source, row_number() OVER (PARTITION BY ip ORDER BY kind, net, ord) AS r
    FROM numbered_ips JOIN entries ON n BETWEEN lo AND hi) WHERE r = 1),
hit_rows AS (
  SELECT f.*, d.ip IS NOT NULL AS outbound,
         CASE WHEN d.ip IS NOT NULL THEN f.dst_ip ELSE f.src_ip END AS bad_ip,
         CASE WHEN d.ip IS NOT NULL THEN f.src_ip ELSE f.dst_ip END AS peer_ip,
         CASE WHEN d.ip IS NOT NULL THEN d.static_hit ELSE s.static_hit END AS static_hit,
         CASE WHEN d.ip IS NOT NULL THEN d.source ELSE s.source END AS source
  FROM flows f LEFT JOIN hosts d ON f.dst_ip = d.ip LEFT JOIN hosts s ON f.src_ip = s.ip
  WHERE d.ip IS NOT NULL OR s.ip IS NOT NULL)"""


STATIC = [("192.0.2.66/32", 3221226050, 3221226050), ("192.0.2.99/32", 3221226083, 3221226083),
          ("203.0.113.200/32", 3405803976, 3405803976), ("198.51.100.128/28", 3325256832, 3325256847)]

GROUPS = """SELECT bad_ip, outbound, any_value(static_hit) AS static_hit, any_value(source) AS source, COUNT(*) AS events,
       CAST(SUM(packet_length) AS BIGINT) AS total_bytes, MIN(ts_us) AS first_us, MAX(ts_us) AS last_us,
       array_to_string(list_sort(list(DISTINCT dst_port)), ',') AS dst_ports, COUNT(DISTINCT peer_ip) AS peers_count,
       array_to_string(list_slice(list_sort(list(DISTINCT peer_ip)), 1, 20), ',') AS peers,
       CASE WHEN outbound THEN 'HIGH' ELSE 'MEDIUM' END AS severity {extra}
FROM hit_rows GROUP BY bad_ip, outbound"""
FIVE = ", '[' || array_to_string(list_slice(list_sort(list(DISTINCT dst_port)), 1, 5), ', ') || ']' AS five"
ALL_LISTED = f"WITH {EVENT_FLOWS}, {FEEDS}, {listed_ctes(STATIC)}"
_PEERS = PEER.format(n="peers_count", one="peers")
LIST_ALERT = f"""SELECT first_us AS timestamp_us,
       CASE WHEN static_hit THEN 'BLACKLISTED_IP' ELSE 'THREAT_INTEL_HIT' END AS alert_type, severity,
       CAST(CASE WHEN outbound THEN 3 ELSE 2 END AS INTEGER) AS severity_rank, 'Rule' AS method,
       CASE WHEN static_hit THEN 'Blacklisted IP' ELSE 'Threat intel hit' END AS label,
       CASE WHEN outbound THEN {_PEERS} ELSE bad_ip END AS source_ip,
       CASE WHEN outbound THEN bad_ip ELSE {_PEERS} END AS dest_ip,
       CASE WHEN outbound THEN 'Outbound connections to' ELSE 'Inbound traffic from' END
       || CASE WHEN static_hit THEN ' blacklisted host ' || bad_ip
               ELSE ' host ' || bad_ip || ' listed in threat feed ''' || source || '''' END
       || ': ' || events || ' events, ' || peers_count || ' internal peer(s), dst ports ' || five AS description,
       last_us AS last_seen_us
FROM ({ALL_LISTED} {GROUPS.format(extra=FIVE)})"""

FEATURES = f"""{EVENT_FLOWS},
feats AS (
  SELECT *, COUNT(*) OVER s AS src_conn_freq, CAST(SUM(packet_length) OVER s AS BIGINT) AS src_bytes_window,
         COUNT(*) OVER p AS pair_conn_freq
  FROM flows
  WINDOW s AS (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN {HOUR_US} PRECEDING AND CURRENT ROW),
         p AS (PARTITION BY src_ip, dst_ip ORDER BY ts_us RANGE BETWEEN {HOUR_US} PRECEDING AND CURRENT ROW))"""
BASELINE = " UNION ALL ".join(
    f"SELECT '{f}' AS name, CAST(quantile_cont({f}, 0.5) AS DOUBLE) AS median, "
    f"CAST(greatest(quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25), 1.0) AS DOUBLE) AS spread FROM feats"
    for f in ("packet_length", "src_conn_freq", "src_bytes_window", "pair_conn_freq"))


def _z(f: str) -> str:
    return f"(({f} - (SELECT median FROM base WHERE name = '{f}')) / (SELECT spread FROM base WHERE name = '{f}'))"


_ML = ("packet_length", "src_conn_freq", "src_bytes_window", "pair_conn_freq")
_BEST = "greatest(" + ", ".join(f"abs(z{i})" for i in range(4)) + ")"


def _pick(values: list[str]) -> str:
    whens = " ".join(f"WHEN abs(z{i}) = {_BEST} THEN {v}" for i, v in enumerate(values[:3]))
    return f"CASE {whens} ELSE {values[3]} END"


ANOMALY_CTES = f"""{FEATURES}, base AS ({BASELINE}),
bad AS (SELECT *, round(0.1 - src_bytes_window / 200000.0, 6) AS anomaly_score FROM feats
        WHERE round(0.1 - src_bytes_window / 200000.0, 6) < 0),
worst AS (SELECT * FROM bad QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY anomaly_score, ts_us, seq) = 1),
zs AS (SELECT src_ip, dst_ip, anomaly_score, packet_length, src_conn_freq, src_bytes_window, pair_conn_freq,
              {', '.join(f'{_z(f)} AS z{i}' for i, f in enumerate(_ML))} FROM worst),
expl AS (SELECT src_ip, dst_ip, anomaly_score, {_pick([f"'{f}'" for f in _ML])} AS top_feature,
                CAST({_pick(list(_ML))} AS BIGINT) AS top_feature_value,
                {_pick([f'z{i}' for i in range(4)])} AS z FROM zs),
grp AS (SELECT src_ip, dst_ip, COUNT(*) AS anomalous_records, MAX(packet_length) AS max_packet_length,
               MAX(src_conn_freq) AS max_src_conn_freq, MIN(ts_us) AS first_us, MAX(ts_us) AS last_us,
               array_to_string(list_slice(list_sort(list(DISTINCT dst_port)), 1, 10), ',') AS dst_ports
        FROM bad GROUP BY src_ip, dst_ip),
anomalies AS (SELECT grp.*, expl.* EXCLUDE (src_ip, dst_ip),
                     CASE WHEN anomaly_score <= -0.15 THEN 'HIGH' WHEN anomaly_score <= -0.05 THEN 'MEDIUM' ELSE 'LOW' END AS severity
              FROM grp JOIN expl USING (src_ip, dst_ip))"""

# One alert per event, as in the inputs.
ALERTS = """
alerts AS (
  SELECT *, CASE WHEN alert_type = 'ML_ANOMALY' THEN 'ML' ELSE 'Rule' END AS method,
         CASE alert_type WHEN 'PORT_SCAN' THEN 'Port scan' WHEN 'BRUTE_FORCE' THEN 'Brute force'
              WHEN 'BLACKLISTED_IP' THEN 'Blacklisted IP' WHEN 'DNS_TUNNELING' THEN 'DNS tunneling' ELSE 'ML anomaly' END AS label,
         CAST(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS INTEGER) AS severity_rank,
         alert_type || '|' || source_ip || '|' || dest_ip AS alert_key,
         '{"first_seen":"' || seen || '","hits":' || k || ',"id":' || event_id || '}' AS details
  FROM (
    SELECT event_id, k, ts, epoch_us(ts) AS timestamp_us,
           epoch_us(ts) + CAST(round(value * 60) AS BIGINT) * 1000000 AS last_seen_us,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS seen,
           CASE event_type WHEN 'click' THEN 'PORT_SCAN' WHEN 'view' THEN 'BRUTE_FORCE' WHEN 'error' THEN 'BLACKLISTED_IP'
                WHEN 'signup' THEN 'DNS_TUNNELING' WHEN 'purchase' THEN 'ML_ANOMALY' END AS alert_type,
           CASE WHEN k % 7 = 0 THEN 'HIGH' WHEN k % 2 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
           '10.0.0.' || (user_id % 256) AS source_ip, 'host-' || (k % 3) AS dest_ip,
           event_type || ' seen ' || k || ' times' AS description
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))"""
ALERT_COLUMNS = ("timestamp_us, alert_type, severity, severity_rank, method, label, source_ip, dest_ip, description, "
                 "last_seen_us")

# The damaged native fields, and what each should become.
RAW = """
raw AS (
  SELECT event_id AS i, event_id AS seq, k, user_id, value, ts FROM
    (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
native AS (
  SELECT seq, i, epoch_us(ts) AS ts_us,
         CASE WHEN i % 29 = 0 THEN 'not-a-date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS t,
         CASE WHEN i % 19 = 0 THEN '10.0.0.999' WHEN i % 31 = 0 THEN '2001:db8::' || printf('%x', user_id)
              ELSE '10.0.0.' || (user_id % 256) END AS src_ip,
         '192.168.1.10' AS dst_ip, CAST(k AS INTEGER) AS src_port,
         CASE WHEN i % 23 = 0 THEN '0x' || printf('%x', k) ELSE CAST(k AS VARCHAR) END AS sp,
         CASE WHEN i % 17 = 0 THEN 70000 ELSE k * 3 END AS dst_port,
         CASE WHEN i % 37 = 0 THEN 'XYZ' WHEN i % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
         CASE WHEN i % 37 = 0 THEN 'XYZ' WHEN i % 3 = 0 THEN 'udp' ELSE 'TCP' END AS proto,
         CAST(round(value * 100) AS BIGINT) + 1 AS packet_length,
         CASE WHEN i % 41 = 0 THEN '-5' WHEN i % 43 = 0 THEN '12.5' ELSE CAST(CAST(round(value * 100) AS BIGINT) + 1 AS VARCHAR) END AS len,
         CASE WHEN i % 41 = 0 OR i % 43 = 0 THEN FALSE ELSE packet_length BETWEEN 1 AND 65535 END AS len_ok,
         i % 19 <> 0 AND NOT (i % 31 = 0 AND user_id > 65535) AS src_ok,      -- an IPv6 group has four digits
         concat_ws('; ', CASE WHEN i % 29 = 0 THEN 'invalid timestamp' END, CASE WHEN NOT src_ok THEN 'invalid src_ip' END,
                   CASE WHEN i % 17 = 0 THEN 'invalid dst_port' END, CASE WHEN i % 37 = 0 THEN 'invalid protocol' END,
                   CASE WHEN NOT len_ok THEN 'invalid packet_length' END) AS reason
  FROM raw)"""
NATIVE_ROWS = ("SELECT seq, ts_us, src_ip, dst_ip, src_port, CAST(dst_port AS INTEGER) AS dst_port, protocol, packet_length "
               "FROM native WHERE reason = ''")
REJECTS = "SELECT seq, reason, concat_ws(',', t, src_ip, dst_ip, sp, CAST(dst_port AS VARCHAR), proto, len) AS raw FROM native WHERE reason <> ''"
LINES = f"""{RAW},
shaped AS (
  SELECT *, CASE WHEN i % 101 < 4 THEN 'header' WHEN i % 53 = 0 OR i % 59 = 0 THEN 'blank'
                 WHEN i % 61 = 0 THEN 'wrong field count (expected 7, got 8)'
                 WHEN i % 67 = 0 THEN 'wrong field count (expected 7, got 3)' ELSE 'row' END AS kind FROM native),
line_rejects AS (
  SELECT seq, reason FROM shaped WHERE kind = 'row' AND reason <> ''
  UNION ALL SELECT seq, kind FROM shaped WHERE kind LIKE 'wrong%'
  UNION ALL SELECT seq, 'repeated header row' FROM (
    SELECT seq, row_number() OVER (PARTITION BY seq % 4 ORDER BY seq) AS nth FROM shaped WHERE kind = 'header') WHERE nth > 1)"""

CICIDS_ROWS = """SELECT seq, epoch_us(date_trunc('minute', ts)) AS ts_us, '10.0.0.' || (user_id % 256) AS src_ip,
        '192.168.1.10' AS dst_ip, CAST(k AS INTEGER) AS src_port, CAST(k AS INTEGER) AS dst_port,
        CASE i % 5 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN 'HOPOPT' WHEN 3 THEN 'PROTO-200' ELSE 'ARP' END AS protocol,
        CAST(round(value * 100) AS BIGINT) * 1000 AS packet_length FROM raw"""
UNSW_ROWS = """SELECT seq, epoch_us(date_trunc('second', ts)) AS ts_us, '10.0.0.' || (user_id % 256) AS src_ip,
        '192.168.1.10' AS dst_ip, CAST(CASE WHEN i % 3 = 0 THEN 0 ELSE k END AS INTEGER) AS src_port,
        CAST(CASE WHEN i % 11 = 0 THEN 0 ELSE k END AS INTEGER) AS dst_port, 'TCP' AS protocol, CAST(0 AS BIGINT) AS packet_length
        FROM raw WHERE i % 13 <> 0"""
MIXED_KIND = "i // 500 % 4"
UNSW_LINE = """CASE WHEN i % 3 = 0 THEN '-' WHEN i % 3 = 1 THEN '0x00' || printf('%X', k) ELSE CAST(k AS VARCHAR) END AS sp,
        CASE WHEN i % 11 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS dp,
        CASE WHEN i % 2 = 0 THEN epoch_us(ts) // 1000000 ELSE epoch_us(ts) // 1000000 * 1000 END AS st"""

#: Twelve full trees of depth three, walked a level at a time: at level l, tree t asks for feature t + l.
def _walk_step(level: int) -> str:
    asked = f"CASE (t + {level}) % 4 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_ML)) + " END"
    name = f"CASE (t + {level}) % 4 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_ML)) + " END"
    return f"""w{level + 1} AS (SELECT w.* EXCLUDE (node), CASE WHEN {asked} <= median + spread * ((t * 7 + node * 3) % 9 - 4) / 4
        THEN 2 * node + 1 ELSE 2 * node + 2 END AS node FROM w{level} w JOIN base ON base.name = {name})"""


WALK = f"""WITH {FEATURES}, base AS ({BASELINE}), w0 AS (SELECT feats.*, t, 0 AS node FROM feats, range(12) trees(t)),
{", ".join(map(_walk_step, range(3)))}
SELECT seq, round(-pow(2, -(SUM(3 + (t + node) % 5 * 0.5) / 12) / (2 * (ln(255.0) + 0.5772156649015329) - 2 * 255.0 / 256)), 6) AS raw_score
FROM w3 GROUP BY seq"""

MERGED = f"""WITH {ALERTS},
keyed AS (SELECT *, CASE alert_type WHEN 'PORT_SCAN' THEN {72 * HOUR_US} WHEN 'BRUTE_FORCE' THEN {120 * HOUR_US}
                         WHEN 'DNS_TUNNELING' THEN {72 * HOUR_US} END AS gap FROM alerts),
reach AS (SELECT *, MAX(last_seen_us) OVER (PARTITION BY alert_key ORDER BY timestamp_us, last_seen_us
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM keyed),
clustered AS (SELECT *, SUM(CASE WHEN gap IS NOT NULL AND (r IS NULL OR timestamp_us > r + gap) THEN 1 ELSE 0 END)
                        OVER (PARTITION BY alert_key ORDER BY timestamp_us, last_seen_us ROWS UNBOUNDED PRECEDING) AS c FROM reach),
best AS (SELECT *, row_number() OVER (PARTITION BY alert_key, c ORDER BY severity_rank DESC, length(details) DESC, timestamp_us) AS n,
                COUNT(*) OVER g AS merged, MIN(timestamp_us) OVER g AS first_us, MAX(last_seen_us) OVER g AS end_us
         FROM clustered WINDOW g AS (PARTITION BY alert_key, c))
SELECT alert_key, alert_type, severity, first_us AS timestamp_us, first_us AS first_seen_us, end_us AS last_seen_us,
       CASE WHEN merged = 1 THEN details ELSE
         '{{"first_seen":"' || CASE WHEN first_us % 1000000 = 0 THEN strftime(make_timestamp(first_us), '%Y-%m-%d %H:%M:%S')
                              ELSE strftime(make_timestamp(first_us), '%Y-%m-%d %H:%M:%S.%f') END
         || '","hits":' || k || ',"id":' || event_id || ',"merged_alerts":' || merged || '}}' END AS details, merged
FROM best WHERE n = 1"""

_TL = """facts AS (SELECT MIN(timestamp_us) AS a, MAX(timestamp_us) AS b, COUNT(*) AS n FROM alerts)"""

ORACLES: dict[str, str] = {
    "flows_from_events": f"WITH {EVENT_FLOWS} SELECT * EXCLUDE (ts) FROM flows",
    "flows_from_lineitem": f"""WITH {LINE_FLOWS} SELECT src_ip, dst_ip, COUNT(*) AS n, CAST(SUM(packet_length) AS BIGINT) AS bytes,
        MIN(ts_us) AS first_us, MAX(ts_us) AS last_us, COUNT(DISTINCT dst_port) AS ports FROM flows GROUP BY src_ip, dst_ip""",
    "endpoints": f"WITH {EVENT_FLOWS} SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows",
    "busy_scan_pairs": f"""WITH {EVENT_FLOWS} SELECT src_ip, dst_ip, COUNT(DISTINCT dst_port) AS size FROM flows
        GROUP BY src_ip, dst_ip HAVING COUNT(DISTINCT dst_port) > 10""",
    "busy_pairs": f"WITH {LINE_FLOWS} SELECT src_ip, dst_ip, COUNT(*) AS size FROM flows GROUP BY src_ip, dst_ip HAVING COUNT(*) > 100",
    "port_scan_incidents": scan_sql(EVENT_FLOWS, 72 * HOUR_US, 3, 5),
    "port_scan_incidents_tied": scan_sql(LINE_FLOWS, 3 * DAY_US, 4, 6),
    "port_scan_alerts": SCAN_ALERT,
    "brute_force_incidents": brute_sql(EVENT_FLOWS, 120 * HOUR_US, 1, 3, "dst_port < 50"),
    "brute_force_incidents_tied": brute_sql(LINE_FLOWS, 60 * DAY_US, 1, 3),
    "brute_force_alerts": BRUTE_ALERT,
    "dns_incidents": DNS_SQL,
    "dns_alerts": DNS_ALERT,
    "incident_rows": f"""WITH {EVENT_FLOWS}, picked AS (SELECT * FROM flows WHERE {DNS_PORTS}),
        {incident_ctes('src_ip', 72 * HOUR_US, 2, None, 'picked')}
        SELECT src_ip, start_us, end_us, CAST(peak AS BIGINT) AS peak, seq, ts_us FROM inc_rows""",
    "beacon_intervals": f"""WITH {BEACON_CTES} SELECT src_ip, dst_ip, connections, first_us, last_us, round(mean_s, 2) AS mean_s,
        round(std_s, 2) AS std_s, round(min_s, 2) AS min_s, round(max_s, 2) AS max_s FROM stats JOIN seen USING (src_ip, dst_ip)""",
    "beacons": f"WITH {BEACON_CTES} SELECT src_ip, dst_ip, connections, severity, first_us, last_us, dst_ports FROM beacons",
    "off_hours_sources": OFF_SQL,
    "off_hours_wrapped": off_sql("(hour(ts) < 20 AND hour(ts) >= 4)", 40, 50),
    "off_hours_alerts": OFF_ALERT,
    "feed_entries": f"WITH {FEEDS} SELECT source, feed_ord, ord, entry FROM feed",
    "feed_merge": f"WITH {FEEDS} SELECT entry, source FROM merged",
    "feed_status": f"WITH {FEEDS} SELECT source, COUNT(*) AS entries FROM feed GROUP BY source",
    "feed_intake": f"""WITH {FEEDS} SELECT COUNT(*) FILTER (prefix = 32) AS hosts, COUNT(*) FILTER (prefix <> 32) AS networks,
        COUNT(*) AS size FROM merged""",
    "feed_combined_view": f"""WITH {FEEDS} SELECT entry, source FROM merged
        UNION ALL SELECT * FROM (VALUES {', '.join(f"('{e}', 'static')" for e, _, _ in STATIC)})""",
    "listed_hosts": f"{ALL_LISTED} SELECT ip, static_hit, source FROM hosts",
    "listed_rows": f"{ALL_LISTED} SELECT seq, outbound, bad_ip, peer_ip, static_hit FROM hit_rows",
    "blocklist_groups": f"WITH {EVENT_FLOWS}, {listed_ctes(STATIC, feed=False)} {GROUPS.format(extra='')}",
    "threat_feed_groups": f"WITH {EVENT_FLOWS}, {FEEDS}, {listed_ctes(STATIC[3:])} {GROUPS.format(extra='')}",
    "blocklist_alerts": LIST_ALERT,
    "rule_alerts": " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (SCAN_ALERT, DNS_ALERT, OFF_ALERT, f"""
        SELECT first_us AS timestamp_us, 'BLACKLISTED_IP' AS alert_type, severity,
               CAST(CASE WHEN outbound THEN 3 ELSE 2 END AS INTEGER) AS severity_rank, 'Rule' AS method, 'Blacklisted IP' AS label,
               CASE WHEN outbound THEN {_PEERS} ELSE bad_ip END AS source_ip, CASE WHEN outbound THEN bad_ip ELSE {_PEERS} END AS dest_ip,
               CASE WHEN outbound THEN 'Outbound connections to' ELSE 'Inbound traffic from' END || ' blacklisted host ' || bad_ip
               || ': ' || events || ' events, ' || peers_count || ' internal peer(s), dst ports ' || five AS description,
               last_us AS last_seen_us
        FROM (WITH {EVENT_FLOWS}, {listed_ctes(STATIC, feed=False)} {GROUPS.format(extra=FIVE)})""")),
    "ml_features": f"WITH {FEATURES} SELECT seq, packet_length, src_conn_freq, src_bytes_window, pair_conn_freq FROM feats",
    "ml_baseline": f"WITH {FEATURES} {BASELINE}",
    "exact_quantiles": " UNION ALL ".join(
        f"SELECT '{c}' AS name, CAST({p} AS DOUBLE) AS prob, round(quantile_cont({c}, {p}), 6) AS quantile FROM lineitem"
        for c in ("l_quantity", "l_extendedprice") for p in (0.0, 0.03, 0.5, 0.97, 1.0)),
    "anomaly_groups": f"""WITH {ANOMALY_CTES} SELECT src_ip, dst_ip, severity, anomalous_records, anomaly_score, top_feature,
        top_feature_value, round(z, 2) AS top_feature_z, max_packet_length, max_src_conn_freq, dst_ports, first_us, last_us FROM anomalies""",
    "forest_walk": WALK,
    "forest_samples": """SELECT range AS tree, least(256, n) AS rows, least(256, n) AS distinct_rows
        FROM range(300), (SELECT COUNT(*) AS n FROM events)""",
    "ml_corroborated": f"""WITH {ANOMALY_CTES},
        rules AS (SELECT source_ip, alert_type FROM ({DNS_ALERT}) UNION SELECT source_ip, alert_type FROM ({OFF_ALERT})),
        types AS (SELECT source_ip, string_agg(alert_type, ', ' ORDER BY alert_type) AS t FROM rules GROUP BY source_ip),
        shown AS (SELECT a.*, 'Traffic deviates from baseline: ' || top_feature || '=' || format('{{:,}}', top_feature_value)
                    || ' (baseline median ' || format('{{:,}}', CAST(round_even(median, 0) AS BIGINT)) || '); ' || anomalous_records
                    || ' anomalous record(s)' || CASE WHEN t IS NULL THEN '' ELSE ' [corroborates ' || t || ']' END AS d
                  FROM anomalies a JOIN base ON base.name = a.top_feature LEFT JOIN types ON types.source_ip = a.src_ip)
        {alert_select('ML_ANOMALY', 'ML anomaly', 'src_ip', 'dst_ip', 'first_us', 'last_us', 'd', 'shown', 'ML')}""",
    "merge_duplicates": MERGED,
    "alerts_selected": f"WITH {ALERTS} SELECT {ALERT_COLUMNS} FROM alerts WHERE alert_type = 'PORT_SCAN' AND severity_rank >= 2",
    "alerts_searched": f"""WITH {ALERTS} SELECT {ALERT_COLUMNS} FROM alerts WHERE severity IN ('HIGH', 'MEDIUM')
        AND label IN ('Port scan', 'Blacklisted IP') AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:01'
        AND (contains(lower(description), 'seen 4') OR contains(lower(source_ip), 'seen 4') OR contains(lower(dest_ip), 'seen 4'))""",
    "alerts_flat": f"""WITH {ALERTS} SELECT timestamp_us AS time_us, severity, label AS type, alert_type AS code, method, source_ip,
        dest_ip AS destination, description FROM alerts""",
    "alerts_recent": f"WITH {ALERTS} SELECT {ALERT_COLUMNS} FROM alerts ORDER BY timestamp_us DESC, severity_rank DESC, alert_key LIMIT 15",
    "alerts_by_severity": f"""WITH {ALERTS} SELECT severity, COUNT(alert_key) AS alerts
        FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) v(severity) LEFT JOIN alerts USING (severity) GROUP BY severity""",
    "alerts_by_type": f"""WITH {ALERTS} SELECT alert_type, COUNT(alert_key) AS alerts
        FROM (VALUES ('PORT_SCAN'), ('BRUTE_FORCE'), ('BLACKLISTED_IP'), ('ML_ANOMALY'), ('DNS_TUNNELING'), ('BEACONING'),
                     ('TIME_OF_DAY_ANOMALY'), ('THREAT_INTEL_HIT')) v(alert_type) LEFT JOIN alerts USING (alert_type) GROUP BY alert_type""",
    "alert_log_lines": f"""WITH {ALERTS} SELECT left(seen, 23) || ' | ' || rpad(severity, 6, ' ') || ' | '
        || CASE WHEN length(alert_type) < 14 THEN rpad(alert_type, 14, ' ') ELSE alert_type END || ' | ' || source_ip || ' -> '
        || dest_ip || ' | ' || description || ' | ' || details AS value FROM alerts""",
    "alert_json": f"""WITH {ALERTS} SELECT '{{"timestamp":"' || replace(seen, ' ', 'T') || '","alert_type":"' || alert_type
        || '","severity":"' || severity || '","source_ip":"' || source_ip || '","dest_ip":"' || dest_ip || '","description":"'
        || description || '","details":"' || replace(details, '"', '\\"') || '"}}' AS value FROM alerts""",
    "alert_timeline": f"""WITH {ALERTS}, {_TL}, shape AS (SELECT a, greatest(b - a, 1000000) AS width, greatest(1, least(48, 2 * n)) AS c FROM facts)
        SELECT least((timestamp_us - a) * c // width, c - 1) AS bucket, severity, COUNT(*) AS alerts FROM alerts, shape GROUP BY ALL""",
    "alert_methods": f"""WITH {ALERTS} SELECT alert_type, label, method, COUNT(*) AS alerts, COUNT(*) FILTER (severity = 'HIGH') AS high,
        COUNT(*) FILTER (severity = 'MEDIUM') AS medium, COUNT(*) FILTER (severity = 'LOW') AS low FROM alerts GROUP BY ALL""",
    "alert_method_totals": f"WITH {ALERTS} SELECT method, alert_type, COUNT(*) AS alerts FROM alerts GROUP BY ROLLUP (method, alert_type)",
    "alert_top_sources": f"WITH {ALERTS} SELECT source_ip, COUNT(*) AS alerts FROM alerts GROUP BY source_ip ORDER BY alerts DESC, source_ip LIMIT 10",
    "alert_top_threats": f"WITH {ALERTS} SELECT alert_type, label, COUNT(*) AS alerts FROM alerts GROUP BY ALL ORDER BY alerts DESC, alert_type LIMIT 5",
    "alert_worst_per_source": f"WITH {ALERTS} SELECT source_ip, COUNT(*) AS alerts, arg_max(severity, severity_rank) AS worst FROM alerts GROUP BY source_ip",
    "alert_best_findings": f"""WITH {ALERTS},
        best AS (SELECT *, COUNT(*) OVER (PARTITION BY alert_type) AS n FROM alerts
                 QUALIFY row_number() OVER (PARTITION BY alert_type ORDER BY severity_rank DESC, timestamp_us DESC, alert_key DESC) = 1)
        SELECT v.alert_type, v.label, coalesce(n, 0) AS alerts, coalesce(severity, '-') AS worst,
               coalesce(source_ip || ' -> ' || dest_ip || ': ' || description, 'nothing detected') AS finding
        FROM (VALUES ('DNS_TUNNELING', 'DNS tunneling'), ('BEACONING', 'C2 beaconing'), ('TIME_OF_DAY_ANOMALY', 'Off-hours activity'),
                     ('THREAT_INTEL_HIT', 'Threat intel hit')) v(alert_type, label) LEFT JOIN best ON best.alert_type = v.alert_type""",
    "kpis": f"""WITH {ALERTS} SELECT (SELECT COUNT(*) FROM events) AS records, COUNT(*) AS alerts,
        COUNT(*) FILTER (severity = 'LOW') AS low, COUNT(*) FILTER (severity = 'MEDIUM') AS medium,
        COUNT(*) FILTER (severity = 'HIGH') AS high, COUNT(DISTINCT source_ip) AS flagged_sources FROM alerts""",
    "traffic_summary": f"""WITH {LINE_FLOWS} SELECT COUNT(*) AS records, CAST(SUM(packet_length) AS BIGINT) AS total_bytes,
        round(avg(packet_length), 4) AS mean_bytes, COUNT(DISTINCT src_ip) AS sources, COUNT(DISTINCT dst_ip) AS destinations,
        COUNT(DISTINCT dst_port) AS dst_ports, MIN(ts_us) AS first_us, MAX(ts_us) AS last_us FROM flows""",
    "traffic_display": f"""WITH {EVENT_FLOWS}, t AS (SELECT MIN(ts) AS a, MAX(ts) AS b, COUNT(*) AS n, (MAX(ts_us) - MIN(ts_us)) // 1000000 AS s FROM flows)
        SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_seen,
               printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock_span, format('{{:,}}', n) AS records FROM t""",
    "protocol_distribution": f"""WITH {EVENT_FLOWS} SELECT protocol, COUNT(*) AS records,
        round(COUNT(*) * 100 / (SELECT COUNT(*) FROM flows), 1) AS percent FROM flows GROUP BY protocol""",
    "protocol_pie": f"""WITH {EVENT_FLOWS}, c AS (SELECT protocol, COUNT(*) AS n, row_number() OVER (ORDER BY COUNT(*) DESC, protocol) AS r
        FROM flows GROUP BY protocol) SELECT CASE WHEN r < 3 THEN protocol ELSE 'Other' END AS protocol, CAST(SUM(n) AS BIGINT) AS records FROM c GROUP BY 1""",
    "talkers_by_packets": f"""WITH {LINE_FLOWS} SELECT src_ip, COUNT(*) AS packets, CAST(SUM(packet_length) AS BIGINT) AS bytes,
        COUNT(DISTINCT dst_port) AS dst_ports FROM flows GROUP BY src_ip ORDER BY packets DESC, src_ip LIMIT 10""",
    "talkers_by_bytes": f"""WITH {EVENT_FLOWS} SELECT src_ip, CAST(SUM(packet_length) AS BIGINT) AS bytes FROM flows
        GROUP BY src_ip ORDER BY bytes DESC, src_ip LIMIT 10""",
    "talkers_with_alerts": f"""WITH {EVENT_FLOWS}, {ALERTS},
        top AS (SELECT src_ip, COUNT(*) AS packets, CAST(SUM(packet_length) AS BIGINT) AS bytes, COUNT(DISTINCT dst_port) AS dst_ports
                FROM flows GROUP BY src_ip ORDER BY packets DESC, src_ip LIMIT 10),
        raised AS (SELECT source_ip, COUNT(*) AS n, arg_max(severity, severity_rank) AS worst FROM alerts GROUP BY source_ip)
        SELECT CAST(row_number() OVER (ORDER BY packets DESC, src_ip) AS INTEGER) AS rank, src_ip, packets, bytes, dst_ports,
               coalesce(n, 0) AS alerts, worst FROM top LEFT JOIN raised ON source_ip = src_ip""",
    "replay_totals": f"""WITH {EVENT_FLOWS}, {ALERTS}, b AS (SELECT MIN(ts_us) AS a, greatest(MAX(ts_us) - MIN(ts_us), 1) AS s FROM flows),
        cut AS (SELECT range AS slice, a, s FROM range(1, 41), b)
        SELECT slice, (SELECT COUNT(*) FROM flows WHERE (ts_us - a) * 40 <= slice * s) AS n,
               (SELECT CAST(SUM(packet_length) AS BIGINT) FROM flows WHERE (ts_us - a) * 40 <= slice * s) AS bytes,
               (SELECT COUNT(*) FROM alerts WHERE (timestamp_us - a) * 40 <= slice * s) AS alerts FROM cut""",
    "parse_native": f"WITH {RAW} {NATIVE_ROWS}",
    "parse_native_rejects": f"WITH {RAW} {REJECTS}",
    "parse_reason_counts": f"WITH {RAW} SELECT reason, COUNT(*) AS rows FROM native WHERE reason <> '' GROUP BY reason",
    "parse_quality": f"""WITH {RAW} SELECT COUNT(*) AS total, COUNT(*) FILTER (reason = '') AS valid,
        COUNT(*) FILTER (reason <> '') AS invalid FROM native""",
    "parse_reject_sample": f"WITH {RAW} {REJECTS} ORDER BY seq LIMIT 100",
    "parse_cicids": f"WITH {RAW} {CICIDS_ROWS}",
    "parse_unsw": f"WITH {RAW} {UNSW_ROWS}",
    "parse_headerless": f"WITH {RAW} {UNSW_ROWS}",
    "parse_mixed_layouts": f"""WITH {RAW}, rows AS ({NATIVE_ROWS} AND {MIXED_KIND} = 0
        UNION ALL {CICIDS_ROWS} WHERE {MIXED_KIND} = 1 UNION ALL {UNSW_ROWS} AND {MIXED_KIND} = 2) SELECT * EXCLUDE (seq) FROM rows""",
    "parse_mixed_rejects": f"""WITH {RAW}, lines AS (SELECT *, {UNSW_LINE} FROM raw)
        SELECT reason, CASE WHEN i % 19 <> 0 AND i % 31 <> 0 THEN replace(raw, ',10.0.0.', ', 10.0.0.') ELSE raw END AS raw
            FROM ({REJECTS.replace("SELECT seq,", "SELECT i,", 1)} AND {MIXED_KIND} = 0)
        UNION ALL SELECT 'invalid protocol', '10.0.0.' || (user_id % 256) || ',' || sp || ',192.168.1.10,' || dp || ',bad name,0,0,0'
            || repeat(',0', 20) || ',' || st || repeat(',0', 20) FROM lines WHERE i % 13 = 0 AND {MIXED_KIND} = 2
        UNION ALL SELECT 'file skipped: closest profile ''default'' is missing: timestamp (as Timestamp or timestamp); '
            || 'src_ip (as Source IP or src_ip or source_ip); dst_ip (as Destination IP or dst_ip or destination_ip); '
            || 'src_port (as Source Port or src_port or source_port); dst_port (as Destination Port or dst_port or destination_port); '
            || 'protocol (as Protocol or protocol); packet_length (as Packet Length or packet_length)', 'what,is'
            FROM (SELECT DISTINCT i // 500 FROM raw WHERE {MIXED_KIND} = 3)""",
    "parse_offsets": """SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('second', ts)) - 7200000000
        WHEN 1 THEN epoch_us(date_trunc('second', ts)) + 19800000000 WHEN 2 THEN epoch_us(ts)
        ELSE epoch_us(date_trunc('second', ts)) END AS ts_us FROM events""",
    "parse_custom": f"""WITH {RAW} SELECT seq, ts_us, src_ip, dst_ip, src_port, CAST(dst_port AS INTEGER) AS dst_port, protocol, packet_length
        FROM native WHERE i % 29 <> 0 AND src_ok AND i % 17 <> 0 AND protocol = 'TCP' AND i % 41 <> 0 AND i % 43 <> 0""",
    "parse_lines": f"WITH {LINES} SELECT seq, ts_us, src_ip, dst_ip, src_port, CAST(dst_port AS INTEGER) AS dst_port, protocol, packet_length "
                   "FROM shaped WHERE kind = 'row' AND reason = ''",
    "parse_line_rejects": f"WITH {LINES} SELECT seq, reason FROM line_rejects",
    "parse_line_quality": f"""WITH {LINES} SELECT v + r AS total, v AS valid, r AS invalid FROM
        (SELECT (SELECT COUNT(*) FROM shaped WHERE kind = 'row' AND reason = '') AS v, (SELECT COUNT(*) FROM line_rejects) AS r)""",
    "log_file_scan": f"WITH {RAW} SELECT reason, COUNT(*) AS rows FROM native WHERE reason <> '' GROUP BY reason",
    "capture_flows": f"""WITH {RAW} SELECT epoch_us(ts) AS ts_us,
        '10.' || ((user_id // 65536) % 256) || '.' || ((user_id // 256) % 256) || '.' || (user_id % 256) AS src_ip,
        '192.168.1.10' AS dst_ip, CAST(CASE WHEN i % 3 = 2 THEN 0 ELSE 49152 + i % 16384 END AS INTEGER) AS src_port,
        CAST(CASE WHEN i % 3 = 2 THEN 0 ELSE k END AS INTEGER) AS dst_port,
        CASE i % 3 WHEN 0 THEN 'UDP' WHEN 1 THEN 'TCP' ELSE 'ICMP' END AS protocol, CAST(40 + k AS BIGINT) AS packet_length
        FROM raw WHERE i % 50 <> 0""",
    "capture_rejects": f"""WITH {RAW} SELECT 'packet skipped: unsupported IP protocol 47' AS reason, COUNT(*) AS rows FROM raw WHERE i % 50 = 0""",
    "stream_live_traffic": f"""WITH {EVENT_FLOWS} SELECT epoch_us(date_trunc('day', ts)) AS window_start_us, protocol, COUNT(*) AS records,
        CAST(SUM(packet_length) AS BIGINT) AS bytes FROM flows GROUP BY ALL""",
    "stream_port_scan_alerts": SCAN_ALERT,
}

BRUTE_EVENT_ALERT = alert_select(
    "BRUTE_FORCE", "Brute force", "src_ip", "dst_ip", "start_us", "end_us",
    f"'Brute force on port ' || dst_port || ': ' || connections || ' connections in ' || {SECS} || 's (peak ' || peak "
    "|| ' in 432000s, threshold >1)'",
    f"({brute_sql(EVENT_FLOWS, 120 * HOUR_US, 1, 3, 'dst_port < 50')})")
BEACON_ALERT = alert_select("BEACONING", "C2 beaconing", "src_ip", "dst_ip", "first_us", "last_us",
                            "'Possible C2 beaconing: ' || connections || ' connections every ' || printf('%.1f', mean_s) || 's (std ' || "
                            "printf('%.2f', std_s) || 's, threshold <155000s), dst ports ' || shown_ports",
                            f"(WITH {BEACON_CTES} SELECT * FROM beacons)")
ORACLES["beacon_alerts"] = BEACON_ALERT
#: All six rules with feeds; the stream gives what the batch gives.
ORACLES["rule_alerts_all"] = ORACLES["stream_rule_alerts"] = " UNION ALL ".join(
    f"SELECT * FROM ({q})" for q in (SCAN_ALERT, BRUTE_EVENT_ALERT, DNS_ALERT, OFF_ALERT, LIST_ALERT, BEACON_ALERT))

#: The five time slices of the streamed events, the slice sent again, and the watermark after each batch.
SLICED = f"""{EVENT_FLOWS},
ends AS (SELECT MIN(ts_us) AS low, (MAX(ts_us) - MIN(ts_us)) // 5 AS width FROM flows),
sliced AS (SELECT flows.*, least((ts_us - low) // width, 4) AS batch FROM flows, ends),
again AS (SELECT * FROM sliced WHERE batch = 0 AND seq % 50 = 0)"""
ORACLES["stream_late_rows"] = f"WITH {SLICED} SELECT seq, ts_us, src_ip, dst_ip FROM again"
ORACLES["stream_counters"] = f"""WITH {SLICED},
per AS (SELECT batch, COUNT(*) AS n, MAX(ts_us) - {HOUR_US} AS mark FROM sliced GROUP BY batch)
SELECT batch, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS late,
       (SELECT COUNT(*) FROM flows WHERE ts_us <= mark) AS final_rows FROM per
UNION ALL SELECT 5 AS batch, (SELECT COUNT(*) FROM flows) + (SELECT COUNT(*) FROM again) AS rows, (SELECT COUNT(*) FROM again) AS late,
       (SELECT COUNT(*) FROM flows WHERE ts_us <= (SELECT MAX(ts_us) - {HOUR_US} FROM flows)) AS final_rows"""

ORACLES["alerts_csv_sink"] = ORACLES["alerts_json_sink"] = ORACLES["alerts_flat"]
ORACLES["alerts_log_sink"] = f"WITH {ALERTS} SELECT severity, alert_type, COUNT(*) AS alerts FROM alerts GROUP BY ALL"
ORACLES["stream_log_counts"] = f"""WITH {LINES},
read AS (SELECT seq, reason = '' AS good FROM shaped WHERE kind = 'row' AND reason = '' UNION ALL SELECT seq, FALSE AS good FROM line_rejects)
SELECT CAST(seq % 4 AS BIGINT) AS batch, COUNT(*) AS total, count_if(good)::BIGINT AS valid, count_if(NOT good)::BIGINT AS invalid
FROM read GROUP BY seq % 4"""
