"""SQL counterparts of the registered queries, over the same tables."""

from __future__ import annotations

LOGS = """
base AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
shaped AS (
  SELECT event_id, ts, k,
    '10.0.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(user_id % 20 AS VARCHAR) AS src_ip,
    '203.0.113.' || CAST(k % 50 AS VARCHAR) AS dst_ip,
    CAST(1024 + event_id % 60000 AS INTEGER) AS src_port,
    CAST(CASE event_type WHEN 'error' THEN CASE k % 3 WHEN 0 THEN 22 WHEN 1 THEN 23 ELSE 3389 END
      WHEN 'purchase' THEN 445 WHEN 'signup' THEN 53 WHEN 'view' THEN 443 ELSE 8000 + k END AS INTEGER) AS dst_port,
    CASE event_type WHEN 'signup' THEN 'udp' ELSE 'tcp' END AS protocol,
    CASE event_type WHEN 'error' THEN 'denied' WHEN 'purchase' THEN 'Drop' WHEN 'signup' THEN 'accept'
      WHEN 'view' THEN 'ALLOW' ELSE 'pass' END AS action,
    CAST(round(value * 100) AS BIGINT) * 1000 AS bytes_sent,
    CAST(k * 100 AS BIGINT) AS bytes_received,
    CASE WHEN event_type IN ('view', 'signup') THEN 'normal' WHEN event_type = 'click' THEN 'benign' ELSE 'suspect' END AS label
  FROM base
),
fw AS (
  SELECT event_id AS row_id, ts AS timestamp, src_ip, dst_ip, src_port, dst_port, upper(protocol) AS protocol,
    CASE WHEN lower(action) IN ('denied', 'drop') THEN 'BLOCK' ELSE 'ALLOW' END AS action, bytes_sent, bytes_received, label,
    epoch_us(ts) AS us
  FROM shaped
)"""

# Written forms of the time in the raw log, by the value of k.
TIME_FORMS = {
    14: "%Y/%m/%d %H:%M:%S", 33: "%-m/%-d/%Y %-H:%M:%S", 34: "%m/%d/%Y %I:%M:%S %p", 35: "%Y%m%dT%H%M%S",
    36: "%d %b %Y %H:%M:%S", 37: "%B %-d, %Y %H:%M", 38: "%Y.%m.%d %H:%M:%S", 39: "%a, %d %b %Y %H:%M:%S GMT",
    40: "%Y-%m-%dT%H:%M:%S+02:00", 41: "%Y/%-m/%-d %-H:%M:%S.%f", 43: "%d-%b-%Y %H:%M:%S",
}
_WRITTEN = " ".join(f"WHEN {k} THEN strftime(ts, '{form}')" for k, form in TIME_FORMS.items())
# the instant that a written form still holds
_READ = "CASE k WHEN 13 THEN NULL WHEN 37 THEN date_trunc('minute', ts) WHEN 40 THEN date_trunc('second', ts) - INTERVAL 2 HOUR " + " ".join(
    f"WHEN {k} THEN date_trunc('second', ts)" for k in TIME_FORMS if k not in (37, 40, 41)
) + " ELSE ts END"

RAW = LOGS + f""",
raw_once AS (
  SELECT k, CAST(event_id AS VARCHAR) AS id,
    CASE k WHEN 13 THEN 'no time' {_WRITTEN} ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS t, {_READ} AS instant,
    CASE k WHEN 17 THEN '999.1.1.1' WHEN 18 THEN ' ' || src_ip || chr(9) ELSE src_ip END AS src,
    CASE k WHEN 27 THEN '2001:db8::7' ELSE dst_ip END AS dst,
    CAST(src_port AS VARCHAR) AS sport,
    CASE k WHEN 19 THEN '70000' WHEN 20 THEN '22.7' WHEN 21 THEN 'ssh' ELSE CAST(dst_port AS VARCHAR) END AS dport,
    CASE WHEN k <> 29 THEN protocol END AS proto, action,
    CASE k WHEN 23 THEN '-5' ELSE CAST(bytes_sent AS VARCHAR) END AS sent,
    CASE k WHEN 17 THEN 'n/k' ELSE CAST(bytes_received AS VARCHAR) END AS received,
    CASE WHEN k <> 31 THEN label END AS label
  FROM shaped
),
raw_all AS (SELECT * FROM raw_once UNION ALL SELECT * FROM raw_once WHERE k = 13 OR k = 42),
deduped AS (SELECT DISTINCT * FROM raw_all),
typed AS (
  SELECT CAST(id AS BIGINT) AS row_id,
    instant AS timestamp,
    trim(src, ' ' || chr(9)) AS src_ip, dst AS dst_ip, TRY_CAST(sport AS DOUBLE) AS sp, TRY_CAST(dport AS DOUBLE) AS dp,
    upper(proto) AS protocol,
    CASE WHEN lower(action) IN ('denied', 'drop') THEN 'BLOCK' ELSE 'ALLOW' END AS action,
    TRY_CAST(sent AS BIGINT) AS bytes_sent, TRY_CAST(received AS BIGINT) AS bytes_received, label
  FROM deduped
),
checked AS (
  SELECT *, timestamp IS NULL AS bad_time,
    src_ip LIKE '999%' AS bad_ip,
    NOT coalesce(sp BETWEEN 0 AND 65535, false) OR NOT coalesce(dp BETWEEN 0 AND 65535, false) AS bad_port,
    NOT coalesce(bytes_sent >= 0, false) OR NOT coalesce(bytes_received >= 0, false) AS bad_bytes
  FROM typed
),
summary AS (
  SELECT (SELECT count(*) FROM raw_all) AS original_row_count,
    count(*) FILTER (WHERE NOT (bad_time OR bad_ip OR bad_port OR bad_bytes)) AS final_row_count,
    (SELECT count(*) FROM raw_all) - count(*) AS duplicate_rows_removed,
    count(*) FILTER (WHERE bad_time) AS invalid_timestamps,
    count(*) FILTER (WHERE bad_ip) AS invalid_ip_addresses,
    count(*) FILTER (WHERE bad_port) AS invalid_ports,
    -- "Protocol" is counted again as the canonical protocol
    (SELECT 2 * count(*) FILTER (WHERE proto IS NULL) + count(*) FILTER (WHERE label IS NULL) FROM raw_all) AS missing_values,
    count(*) FILTER (WHERE bad_bytes) AS invalid_bytes
  FROM checked
)"""

# The cleaned raw log as the log that everything else reads.
CLEANED = RAW.replace("\nfw AS (", "\nfw_given AS (") + """,
fw AS (
  SELECT row_id, timestamp, src_ip, dst_ip, CAST(trunc(sp) AS INTEGER) AS src_port, CAST(trunc(dp) AS INTEGER) AS dst_port, protocol, action,
    bytes_sent, bytes_received, label, epoch_us(timestamp) AS us
  FROM checked WHERE NOT (bad_time OR bad_ip OR bad_port OR bad_bytes)
)"""
# The same of a log that lacks most columns: only those supplied are checked.
PARTIAL = RAW.replace("\nfw AS (", "\nfw_given AS (") + """,
fw AS (
  SELECT row_id, timestamp, src_ip, dst_ip, CAST(trunc(dp) AS INTEGER) AS dst_port, 'UNKNOWN' AS protocol, 'UNKNOWN' AS action, 0::BIGINT AS bytes_sent,
    0::BIGINT AS bytes_received, CAST(NULL AS VARCHAR) AS label, epoch_us(timestamp) AS us
  FROM checked WHERE NOT (bad_time OR bad_ip) AND coalesce(dp BETWEEN 0 AND 65535, false)
)"""

WINDOW = 720
W_US = WINDOW * 60_000_000
SETS = """count(*) AS event_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
    list_sort(list(DISTINCT dst_ip)) AS dsts, list_sort(list(DISTINCT dst_port)) AS ports"""


def _scan(name: str, value: str, threshold: str, source: str = "fw") -> str:
    """First closed window with enough distinct values; event times are unique, so no ties arise."""
    return f"""
{name}_counts AS (
  SELECT src_ip, timestamp, threshold, threshold_source, asset_baseline_value,
    count(DISTINCT {value}) OVER (PARTITION BY src_ip ORDER BY timestamp
      RANGE BETWEEN INTERVAL '{WINDOW} minutes' PRECEDING AND CURRENT ROW) AS n
  FROM {source} {threshold}
),
{name}_hits AS (
  SELECT src_ip, min(timestamp) AS hit, threshold, threshold_source, asset_baseline_value FROM {name}_counts
  WHERE n >= threshold GROUP BY ALL
),
{name} AS (
  SELECT src_ip, hit, threshold, threshold_source, asset_baseline_value, {SETS}
  FROM fw JOIN {name}_hits h USING (src_ip)
  WHERE timestamp BETWEEN hit - INTERVAL '{WINDOW} minutes' AND hit GROUP BY ALL
)"""


def _global(value: int) -> str:
    columns = f"SELECT {value} AS threshold, 'global_config' AS threshold_source, CAST(NULL AS DOUBLE) AS asset_baseline_value"
    return f"CROSS JOIN ({columns})"


def _flat(kind: str, severity: str, minutes: int, score: int, dst: str, time: str, threshold: str, observed: str,
          source: str = "threshold_source", base: str = "asset_baseline_value") -> str:
    return f"""SELECT {time} AS timestamp, src_ip, {dst} AS dst_ip, '{kind}' AS alert_type, '{severity}' AS severity,
    CAST(event_count AS BIGINT) AS event_count, CAST({minutes} AS BIGINT) AS window_minutes,
    CAST({score} AS BIGINT) AS score_contribution, first_seen, last_seen,
    array_to_string(dsts, ', ') AS affected_destinations, array_to_string(ports, ', ') AS affected_ports,
    CAST({source} AS VARCHAR) AS threshold_source, CAST({threshold} AS BIGINT) AS effective_threshold,
    CAST({observed} AS BIGINT) AS observed_value, round(CAST({base} AS DOUBLE), 2) AS asset_baseline_value"""


SEVERAL = "CASE WHEN len(dsts) > 1 THEN 'multiple' ELSE dsts[1] END"

BURST = f"""
burst_counts AS (
  SELECT *, count(*) OVER (PARTITION BY src_ip ORDER BY timestamp
    RANGE BETWEEN INTERVAL '{WINDOW * 60 - 1}.999999 seconds' PRECEDING AND CURRENT ROW) AS n
  FROM fw WHERE action = 'BLOCK' AND dst_port IN (22, 23, 3389)
),
burst_hits AS (SELECT src_ip, min(timestamp) AS hit FROM burst_counts WHERE n >= 6 GROUP BY src_ip),
burst AS (
  SELECT src_ip, hit, {SETS} FROM burst_counts JOIN burst_hits USING (src_ip)
  WHERE timestamp > hit - INTERVAL '{WINDOW} minutes' AND timestamp <= hit GROUP BY src_ip, hit
),
burst_alerts AS (
  {_flat("Repeated blocked connections", "Medium", WINDOW, 30, SEVERAL, "hit", "6", "event_count", "'global_config'", "NULL")}
  FROM burst
)"""
PORTS = _scan("pscan", "dst_port", _global(12)) + f""",
pscan_alerts AS (
  {_flat("Port scan", "Low", WINDOW, 25, SEVERAL, "hit", "threshold", "len(ports)")} FROM pscan
)"""
HOSTS = _scan("hscan", "dst_ip", _global(16)) + f""",
hscan_alerts AS (
  {_flat("Host scan", "Low", WINDOW, 20, "'multiple'", "hit", "threshold", "len(dsts)")} FROM hscan
)"""
LIMIT = "lim AS (SELECT greatest(quantile_cont(bytes_sent, 0.99), 10000000) AS lim FROM fw)"
LARGE = LIMIT + f""",
large AS (
  SELECT timestamp, src_ip, dst_ip, arg_min(dst_port, row_id) AS dst_port, arg_min(bytes_sent, row_id) AS bytes_sent,
    any_value(lim) AS lim
  FROM fw CROSS JOIN lim WHERE bytes_sent >= lim GROUP BY timestamp, src_ip, dst_ip
),
large_rows AS (
  SELECT *, 1 AS event_count, timestamp AS first_seen, timestamp AS last_seen, [dst_ip] AS dsts, [dst_port] AS ports FROM large
),
large_alerts AS (
  {_flat("Large outbound transfer", "Low", 0, 20, "dst_ip", "timestamp", "floor(lim)", "bytes_sent", "'global_config'", "NULL")}
  FROM large_rows
)"""
OFF = f"""
off_rows AS (
  SELECT fw.*, bytes_sent >= floor(lim) AS is_large FROM fw CROSS JOIN lim
  WHERE hour(timestamp) < 5 AND (action = 'BLOCK' OR bytes_sent >= floor(lim) OR dst_port IN (23, 3389, 445, 1433, 3306, 5900))
),
off AS (
  SELECT src_ip, count(*) FILTER (WHERE action = 'BLOCK') AS blocked_events,
    count(*) FILTER (WHERE is_large) AS large_transfer_events, {SETS} FROM off_rows GROUP BY src_ip
),
off_alerts AS (
  {_flat("Suspicious off-hours activity", "Low", 5, 10, SEVERAL, "first_seen", "NULL", "NULL", "NULL", "NULL")} FROM off
)"""
ALERTS = ",\n".join((BURST, PORTS, HOSTS, LARGE, OFF)) + """,
united AS (
  SELECT 0 AS detector, * FROM burst_alerts UNION ALL SELECT 1, * FROM pscan_alerts UNION ALL SELECT 2, * FROM hscan_alerts
  UNION ALL SELECT 3, * FROM large_alerts UNION ALL SELECT 4, * FROM off_alerts
),
alerts AS (
  SELECT printf('ALT-%06d', row_number() OVER (ORDER BY timestamp, detector, src_ip, dst_ip)) AS alert_id,
    * EXCLUDE (detector) FROM united
)"""

SCORES = """CASE alert_type WHEN 'Repeated blocked connections' THEN 30 WHEN 'Port scan' THEN 25 WHEN 'Host scan' THEN 20
      WHEN 'Large outbound transfer' THEN 20 ELSE 10 END"""

# advice per alert type in alphabetical order of the types; texts do not repeat between types
ADVICE = {
    "Host scan": (
        "Investigate why the source contacted many systems. | Confirm whether it is an administrative or inventory tool."
        " | Inspect endpoint activity."
    ),
    "Large outbound transfer": (
        "Verify the destination. | Check whether the traffic corresponds to backup or update activity."
        " | Review the source system. | Identify the transferred data when authorized."
    ),
    "Port scan": (
        "Check whether the source is an authorized scanner. | Identify the ports contacted."
        " | Inspect other activity from the same host. | Verify whether the scan was planned."
    ),
    "Repeated blocked connections": (
        "Review authentication logs. | Check whether a successful login occurred after the failures."
        " | Confirm whether the source is an authorized system. | Review the targeted account or service."
    ),
    "Suspicious off-hours activity": (
        "Confirm whether the activity was expected during the observed time."
        " | Review related blocked connections or unusual ports."
        " | Compare the source behavior with normal business-hours activity."
    ),
}
ADVICE_ROWS = ", ".join(f"('{kind}', '{text}')" for kind, text in ADVICE.items())

# the greedy grouping follows the chain from each source's first alert to the first one more than a window later
INCIDENTS = f"""
chain AS (
  SELECT src_ip, min(timestamp) AS anchor FROM alerts GROUP BY src_ip
  UNION ALL
  SELECT c.src_ip, (SELECT min(a.timestamp) FROM alerts a
                    WHERE a.src_ip = c.src_ip AND a.timestamp > c.anchor + INTERVAL '1440 minutes') AS anchor
  FROM chain c WHERE c.anchor IS NOT NULL
),
anchored AS (
  SELECT a.*, (SELECT max(c.anchor) FROM chain c WHERE c.src_ip = a.src_ip AND c.anchor <= a.timestamp) AS anchor FROM alerts a
),
advice(alert_type, text) AS (VALUES {ADVICE_ROWS}),
types AS (
  SELECT DISTINCT src_ip, anchor, alert_type, {SCORES} AS score FROM anchored
),
type_texts AS (
  SELECT src_ip, anchor, count(*) AS kinds, string_agg(alert_type, ', ' ORDER BY alert_type) AS alert_types,
    sum(score) + CASE WHEN count(*) > 1 THEN 15 ELSE 0 END AS total,
    string_agg(alert_type || ': +' || score, ' | ' ORDER BY alert_type)
      || CASE WHEN count(*) > 1 THEN ' | Multiple alert types bonus: +15' ELSE '' END AS lines,
    string_agg(text, ' | ' ORDER BY alert_type) AS recommendations
  FROM types JOIN advice USING (alert_type) GROUP BY src_ip, anchor
),
grouped AS (
  SELECT src_ip, anchor, min(first_seen) AS start_time, max(last_seen) AS end_time, count(*) AS alert_count,
    sum(event_count) AS event_count,
    list_sort(list_distinct(flatten(list(string_split(affected_destinations, ', '))))) AS dsts,
    list_sort(list_distinct(flatten(list(string_split(affected_ports, ', '))))) AS ports
  FROM anchored GROUP BY src_ip, anchor
),
scored AS (
  SELECT *, least(total, 100) AS risk FROM grouped JOIN type_texts USING (src_ip, anchor)
),
incidents AS (
  SELECT printf('INC-%06d', row_number() OVER (ORDER BY src_ip, anchor)) AS incident_id, src_ip, start_time, end_time,
    CAST(alert_count AS BIGINT) AS alert_count, alert_types, array_to_string(dsts, ', ') AS affected_destinations,
    array_to_string(ports, ', ') AS affected_ports, CAST(event_count AS BIGINT) AS event_count,
    CAST(risk AS BIGINT) AS risk_score,
    CASE WHEN risk <= 29 THEN 'Low' WHEN risk <= 59 THEN 'Medium' WHEN risk <= 79 THEN 'High' ELSE 'Critical' END AS severity,
    lines || ' | Final score: ' || risk AS score_breakdown,
    'The source IP ' || src_ip || ' produced ' || alert_count || ' alert(s) involving ' || event_count || ' event(s). '
      || 'Observed alert type(s): ' || alert_types || '. The activity affected ' || len(dsts) || ' destination value(s). '
      || 'The activity involved ' || len(ports) || ' destination port value(s). '
      || 'These suspicious behaviors produced a risk score of ' || risk || ' out of 100 and require investigation.' AS explanation,
    recommendations
  FROM scored
)"""


def _baseline(key: str) -> str:
    """Per-asset statistics; ``key`` is the asset expression."""

    def metric(name: str, measure: str) -> str:
        return f"""
{name}_buckets AS (
  SELECT {key} AS asset_key, us // {W_US} AS bucket, {measure} AS v FROM fw GROUP BY 1, 2
),
{name}_stats AS (
  SELECT asset_key, median(v) AS med, mad(CAST(v AS DOUBLE)) AS dev FROM {name}_buckets GROUP BY 1
)"""

    return ",".join(
        (
            metric("blocked", "sum(CASE WHEN action = 'BLOCK' THEN 1 ELSE 0 END)"),
            metric("ports", "count(DISTINCT dst_port)"),
            metric("dsts", "count(DISTINCT dst_ip)"),
        )
    ) + f""",
sizes AS (SELECT {key} AS asset_key, count(*) AS event_count, quantile_cont(bytes_sent, 0.95) AS p95 FROM fw GROUP BY 1),
baseline AS (
  SELECT asset_key, event_count, blocked_stats.med AS blocked_rate_median, blocked_stats.dev AS blocked_rate_mad,
    ports_stats.med AS unique_ports_median, ports_stats.dev AS unique_ports_mad,
    dsts_stats.med AS unique_dsts_median, dsts_stats.dev AS unique_dsts_mad, p95 AS bytes_sent_p95
  FROM sizes JOIN blocked_stats USING (asset_key) JOIN ports_stats USING (asset_key) JOIN dsts_stats USING (asset_key)
)"""


ASSET = _baseline("src_ip")
SUBNET_KEY = "regexp_replace(src_ip, '[0-9]+$', '0/24')"
SUBNET = _baseline(SUBNET_KEY)
BASELINE_COLUMNS = ", ".join(
    ["asset_key", "event_count"]
    + [f"round({c}, 6) AS {c}" for c in (
        "blocked_rate_median", "blocked_rate_mad", "unique_ports_median", "unique_ports_mad", "unique_dsts_median",
        "unique_dsts_mad", "bytes_sent_p95")]
)

FEATURES = f"""
windows AS (
  SELECT src_ip, us // {W_US} AS bucket, make_timestamp((us // {W_US}) * {W_US}) AS window_start,
    count(*) AS connection_count, count(*) FILTER (WHERE action = 'BLOCK') AS blocked_count,
    count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT dst_port) AS unique_dst_ports,
    CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent_total, CAST(sum(bytes_received) AS BIGINT) AS bytes_received_total,
    avg(bytes_sent) AS average_bytes_sent, avg(bytes_received) AS average_bytes_received,
    avg(CASE WHEN protocol = 'TCP' THEN 1 ELSE 0 END) AS tcp_ratio, avg(CASE WHEN protocol = 'UDP' THEN 1 ELSE 0 END) AS udp_ratio,
    avg(CASE WHEN label IN ('normal', 'benign') THEN 1 ELSE 0 END) AS normal_label_ratio
  FROM fw GROUP BY ALL
),
features AS (
  SELECT *, blocked_count / connection_count AS blocked_ratio, hour(window_start) AS activity_hour,
    CASE WHEN hour(window_start) BETWEEN 5 AND 23 THEN 0 ELSE 1 END AS off_hours_indicator,
    normal_label_ratio = 1 AS has_reliable_normal_label
  FROM windows
)"""
FEATURE_COLUMNS = """src_ip, window_start, connection_count, blocked_count, round(blocked_ratio, 6) AS blocked_ratio,
  unique_dst_ips, unique_dst_ports, bytes_sent_total, bytes_received_total, round(average_bytes_sent, 6) AS average_bytes_sent,
  round(average_bytes_received, 6) AS average_bytes_received, round(tcp_ratio, 6) AS tcp_ratio, round(udp_ratio, 6) AS udp_ratio,
  activity_hour, off_hours_indicator, round(normal_label_ratio, 6) AS normal_label_ratio, has_reliable_normal_label"""

EXPLAINED = (
    ("unique_dst_ports", "Number of destination ports"),
    ("bytes_sent_total", "Outgoing data volume"),
    ("unique_dst_ips", "Number of destination machines"),
    ("connection_count", "Connection count"),
    ("blocked_ratio", "Blocked-connection ratio"),
    ("bytes_received_total", "Incoming data volume"),
)
SCALED = (
    "connection_count", "blocked_count", "blocked_ratio", "unique_dst_ips", "unique_dst_ports", "bytes_sent_total",
    "bytes_received_total", "average_bytes_sent", "average_bytes_received", "tcp_ratio", "udp_ratio", "activity_hour",
    "off_hours_indicator",
)
MEDIANS = "medians AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c, _ in EXPLAINED) + " FROM features)"
REASONS = "\n  UNION ALL ".join(
    [
        f"""SELECT src_ip, window_start, {place} AS place, '{label}' AS label, CAST({c} AS DOUBLE) AS v, CAST(m_{c} AS DOUBLE) AS m
  FROM features CROSS JOIN medians"""
        for place, (c, label) in enumerate(EXPLAINED)
    ]
)
EXPLANATIONS = f"""
compared AS (
  {REASONS}
),
weighted AS (
  SELECT *, CASE WHEN m > 0 THEN v / m WHEN v > 0 THEN v + 1 ELSE 1 END AS times FROM compared
),
reasons AS (
  SELECT src_ip, window_start, place, times,
    label || ' is ' || printf('%.1f', times) || ' times higher than the dataset median (' || printf('%g', v) || ' vs '
      || printf('%g', m) || ').' AS text
  FROM weighted WHERE times >= 1.5
  UNION ALL
  SELECT src_ip, window_start, 6, 2.0, 'Activity occurred outside the configured working hours.' FROM features
  WHERE off_hours_indicator = 1
),
strongest AS (
  SELECT *, row_number() OVER (PARTITION BY src_ip, window_start ORDER BY times DESC, place) AS strength FROM reasons
),
texts AS (
  SELECT src_ip, window_start, string_agg(text, ' ' ORDER BY strength) AS text FROM strongest WHERE strength <= 3 GROUP BY 1, 2
)"""
FALLBACK = (
    "The combined behavior differs from the dataset baseline; no single feature exceeded 1.5 times its median."
)

def _forest(trees: int = 200, seed: int = 42, size: int = 256, contamination: float = 0.02, threshold: float = 60) -> str:
    """Isolation forest over ``features``: samples and cuts by hash, all trees grown and walked level by level."""
    levels = max(1, (size - 1).bit_length())
    prime = 2**31 - 1
    word = "('0x' || substr({0}, {1}, 8))::BIGINT"
    values = ", ".join(f"coalesce((CAST({c} AS DOUBLE) - q_{c}[2]) / CASE WHEN q_{c}[3] - q_{c}[1] = 0 THEN 1 ELSE q_{c}[3] - q_{c}[1] END, 0)" for c in SCALED)
    quantiles = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) AS q_{c}" for c in SCALED)
    lows, highs = (", ".join(f"{f}(f[{i}])" for i in range(1, len(SCALED) + 1)) for f in ("min", "max"))
    path = "CASE WHEN {0} <= 1 THEN 0 WHEN {0} = 2 THEN 1 ELSE 2 * (ln({0} - 1) + 0.5772156649015329) - 2 * ({0} - 1) / {0} END"
    parts = [f"""
levels_of AS (SELECT {quantiles} FROM features),
scaled AS (
  SELECT src_ip, window_start, [{values}] AS f, has_reliable_normal_label AS normal, md5('{seed}|' || src_ip || '|' || epoch_us(window_start)) AS h
  FROM features CROSS JOIN levels_of
),
rows_of AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY src_ip, window_start) AS r, {word.format("h", 1)} % {prime} AS one, {word.format("h", 9)} % {prime} AS two,
    normal OR (SELECT count(*) FILTER (WHERE normal) FROM scaled) < 5 AS trains FROM scaled
),
trees AS (
  SELECT tree, {word.format("h", 1)} % {prime - 1} + 1 AS a, {word.format("h", 9)} % {prime - 1} + 1 AS b, {word.format("h", 17)} % {prime} AS c
  FROM (SELECT tree, md5('{seed}:' || tree) AS h FROM range({trees}) t(tree))
),
drawn AS (
  SELECT tree, r, row_number() OVER (PARTITION BY tree ORDER BY (one * a % {prime} + two * b % {prime} + c) % {prime}, r) AS place
  FROM rows_of CROSS JOIN trees WHERE trains
),
at_0 AS MATERIALIZED (
  SELECT t.tree, r.r, r.f, 1::BIGINT AS node, coalesce(d.place <= {size}, false) AS sampled
  FROM rows_of r CROSS JOIN trees t LEFT JOIN drawn d ON d.tree = t.tree AND d.r = r.r
),
depths AS (SELECT ceil(log2(greatest(count(*) FILTER (WHERE sampled), 2)))::INTEGER AS most FROM at_0 WHERE tree = 0)"""]
    for level in range(levels + 1):
        parts.append(f"""
nodes_{level} AS MATERIALIZED (
  SELECT tree, node, n, low, high, list_filter(range(1, {len(SCALED) + 1}), lambda i: high[i] > low[i]) AS varying, md5('{seed}:' || tree || ':' || node) AS h
  FROM (SELECT tree, node, count(*) AS n, [{lows}] AS low, [{highs}] AS high FROM at_{level} WHERE sampled GROUP BY tree, node)
),
cuts_{level} AS MATERIALIZED (
  SELECT tree, node, n, CASE WHEN n > 1 AND len(varying) > 0 AND {level} < most THEN feature END AS feature,
    low[feature] + ({word.format("h", 9)} / 4294967296.0::DOUBLE) * (high[feature] - low[feature]) AS cut
  FROM (SELECT *, varying[({word.format("h", 1)} * len(varying) >> 32) + 1] AS feature FROM nodes_{level}) CROSS JOIN depths
),
ended_{level} AS (
  SELECT tree, r, {level} + {path.format("n")} AS length FROM at_{level} JOIN cuts_{level} USING (tree, node) WHERE feature IS NULL
),
at_{level + 1} AS MATERIALIZED (
  SELECT tree, r, f, 2 * node + CASE WHEN f[feature] <= cut THEN 0 ELSE 1 END AS node, sampled
  FROM at_{level} JOIN cuts_{level} USING (tree, node) WHERE feature IS NOT NULL
)""")
    ended = " UNION ALL ".join(f"SELECT * FROM ended_{level}" for level in range(levels + 1))
    parts.append(f"""
sampled_rows AS (SELECT count(*)::DOUBLE AS n FROM at_0 WHERE tree = 0 AND sampled),
raw AS (
  SELECT src_ip, window_start, trains,
    round(pow(2, -(total / {trees}) / greatest((SELECT {path.format("n")} FROM sampled_rows), 1e-12)), 12) AS raw_score
  FROM rows_of JOIN (SELECT r, sum(length) AS total FROM ({ended}) GROUP BY r) USING (r)
),
bounds AS (SELECT min(raw_score) AS low, max(raw_score) AS high, quantile_cont(-raw_score, {contamination}) FILTER (WHERE trains) AS cut FROM raw),
judged AS (
  SELECT src_ip, window_start, raw_score, CASE WHEN high > low THEN round_even((raw_score - low) / (high - low) * 100, 2) ELSE 0 END AS score,
    CASE WHEN -raw_score < cut THEN -1 ELSE 1 END AS prediction
  FROM raw CROSS JOIN bounds
),
anomalies AS (
  SELECT f.*, j.raw_score, j.score, j.prediction, j.prediction = -1 AND j.score >= {threshold} AS is_ai_anomaly, coalesce(t.text, '{FALLBACK}') AS ai_explanation
  FROM judged j JOIN features f USING (src_ip, window_start) LEFT JOIN texts t USING (src_ip, window_start)
)""")
    return ",".join(parts).lstrip()


FOREST = ",\n".join((FEATURES, MEDIANS, EXPLANATIONS, _forest()))

COUNTS = """count(*) AS total_events, count(*) FILTER (WHERE action = 'ALLOW') AS allowed_events,
  count(*) FILTER (WHERE action = 'BLOCK') AS blocked_events,
  round(count(*) FILTER (WHERE action = 'BLOCK') / count(*), 6) AS blocked_ratio,
  CAST(sum(bytes_sent) AS BIGINT) AS bytes_sent_total, CAST(sum(bytes_received) AS BIGINT) AS bytes_received_total"""

SERVICE = """CASE dst_port WHEN 22 THEN 'SSH' WHEN 23 THEN 'Telnet' WHEN 53 THEN 'DNS' WHEN 443 THEN 'HTTPS' WHEN 445 THEN 'SMB'
  WHEN 3389 THEN 'RDP' WHEN 8080 THEN 'HTTP alternative' ELSE 'Unknown' END"""

THRESHOLDS = """
levels AS (
  SELECT asset_key, event_count, 'blocked_rate' AS metric, blocked_rate_median AS level, 6.0::DOUBLE AS fallback FROM baseline
  UNION ALL SELECT asset_key, event_count, 'unique_ports', unique_ports_median, 12.0 FROM baseline
  UNION ALL SELECT asset_key, event_count, 'unique_dsts', unique_dsts_median, 16.0 FROM baseline
  UNION ALL SELECT asset_key, event_count, 'bytes_sent', bytes_sent_p95, 10000000.0 FROM baseline
),
effective AS (
  SELECT asset_key, metric, event_count >= 20 AND level > 0 AS known,
    CAST(CASE WHEN event_count >= 20 AND level > 0 THEN greatest(5.0, level * 2.0) ELSE fallback END AS DOUBLE) AS threshold, level
  FROM levels
)"""

OWN_PORTS = """JOIN (
    SELECT asset_key AS src_ip, CAST(floor(threshold) AS BIGINT) AS threshold,
      CASE WHEN known THEN 'per_asset_baseline' ELSE 'global_config' END AS threshold_source,
      CASE WHEN known THEN round_even(level, 2) END AS asset_baseline_value
    FROM effective WHERE metric = 'unique_ports') own USING (src_ip)"""


def _own(metric: str, fallback: str = "threshold") -> str:
    """Each source's own threshold of a metric, else the global one."""
    return OWN_PORTS.replace("unique_ports", metric).replace("floor(threshold)", f"CASE WHEN known THEN floor(threshold) ELSE {fallback} END")


# Alerts of a run with baselining by the threshold that they passed.
MODES = ",\n".join((
    LIMIT, OFF, _scan("ownp", "dst_port", _own("unique_ports")), _scan("ownh", "dst_ip", _own("unique_dsts")),
)) + f""",
own_burst AS (
  SELECT src_ip, threshold, threshold_source, count(*) OVER (PARTITION BY src_ip ORDER BY timestamp
    RANGE BETWEEN INTERVAL '{WINDOW * 60 - 1}.999999 seconds' PRECEDING AND CURRENT ROW) AS n
  FROM fw {_own("blocked_rate")} WHERE action = 'BLOCK' AND dst_port IN (22, 23, 3389)
),
own_large AS (
  SELECT timestamp, src_ip, dst_ip, arg_min(CASE WHEN known THEN 'per_asset_baseline' ELSE 'global_config' END, row_id) AS threshold_source
  FROM fw CROSS JOIN lim JOIN effective e ON e.asset_key = src_ip AND metric = 'bytes_sent'
  WHERE bytes_sent >= CASE WHEN known THEN threshold ELSE lim END GROUP BY timestamp, src_ip, dst_ip
),
sources AS (
  SELECT threshold_source FROM ownp UNION ALL SELECT threshold_source FROM ownh UNION ALL SELECT threshold_source FROM own_large
  UNION ALL SELECT any_value(threshold_source) FROM own_burst WHERE n >= threshold GROUP BY src_ip UNION ALL SELECT 'global_config' FROM off
)"""

TIMELINE = """
related AS (
  SELECT incident_id, fw.* FROM fw JOIN incidents i ON fw.src_ip = i.src_ip AND fw.timestamp BETWEEN i.start_time AND i.end_time
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY timestamp, row_id) AS a,
    row_number() OVER (PARTITION BY incident_id ORDER BY timestamp DESC, row_id DESC) AS z FROM related
),
timeline AS (
  SELECT incident_id, timestamp AS time, 'First related event' AS activity,
    action || ' ' || protocol || ' to ' || dst_ip || ':' || dst_port AS details FROM ranked WHERE a = 1
  UNION ALL
  SELECT incident_id, timestamp, 'Last related event', action || ' ' || protocol || ' to ' || dst_ip || ':' || dst_port
  FROM ranked WHERE z = 1
  UNION ALL
  SELECT incident_id, a.timestamp, a.alert_type || ' threshold reached',
    a.event_count || ' event(s), score +' || a.score_contribution
  FROM alerts a JOIN incidents i ON a.src_ip = i.src_ip AND a.timestamp BETWEEN i.start_time AND i.end_time
)"""

SPEC_SOURCES = "('10.0.0.0', '10.0.1.5', '10.0.2.10', '10.0.3.3')"
SPEC_TYPES = "('Port scan', 'Large outbound transfer')"
SHORT_TIME = (
    "CASE WHEN microsecond({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%d %H:%M:%S') "
    "ELSE strftime({0}, '%Y-%m-%d %H:%M:%S.%f') END"
)


def statements() -> dict[str, str]:
    def over(*parts: str, select: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select

    own_alerts = _flat("Port scan", "Low", WINDOW, 25, SEVERAL, "hit", "threshold", "len(ports)")
    subnet_alerts = _flat(
        "Large outbound transfer", "Low", 0, 20, "dst_ip", "timestamp", "floor(threshold)", "bytes_sent"
    )
    subnet_rows = f"""
large AS (
  SELECT timestamp, src_ip, dst_ip, arg_min(dst_port, row_id) AS dst_port, arg_min(bytes_sent, row_id) AS bytes_sent,
    any_value(threshold) AS threshold, any_value(CASE WHEN known THEN 'per_asset_baseline' ELSE 'global_config' END) AS threshold_source,
    any_value(CASE WHEN known THEN round_even(level, 2) END) AS asset_baseline_value
  FROM fw JOIN effective e ON e.asset_key = {SUBNET_KEY} AND metric = 'bytes_sent'
  WHERE bytes_sent >= threshold GROUP BY timestamp, src_ip, dst_ip
),
large_rows AS (
  SELECT *, 1 AS event_count, timestamp AS first_seen, timestamp AS last_seen, [dst_ip] AS dsts, [dst_port] AS ports FROM large
)"""
    cards = f"""
top AS (
  SELECT *, row_number() OVER (ORDER BY risk_score DESC, incident_id) AS incident_rank FROM incidents
  QUALIFY incident_rank <= 5
),
card AS (
  SELECT incident_rank, list_concat([
    incident_id || ' - ' || severity || ' - Risk ' || risk_score || '/100',
    'Source IP: ' || src_ip,
    'Window: ' || {SHORT_TIME.format("start_time")} || ' to ' || {SHORT_TIME.format("end_time")},
    'Alert types: ' || alert_types,
    'Affected destinations: ' || affected_destinations,
    'Affected ports: ' || affected_ports,
    'Explanation:', explanation,
    'Risk score breakdown:', replace(score_breakdown, ' | ', '; '),
    'Recommendations:'], list_transform(string_split(recommendations, ' | '), lambda r: '- ' || r)) AS lines
  FROM top
)"""
    filtered = f"""
  SELECT 'logs' AS view, src_ip, count(*) AS n FROM fw
  WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND src_ip IN {SPEC_SOURCES} GROUP BY src_ip
  UNION ALL
  SELECT 'alerts', src_ip, count(*) FROM alerts
  WHERE CAST(timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND src_ip IN {SPEC_SOURCES}
    AND severity IN ('Low', 'Medium') AND alert_type IN {SPEC_TYPES} GROUP BY src_ip
  UNION ALL
  SELECT 'incidents', src_ip, count(*) FROM incidents
  WHERE CAST(start_time AS DATE) <= DATE '2024-01-20' AND CAST(end_time AS DATE) >= DATE '2024-01-05'
    AND src_ip IN {SPEC_SOURCES} AND severity IN ('Low', 'Medium')
    AND (contains(alert_types, 'Port scan') OR contains(alert_types, 'Large outbound transfer')) GROUP BY src_ip"""
    found = (LOGS, ALERTS)
    full = (LOGS, ALERTS, INCIDENTS)
    return {
        "schema_mapping": over(RAW, select="""
  SELECT proto AS protocol, action, count(t) AS timestamps, count(src) AS sources, count(DISTINCT dst) AS targets,
    count(label) AS labels FROM raw_all GROUP BY proto, action"""),
        "clean_logs": over(RAW, select="""
  SELECT row_id, timestamp, src_ip, dst_ip, CAST(trunc(sp) AS INTEGER) AS src_port, CAST(trunc(dp) AS INTEGER) AS dst_port,
    protocol, action, bytes_sent, bytes_received, label FROM checked WHERE NOT (bad_time OR bad_ip OR bad_port OR bad_bytes)"""),
        "cleaning_summary": over(RAW, select="SELECT * FROM summary"),
        "action_normalisation": over(LOGS, select="SELECT action, protocol, count(*) AS events FROM fw GROUP BY 1, 2"),
        "service_names": over(LOGS, select=f"SELECT {SERVICE} AS service, count(*) AS events FROM fw GROUP BY 1"),
        "top_source_ips": over(*full, select=f"""
  SELECT t.*, coalesce(a.n, 0) AS alert_count, coalesce(i.risk, 0) AS highest_incident_risk_score FROM (
    SELECT src_ip, {COUNTS}, count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT dst_port) AS unique_dst_ports
    FROM fw GROUP BY src_ip) t
  LEFT JOIN (SELECT src_ip, count(*) AS n FROM alerts GROUP BY 1) a USING (src_ip)
  LEFT JOIN (SELECT src_ip, max(risk_score) AS risk FROM incidents GROUP BY 1) i USING (src_ip)
  ORDER BY total_events DESC, src_ip LIMIT 10"""),
        "top_destination_ports": over(LOGS, select=f"""
  SELECT dst_port, {SERVICE} AS service_name, {COUNTS}, count(DISTINCT src_ip) AS unique_source_ips,
    count(DISTINCT dst_ip) AS unique_destination_ips FROM fw GROUP BY dst_port ORDER BY total_events DESC, dst_port LIMIT 10"""),
        "top_destination_ips": over(LOGS, select=f"""
  SELECT dst_ip, {COUNTS}, count(DISTINCT src_ip) AS unique_source_ips FROM fw GROUP BY dst_ip
  ORDER BY total_events DESC, dst_ip LIMIT 10"""),
        "asset_key": over(LOGS, select="""
  SELECT '10.0.' || CAST((CAST(string_split(src_ip, '.')[3] AS INTEGER) // 4) * 4 AS VARCHAR) || '.0/22' AS network,
    count(*) AS events FROM fw GROUP BY 1"""),
        "source_quantiles": over(LOGS, select="""
  SELECT src_ip, p, round(q, 3) AS quantile, total FROM (
    SELECT src_ip, unnest([0.25, 0.5, 0.75, 0.99])::DOUBLE AS p,
      unnest(quantile_cont(bytes_sent, [0.25, 0.5, 0.75, 0.99])) AS q, count(*) AS total FROM fw GROUP BY src_ip)"""),
        "asset_baseline": over(LOGS, ASSET, select=f"SELECT {BASELINE_COLUMNS} FROM baseline"),
        "subnet_baseline": over(LOGS, SUBNET, select=f"SELECT {BASELINE_COLUMNS} FROM baseline"),
        "effective_thresholds": over(LOGS, ASSET, THRESHOLDS, select="""
  SELECT asset_key, metric, round(threshold, 6) AS threshold,
    CASE WHEN known THEN 'per_asset_baseline' ELSE 'global_config' END AS threshold_source,
    CASE WHEN known THEN round(level, 6) END AS asset_baseline_value FROM effective"""),
        "blocked_burst": over(LOGS, BURST, select="SELECT * FROM burst_alerts"),
        "port_scan": over(LOGS, PORTS, select="SELECT * FROM pscan_alerts"),
        "host_scan": over(LOGS, HOSTS, select="SELECT * FROM hscan_alerts"),
        "large_transfer": over(LOGS, LARGE, select="SELECT * FROM large_alerts"),
        "off_hours": over(LOGS, LIMIT, OFF, select="""
  SELECT a.* EXCLUDE (threshold_source, effective_threshold, observed_value, asset_baseline_value),
    '00:00-05:00' AS off_hours_window, blocked_events,
    array_to_string(list_filter(ports, lambda p: p IN (23, 445, 1433, 3306, 3389, 5900)), ', ') AS rare_ports,
    large_transfer_events FROM off_alerts a JOIN off USING (src_ip)"""),
        "baseline_port_scan": over(LOGS, ASSET, THRESHOLDS, _scan("own", "dst_port", OWN_PORTS).replace("own_counts", "opc")
                                   .replace("own_hits", "oph").replace("own AS (", "opw AS ("),
                                   select=f"{own_alerts} FROM opw"),
        "subnet_large_transfer": over(LOGS, SUBNET, THRESHOLDS, subnet_rows, select=f"{subnet_alerts} FROM large_rows"),
        "all_alerts": over(*found, select="SELECT * FROM alerts"),
        "alert_severities": over(*found, select="""
  SELECT alert_type, max(score_contribution) AS score,
    CASE WHEN max(score_contribution) <= 29 THEN 'Low' ELSE 'Medium' END AS severity,
    CAST(CASE WHEN max(score_contribution) <= 29 THEN 1 ELSE 2 END AS BIGINT) AS severity_rank FROM alerts GROUP BY 1"""),
        "incidents": over(*full, select="SELECT * FROM incidents"),
        "incident_scores": over(*full, select="SELECT incident_id, risk_score, severity, score_breakdown FROM incidents"),
        "behaviour_features": over(LOGS, FEATURES, select=f"SELECT {FEATURE_COLUMNS} FROM features"),
        "baseline_features": over(LOGS, FEATURES, ASSET, select=f"""
  SELECT {FEATURE_COLUMNS.replace("src_ip,", "f.src_ip AS src_ip,", 1)},
    round(connection_count / b.event_count, 6) AS connection_count_vs_baseline_ratio,
    round(CASE WHEN unique_ports_median > 0 THEN unique_dst_ports / unique_ports_median ELSE 1 END, 6) AS unique_ports_vs_baseline_ratio
  FROM features f JOIN baseline b ON b.asset_key = f.src_ip"""),
        "feature_medians": over(LOGS, FEATURES, MEDIANS, select="SELECT "
                                + ", ".join(f"round(CAST(m_{c} AS DOUBLE), 6) AS {c}" for c, _ in EXPLAINED) + " FROM medians"),
        "anomaly_explanations": over(LOGS, FEATURES, MEDIANS, EXPLANATIONS, select=f"""
  SELECT src_ip, window_start, coalesce(text, '{FALLBACK}') AS ai_explanation
  FROM features LEFT JOIN texts USING (src_ip, window_start)"""),
        "isolation_forest": over(LOGS, FOREST, select=f"""
  SELECT {FEATURE_COLUMNS}, score AS ai_anomaly_score, round(raw_score, 6) AS raw_anomaly_score,
    prediction AS isolation_forest_prediction, is_ai_anomaly, ai_explanation FROM anomalies"""),
        "anomaly_view": over(LOGS, FOREST, select=f"""
  SELECT src_ip, window_start, connection_count, unique_dst_ips, unique_dst_ports, round(blocked_ratio, 6) AS blocked_ratio,
    bytes_sent_total, score AS ai_anomaly_score, is_ai_anomaly, ai_explanation FROM anomalies
  WHERE is_ai_anomaly OR NOT (SELECT bool_or(is_ai_anomaly) FROM anomalies)
  QUALIFY is_ai_anomaly OR row_number() OVER (ORDER BY score DESC, src_ip, window_start) <= 20"""),
        "anomaly_chart": over(LOGS, FOREST, select="""
  SELECT src_ip || ' | ' || strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_label, score AS ai_anomaly_score FROM anomalies
  ORDER BY score DESC, src_ip, window_start LIMIT 30"""),
        "anomalies_at_threshold": over(LOGS, FOREST, select="""
  SELECT src_ip, window_start, score AS ai_anomaly_score FROM anomalies WHERE prediction = -1 AND score >= 85"""),
        "run_summary": over(CLEANED, ALERTS, INCIDENTS, FOREST, select="""
  SELECT original_row_count AS input_rows, final_row_count AS cleaned_rows, (SELECT count(*) FROM alerts) AS alerts_detected,
    (SELECT count(*) FROM incidents) AS incidents_created, (SELECT count(*) FROM anomalies WHERE is_ai_anomaly) AS ai_anomalies,
    (SELECT max(score) FROM anomalies) AS highest_ai_score,
    (SELECT src_ip FROM fw GROUP BY src_ip ORDER BY count(*) DESC, src_ip LIMIT 1) AS most_active_source_ip,
    (SELECT CAST(dst_port AS VARCHAR) FROM fw GROUP BY dst_port ORDER BY count(*) DESC, dst_port LIMIT 1) AS most_frequent_destination_port,
    false AS baselining_enabled, duplicate_rows_removed, invalid_timestamps, invalid_ip_addresses, invalid_ports, invalid_bytes, missing_values,
    'timestamp=Generated Time; src_ip=Source address; dst_ip=Destination address; src_port=Source Port; dst_port=Destination Port; '
      || 'protocol=src__Protocol; action=src__Action; bytes_sent=Bytes Sent; bytes_received=Bytes Received' AS mapped_columns,
    '' AS unavailable_columns, '' AS skipped_detectors FROM summary"""),
        "partial_alerts": over(PARTIAL, PORTS, HOSTS, select="SELECT * FROM pscan_alerts UNION ALL SELECT * FROM hscan_alerts"),
        "partial_features": over(PARTIAL, FEATURES, select=f"SELECT {FEATURE_COLUMNS} FROM features"),
        "partial_mapping": over(PARTIAL, select="""
  SELECT count(*) AS events, 'timestamp, src_ip, dst_ip, dst_port' AS mapped,
    'src_port, protocol, action, bytes_sent, bytes_received' AS unavailable,
    'Repeated blocked connections, Large outbound transfer, Suspicious off-hours activity' AS skipped FROM fw"""),
        "cleaned_columns": over(CLEANED, select="SELECT * EXCLUDE (us) FROM fw"),
        "csv_log": over(CLEANED, select="SELECT * EXCLUDE (us) FROM fw"),
        "json_lines_log": over(CLEANED, select="SELECT * EXCLUDE (us) FROM fw"),
        "incident_labels": over(*full, select="""
  SELECT incident_id || ' | ' || severity || ' | risk ' || risk_score || ' | ' || src_ip AS label FROM incidents"""),
        "port_labels": over(LOGS, select=f"""
  SELECT dst_port || ' - ' || {SERVICE} AS port_label, count(*) AS total_events FROM fw GROUP BY dst_port
  ORDER BY total_events DESC, dst_port LIMIT 10"""),
        "incident_view": over(*full, select="""
  SELECT incident_id, src_ip, start_time, end_time, risk_score, severity, alert_types, alert_count FROM incidents"""),
        "incident_lookup": over(*full, select="""
  SELECT incident_id, src_ip, start_time, end_time, risk_score, explanation FROM incidents WHERE incident_id = 'INC-000007'"""),
        "baseline_lookup": over(LOGS, ASSET, select=f"SELECT {BASELINE_COLUMNS} FROM baseline WHERE asset_key = '10.0.1.5'"),
        "destination_networks": over(CLEANED, select="""
  SELECT CASE WHEN contains(dst_ip, ':') THEN '2001:d00::/24' ELSE regexp_replace(dst_ip, '[0-9]+$', '0/24') END AS network, count(*) AS events
  FROM fw GROUP BY 1"""),
        "threshold_modes": over(LOGS, ASSET, THRESHOLDS, MODES, select="""
  SELECT CASE threshold_source WHEN 'per_asset_baseline' THEN 'per-asset' ELSE 'global' END AS threshold_mode, count(*) AS alerts
  FROM sources GROUP BY 1"""),
        "robust_scaling": over(LOGS, FEATURES, select="SELECT src_ip, window_start, " + ", ".join(
            f"round((x.{c} - q_{c}[2]) / coalesce(nullif(q_{c}[3] - q_{c}[1], 0), 1), 5) AS {c}" for c in SCALED)
            + " FROM features x CROSS JOIN (SELECT "
            + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]) AS q_{c}" for c in SCALED) + " FROM features)"),
        "kpi_summary": over(*full, select="""
  SELECT count(*) AS events, count(*) FILTER (WHERE action = 'ALLOW') AS allowed, count(*) FILTER (WHERE action = 'BLOCK') AS blocked,
    (SELECT count(*) FROM alerts) AS alerts, (SELECT count(*) FROM incidents) AS incidents,
    (SELECT count(*) FROM incidents WHERE severity = 'Critical') AS critical_incidents,
    (SELECT coalesce(max(risk_score), 0) FROM incidents) AS highest_risk FROM fw"""),
        "severity_histogram": over(*full, select="""
  SELECT s.severity, count(i.incident_id) AS count FROM (VALUES ('Low'), ('Medium'), ('High'), ('Critical')) s(severity)
  LEFT JOIN incidents i ON i.severity = s.severity GROUP BY 1"""),
        "action_counts": over(LOGS, select="SELECT action, count(*) AS count FROM fw GROUP BY action"),
        "events_over_time": over(LOGS, select="""
  SELECT d.day AS bin_start, 'day' AS bin_unit, count(fw.row_id) AS events
  FROM (SELECT unnest(generate_series(date_trunc('day', min(timestamp)), max(timestamp), INTERVAL 1 DAY))::TIMESTAMP AS day FROM fw) d
  LEFT JOIN fw ON date_trunc('day', fw.timestamp) = d.day GROUP BY 1"""),
        "observed_counts": over(LOGS, select="""
  SELECT count(DISTINCT src_ip) AS source_ips, count(DISTINCT dst_port) AS destination_ports, 0.0::DOUBLE AS highest_ai_score FROM fw"""),
        "date_domain": over(LOGS, select="""
  SELECT CAST(min(timestamp) AS DATE) AS min_date, CAST(max(timestamp) AS DATE) AS max_date FROM fw"""),
        "source_domain": over(LOGS, select="SELECT DISTINCT src_ip FROM fw"),
        "filtered_views": over(*full, select=filtered),
        "alert_search": over(*found, select="SELECT alert_id, alert_type, src_ip FROM alerts WHERE alert_type ILIKE '%scan%'"),
        "evidence_fields": over(*found, select="""
  SELECT timestamp, src_ip, alert_type, severity, 'global' AS threshold_mode,
    CAST(effective_threshold AS DOUBLE) AS effective_threshold, CAST(observed_value AS DOUBLE) AS observed_value, event_count,
    CAST(score_contribution AS INTEGER) AS score_contribution FROM alerts"""),
        "incident_alerts": over(*full, select="""
  SELECT incident_id, alert_id, timestamp, alert_type FROM alerts a JOIN incidents i
  ON a.src_ip = i.src_ip AND a.timestamp BETWEEN i.start_time AND i.end_time"""),
        "incident_events": over(*full, select="""
  SELECT incident_id, timestamp, fw.src_ip, dst_ip, dst_port, protocol, action, bytes_sent, bytes_received, row_id
  FROM fw JOIN incidents i ON fw.src_ip = i.src_ip AND fw.timestamp BETWEEN i.start_time AND i.end_time"""),
        "incident_timeline": over(*full, TIMELINE, select="SELECT * FROM timeline"),
        "recommendation_items": over(*full, select="""
  SELECT incident_id, CAST(unnest(generate_series(0, len(items) - 1)) AS INTEGER) AS place, unnest(items) AS recommendation
  FROM (SELECT incident_id, string_split(recommendations, ' | ') AS items FROM incidents)"""),
        "report_cleaning_table": over(RAW, select="""
  SELECT 'Original rows' AS item, original_row_count AS value FROM summary
  UNION ALL SELECT 'Final rows', final_row_count FROM summary
  UNION ALL SELECT 'Duplicates removed', duplicate_rows_removed FROM summary
  UNION ALL SELECT 'Invalid timestamps', invalid_timestamps FROM summary
  UNION ALL SELECT 'Invalid IP addresses', invalid_ip_addresses FROM summary
  UNION ALL SELECT 'Invalid ports', invalid_ports FROM summary"""),
        "report_top_incidents": over(*full, select="""
  SELECT incident_id, src_ip, start_time, end_time, risk_score, severity, alert_types, alert_count FROM incidents
  ORDER BY risk_score DESC, incident_id LIMIT 10"""),
        "report_first_alerts": over(*found, select="""
  SELECT timestamp, src_ip, alert_type, severity, event_count, CAST(score_contribution AS INTEGER) AS score_contribution
  FROM alerts ORDER BY timestamp, alert_id LIMIT 10"""),
        "report_sources": over(*found, select=f"""
  SELECT t.*, coalesce(a.n, 0) AS alert_count FROM (
    SELECT src_ip, {COUNTS}, count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT dst_port) AS unique_dst_ports
    FROM fw GROUP BY src_ip) t
  LEFT JOIN (SELECT src_ip, count(*) AS n FROM alerts GROUP BY 1) a USING (src_ip)
  ORDER BY total_events DESC, src_ip LIMIT 10"""),
        "report_ports": over(LOGS, select=f"""
  SELECT dst_port, {SERVICE} AS service_name, {COUNTS}, count(DISTINCT src_ip) AS unique_source_ips FROM fw
  GROUP BY dst_port ORDER BY total_events DESC, dst_port LIMIT 10"""),
        "report_destinations": over(LOGS, select=f"""
  SELECT dst_ip, {COUNTS}, count(DISTINCT src_ip) AS unique_source_ips FROM fw GROUP BY dst_ip
  ORDER BY total_events DESC, dst_ip LIMIT 10"""),
        "incident_cards": over(*full, cards, select="""
  SELECT CAST(incident_rank AS INTEGER) AS incident_rank, CAST(unnest(generate_series(0, len(lines) - 1)) AS INTEGER) AS line_no,
    unnest(lines) AS line FROM card"""),
    }
