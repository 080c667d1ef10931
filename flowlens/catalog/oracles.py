"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from flowlens.catalog import fixtures
from flowlens.catalog.queries import DIGITS, LINEAR_WEIGHTS
from flowlens.config import (
    ABLATION_STAGES,
    ATTACK_LABELS,
    CATEGORICAL_COLUMNS,
    CLASS_SEVERITY,
    CLASSES,
    FEATURE_COLUMNS,
    FLOW_COLUMNS,
    NUMERIC_COLUMNS,
    SEVERITY_WEIGHT,
    THETA_GRID,
    stage_features,
)


def _texts(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def _case(column: str, pairs: dict) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else repr(v)

    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in pairs.items()) + " END"


CLASS_LIST = _texts(CLASSES)


def _name(column: str) -> str:
    return f"{CLASS_LIST}[{column} + 1]"


def _r(expression: str, alias: str, digits: int | None = None) -> str:
    digits = digits or DIGITS.get(alias, 6)
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0 AS {alias}"


PACKETS = "packets AS (" + fixtures.duckdb_text(fixtures.PACKETS) + ")"
SCORED = "scored AS (" + fixtures.duckdb_text(fixtures.SCORED) + ")"

KEYED = """
k0 AS (SELECT *, protocol IN ('TCP','UDP') AND src_port IS NOT NULL AND dst_port IS NOT NULL AS pk FROM packets),
k1 AS (SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND (NOT pk OR src_port <= dst_port)) AS fwd FROM k0),
k2 AS (SELECT *, CASE WHEN fwd THEN src_ip ELSE dst_ip END AS a_ip, CASE WHEN fwd THEN dst_ip ELSE src_ip END AS b_ip,
  CASE WHEN fwd THEN src_port ELSE dst_port END AS a_port, CASE WHEN fwd THEN dst_port ELSE src_port END AS b_port,
  CASE protocol WHEN 'TCP' THEN 120000000 WHEN 'UDP' THEN 60000000 ELSE 30000000 END AS tmo,
  coalesce(protocol = 'TCP' AND (tcp_flags LIKE '%F%' OR tcp_flags LIKE '%R%'), false) AS closes FROM k1),
keyed AS (SELECT *, concat_ws('|', a_ip, CASE WHEN pk THEN CAST(a_port AS VARCHAR) ELSE '-' END,
    b_ip, CASE WHEN pk THEN CAST(b_port AS VARCHAR) ELSE '-' END, protocol) AS fk,
  row_number() OVER (ORDER BY t_us, seq) AS ord, lag(t_us) OVER (ORDER BY t_us, seq) AS gprev FROM k2)
"""


def _flow_ctes(idle: str = "t_us") -> str:
    return f"""
{PACKETS}, {KEYED},
lagged AS (SELECT *, lag(t_us) OVER w AS kprev, lag(closes) OVER w AS kclose FROM keyed
  WINDOW w AS (PARTITION BY fk ORDER BY t_us, seq)),
marked AS (SELECT *, CASE WHEN kprev IS NULL OR {idle} - kprev >= tmo OR kclose THEN 1 ELSE 0 END AS is_new FROM lagged),
numbered AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY fk ORDER BY t_us, seq) AS BIGINT) AS flow_no FROM marked),
hist AS (SELECT *, row_number() OVER (PARTITION BY fk, flow_no ORDER BY t_us DESC, seq DESC) AS from_end FROM numbered),
flows AS (SELECT md5(concat_ws('#', fk, min(t_us), arg_min(seq, (t_us, seq)))) AS flow_id, fk, flow_no,
  any_value(a_ip) AS a_ip, any_value(b_ip) AS b_ip, any_value(a_port) AS a_port, any_value(b_port) AS b_port,
  any_value(protocol) AS protocol, any_value(tmo) AS tmo, bool_or(closes) AS closed,
  min(t_us) AS start_us, max(t_us) AS last_us, arg_min(seq, ord) AS start_seq, min(ord) AS first_ord, max(ord) AS last_ord,
  count(*) AS packet_count, CAST(sum(packet_length) AS BIGINT) AS byte_count,
  count(*) FILTER (fwd) AS fwd_packets, CAST(coalesce(sum(packet_length) FILTER (fwd), 0) AS BIGINT) AS fwd_bytes,
  count(*) FILTER (NOT fwd) AS rev_packets, CAST(coalesce(sum(packet_length) FILTER (NOT fwd), 0) AS BIGINT) AS rev_bytes,
  count(tls_sni) AS n_tls, coalesce(arg_min(tls_sni, ord) FILTER (tls_sni IS NOT NULL), '') AS tls_sni,
  coalesce(arg_max(dns_record_type, ord) FILTER (dns_query_name IS NOT NULL), '') AS dns_record_type,
  coalesce(avg(length(dns_query_name)), 0.0) AS dns_query_length
  FROM hist GROUP BY fk, flow_no),
reasoned AS (SELECT *, CASE WHEN closed THEN 'tcp_close'
   WHEN (SELECT max(t_us) FROM packets) - last_us >= tmo THEN 'timeout' ELSE 'flush' END AS finalize_reason FROM flows),
sizes AS (SELECT fk, flow_no, packet_length, count(*) AS c FROM hist WHERE from_end <= 512 GROUP BY ALL),
size_entropy AS (SELECT fk, flow_no, sum(-p * log2(p)) AS entropy FROM
  (SELECT fk, flow_no, c / sum(c) OVER (PARTITION BY fk, flow_no) AS p FROM sizes) GROUP BY ALL),
gaps AS (SELECT fk, flow_no, CAST(sum(gap) AS DOUBLE) / count(gap) / 1000000 AS iat_mean,
  sqrt(CAST(count(gap) * sum(CAST(gap AS HUGEINT) * gap) - sum(gap) * sum(gap) AS DOUBLE)) / count(gap) / 1000000 AS iat_std FROM
  (SELECT fk, flow_no, t_us - lag(t_us) OVER (PARTITION BY fk, flow_no ORDER BY t_us, seq) AS gap
   FROM hist WHERE from_end <= 512) GROUP BY fk, flow_no),
chars AS (SELECT dns_query_name, unnest(string_split(dns_query_name, '')) AS ch
  FROM (SELECT DISTINCT dns_query_name FROM packets WHERE dns_query_name IS NOT NULL)),
name_entropy AS (SELECT dns_query_name, sum(-p * log2(p)) AS e FROM
  (SELECT dns_query_name, c / sum(c) OVER (PARTITION BY dns_query_name) AS p FROM
    (SELECT dns_query_name, ch, count(*) AS c FROM chars GROUP BY dns_query_name, ch)) GROUP BY dns_query_name),
dns AS (SELECT fk, flow_no, avg(e) AS dns_entropy FROM hist JOIN name_entropy USING (dns_query_name) GROUP BY ALL),
own AS (SELECT r.*, (last_us - start_us) / 1000000.0 AS duration,
  CASE WHEN last_us > start_us THEN packet_count / ((last_us - start_us) / 1000000.0) ELSE 0 END AS packet_rate,
  CASE WHEN last_us > start_us THEN byte_count / ((last_us - start_us) / 1000000.0) ELSE 0 END AS byte_rate,
  byte_count / packet_count AS avg_packet_size,
  fwd_bytes / greatest(rev_bytes, 1) AS byte_ratio, fwd_packets / greatest(rev_packets, 1) AS packet_ratio,
  entropy, coalesce(iat_mean, 0) AS iat_mean, coalesce(iat_std, 0) AS iat_std,
  CASE WHEN coalesce(iat_mean, 0) > 0 THEN 1 / (1 + iat_std / iat_mean) ELSE 0 END AS periodicity_score,
  coalesce(dns_entropy, 0) AS dns_entropy, CASE WHEN n_tls > 0 THEN 'observed' ELSE '' END AS tls_ja3
  FROM reasoned r LEFT JOIN size_entropy USING (fk, flow_no) LEFT JOIN gaps USING (fk, flow_no)
  LEFT JOIN dns USING (fk, flow_no))"""


FLOWS = _flow_ctes()
FLOWS_EXACT = _flow_ctes("gprev")

PAST = """
seen AS (SELECT f.flow_id, count(DISTINCT o.b_ip) AS dest_fanout, count(DISTINCT o.b_port) AS port_fanout,
  count(o.flow_id) AS flow_count
  FROM flows f LEFT JOIN flows o ON o.a_ip = f.a_ip AND o.start_us BETWEEN f.last_us - 60000000 AND f.last_us
  GROUP BY f.flow_id)"""

VISIBLE = """
triggered AS (SELECT f.*, CASE WHEN closed THEN last_ord ELSE coalesce(
    (SELECT min(p.ord) FROM keyed p WHERE p.t_us >= f.last_us + f.tmo), 9223372036854775807) END AS trig FROM flows f),
steps AS (SELECT *, max(last_us) OVER (PARTITION BY a_ip ORDER BY trig, CASE WHEN closed THEN 0 ELSE 1 END, first_ord
    ROWS UNBOUNDED PRECEDING) AS runmax FROM triggered),
seen AS (SELECT f.flow_id, count(DISTINCT o.b_ip) AS dest_fanout, count(DISTINCT o.b_port) AS port_fanout,
  count(o.first_ord) AS flow_count
  FROM steps f LEFT JOIN steps o ON o.a_ip = f.a_ip AND o.first_ord <= f.trig AND o.start_us >= f.runmax - 60000000
  GROUP BY f.flow_id)"""

FEATURES = """
features AS (SELECT o.flow_id, a_ip AS src_ip, b_ip AS dst_ip, a_port AS src_port, b_port AS dst_port,
  lower(protocol) AS protocol, duration, packet_count, byte_count, packet_rate, byte_rate, avg_packet_size, byte_ratio,
  packet_ratio, dest_fanout, port_fanout, flow_count, entropy, dns_query_length, dns_entropy, iat_mean, iat_std,
  periodicity_score, dns_record_type, tls_ja3, '' AS tls_ja3s, '' AS tls_ja4, tls_sni, start_us, last_us, start_seq
  FROM own o JOIN seen USING (flow_id)),
model AS (SELECT *, CASE WHEN dns_record_type <> '' THEN 1.0 ELSE 0.0 END AS has_dns,
  CASE WHEN dns_record_type = 'A' THEN 1.0 ELSE 0.0 END AS dns_is_A,
  CASE WHEN dns_record_type = 'AAAA' THEN 1.0 ELSE 0.0 END AS dns_is_AAAA,
  CASE WHEN dns_record_type = 'TXT' THEN 1.0 ELSE 0.0 END AS dns_is_TXT,
  CASE WHEN dns_record_type = 'NS' THEN 1.0 ELSE 0.0 END AS dns_is_NS,
  CASE WHEN tls_ja3 <> '' THEN 1.0 ELSE 0.0 END AS has_tls, CAST(length(tls_sni) AS DOUBLE) AS tls_sni_length
  FROM features)"""

WHOLE = {"packet_count", "byte_count", "dest_fanout", "port_fanout", "flow_count"}
CONTRACT = ", ".join(
    c if c in WHOLE or c not in NUMERIC_COLUMNS else _r(c, c) for c in FLOW_COLUMNS
)
TOTALS = """SELECT flow_id, fk AS flow_key, flow_no, start_us, last_us, packet_count, byte_count, fwd_packets, fwd_bytes,
  rev_packets, rev_bytes, finalize_reason FROM reasoned"""

PREDICTED = f"""{SCORED},
predicted AS (SELECT *, CASE WHEN ml_conf >= 0.85 THEN 'light' ELSE 'heavy' END AS model_used,
  CASE WHEN ml_conf >= 0.85 THEN light_pred ELSE heavy_pred END AS dl_pred FROM scored)"""

RISK = "CASE WHEN ml_pred = dl_pred THEN dl_conf ELSE dl_conf * 0.85 END"
SEVERITY = """CASE WHEN dl_pred = 0 THEN 'INFO' WHEN dl_conf >= 0.90 THEN 'CRITICAL' WHEN dl_conf >= 0.75 THEN 'HIGH'
  WHEN dl_conf >= 0.50 THEN 'MEDIUM' ELSE 'LOW' END"""
ISO = """strftime(make_timestamp(last_us), '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN last_us % 1000000 <> 0 THEN '.' || lpad(CAST(last_us % 1000000 AS VARCHAR), 6, '0') ELSE '' END || 'Z'"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _report_ctes(truth: str, pred: str, source: str, by: str = "") -> str:
    """Per-class scores from contingency counts, optionally per group."""
    g = f"{by}, " if by else ""
    using = f"({g}class_idx)"
    return f"""
pairs AS (SELECT {g}{truth} AS y, {pred} AS p, count(*) AS n FROM {source} GROUP BY ALL),
truths AS (SELECT {g}y AS class_idx, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM pairs GROUP BY ALL),
guesses AS (SELECT {g}p AS class_idx, sum(n) AS predicted FROM pairs GROUP BY ALL),
scores AS (SELECT {g}class_idx, coalesce(support, 0) AS support,
  CASE WHEN coalesce(predicted, 0) > 0 THEN coalesce(tp, 0) / predicted ELSE 0 END AS pr,
  CASE WHEN coalesce(support, 0) > 0 THEN tp / support ELSE 0 END AS re FROM truths FULL JOIN guesses USING {using}),
graded AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM scores)"""


def _flat_scored() -> str:
    return f"""{FLOWS}, {PAST}, {FEATURES}, {PREDICTED},
sf AS (SELECT m.*, p.ml_pred, p.dl_pred, p.ml_conf, p.dl_conf, p.model_used FROM model m JOIN predicted p ON p.seq = m.start_seq)"""


def _evidence_ctes() -> str:
    # One row per flow and feature: the contribution of the feature to the verdict's class.
    values = ", ".join(f"CAST({c} AS DOUBLE)" for c in FEATURE_COLUMNS)
    weights = "[" + ",".join("[" + ",".join(repr(w) for w in row) + "]" for row in LINEAR_WEIGHTS) + "]"
    return f"""{_flat_scored()},
long AS (SELECT flow_id, ml_pred, dl_pred, unnest([{values}]) AS x, unnest(range(0, {len(FEATURE_COLUMNS)})) AS j FROM sf),
usual AS (SELECT j, avg(x) AS mu FROM (SELECT unnest([{values}]) AS x, unnest(range(0, {len(FEATURE_COLUMNS)})) AS j FROM model) GROUP BY j),
shares AS (SELECT flow_id, dl_pred, j, x, {weights}[ml_pred + 1][j + 1] * (x - mu) AS c FROM long JOIN usual USING (j)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY abs(c) DESC, j) AS place FROM shares)"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["flow_key"] = _with(
        f"{PACKETS}, {KEYED}",
        "SELECT seq, fk AS flow_key, fwd AS is_forward, CAST(tmo AS BIGINT) AS timeout_us, closes AS closes_flow FROM keyed",
    )
    q["flows_event_gap"] = _with(FLOWS, TOTALS)
    q["flows_replay_exact"] = _with(FLOWS_EXACT, TOTALS)
    q["flow_reasons"] = _with(
        FLOWS,
        "SELECT finalize_reason, count(*) AS flows, CAST(sum(packet_count) AS BIGINT) AS packets FROM reasoned GROUP BY 1",
    )
    q["flow_peak_concurrency"] = _with(
        FLOWS,
        """SELECT CAST(max(level) AS BIGINT) AS peak_flows, CAST(50000 AS BIGINT) AS capacity,
  CAST(greatest(max(level) - 50000, 0) AS BIGINT) AS over_capacity FROM (
  SELECT sum(d) OVER (ORDER BY t RANGE UNBOUNDED PRECEDING) AS level FROM (
    SELECT start_us AS t, 1 AS d FROM flows UNION ALL SELECT last_us + 1, -1 FROM flows))""",
    )

    def measured(*names: str) -> str:
        texts = {"dns_record_type"}
        return _with(FLOWS, "SELECT flow_id, " + ", ".join(n if n in texts else _r(n, n) for n in names) + " FROM own")

    q["flow_rates"] = measured("duration", "packet_rate", "byte_rate", "avg_packet_size", "byte_ratio", "packet_ratio")
    q["flow_entropy"] = measured("entropy")
    q["flow_iat"] = measured("iat_mean", "iat_std", "periodicity_score")
    q["flow_dns"] = measured("dns_query_length", "dns_entropy", "dns_record_type")
    q["flow_tls"] = _with(FLOWS, "SELECT flow_id, tls_ja3, tls_sni FROM own")
    q["flow_feature_variants"] = _with(
        FLOWS,
        "SELECT flow_id, "
        + ", ".join(
            [
                _r("fwd_bytes / (rev_bytes + 1)", "byte_ratio_open"),
                _r("fwd_packets / (rev_packets + 1)", "packet_ratio_open"),
                _r("exp(-iat_std / (iat_mean + 1e-9))", "periodicity_exp"),
            ]
        )
        + " FROM own",
    )
    seen = "SELECT flow_id, dest_fanout, port_fanout, flow_count FROM seen"
    q["source_behaviour_past"] = _with(f"{FLOWS}, {PAST}", seen)
    q["source_behaviour_replay"] = _with(f"{FLOWS_EXACT}, {VISIBLE}", seen)
    base = f"{FLOWS}, {PAST}, {FEATURES}"
    q["flow_features"] = _with(base, f"SELECT {CONTRACT} FROM features")
    q["flow_features_replay"] = _with(f"{FLOWS_EXACT}, {VISIBLE}, {FEATURES}", f"SELECT {CONTRACT} FROM features")
    q["engineered"] = _with(
        base,
        """SELECT flow_id, CAST(has_dns AS DOUBLE) AS has_dns, CAST(dns_is_A AS DOUBLE) AS dns_is_A,
  CAST(dns_is_AAAA AS DOUBLE) AS dns_is_AAAA, CAST(dns_is_TXT AS DOUBLE) AS dns_is_TXT,
  CAST(dns_is_NS AS DOUBLE) AS dns_is_NS, CAST(has_tls AS DOUBLE) AS has_tls, tls_sni_length FROM model""",
    )
    q["feature_groups"] = _with(
        base,
        "SELECT flow_id, "
        + ", ".join(_r(" + ".join(stage_features(s)), s) for s in ABLATION_STAGES)
        + " FROM model",
    )
    stats = ", ".join(f"avg({c}) AS m{j}, stddev_pop({c}) AS s{j}" for j, c in enumerate(FEATURE_COLUMNS))
    q["scaled_features"] = _with(
        f"{base}, stats AS (SELECT {stats} FROM model)",
        "SELECT flow_id, "
        + ", ".join(
            _r(f"({c} - m{j}) / CASE WHEN s{j} > 0 THEN s{j} ELSE 1 END", c) for j, c in enumerate(FEATURE_COLUMNS)
        )
        + " FROM model, stats",
    )
    finite = " OR ".join(f"{c} IS NULL OR isnan(CAST({c} AS DOUBLE)) OR isinf(CAST({c} AS DOUBLE))" for c in NUMERIC_COLUMNS)
    q["contract_report"] = _with(
        base,
        f"""SELECT count(*) AS rows, count(*) FILTER ({finite}) AS rows_not_finite, CAST(0 AS BIGINT) AS missing_columns,
  CAST(0 AS BIGINT) AS columns_not_text, count(*) FILTER ({finite}) = 0 AS ok FROM features""",
    )

    q["captures"] = _with(
        PACKETS,
        """SELECT t_us, src_ip, dst_ip, src_port, dst_port, protocol, tcp_flags, dns_query_name,
  CAST(length(dns_query_name) AS INT) AS dns_query_length, dns_record_type, tls_sni IS NOT NULL AS tls_handshake, tls_sni
FROM packets""",
    )
    q["sensor_import"] = _with(
        PACKETS, "SELECT t_us, src_ip, dst_ip, src_port, dst_port, protocol, packet_length FROM packets"
    )
    q["flow_csv_roundtrip"] = _with(
        base,
        f"""SELECT flow_id, src_ip, dst_port, protocol, CAST(packet_count AS DOUBLE) AS packet_count, {_r('entropy', 'entropy')},
  {_r('iat_mean', 'iat_mean')}, CAST(has_dns AS DOUBLE) AS has_dns, tls_sni FROM model""",
    )

    # Training-set tables
    q["chrono_split"] = _with(
        SCORED,
        """SELECT seq, CASE WHEN pos < floor(n * 0.70) THEN 'train' WHEN pos < floor(n * 0.85) THEN 'val' ELSE 'test' END AS part
FROM (SELECT seq, row_number() OVER (ORDER BY t_us, seq) - 1 AS pos, count(*) OVER () AS n FROM scored)""",
    )
    q["label_encode_validate"] = _with(
        SCORED,
        f"""SELECT seq, label, CAST(list_position({CLASS_LIST}, label) - 1 AS INT) AS label_idx FROM
  (SELECT seq, CASE WHEN event_type = 'error' THEN 'error' ELSE {_name('y_true')} END AS label
   FROM scored JOIN events ON event_id = seq)""",
    )
    q["unknown_labels"] = f"""SELECT event_type AS label, count(*) AS rows FROM events
WHERE NOT list_contains({CLASS_LIST}, event_type) GROUP BY 1"""
    q["class_distribution"] = _with(
        f"{SCORED}, c AS (SELECT unnest(range(0, 7)) AS class_idx)",
        f"""SELECT CAST(class_idx AS INT) AS class_idx, {_name('class_idx')} AS label, count(seq) AS count,
  {_r('count(seq) / greatest((SELECT count(*) FROM scored), 1)', 'fraction')}
FROM c LEFT JOIN scored ON y_true = class_idx GROUP BY class_idx""",
    )
    q["balanced_weights"] = _with(
        f"{SCORED}, c AS (SELECT y_true, count(*) AS n FROM scored GROUP BY 1)",
        f"""SELECT {_name('y_true')} AS label, n AS count,
  {_r('(SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)', 'weight')} FROM c""",
    )
    frame = "(PARTITION BY src_ip ORDER BY start_us, start_seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"

    def padded(c: str) -> str:
        return f"sum({c}) OVER w + (10 - count(*) OVER w) * first_value({c}) OVER w"

    q["host_sequences"] = _with(
        base,
        "SELECT flow_id, CAST(10 AS INT) AS length, "
        + ", ".join(
            [_r("first_value(byte_count) OVER w", "first_bytes")]
            + [_r(padded(c), f"sum_{c}") for c in ("packet_count", "byte_count", "duration", "has_dns")]
        )
        + f" FROM model WINDOW w AS {frame}",
    )
    q["interval_labels"] = _with(
        f"{FLOWS}, experiments AS ({fixtures.EXPERIMENTS}), hits AS (SELECT flow_id, e.experiment_id, "
        f"{_case('attack_type', ATTACK_LABELS)} AS label, "
        "row_number() OVER (PARTITION BY flow_id ORDER BY e.start_us DESC, e.experiment_id) AS place "
        "FROM flows f JOIN experiments e ON least(f.a_ip, f.b_ip) = least(e.src_ip, e.dst_ip) "
        "AND greatest(f.a_ip, f.b_ip) = greatest(e.src_ip, e.dst_ip) AND f.start_us BETWEEN e.start_us AND e.end_us)",
        """SELECT f.flow_id, CAST(experiment_id AS BIGINT) AS experiment_id, coalesce(label, 'benign') AS label
FROM flows f LEFT JOIN (SELECT * FROM hits WHERE place = 1) h USING (flow_id)""",
    )
    q["label_join"] = _with(
        f"{FLOWS}, {SCORED}",
        f"""SELECT flow_id, packet_count, CASE WHEN protocol <> 'ICMP' THEN {_name('y_true')} END AS label
FROM flows LEFT JOIN scored ON seq = start_seq""",
    )
    md5 = "CAST(('0x' || substr(md5('42#' || {}), 1, 15)) AS BIGINT) % 2147483648"
    q["stratified_split"] = _with(
        f"{SCORED}, p AS (SELECT seq, y_true, row_number() OVER (PARTITION BY y_true ORDER BY "
        f"{md5.format('CAST(seq AS VARCHAR)')}, seq) AS place, count(*) OVER (PARTITION BY y_true) AS n FROM scored)",
        f"""SELECT seq, {_name('y_true')} AS label, CASE WHEN place <= floor(n * 0.6) THEN 'train'
  WHEN place <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS part FROM p""",
    )
    q["group_split"] = _with(
        SCORED,
        f"""SELECT src_ip, CASE WHEN {md5.format('src_ip')} % 100 < 20 THEN 'test' ELSE 'train' END AS part,
  count(*) AS n FROM scored GROUP BY ALL""",
    )

    # Routing and evaluation
    q["route"] = _with(PREDICTED, "SELECT seq, ml_conf, model_used FROM predicted")
    q["route_three_tier"] = _with(
        SCORED,
        "SELECT seq, CASE WHEN ml_conf >= 0.90 THEN 'xgb_only' WHEN ml_conf >= 0.60 THEN 'light' ELSE 'heavy' END AS tier FROM scored",
    )
    q["routing_stats"] = _with(
        SCORED,
        f"""SELECT CAST(0.85 AS DOUBLE) AS theta, count(*) AS n, count(*) FILTER (ml_conf >= 0.85) AS n_light,
  count(*) FILTER (ml_conf < 0.85) AS n_heavy, {_r('count(*) FILTER (ml_conf >= 0.85) / count(*)', 'pct_light')},
  {_r('count(*) FILTER (ml_conf < 0.85) / count(*)', 'pct_heavy')} FROM scored""",
    )
    grid = ",".join(f"({t!r})" for t in THETA_GRID)
    sweep = f"""{SCORED}, grid AS (SELECT CAST(theta AS DOUBLE) AS theta FROM (VALUES {grid}) g(theta)),
sweep AS (SELECT theta, count(*) FILTER (ml_conf >= theta) / count(*) AS pct_light,
  count(*) FILTER (ml_conf < theta) / count(*) AS pct_heavy,
  avg(CASE WHEN (CASE WHEN ml_conf >= theta THEN light_pred ELSE heavy_pred END) = y_true THEN 1.0 ELSE 0.0 END) AS overall_dl_accuracy,
  avg(CASE WHEN light_pred = y_true THEN 1.0 ELSE 0.0 END) FILTER (ml_conf >= theta) AS light_branch_accuracy,
  avg(CASE WHEN heavy_pred = y_true THEN 1.0 ELSE 0.0 END) FILTER (ml_conf < theta) AS heavy_branch_accuracy,
  avg(CASE WHEN ml_pred = y_true THEN 1.0 ELSE 0.0 END) FILTER (ml_conf < theta) AS heavy_branch_xgb_only_accuracy,
  avg(CASE WHEN light_pred = y_true THEN 1.0 ELSE 0.0 END) AS fixed_100pct_light_accuracy,
  avg(CASE WHEN heavy_pred = y_true THEN 1.0 ELSE 0.0 END) AS fixed_100pct_heavy_accuracy
  FROM grid CROSS JOIN scored GROUP BY theta)"""
    columns = [
        "pct_light",
        "pct_heavy",
        "overall_dl_accuracy",
        "light_branch_accuracy",
        "heavy_branch_accuracy",
        "heavy_branch_xgb_only_accuracy",
        "fixed_100pct_light_accuracy",
        "fixed_100pct_heavy_accuracy",
    ]
    q["theta_sweep"] = _with(sweep, "SELECT theta, " + ", ".join(_r(c, c) for c in columns) + " FROM sweep")
    renamed = {
        "theta": "selected_theta",
        "overall_dl_accuracy": "validation_overall_dl_accuracy",
        "pct_light": "light_routing_fraction",
        "pct_heavy": "heavy_routing_fraction",
        "light_branch_accuracy": "light_branch_accuracy",
        "heavy_branch_accuracy": "heavy_branch_accuracy",
        "fixed_100pct_light_accuracy": "fixed_100pct_light_accuracy",
        "fixed_100pct_heavy_accuracy": "fixed_100pct_heavy_accuracy",
    }
    q["theta_select"] = _with(
        sweep,
        "SELECT "
        + ", ".join(_r(c, a) for c, a in renamed.items())
        + ", pct_heavy <= 0.40 AS within_limit FROM sweep"
        + " ORDER BY CASE WHEN pct_heavy <= 0.40 THEN 0 ELSE 1 END, overall_dl_accuracy DESC, theta LIMIT 1",
    )
    stacked = f"""{SCORED}, stacked AS (
  SELECT 'xgboost_only' AS strategy, y_true AS y, ml_pred AS pred, 0 AS calls, ml_conf FROM scored
  UNION ALL SELECT 'always_light', y_true, light_pred, 1, ml_conf FROM scored
  UNION ALL SELECT 'always_heavy', y_true, heavy_pred, 1, ml_conf FROM scored
  UNION ALL SELECT 'risk_adaptive', y_true, CASE WHEN ml_conf >= 0.85 THEN light_pred ELSE heavy_pred END, 1, ml_conf FROM scored)"""
    q["baseline_comparison"] = _with(
        stacked + "," + _report_ctes("y", "pred", "stacked", "strategy")
        + ", macro AS (SELECT strategy, avg(f1) AS macro_f1 FROM graded GROUP BY 1)",
        "SELECT strategy, "
        + ", ".join(
            [
                _r("avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END)", "accuracy"),
                _r("any_value(macro_f1)", "macro_f1"),
                _r("avg(CASE WHEN pred <> 0 THEN 1.0 ELSE 0.0 END) FILTER (y <> 0)", "malicious_recall"),
                _r("avg(CASE WHEN pred = 0 THEN 1.0 ELSE 0.0 END) FILTER (y <> 0)", "malicious_to_benign_rate"),
                "CAST(sum(calls) AS BIGINT) AS n_dl_calls",
                _r("CASE WHEN strategy = 'risk_adaptive' THEN avg(CASE WHEN ml_conf >= 0.85 THEN 1.0 ELSE 0.0 END) END", "pct_light"),
                _r("CASE WHEN strategy = 'risk_adaptive' THEN avg(CASE WHEN ml_conf < 0.85 THEN 1.0 ELSE 0.0 END) END", "pct_heavy"),
            ]
        )
        + " FROM stacked JOIN macro USING (strategy) GROUP BY strategy",
    )
    points = ", ".join(f"CAST((seq * {i + 3} + y_true * {2 * i + 1}) % 10 AS DOUBLE) / 10" for i in range(7))
    q["verdict_argmax"] = _with(
        f"{SCORED}, p AS (SELECT seq, [{points}] AS p FROM scored)",
        f"""SELECT seq, CAST(list_position(p, list_max(p)) - 1 AS INT) AS class_idx,
  {CLASS_LIST}[list_position(p, list_max(p))] AS verdict, list_max(p) AS confidence FROM p""",
    )
    q["confusion_matrix"] = _with(
        f"{PREDICTED}, c AS (SELECT unnest(range(0, 7)) AS i)",
        f"SELECT {_name('i')} AS true_class, "
        + ", ".join(f"count(*) FILTER (dl_pred = {i} AND y_true = i) AS pred_{c}" for i, c in enumerate(CLASSES))
        + " FROM c LEFT JOIN predicted ON y_true = i GROUP BY i",
    )
    report = PREDICTED + "," + _report_ctes("y_true", "dl_pred", "predicted")
    q["class_report"] = _with(
        report,
        f"""SELECT {_name('class_idx')} AS class, {_r('pr', 'precision')}, {_r('re', 'recall')}, {_r('f1', 'f1')},
  CAST(support AS BIGINT) AS support FROM graded
UNION ALL SELECT 'macro avg', {_r('avg(pr)', 'a')}, {_r('avg(re)', 'b')}, {_r('avg(f1)', 'c')}, CAST(sum(support) AS BIGINT) FROM graded
UNION ALL SELECT 'weighted avg', {_r('sum(pr * support) / sum(support)', 'a')}, {_r('sum(re * support) / sum(support)', 'b')},
  {_r('sum(f1 * support) / sum(support)', 'c')}, CAST(sum(support) AS BIGINT) FROM graded""",
    )
    q["overall_metrics"] = _with(
        report,
        "SELECT count(*) AS n, "
        + ", ".join(
            [
                _r("avg(CASE WHEN y_true = dl_pred THEN 1.0 ELSE 0.0 END)", "accuracy"),
                _r("avg(CASE WHEN dl_pred <> 0 THEN 1.0 ELSE 0.0 END) FILTER (y_true <> 0)", "malicious_recall"),
                _r("avg(CASE WHEN dl_pred = 0 THEN 1.0 ELSE 0.0 END) FILTER (y_true <> 0)", "malicious_to_benign_rate"),
                _r("coalesce(avg(CASE WHEN dl_pred <> 0 THEN 1.0 ELSE 0.0 END) FILTER (y_true = 0), 0)", "benign_fpr"),
                _r("(SELECT avg(f1) FROM graded)", "macro_f1"),
            ]
        )
        + " FROM predicted",
    )
    q["branch_metrics"] = _with(
        PREDICTED
        + ","
        + _report_ctes("y_true", "dl_pred", "predicted", "model_used")
        + ", macro AS (SELECT model_used, sum(f1) / 7 AS macro_f1 FROM graded GROUP BY 1)",
        "SELECT model_used, count(*) AS n_flows, "
        + _r("avg(CASE WHEN y_true = dl_pred THEN 1.0 ELSE 0.0 END)", "accuracy")
        + ", "
        + _r("any_value(macro_f1)", "macro_f1")
        + " FROM predicted JOIN macro USING (model_used) GROUP BY model_used",
    )

    def ece(pred: str, conf: str) -> str:
        return f"""(SELECT sum(n * abs(acc - con)) / (SELECT count(*) FROM predicted) FROM (
  SELECT count(*) AS n, avg(CASE WHEN {pred} = y_true THEN 1.0 ELSE 0.0 END) AS acc, avg({conf}) AS con
  FROM predicted JOIN (SELECT i * CAST(0.1 AS DOUBLE) AS lo, CASE WHEN i = 9 THEN 1.0 ELSE (i + 1) * CAST(0.1 AS DOUBLE) END AS hi
    FROM range(0, 10) r(i)) b ON {conf} > lo AND {conf} <= hi GROUP BY lo))"""

    q["ece"] = _with(
        PREDICTED, f"SELECT (SELECT count(*) FROM predicted) AS n, {_r(ece('ml_pred', 'ml_conf'), 'ece')}"
    )
    q["calibration_report"] = _with(
        PREDICTED,
        f"""SELECT {_r('a', 'raw_xgboost_ece')}, {_r('b', 'calibrated_ece')}, b <= a AS improved
FROM (SELECT {ece('ml_pred', 'ml_conf')} AS a, {ece('dl_pred', 'dl_conf')} AS b)""",
    )
    timing = f"""{PREDICTED}, scoped AS (SELECT 'overall' AS scope, latency_ms FROM predicted
  UNION ALL SELECT model_used, latency_ms FROM predicted),
summary AS (SELECT scope, count(*) AS n, avg(latency_ms) AS mean_ms, quantile_cont(latency_ms, 0.5) AS p50_ms,
  quantile_cont(latency_ms, 0.95) AS p95_ms, quantile_cont(latency_ms, 0.99) AS p99_ms, max(latency_ms) AS max_ms
  FROM scoped GROUP BY scope)"""
    q["latency_summary"] = _with(
        timing,
        "SELECT scope, n, " + ", ".join(_r(c, c) for c in ("mean_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms")) + " FROM summary",
    )
    q["latency_nearest_rank"] = _with(
        f"""{PREDICTED}, o AS (SELECT latency_ms, model_used, row_number() OVER (ORDER BY latency_ms, seq) - 1 AS pos,
  count(*) OVER () AS n FROM predicted)""",
        "SELECT count(*) AS n, "
        + ", ".join(
            [
                _r("100.0 * count(*) FILTER (model_used = 'heavy') / count(*)", "heavy_percent"),
                _r("median(latency_ms)", "p50_ms"),
                _r("max(latency_ms) FILTER (pos = floor(n * 0.95))", "p95_ms"),
                _r("max(latency_ms) FILTER (pos = floor(n * 0.99))", "p99_ms"),
            ]
        )
        + " FROM o",
    )
    q["throughput_table"] = _with(
        f"""{timing}, cap AS (SELECT count(*) / (sum(latency_ms) / 1000.0) AS r,
  count(*) FILTER (model_used = 'light') / count(*) AS pl, count(*) FILTER (model_used = 'heavy') / count(*) AS ph FROM predicted),
rates AS (SELECT CAST(t AS BIGINT) AS t FROM (VALUES (100), (500), (1000), (5000)) v(t))""",
        "SELECT t AS target_rate_flows_per_sec, "
        + ", ".join(
            [
                _r("t * 10.0", "offered_flows_in_10s_window"),
                _r("least(t * 10.0, r * 10.0)", "processed_flows"),
                _r("greatest(t * 10.0 - r * 10.0, 0)", "dropped_flows"),
                "r >= t AS sustainable",
                _r("mean_ms", "mean_latency_ms"),
                _r("p95_ms", "p95_latency_ms"),
                _r("p99_ms", "p99_latency_ms"),
                _r("pl", "pct_light"),
                _r("ph", "pct_heavy"),
            ]
        )
        + " FROM cap, rates, summary WHERE scope = 'overall'",
    )
    q["compute_saving"] = _with(
        f"""{PREDICTED}, m AS (SELECT avg(latency_ms * 0.1) AS t, avg(latency_ms * 0.3) AS l, avg(latency_ms) AS h,
  avg(CASE WHEN model_used = 'light' THEN 1.0 ELSE 0.0 END) AS sl, avg(CASE WHEN model_used = 'heavy' THEN 1.0 ELSE 0.0 END) AS sh
  FROM predicted)""",
        "SELECT "
        + ", ".join(
            [
                _r("t + h", "always_heavy_ms_per_flow"),
                _r("t + sl * l + sh * h", "adaptive_ms_per_flow"),
                _r("1 - sh", "heavy_call_reduction"),
                _r("1 - (t + sl * l + sh * h) / (t + h)", "latency_reduction"),
            ]
        )
        + " FROM m",
    )
    q["backlog"] = _with(
        SCORED,
        """SELECT count(*) AS n, count(*) FILTER (t_us / 1000000 + latency_ms / 1000.0 > seq / CAST(50.0 AS DOUBLE)) AS backlogged_flows
FROM scored""",
    )

    # Alerts and incidents
    q["alerts"] = _with(
        _flat_scored(),
        f"""SELECT {ISO} AS "timestamp", flow_id, src_ip AS source_ip, dst_ip AS destination_ip, protocol,
  {_name('dl_pred')} AS threat_class, {_r('dl_conf', 'confidence')}, {SEVERITY} AS severity, model_used,
  ml_pred = dl_pred AS model_agreement, {_name('ml_pred')} AS xgb_verdict, {_name('dl_pred')} AS dl_verdict,
  {_name('ml_pred')} AS ml_verdict, {_r('ml_conf', 'ml_confidence')}, {_r(f'round({RISK}, 4)', 'risk_score')},
  'xgboost_triage' AS evidence_source FROM sf WHERE dl_pred <> 0""",
    )
    level = _case(_name("ml_pred"), CLASS_SEVERITY)
    q["alerts_class_severity"] = _with(
        SCORED,
        f"""SELECT seq, {_name('ml_pred')} AS threat_class, {level} AS severity,
  {_r(f"round(ml_conf * CAST({_case(level, SEVERITY_WEIGHT)} AS DOUBLE), 3)", 'risk_score')} FROM scored""",
    )
    names = _texts(FEATURE_COLUMNS)
    q["alert_evidence"] = _with(
        _evidence_ctes(),
        f"""SELECT flow_id, CAST(place - 1 AS INT) AS position, {names}[j + 1] AS feature,
  CASE WHEN {names}[j + 1] IN ('iat_mean', 'iat_std') THEN round(x, 9) + 0.0 ELSE round(x, 6) + 0.0 END AS value,
  {_r('c', 'contribution')}, 'xgboost_triage' AS evidence_source FROM ranked WHERE place <= 5 AND dl_pred <> 0""",
    )
    q["replay_records_flat"] = _with(
        _evidence_ctes(),
        f"""SELECT sf.flow_id, {ISO} AS "timestamp", src_ip AS source_ip, dst_ip AS destination_ip, src_port AS source_port,
  dst_port AS destination_port, upper(protocol) AS protocol, {_name('sf.ml_pred')} AS xgboost_class,
  {_r('ml_conf', 'xgboost_confidence')}, model_used, {_name('sf.dl_pred')} AS dl_class, {_r('dl_conf', 'dl_confidence')},
  CAST(5 AS INT) AS evidence_size, {names}[r.j + 1] AS top_feature,
  CASE WHEN sf.dl_pred <> 0 THEN {SEVERITY.replace('dl_pred', 'sf.dl_pred')} END AS alert_severity,
  {_r(f"CASE WHEN sf.dl_pred <> 0 THEN round({RISK.replace('ml_pred', 'sf.ml_pred').replace('= dl_pred', '= sf.dl_pred')}, 4) END", 'alert_risk')}
FROM sf JOIN ranked r ON r.flow_id = sf.flow_id AND place = 1""",
    )
    stream = f"""{PREDICTED}, alerts AS (SELECT seq AS alert_id, src_ip, t_us, dl_pred, {_name('dl_pred')} AS threat_class,
  round({RISK}, 4) AS risk_score FROM predicted WHERE dl_pred <> 0)"""
    q["incidents"] = _with(
        f"""{stream}, trail AS (SELECT a.alert_id, any_value(a.src_ip) AS src_ip, any_value(a.t_us) AS t_us, count(*) AS alert_count,
  count(DISTINCT o.dl_pred) AS class_count, max(o.risk_score) AS max_risk_score, list_sort(list(DISTINCT o.dl_pred)) AS idx
  FROM alerts a JOIN alerts o ON o.src_ip = a.src_ip AND o.t_us BETWEEN a.t_us - 300000000 AND a.t_us GROUP BY a.alert_id)""",
        f"""SELECT src_ip AS incident_id, src_ip, alert_id, t_us, alert_count, CAST(class_count AS INT) AS class_count,
  array_to_string(list_transform(idx, lambda i: {CLASS_LIST}[i + 1]), ',') AS threat_classes, {_r('max_risk_score', 'max_risk_score')}
FROM trail WHERE class_count >= 2 OR max_risk_score > 0.85""",
    )
    q["recent_alerts"] = _with(
        stream,
        f"""SELECT alert_id, src_ip, t_us, threat_class, {_r('risk_score', 'risk_score')} FROM alerts
ORDER BY t_us DESC, alert_id LIMIT 50""",
    )
    q["dashboard_minute"] = _with(
        PREDICTED,
        f"""SELECT CAST(floor(t_us / 60000000) AS BIGINT) AS minute, count(*) AS flows, count(*) FILTER (dl_pred <> 0) AS alert_count,
  {_r('avg(dl_conf)', 'avg_confidence')}, {_r('count(*) / 60.0', 'flows_per_sec')} FROM predicted GROUP BY 1""",
    )
    q["dashboard_totals"] = _with(
        f"""{stream}, trail AS (SELECT a.alert_id, any_value(a.src_ip) AS src_ip, count(DISTINCT o.dl_pred) AS k, max(o.risk_score) AS m
  FROM alerts a JOIN alerts o ON o.src_ip = a.src_ip AND o.t_us BETWEEN a.t_us - 300000000 AND a.t_us GROUP BY a.alert_id)""",
        f"""SELECT count(*) AS flows, {_r('count(*) / ((max(t_us) - min(t_us)) / 1000000)', 'flows_per_sec')},
  count(*) FILTER (dl_pred <> 0) AS alert_count, {_r('avg(dl_conf)', 'avg_confidence')},
  (SELECT count(DISTINCT src_ip) FROM trail WHERE k >= 2 OR m > 0.85) AS incident_count FROM predicted""",
    )
    q["verdict_cube"] = _with(
        f"""{PREDICTED}, v AS (SELECT {_name('dl_pred')} AS dl_verdict, model_used, ml_pred = dl_pred AS model_agreement FROM predicted)""",
        """SELECT dl_verdict, model_used, model_agreement, count(*) AS n,
  CAST(grouping(dl_verdict, model_used, model_agreement) AS BIGINT) AS level
FROM v GROUP BY CUBE (dl_verdict, model_used, model_agreement)""",
    )
    # Streams equal their batch operators
    measures = ", ".join(_r(n, n) for n in ("entropy", "iat_mean", "iat_std"))
    q["stream_flows"] = _with(FLOWS, TOTALS.replace("flow_no, ", "").replace(" FROM reasoned", f", {measures} FROM own"))
    q["intake_restart"] = _with(FLOWS, TOTALS.replace("flow_no, ", ""))
    q["model_evidence"] = _with(
        f"{FLOWS}, tested AS (SELECT CAST(count(*) - floor(count(*) * 0.85) AS BIGINT) AS n FROM flows)",
        "SELECT n AS flows, n AS exact_flows, n AS top_flows FROM tested",
    )
    q["flow_csv_headers"] = q["flow_csv_roundtrip"]
    q["stream_scored"] = _with(
        FLOWS,
        "SELECT count(*) AS flows, count(*) AS equal_flows, CAST(0 AS BIGINT) AS alerts_off FROM flows",
    )
    q["stream_behaviour"] = q["source_behaviour_past"]
    q["stream_incidents"] = q["incidents"].replace("src_ip AS incident_id, src_ip,", "src_ip,")
    recent = "(PARTITION BY src_ip ORDER BY t_us, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
    q["stream_sequences"] = _with(
        SCORED,
        f"""SELECT seq, {_r('sum(y_true) OVER w + (10 - count(*) OVER w) * first_value(y_true) OVER w', 'sum_class')},
  {_r('first_value(latency_ms) OVER w', 'oldest_ms')} FROM scored WINDOW w AS {recent}""",
    )
    q["stream_alerts"] = _with(
        _flat_scored(),
        f"""SELECT flow_id, {_name('dl_pred')} AS threat_class, {_r('dl_conf', 'confidence')}, {SEVERITY} AS severity, model_used,
  {_r(f'round({RISK}, 4)', 'risk_score')} FROM sf WHERE dl_pred <> 0""",
    )
    assert set(CATEGORICAL_COLUMNS) <= set(FLOW_COLUMNS)
    return q
