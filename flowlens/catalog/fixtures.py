"""The driver's tables seen as packets, scored flows, experiments and labels.

The same text serves both engines; only the time and JSON expressions differ. Thirty days of events
are read as thirty minutes of packets so that the default timeouts mean something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "US": "unix_micros(CAST(ts AS TIMESTAMP))",
    "K": "CAST(get_json_object(props,'$.k') AS INT)",
}
DUCKDB = {
    "US": "epoch_us(ts)",
    "K": "CAST(json_extract_string(props,'$.k') AS INT)",
}

PACKETS = """
SELECT seq, t_us,
  CASE WHEN rev THEN srv ELSE cli END AS src_ip, CASE WHEN rev THEN cli ELSE srv END AS dst_ip,
  CASE WHEN proto='ICMP' THEN NULL WHEN rev THEN sport ELSE cport END AS src_port,
  CASE WHEN proto='ICMP' THEN NULL WHEN rev THEN cport ELSE sport END AS dst_port,
  proto AS protocol, packet_length, CASE WHEN proto='TCP' THEN flags END AS tcp_flags,
  CASE WHEN proto='UDP' THEN qname END AS dns_query_name,
  CASE WHEN proto='UDP' THEN qtype END AS dns_record_type,
  CASE WHEN proto='TCP' AND k%5=0 THEN concat('host',k,'.example.com') END AS tls_sni
FROM (SELECT event_id AS seq, CAST(FLOOR(({US}-1704067200000000)/1440) AS BIGINT) AS t_us, k,
  concat('10.1.',CAST(FLOOR(user_id/250) AS INT),'.',user_id%250) AS cli,
  CASE WHEN k%2=0 THEN '10.0.0.251' ELSE concat('192.0.2.',user_id%7+1) END AS srv,
  CAST(50000+user_id%1000 AS INT) AS cport,
  CASE event_type WHEN 'signup' THEN 53 WHEN 'error' THEN 0 ELSE 443 END AS sport,
  CASE event_type WHEN 'signup' THEN 'UDP' WHEN 'error' THEN 'ICMP' ELSE 'TCP' END AS proto,
  CASE WHEN event_type='purchase' AND k%3=0 THEN 'FA' WHEN event_type='purchase' AND k%3=1 THEN 'R'
       WHEN event_type='click' THEN 'S' ELSE 'A' END AS flags,
  CAST(40+FLOOR(value) AS INT) AS packet_length, event_id%3=0 AS rev,
  concat('q',event_id%977,'x',k,'.example.com') AS qname,
  CASE k%5 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'TXT' WHEN 3 THEN 'NS' ELSE 'CNAME' END AS qtype
  FROM (SELECT *, {K} AS k FROM events) e) p
"""

SCORED = """
SELECT event_id AS seq, CAST(FLOOR(({US}-1704067200000000)/1440) AS BIGINT) AS t_us,
  concat('10.1.',CAST(FLOOR(user_id/250) AS INT),'.',user_id%250) AS src_ip,
  CAST((event_id*31+user_id)%7 AS INT) AS y_true,
  CAST(CASE WHEN k<78 THEN (event_id*31+user_id)%7 ELSE (event_id*31+user_id+1+k%6)%7 END AS INT) AS ml_pred,
  CAST(50+(event_id*17+k)%51 AS DOUBLE)/100 AS ml_conf,
  CAST(CASE WHEN (event_id*13+k)%100<85 THEN (event_id*31+user_id)%7 ELSE (event_id*31+user_id+1+event_id%6)%7 END AS INT) AS light_pred,
  CAST(CASE WHEN (event_id*29+k)%100<93 THEN (event_id*31+user_id)%7 ELSE (event_id*31+user_id+1+event_id%6)%7 END AS INT) AS heavy_pred,
  CAST(40+(event_id*23+k)%61 AS DOUBLE)/100 AS dl_conf,
  value AS latency_ms
FROM (SELECT *, {K} AS k FROM events) e
"""

EXPERIMENTS = """
SELECT n_nationkey AS experiment_id, concat('10.1.0.',n_nationkey) AS src_ip, '10.0.0.251' AS dst_ip,
  CAST(n_nationkey AS BIGINT)*72000000 AS start_us, CAST(n_nationkey AS BIGINT)*72000000+600000000 AS end_us,
  CASE n_nationkey%9 WHEN 0 THEN 'syn_flood' WHEN 1 THEN 'udp_flood' WHEN 2 THEN 'port_scan' WHEN 3 THEN 'host_scan'
    WHEN 4 THEN 'dns_tunnel' WHEN 5 THEN 'dga' WHEN 6 THEN 'c2_beacon' WHEN 7 THEN 'tls_malware' ELSE 'exfil' END AS attack_type
FROM nation
"""


def _fill(text: str, words: dict[str, str]) -> str:
    for name, value in words.items():
        text = text.replace("{" + name + "}", value)
    return text


def _view(spark: SparkSession, sf_dir: str, text: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(_fill(text, SPARK).replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: source})


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PACKETS, "events")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SCORED, "events")


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, EXPERIMENTS, "nation")


def duckdb_text(text: str) -> str:
    return _fill(text, DUCKDB)
