import struct

import numpy as np
import pytest
from helpers import GOLDEN, S, labelled_flows, packets, random_packets
from pyspark.sql import functions as F

from flowlens.catalog.capture_bytes import capture
from flowlens.config import CLASSES, FEATURE_COLUMNS
from flowlens.operators import alerts as A
from flowlens.operators import dataset as D
from flowlens.operators import evaluate as V
from flowlens.operators import latency as L
from flowlens.operators import routing as R
from flowlens.operators.evidence import evidence_check, occlusion_evidence
from flowlens.operators.features import add_indicators, complete_features, fit_scaler
from flowlens.operators.models import TRIAGE_GRID, score_with, with_vector
from flowlens.operators.sessionize import build_flows, with_reason
from flowlens.plans.flows import extract_features
from flowlens.plans.scoring import Artifacts, score_flows, train_all
from flowlens.sources.captures import capture_counts, capture_packets, read_captures
from flowlens.sources.sinks import write_alerts, write_records, write_report
from flowlens.sources.tables import FLOW_SCHEMA, read_flows
from flowlens.streaming.common import as_files, late_rows, run_available, stream_files
from flowlens.streaming.replay import flow_stream
from flowlens.streaming.sessions import sessionize_available
from flowlens.streaming.sources import behaviour_stream, combine_salts, incident_stream


def test_chronological_split(spark):
    df = spark.range(600).select((F.col("id") / 3).cast("long").alias("t_us"), F.col("id").alias("seq"))
    made = D.chronological_split(df, ["t_us", "seq"])
    got = {r.part: (r.lo, r.hi) for r in made.groupBy("part").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).collect()}
    assert got == {"train": (0, 419), "val": (420, 509), "test": (510, 599)}


def test_random_and_group_splits(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "ddos").otherwise("benign").alias("label"))
    n = {(r.label, r.part): r["count"] for r in D.stratified_split(df, "id").groupBy("label", "part").count().collect()}
    assert (n[("ddos", "train")], n[("benign", "train")]) == (540, 60)
    assert n[("benign", "test")] == 20
    grouped = D.group_split(df.withColumn("g", F.col("id") % 50), "g")
    assert grouped.groupBy("g").agg(F.countDistinct("part").alias("k")).filter("k > 1").count() == 0


def test_labels(spark):
    df = spark.createDataFrame([("ddos",), ("ddos",), ("benign",)], "label string")
    rows = {r.label: (r["count"], r.fraction) for r in D.class_distribution(df).collect()}
    assert len(rows) == 7 and rows["ddos"] == (2, pytest.approx(2 / 3)) and rows["recon_scanning"] == (0, 0.0)
    assert {r.label: r.weight for r in D.class_weights(df).collect()} == {"ddos": 0.75, "benign": 1.5}
    with pytest.raises(ValueError, match="nonsense"):
        D.require_known_labels(df.union(spark.createDataFrame([("nonsense",)], "label string")))


def test_interval_labels(spark):
    flows = spark.createDataFrame(
        [("f1", "b", "a", 5), ("f2", "a", "b", 25), ("f3", "a", "c", 5)], "flow_id string, a_ip string, b_ip string, start_us long"
    )
    log = spark.createDataFrame(
        [(1, "a", "b", 0, 10, "syn_flood"), (2, "b", "a", 5, 9, "exfil"), (3, "a", "b", 5, 9, "dga")],
        "experiment_id long, src_ip string, dst_ip string, start_us long, end_us long, attack_type string",
    )
    want = {"f1": (2, "data_exfiltration"), "f2": (None, "benign"), "f3": (None, "benign")}
    rows = D.label_by_experiment(flows, log).collect()
    assert {r.flow_id: (r.experiment_id, r.label) for r in rows} == want
    assert D.label_by_experiment(flows, log.limit(0)).where("label <> 'benign'").count() == 0


def test_one_pair_owns_all_entries(spark):
    rng = np.random.default_rng(6)
    log = [(i, "a", "b", int(s), int(s + rng.integers(0, 3000 * S)), "exfil") for i, s in enumerate(rng.integers(0, 9000 * S, 200))]
    flows = [(f"f{i}", "a", "b", int(t)) for i, t in enumerate(rng.integers(0, 12000 * S, 500))]
    made = D.label_by_experiment(
        spark.createDataFrame(flows, "flow_id string, a_ip string, b_ip string, start_us long"),
        spark.createDataFrame(log, "experiment_id long, src_ip string, dst_ip string, start_us long, end_us long, attack_type string"),
    )
    got = {r.flow_id: r.experiment_id for r in made.collect()}
    for name, _, _, t in flows:
        open_ones = [(s, -i) for i, _, _, s, e, _ in log if s <= t <= e]
        assert got[name] == (-max(open_ones)[1] if open_ones else None)


def test_host_sequences(spark):
    rows = [(i, "h" if i % 3 else f"h{i}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "t long, host string, x double")
    for cells in (1, 25):
        got = {r.t: [v[0] for v in r.sequence] for r in D.host_sequences(df, "host", ["t"], ["x"], 4, cells).collect()}
        for t, host, _ in rows:
            past = [x for u, h, x in rows if h == host and u <= t][-4:]
            assert got[t] == [past[0]] * (4 - len(past)) + past


def test_alerts(spark):
    cells = [(0.95, "ddos"), (0.90, "ddos"), (0.80, "ddos"), (0.60, "ddos"), (0.2, "ddos"), (0.99, "benign")]
    df = spark.createDataFrame(cells, "c double, v string").select(A.severity(F.col("c"), F.col("v")).alias("s"))
    assert [r.s for r in df.collect()] == ["CRITICAL", "CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
    one = spark.range(1).select(
        A.risk_score(F.lit(0.91), F.lit(False)).alias("r"),
        A.iso_utc(F.lit(1_500_000)).alias("t"),
        R.route(F.lit(0.85), 0.85).alias("b"),
    )
    assert tuple(one.first()) == (0.7735, "1970-01-01T00:00:01.500000Z", "light")


def test_record_and_alert_files(spark, tmp_path):
    flows = complete_features(extract_features(packets(spark, GOLDEN), keep=["last_us"]))
    evidence = F.array(F.struct(F.lit("packet_count").alias("feature"), F.lit(0.5).alias("value"), F.lit("xgboost_triage").alias("evidence_source")))
    hostile = F.col("protocol") == "tcp"
    scored = flows.withColumns(
        {
            "ml_verdict": F.lit("ddos"),
            "ml_confidence": F.lit(0.9),
            "dl_verdict": F.when(hostile, "ddos").otherwise("benign"),
            "dl_confidence": F.lit(0.8),
            "model_used": F.lit("light"),
            "shap_evidence": evidence,
        }
    )
    write_records(scored, str(tmp_path / "records"))
    write_alerts(scored, str(tmp_path / "alerts"))
    records, alerts = spark.read.json(str(tmp_path / "records")), spark.read.json(str(tmp_path / "alerts"))
    assert (records.count(), records.filter("alert IS NULL").count(), alerts.count()) == (5, 2, 3)
    first = alerts.orderBy("timestamp").first()
    assert (first.severity, first.risk_score, first.evidence[0].value) == ("HIGH", 0.8, 8.0)
    write_report(alerts.groupBy("severity").count(), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).first().severity == "HIGH"


def test_incidents_of_hot_sources(spark):
    rng = np.random.default_rng(5)
    rows = [
        (i, "big" if rng.random() < 0.7 else f"s{i % 4}", int(rng.integers(0, 3000)) * S, CLASSES[int(rng.integers(0, 4))], float(rng.integers(1, 100)) / 100)
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "alert_id long, src_ip string, t_us long, threat_class string, risk_score double")
    live = [r for r in rows if r[3] != "benign"]
    want = {}
    for i, src, t, _, _ in live:
        near = [r for r in live if r[1] == src and t - 300 * S <= r[2] <= t]
        classes, risk = {r[3] for r in near}, max(r[4] for r in near)
        if len(classes) >= 2 or risk > 0.85:
            want[i] = (len(near), [c for c in CLASSES if c in classes], risk)
    for cells in (1, 20):
        got = {r.alert_id: (r.alert_count, r.threat_classes, r.max_risk_score) for r in A.incidents(df, cells=cells).collect()}
        assert got == want


def test_latency_matches_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.exponential(3.0, 500), 1)
    df = spark.createDataFrame(
        [(i, float(v), "light" if i % 3 else "heavy") for i, v in enumerate(values)], "i long, ms double, b string"
    )
    rows = {r.scope: r for r in L.latency_summary(df, "b", "ms", "i").collect()}
    for scope, part in (("overall", values), ("heavy", values[::3])):
        want = np.percentile(part, [50, 95, 99])
        assert [rows[scope].p50_ms, rows[scope].p95_ms, rows[scope].p99_ms] == pytest.approx(want)
    near = L.latency_nearest_rank(df, "b", "ms", "i").first()
    assert (near.p95_ms, near.p50_ms) == (sorted(values)[475], pytest.approx(np.median(values)))


def test_evaluation_edges(spark):
    df = spark.createDataFrame([(0, 0, 0.3), (0, 1, 0.0)], "y int, p int, c double")
    r = V.overall_metrics(df, "y", "p").first()
    assert (r.malicious_recall, r.benign_fpr, r.accuracy) == (None, 0.5, 0.5)
    assert r.macro_f1 == pytest.approx((2 / 3 + 0) / 2)
    bins = V.calibration_bins(df, "c", F.col("y") == F.col("p")).collect()
    assert {b.bin: b.inside for b in bins} == {2: True, -1: False}


def test_features_may_be_absent(spark):
    df = complete_features(spark.createDataFrame([("benign",)], "label string"))
    assert set(FEATURE_COLUMNS) <= set(df.columns)
    assert add_indicators(df).first().has_dns == 0.0


def test_flow_csv(spark, tmp_path):
    rows = labelled_flows(spark, 70).drop("seq")
    rows.write.option("header", True).csv(str(tmp_path / "ok"))
    back = read_flows(spark, str(tmp_path / "ok"))
    assert back.count() == 70 and back.filter("tls_sni IS NULL").count() == 0
    rows.withColumn("label", F.lit("odd")).write.option("header", True).csv(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="odd"):
        read_flows(spark, str(tmp_path / "bad")).collect()


def test_flow_files_with_differing_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("flow_id,packet_count,byte_count,timestamp\nf1,20,2000,3.5\nf2,1,60,1.5\n")
    (tmp_path / "b.csv").write_text("byte_count,flow_id,packet_count,timestamp\n500,f3,5,2.5\n")
    rows = read_flows(spark, str(tmp_path), labelled=False).orderBy("row_order").collect()
    assert [(r.flow_id, r.packet_count, r.byte_count) for r in rows] == [("f2", 1, 60), ("f3", 5, 500), ("f1", 20, 2000)]
    assert [r.row_order for r in rows] == [1, 2, 3]


def test_flow_files_with_unknown_headers_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("flow_id,packet_count\nf1,20\n")
    (tmp_path / "empty.csv").write_text("")
    assert read_flows(spark, str(tmp_path), labelled=False).count() == 1
    for text in ("f2,1\nf3,2\n", "flow_id;packet_count\nf4,3\n"):
        (tmp_path / "b.csv").write_text(text)
        with pytest.raises(ValueError, match="b.csv"):
            read_flows(spark, str(tmp_path), labelled=False)


def test_flow_files_without_time_keep_their_lines(spark, tmp_path):
    for name in ("b", "a", "c"):
        lines = "".join(f"{name}{i},{i},64\n" for i in range(30))
        (tmp_path / f"{name}.csv").write_text("flow_id,packet_count,byte_count\n" + lines)
    rows = read_flows(spark, str(tmp_path), labelled=False).orderBy("row_order").collect()
    assert [r.flow_id for r in rows] == [f"{name}{i}" for name in "abc" for i in range(30)]


def test_capture_rows_are_unique_over_many_files(spark):
    records = spark.range(20_000).select(
        F.format_string("capture-%05d.pcap", "id").alias("file"),
        F.lit(0).cast("long").alias("record_no"),
        F.lit(True).alias("ok"),
        F.lit(7).cast("long").alias("t_us"),
        F.lit("10.0.0.1").alias("src_ip"),
        F.lit("10.0.0.2").alias("dst_ip"),
    )
    made = capture_packets(records)
    assert made.select("seq").distinct().count() == 20_000
    first, last = made.agg(F.min("seq"), F.max("seq")).first()
    assert (first, last) == (0, 19_999 << 40)


def test_capture_files(spark, tmp_path):
    p = packets(spark, GOLDEN)
    whole = capture(p.orderBy("seq").toPandas())
    arp = bytes(12) + b"\x08\x06" + bytes(28)
    (tmp_path / "a.pcap").write_bytes(whole + struct.pack("<4I", 9, 0, len(arp), len(arp)) + arp)
    (tmp_path / "b.pcap").write_bytes(whole[:-5])
    (tmp_path / "c.pcap").write_bytes(b"not a capture")
    records = read_captures(spark, str(tmp_path))
    counts = {r.file[-6:]: (r.records_read, r.records_skipped) for r in capture_counts(records).collect()}
    assert counts == {"a.pcap": (15, 1), "b.pcap": (13, 0)}
    flows = build_flows(capture_packets(records.filter(F.col("file").endswith("a.pcap"))))
    assert [r.packet_count for r in flows.orderBy("start_us").collect()] == [2, 8, 1, 1, 2]


def test_train_save_load_score(spark, tmp_path):
    flows = labelled_flows(spark, 420)
    art = train_all(flows, ["seq"], grid=[TRIAGE_GRID[0]], max_iter=25)
    assert art.log[0]["val_macro_f1"] > 0.8
    art.save(str(tmp_path / "full"))
    bare = Artifacts(art.triage, art.light, art.heavy, art.scaler, 0.9, None)
    bare.save(str(tmp_path / "bare"))
    again = Artifacts.load(spark, str(tmp_path / "full"))
    assert again.theta == art.theta and again.calibrator is not None
    assert Artifacts.load(spark, str(tmp_path / "bare")).calibrator is None
    with pytest.raises(FileNotFoundError):
        Artifacts.load(spark, str(tmp_path / "nothing"))
    a = score_flows(flows, art, ["seq"]).select("flow_id", "ml_verdict", "dl_verdict", "dl_confidence", "model_used")
    b = score_flows(flows, again, ["seq"]).select(*a.columns)
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.count() == 420
    vectors = with_vector(complete_features(flows))
    triaged = art.triage.transform(vectors).withColumn("cls", F.col("prediction").cast("int"))
    some = occlusion_evidence(triaged.drop("features"), "flow_id", "cls", "probability", art.triage, fit_scaler(complete_features(flows)))
    check = evidence_check(some).first()
    assert (check["rows"], check.rows_without_evidence, check.rows_degenerate) == (420, 0, 0)


def test_any_scorer(spark):
    def stub(pdf):
        return {
            "ml_verdict": ["ddos"] * len(pdf),
            "ml_confidence": [0.9] * len(pdf),
            "dl_verdict": ["benign"] * len(pdf),
            "dl_confidence": [0.8] * len(pdf),
            "model_used": ["light"] * len(pdf),
            "shap_evidence": [[{"feature": "entropy", "value": 0.1, "evidence_source": "xgboost_triage"}]] * len(pdf),
        }

    df = spark.createDataFrame([("a",), ("b",)], "flow_id string")
    rows = score_with(df, stub, frame=False).collect()
    assert [r.flow_id for r in rows] == ["a", "b"] and rows[0].shap_evidence[0].feature == "entropy"


def test_sessions_over_disordered_files(spark, tmp_path):
    rows = random_packets(8, n=120)
    p = packets(spark, rows).filter("src_ip IS NOT NULL").persist()
    lateness = as_files(p, str(tmp_path / "in"), "t_us", "seq", block_s=600, tick_us=1, file_rows=40)
    assert len(list((tmp_path / "in").glob("*.parquet"))) >= 4
    made = sessionize_available(stream_files(spark, str(tmp_path / "in"), p.schema), str(tmp_path / "work"), lateness)
    batch = with_reason(build_flows(p), p)
    columns = ["flow_id", "packet_count", "byte_count", "fwd_packets", "last_us", "gap_sum", "gap_sq", "n_hist", "finalize_reason"]
    # One packet has no gaps: the stream writes 0 where the batch sum has nothing to add.
    fill = {"gap_sum": 0}
    a = made.select(*columns).fillna(fill).withColumn("gap_sq", F.coalesce(F.col("gap_sq").cast("double"), F.lit(0.0)))
    b = batch.select(*columns).fillna(fill).withColumn("gap_sq", F.coalesce(F.col("gap_sq").cast("double"), F.lit(0.0)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_a_late_opening_is_not_lost(spark, tmp_path):
    """Four files of one row each, the last one behind the others."""
    schema = "a_ip string, t_us long, is_probe boolean, flow_id string, b_ip string, b_port int"
    for at in (200, 300, 400, 150, 2000):
        name = f"f{at}"
        both = [("s", at * S, probe, name, name, 80) for probe in (False, True)] if at < 2000 else [(None, at * S, None, None, None, None)]
        spark.createDataFrame(both, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = stream_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    job = run_available(behaviour_stream(events, "300 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert late_rows(job) == 0
    got = {r.flow_id: (r.dest_fanout, r.port_fanout, r.flow_count) for r in combine_salts(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"f150": (1, 1, 1), "f200": (2, 1, 2), "f300": (1, 1, 1), "f400": (1, 1, 1)}


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    schema = "alert_id long, src_ip string, t_us long, threat_class string, risk_score double"
    for i, at in enumerate((100, 900, 950, 50)):
        spark.createDataFrame([(i, "s", at * S, "ddos", 0.99)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    job = run_available(incident_stream(stream, "10 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert late_rows(job) == 1


def test_flow_stream_archives_what_it_read(spark, tmp_path):
    labelled_flows(spark, 5).select(*FLOW_SCHEMA.names).coalesce(1).write.option("header", True).csv(str(tmp_path / "one"))
    (part,) = (tmp_path / "one").glob("*.csv")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(part.read_text())
    job = run_available(flow_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sum(p["numInputRows"] for p in job.recentProgress) == 5
    assert spark.read.parquet(str(tmp_path / "out")).where("packet_count > 0").count() == 5
