"""Every registered query: a callable (spark, sf_dir) -> DataFrame over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.catalog import fixtures
from flowlens.catalog.capture_bytes import capture_files, view_address
from flowlens.config import (
    ABLATION_STAGES,
    CLASSES,
    DEFAULT,
    DEFAULT_THETA,
    FEATURE_COLUMNS,
    FLOW_COLUMNS,
    MICROS,
    stage_features,
)
from flowlens.functions.measures import first_argmax
from flowlens.functions.network import closes_flow, timeout_us, with_endpoints
from flowlens.operators import alerts as A
from flowlens.operators import dataset as D
from flowlens.operators import evaluate as V
from flowlens.operators import latency as L
from flowlens.operators import models as M
from flowlens.operators import routing as R
from flowlens.operators.behaviour import COUNTS, OPENED, source_behaviour
from flowlens.operators.evidence import linear_evidence
from flowlens.operators.features import (
    add_indicators,
    apply_scaler,
    complete_features,
    contract_check,
    fit_scaler,
    with_measures,
    with_variants,
)
from flowlens.operators.sessionize import (
    build_flows,
    lifecycle_counts,
    peak_concurrency,
    with_reason,
)
from flowlens.plans.flows import extract_features, measured_flows
from flowlens.plans.scoring import score_flows, train_all
from flowlens.sources.captures import capture_packets, decode_files
from flowlens.sources.sensors import packets_of_field_dump
from flowlens.sources.sinks import replay_records
from flowlens.sources.tables import read_flows
from flowlens.storage import work_folder, written
from flowlens.streaming.common import as_files, stream_files
from flowlens.streaming.detect import detect_available
from flowlens.streaming.replay import score_and_alert
from flowlens.streaming.sessions import sessionize_available
from flowlens.streaming.sources import behaviour_events
from flowlens.streaming.windows import behaviour_available, incidents_available, sequences_available

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Weights of the linear triage used by the evidence queries: weight(class, feature position).
LINEAR_WEIGHTS = [
    [((7 * c + 3 * j) % 11 - 5) / 10.0 for j in range(len(FEATURE_COLUMNS))] for c in range(len(CLASSES))
]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# Mean gaps are halves or quarters of microseconds, so six digits would round exact ties.
DIGITS = {"iat_mean": 9, "iat_std": 9}


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles and drop negative zeros, so that both engines print the same values."""
    doubles = [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({n: F.round(n, DIGITS.get(n, 6)) + F.lit(0.0) for n in doubles}) if doubles else df


FLOW_TOTALS = [
    "flow_id",
    "flow_key",
    "flow_no",
    "start_us",
    "last_us",
    "packet_count",
    "byte_count",
    "fwd_packets",
    "fwd_bytes",
    "rev_packets",
    "rev_bytes",
    "finalize_reason",
]


def _measured(spark: SparkSession, sf: str, names: list[str]) -> DataFrame:
    return tidy(with_measures(measured_flows(fixtures.packets(spark, sf))).select("flow_id", *names))


# --- Packets and flows -------------------------------------------------------------------------


@query
def flow_key(spark, sf):
    keyed = with_endpoints(fixtures.packets(spark, sf))
    return keyed.select(
        "seq",
        "flow_key",
        "is_forward",
        timeout_us(F.col("protocol"), DEFAULT).alias("timeout_us"),
        closes_flow(F.col("protocol"), F.col("tcp_flags")).alias("closes_flow"),
    )


@query
def flows_event_gap(spark, sf):
    packets = fixtures.packets(spark, sf)
    return with_reason(measured_flows(packets), packets).select(*FLOW_TOTALS)


@query
def flows_replay_exact(spark, sf):
    packets = fixtures.packets(spark, sf)
    return with_reason(measured_flows(packets, replay=True), packets).select(*FLOW_TOTALS)


@query
def flow_reasons(spark, sf):
    packets = fixtures.packets(spark, sf)
    return lifecycle_counts(with_reason(measured_flows(packets), packets))


@query
def flow_peak_concurrency(spark, sf):
    packets = fixtures.packets(spark, sf)
    return peak_concurrency(measured_flows(packets))


@query
def flow_rates(spark, sf):
    names = ["duration", "packet_rate", "byte_rate", "avg_packet_size", "byte_ratio", "packet_ratio"]
    return _measured(spark, sf, names)


@query
def flow_entropy(spark, sf):
    return _measured(spark, sf, ["entropy"])


@query
def flow_iat(spark, sf):
    return _measured(spark, sf, ["iat_mean", "iat_std", "periodicity_score"])


@query
def flow_dns(spark, sf):
    return _measured(spark, sf, ["dns_query_length", "dns_entropy", "dns_record_type"])


@query
def flow_tls(spark, sf):
    flows = measured_flows(fixtures.packets(spark, sf))
    return flows.select("flow_id", F.when(F.col("n_tls") > 0, "observed").otherwise("").alias("tls_ja3"), "tls_sni")


@query
def flow_feature_variants(spark, sf):
    names = ["byte_ratio_open", "packet_ratio_open", "periodicity_exp"]
    return tidy(with_variants(measured_flows(fixtures.packets(spark, sf))).select("flow_id", *names))


@query
def source_behaviour_past(spark, sf):
    packets = fixtures.packets(spark, sf)
    return source_behaviour(build_flows(packets)).select("flow_id", *COUNTS)


@query
def source_behaviour_replay(spark, sf):
    packets = fixtures.packets(spark, sf)
    flows = build_flows(packets, mode="replay_exact")
    seen = source_behaviour(flows, mode="replay_visible", packets=packets)
    return seen.select("flow_id", *COUNTS)


@query
def flow_features(spark, sf):
    return tidy(extract_features(fixtures.packets(spark, sf)))


@query
def flow_features_replay(spark, sf):
    packets = fixtures.packets(spark, sf)
    return tidy(extract_features(packets, replay=True))


@query
def engineered(spark, sf):
    rows = add_indicators(extract_features(fixtures.packets(spark, sf)))
    kinds = [f"dns_is_{t}" for t in ("A", "AAAA", "TXT", "NS")]
    return rows.select("flow_id", "has_dns", *kinds, "has_tls", "tls_sni_length")


@query
def feature_groups(spark, sf):
    rows = complete_features(extract_features(fixtures.packets(spark, sf)))

    def total(columns):
        out = F.lit(0.0)
        for c in columns:
            out = out + F.col(c)
        return out

    return tidy(rows.select("flow_id", *[total(stage_features(s)).alias(s) for s in ABLATION_STAGES]))


@query
def scaled_features(spark, sf):
    rows = complete_features(extract_features(fixtures.packets(spark, sf)))
    return tidy(apply_scaler(rows, fit_scaler(rows)).select("flow_id", *FEATURE_COLUMNS))


@query
def contract_report(spark, sf):
    return contract_check(extract_features(fixtures.packets(spark, sf)))


# --- Sources -----------------------------------------------------------------------------------

PACKET_FIELDS = ["t_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


@query
def captures(spark, sf):
    """The packet table written as capture bytes and decoded again."""
    records = decode_files(capture_files(fixtures.packets(spark, sf)))
    more = ["tcp_flags", "dns_query_name", "dns_query_length", "dns_record_type", "tls_handshake", "tls_sni"]
    packets = capture_packets(records)
    return packets.withColumns({c: view_address(F.col(c)) for c in ("src_ip", "dst_ip")}).select(*PACKET_FIELDS, *more)


@query
def sensor_import(spark, sf):
    """The packet table as a text field dump, read back as packets."""
    numbers = F.when(F.col("protocol") == "TCP", "6").when(F.col("protocol") == "UDP", "17").otherwise("1")
    dump = fixtures.packets(spark, sf).select(
        F.col("src_ip").alias("ip.src"),
        F.col("dst_ip").alias("ip.dst"),
        F.col("src_port").cast("string").alias("tcp.srcport"),
        F.col("dst_port").cast("string").alias("tcp.dstport"),
        numbers.alias("ip.proto"),
        F.format_string("%d.%06d", F.floor(F.col("t_us") / MICROS), F.col("t_us") % MICROS).alias("frame.time_epoch"),
        F.col("packet_length").cast("string").alias("frame.len"),
    )
    return packets_of_field_dump(dump).select(*PACKET_FIELDS, "packet_length")


@query
def flow_csv_roundtrip(spark, sf):
    """Flow features written as CSV and read back through the contract schema."""
    folder = work_folder(spark, "flow-csv")
    tidy(extract_features(fixtures.packets(spark, sf))).write.option("header", True).csv(f"{folder}/flows")
    back = read_flows(spark, f"{folder}/flows", labelled=False)
    return back.select("flow_id", "src_ip", "dst_port", "protocol", "packet_count", "entropy", "iat_mean", "has_dns", "tls_sni")


@query
def flow_csv_headers(spark, sf):
    """As flow_csv_roundtrip, from a folder whose files order their columns differently and leave some out."""
    folder = f"{work_folder(spark, 'flow-csv')}/flows"
    flows = written(tidy(extract_features(fixtures.packets(spark, sf))), "csv-flows")
    half = F.crc32(F.col("flow_id").cast("binary")) % 2 == 0
    flows.where(half).write.option("header", True).csv(folder)
    other = flows.where(~half).drop("tls_ja3s", "tls_ja4")
    other.select(*reversed(other.columns)).write.mode("append").option("header", True).csv(folder)
    back = read_flows(spark, folder, labelled=False)
    return back.select("flow_id", "src_ip", "dst_port", "protocol", "packet_count", "entropy", "iat_mean", "has_dns", "tls_sni")


# --- Training-set tables -----------------------------------------------------------------------


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.scored(spark, sf).withColumn("label", D.class_name(F.col("y_true")))


@query
def chrono_split(spark, sf):
    rows = fixtures.scored(spark, sf).select("seq", "t_us")
    return D.chronological_split(rows, ["t_us", "seq"]).select("seq", "part")


@query
def label_encode_validate(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("seq"), "event_type")
    rows = _labelled(spark, sf).select("seq", "label").join(events, "seq")
    mixed = rows.withColumn("label", F.when(F.col("event_type") == "error", "error").otherwise(F.col("label")))
    return D.encode_labels(mixed).select("seq", "label", "label_idx")


@query
def unknown_labels(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return D.unknown_labels(events.select(F.col("event_type").alias("label")))


@query
def class_distribution(spark, sf):
    return tidy(D.class_distribution(_labelled(spark, sf)))


@query
def balanced_weights(spark, sf):
    return tidy(D.class_weights(_labelled(spark, sf)))


@query
def host_sequences(spark, sf):
    packets = fixtures.packets(spark, sf)
    rows = complete_features(extract_features(packets, keep=["start_us", "start_seq"]))
    made = D.host_sequences(rows, "src_ip", ["start_us", "start_seq"])

    def summed(name: str):
        j = FEATURE_COLUMNS.index(name)
        return F.aggregate(F.transform("sequence", lambda x: x[j]), F.lit(0.0), lambda a, b: a + b)

    first = F.element_at("sequence", 1)[FEATURE_COLUMNS.index("byte_count")]
    return tidy(
        made.select(
            "flow_id",
            F.size("sequence").alias("length"),
            first.alias("first_bytes"),
            *[summed(n).alias(f"sum_{n}") for n in ("packet_count", "byte_count", "duration", "has_dns")],
        )
    )


@query
def interval_labels(spark, sf):
    flows = measured_flows(fixtures.packets(spark, sf))
    labelled = D.label_by_experiment(flows, fixtures.experiments(spark, sf))
    return labelled.select("flow_id", F.col("experiment_id").cast("long"), "label")


@query
def label_join(spark, sf):
    flows = measured_flows(fixtures.packets(spark, sf)).select("flow_id", "protocol", "start_seq", "packet_count")
    truth = _labelled(spark, sf).select(F.col("seq").alias("start_seq"), "label")
    labels = flows.filter("protocol <> 'ICMP'").join(truth, "start_seq").select("flow_id", "label")
    return D.join_labels(flows, labels).select("flow_id", "packet_count", "label")


@query
def stratified_split(spark, sf):
    return D.stratified_split(_labelled(spark, sf).select("seq", "label"), "seq")


@query
def group_split(spark, sf):
    rows = D.group_split(fixtures.scored(spark, sf).select("seq", "src_ip"), "src_ip")
    return rows.groupBy("src_ip", "part").agg(F.count(F.lit(1)).alias("n"))


# --- Models, fitted on the flows of the driver's events ----------------------------------------


def _training_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows of the packet table, labelled by the scored row of each flow's first packet."""
    flows = extract_features(fixtures.packets(spark, sf), keep=["start_us", "start_seq", "last_us"])
    truth = _labelled(spark, sf).select(F.col("seq").alias("start_seq"), "label")
    return written(flows.join(truth, "start_seq"), "training-flows")


FLOW_ORDER = ["start_us", "start_seq"]
FINISHED = ["last_us", "start_seq"]  # the order in which flows end


def _parts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    made = written(D.chronological_split(complete_features(_training_flows(spark, sf)), FLOW_ORDER), "training-parts")
    return {p: made.filter(F.col("part") == p) for p in ("train", "val", "test")}


@query
def triage_model(spark, sf):
    """Search log of the triage forest."""
    parts = _parts(spark, sf)
    _, log = M.train_triage(parts["train"], parts["val"])
    return spark.createDataFrame(log)


@query
def ablation(spark, sf):
    parts = _parts(spark, sf)
    return spark.createDataFrame(M.ablation(parts["train"], parts["val"]))


@query
def light_model(spark, sf):
    """Test predictions of the light verifier, per class."""
    parts = {k: D.encode_labels(v) for k, v in _parts(spark, sf).items()}
    scaler = written(fit_scaler(parts["train"]), "scaler")
    model = M.train_light(apply_scaler(parts["train"], scaler))
    scored = model.transform(M.with_vector(apply_scaler(parts["test"], scaler)))
    rows = scored.select("label_idx", F.col("prediction").cast("int").alias("pred"))
    return V.class_report(V.contingency(rows, "label_idx", "pred"))


@query
def heavy_model(spark, sf):
    """Test predictions of the temporal verifier, per class."""
    parts = {k: D.encode_labels(v) for k, v in _parts(spark, sf).items()}
    scaler = written(fit_scaler(parts["train"]), "scaler")
    steps = {k: parts[k].select("src_ip", *FLOW_ORDER, *FEATURE_COLUMNS, "label_idx") for k in ("train", "test")}
    sequenced = {k: D.host_sequences(apply_scaler(v, scaler), "src_ip", FLOW_ORDER, slim=True) for k, v in steps.items()}
    model = M.train_heavy(sequenced["train"])
    scored = model.transform(sequenced["test"].withColumn("features", M.sequence_vector()))
    rows = scored.select("label_idx", F.col("prediction").cast("int").alias("pred"))
    return V.class_report(V.contingency(rows, "label_idx", "pred"))


@query
def calibrated_scores(spark, sf):
    """Raw and calibrated calibration error of the triage forest on the test part."""
    parts = {k: M.with_vector(D.encode_labels(v)) for k, v in _parts(spark, sf).items()}
    model, _ = M.train_triage(parts["train"].drop("features"), parts["val"].drop("features"))
    calibrator = M.Calibrator.fit(model.transform(parts["val"]))
    scored = calibrator.apply(model.transform(parts["test"])).withColumn("raw", vector_to_array("probability"))
    scored = written(scored.select("label_idx", "raw", "calibrated"), "calibrated-rows")  # read for both errors

    def error(column: str) -> DataFrame:
        judged = M.with_verdict(scored, column, "v")
        return V.expected_calibration_error(judged, "v_confidence", F.col("v_idx") == F.col("label_idx"))

    return V.calibration_report(error("raw"), error("calibrated"))


@query
def scored_flows(spark, sf):
    """Train every stage on the earlier flows of the packet table, then score all of them."""
    flows = _training_flows(spark, sf)
    scored = score_flows(flows.drop("label"), train_all(flows, FLOW_ORDER), FLOW_ORDER)
    names = ["flow_id", "ml_verdict", "ml_confidence", "dl_verdict", "dl_confidence", "model_used"]
    return scored.select(*names)


@query
def model_evidence(spark, sf):
    """Evidence of a fitted linear triage, held against the model: per flow, all contributions to the verdict's class
    add up to the model's margin at the flow less that at the training mean; and the five kept are the largest."""
    parts = _parts(spark, sf)
    model = M.train_linear_triage(parts["train"])
    weights = model.coefficientMatrix.toArray().tolist()
    means = fit_scaler(parts["train"])
    judged = model.transform(M.with_vector(parts["test"])).withColumn("margins", vector_to_array("rawPrediction"))
    judged = judged.withColumn("ml_idx", F.col("prediction").cast("int"))
    usual = model.transform(M.with_vector(means.select(*[F.col(f"{c}__mean").alias(c) for c in FEATURE_COLUMNS])))
    usual = usual.select(vector_to_array("rawPrediction").alias("usual"))  # one row
    every = linear_evidence(judged, F.col("ml_idx"), weights, means, k=len(FEATURE_COLUMNS)).crossJoin(F.broadcast(usual))
    top = linear_evidence(judged, F.col("ml_idx"), weights, means).select("flow_id", F.col("shap_evidence").alias("top"))
    at = F.col("ml_idx") + 1
    due = F.element_at("margins", at) - F.element_at("usual", at)
    total = F.aggregate("shap_evidence", F.lit(0.0), lambda s, e: s + e.value)
    exact = F.abs(total - due) <= 1e-6 * (1 + F.abs(due))
    first = F.slice("shap_evidence", 1, 5) == F.col("top")
    return every.join(top, "flow_id").agg(
        F.count(F.lit(1)).alias("flows"), F.count_if(exact).alias("exact_flows"), F.count_if(first).alias("top_flows")
    )


# --- Routing and evaluation --------------------------------------------------------------------


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    return _route_and_judge(fixtures.scored(spark, sf))


def _route_and_judge(scored: DataFrame) -> DataFrame:
    """Scored rows with the routed branch and the verifier's verdict."""
    rows = scored.withColumn("model_used", R.route(F.col("ml_conf")))
    verdict = F.when(F.col("model_used") == "light", F.col("light_pred")).otherwise(F.col("heavy_pred"))
    return rows.withColumn("dl_pred", verdict)


@query
def route(spark, sf):
    return _predicted(spark, sf).select("seq", "ml_conf", "model_used")


@query
def route_three_tier(spark, sf):
    return fixtures.scored(spark, sf).select("seq", R.route_three_tier(F.col("ml_conf")).alias("tier"))


@query
def routing_stats(spark, sf):
    return tidy(R.routing_stats(fixtures.scored(spark, sf), "ml_conf", DEFAULT_THETA))


def _sweep(spark, sf):
    return R.threshold_sweep(
        fixtures.scored(spark, sf), "y_true", "ml_pred", "light_pred", "heavy_pred", "ml_conf"
    )


@query
def theta_sweep(spark, sf):
    return tidy(_sweep(spark, sf))


@query
def theta_select(spark, sf):
    return tidy(R.select_theta(_sweep(spark, sf)))


@query
def baseline_comparison(spark, sf):
    return tidy(
        R.compare_strategies(
            fixtures.scored(spark, sf), "y_true", "ml_pred", "light_pred", "heavy_pred", "ml_conf"
        )
    )


@query
def verdict_argmax(spark, sf):
    """First maximum of seven class scores, many of which tie."""
    rows = fixtures.scored(spark, sf)
    scores = F.array(
        *[((F.col("seq") * (i + 3) + F.col("y_true") * (2 * i + 1)) % 10).cast("double") / 10 for i in range(7)]
    )
    p = rows.select("seq", scores.alias("p"))
    best = first_argmax(F.col("p"))
    return p.select("seq", best.alias("class_idx"), D.class_name(best).alias("verdict"), F.array_max("p").alias("confidence"))


@query
def confusion_matrix(spark, sf):
    return V.confusion_matrix(_predicted(spark, sf), "y_true", "dl_pred")


@query
def class_report(spark, sf):
    return tidy(V.report_with_averages(_predicted(spark, sf), "y_true", "dl_pred"))


@query
def overall_metrics(spark, sf):
    return tidy(V.overall_metrics(_predicted(spark, sf), "y_true", "dl_pred"))


@query
def branch_metrics(spark, sf):
    return tidy(V.branch_metrics(_predicted(spark, sf), "y_true", "dl_pred", "model_used"))


@query
def ece(spark, sf):
    rows = fixtures.scored(spark, sf)
    return tidy(V.expected_calibration_error(rows, "ml_conf", F.col("ml_pred") == F.col("y_true")))


@query
def calibration_report(spark, sf):
    rows = _predicted(spark, sf)
    raw = V.expected_calibration_error(rows, "ml_conf", F.col("ml_pred") == F.col("y_true"))
    other = V.expected_calibration_error(rows, "dl_conf", F.col("dl_pred") == F.col("y_true"))
    return tidy(V.calibration_report(raw, other))


@query
def latency_summary(spark, sf):
    rows = _predicted(spark, sf)
    return tidy(L.latency_summary(rows, "model_used", "latency_ms", "seq"))


@query
def latency_nearest_rank(spark, sf):
    rows = _predicted(spark, sf)
    return tidy(
        L.latency_nearest_rank(rows, "model_used", "latency_ms", "seq")
    )


@query
def throughput_table(spark, sf):
    rows = _predicted(spark, sf)
    summary = L.latency_summary(rows, "model_used", "latency_ms", "seq")
    return tidy(L.throughput_table(rows, "latency_ms", "model_used", summary))


@query
def compute_saving(spark, sf):
    rows = _predicted(spark, sf).withColumns(
        {"triage_ms": F.col("latency_ms") * 0.1, "light_ms": F.col("latency_ms") * 0.3, "heavy_ms": F.col("latency_ms")}
    )
    return tidy(L.compute_saving(rows, "triage_ms", "light_ms", "heavy_ms", "model_used"))


@query
def backlog(spark, sf):
    """Rows offered at 50 per second of packet time, finished at their recorded time plus latency."""
    rows = fixtures.scored(spark, sf)
    done = (F.col("t_us") / MICROS + F.col("latency_ms") / 1000.0).alias("finished_s")
    return L.backlog(rows.select(F.col("seq"), done), "seq", "finished_s", 50.0)


# --- Alerts and incidents ----------------------------------------------------------------------


def _scored_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flow features with a prediction taken from the scored row of the flow's first packet."""
    flows = complete_features(
        extract_features(fixtures.packets(spark, sf), keep=["start_seq", "last_us"])
    )
    return flows.join(_prediction_columns(_predicted(spark, sf)), "start_seq")


def _prediction_columns(predicted: DataFrame) -> DataFrame:
    return predicted.select(
        F.col("seq").alias("start_seq"),
        F.col("ml_pred").alias("ml_idx"),
        D.class_name(F.col("ml_pred")).alias("ml_verdict"),
        F.col("ml_conf").alias("ml_confidence"),
        D.class_name(F.col("dl_pred")).alias("dl_verdict"),
        F.col("dl_conf").alias("dl_confidence"),
        "model_used",
    )


def _explained_flows(spark: SparkSession, sf: str) -> DataFrame:
    flows = complete_features(extract_features(fixtures.packets(spark, sf), keep=["start_seq", "last_us"]))
    flows = written(flows, "explained-flows")  # read for the means and for the rows
    rows = flows.join(_prediction_columns(_predicted(spark, sf)), "start_seq")
    means = fit_scaler(flows)
    return linear_evidence(rows, F.col("ml_idx"), LINEAR_WEIGHTS, means)


@query
def alerts(spark, sf):
    made = A.build_alerts(_scored_flows(spark, sf).withColumn("shap_evidence", _no_evidence()))
    return tidy(made.drop("evidence"))


def _no_evidence():
    return F.array().cast("array<struct<feature:string,value:double,evidence_source:string>>")


@query
def alerts_class_severity(spark, sf):
    rows = fixtures.scored(spark, sf)
    verdict = D.class_name(F.col("ml_pred"))
    return tidy(
        rows.select(
            "seq",
            verdict.alias("threat_class"),
            A.class_severity(verdict).alias("severity"),
            A.class_risk(F.col("ml_conf"), verdict).alias("risk_score"),
        )
    )


@query
def alert_evidence(spark, sf):
    made = A.build_alerts(_explained_flows(spark, sf))
    long = made.select("flow_id", F.posexplode("evidence").alias("position", "e"))
    value = F.when(F.col("e.feature").isin(list(DIGITS)), F.round("e.value", 9)).otherwise(F.round("e.value", 6))
    return long.select(
        "flow_id",
        "position",
        F.col("e.feature").alias("feature"),
        (value + F.lit(0.0)).alias("value"),
        (F.round("e.contribution", 6) + F.lit(0.0)).alias("contribution"),
        F.col("e.evidence_source").alias("evidence_source"),
    )


@query
def replay_records_flat(spark, sf):
    """The record sink's rows with the nested parts flattened."""
    made = replay_records(_explained_flows(spark, sf))
    return tidy(
        made.select(
            *[c for c in made.columns if c not in ("shap_evidence", "alert")],
            F.size("shap_evidence").alias("evidence_size"),
            F.col("shap_evidence")[0]["feature"].alias("top_feature"),
            F.col("alert.severity").alias("alert_severity"),
            F.col("alert.risk_score").alias("alert_risk"),
        )
    )


def _alert_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _alert_columns(_predicted(spark, sf))


def _alert_columns(rows: DataFrame) -> DataFrame:
    agree = F.col("ml_pred") == F.col("dl_pred")
    return rows.select(
        F.col("seq").alias("alert_id"),
        "src_ip",
        "t_us",
        D.class_name(F.col("dl_pred")).alias("threat_class"),
        A.risk_score(F.col("dl_conf"), agree).alias("risk_score"),
    )


@query
def incidents(spark, sf):
    stream = _alert_stream(spark, sf)
    made = A.incidents(stream)
    return tidy(made.withColumn("threat_classes", F.array_join("threat_classes", ",")))


@query
def recent_alerts(spark, sf):
    return tidy(A.recent_alerts(_alert_stream(spark, sf).filter("threat_class <> 'benign'"), 50))


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf).select(
        "t_us",
        "model_used",
        D.class_name(F.col("ml_pred")).alias("ml_verdict"),
        D.class_name(F.col("dl_pred")).alias("dl_verdict"),
        F.col("dl_conf").alias("dl_confidence"),
    )


@query
def dashboard_minute(spark, sf):
    return tidy(A.dashboard_minutes(_verdicts(spark, sf)))


@query
def dashboard_totals(spark, sf):
    return tidy(A.dashboard_totals(_verdicts(spark, sf), A.incidents(_alert_stream(spark, sf))))


@query
def verdict_cube(spark, sf):
    return A.verdict_cube(_verdicts(spark, sf))


# --- Streams over the driver's event file ------------------------------------------------------


def _replayed(rows: DataFrame, folder: str, t_us: str, tie: str, tick_us: int = 1000, files: int = 1) -> tuple[DataFrame, str]:
    """A table as a stream of several files out of order, and the lateness that covers the disorder."""
    lateness = as_files(rows, f"{folder}/in", t_us, tie, tick_us=tick_us)
    # what waits is a share of the table, so the number of batches must not grow with it
    files = max(files, -(-len(rows.sparkSession.read.parquet(f"{folder}/in").inputFiles()) // 8))
    return stream_files(rows.sparkSession, f"{folder}/in", rows.schema, files_per_batch=files), lateness


@query
def stream_flows(spark, sf):
    """Flow sessions of the packet stream; equal to flows_event_gap."""
    folder = work_folder(spark, "flows")
    packets, lateness = _replayed(fixtures.packets(spark, sf), folder, "t_us", "seq", tick_us=1, files=2)
    made = with_measures(sessionize_available(packets, folder, lateness))
    return tidy(made.select(*[c for c in FLOW_TOTALS if c != "flow_no"], "entropy", "iat_mean", "iat_std"))


@query
def intake_restart(spark, sf):
    """Flow sessions over two runs of a folder intake that archives what it read; equal to flows_event_gap.

    The first run ends with open flows and waiting packets; the second one finds them in the state.
    """
    folder = work_folder(spark, "intake")
    packets = fixtures.packets(spark, sf)
    half = packets.agg(F.expr("percentile_approx(t_us, 0.5)").alias("at")).first()["at"] or 0
    early = F.col("t_us") + F.pmod(F.xxhash64("seq"), F.lit(60 * MICROS)) < half
    lateness = as_files(packets.where(early), f"{folder}/in", "t_us", "seq", end=False)
    stream = stream_files(spark, f"{folder}/in", packets.schema, files_per_batch=2, archive=f"{folder}/archive")
    sessionize_available(stream, folder, lateness, flush=False)
    as_files(packets.where(~early), f"{folder}/in", "t_us", "seq", tick_us=1)
    made = sessionize_available(stream, folder, lateness)
    return made.select(*[c for c in FLOW_TOTALS if c != "flow_no"])


@query
def stream_scored(spark, sf):
    """Packets to scored flows and alert files in one stream, held against the batch jobs on the same packets.

    Models are fitted on the batch flows. One row: flows scored, those with the batch verdicts, and alerts that agree.
    """
    flows = _training_flows(spark, sf)
    art = train_all(flows, FINISHED, grid=[{"maxDepth": 6, "numTrees": 10}], max_iter=20)
    want = score_flows(flows.drop("label"), art, FINISHED)
    folder = work_folder(spark, "detect")
    packets, lateness = _replayed(fixtures.packets(spark, sf), folder, "t_us", "seq", tick_us=1, files=3)
    detect_available(packets, folder, lateness, art)
    got = spark.read.parquet(f"{folder}/scored")
    names = ["flow_id", *FLOW_COLUMNS[6:], "ml_verdict", "ml_confidence", "dl_verdict", "dl_confidence", "model_used"]
    same = tidy(got.select(*names)).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    same = same.join(tidy(want.select(*names)).withColumn("m", F.lit(1)), names, "left")
    made = same.agg(F.sum("n").alias("flows"), F.sum(F.when(F.col("m") == F.col("n"), 1).otherwise(0)).alias("equal_flows"))
    alerts = spark.read.schema("flow_id string").json(f"{folder}/alerts").select("flow_id")
    due = got.where("dl_verdict <> 'benign'").select("flow_id", F.lit(1).alias("due"))
    off = alerts.withColumn("is", F.lit(1)).join(due, "flow_id", "full").where("is IS NULL OR due IS NULL")
    return made.crossJoin(off.agg(F.count(F.lit(1)).alias("alerts_off")))  # one row and one row


@query
def stream_behaviour(spark, sf):
    """Source behaviour on a stream of openings and probes; equal to source_behaviour_past."""
    folder = work_folder(spark, "behaviour")
    flows = written(measured_flows(fixtures.packets(spark, sf)).select("flow_id", *OPENED, "last_us"), "behaviour-flows")
    events, lateness = _replayed(behaviour_events(flows), folder, "t_us", "flow_id", tick_us=1)
    return behaviour_available(events, folder, lateness)


@query
def stream_incidents(spark, sf):
    """Incidents of the alert stream; equal to incidents."""
    folder = work_folder(spark, "incidents")
    alerts, lateness = _replayed(_alert_stream(spark, sf), folder, "t_us", "alert_id", tick_us=1)
    return tidy(incidents_available(alerts, folder, lateness))


@query
def stream_sequences(spark, sf):
    """Host sequences of a flow stream."""
    folder = work_folder(spark, "sequences")
    rows = fixtures.scored(spark, sf).select(
        F.col("seq").cast("string").alias("flow_id"), "seq", "t_us", "src_ip", "y_true", "latency_ms"
    )
    stream, lateness = _replayed(rows, folder, "t_us", "seq", tick_us=1)
    out = sequences_available(stream, "src_ip", "seq", folder, lateness, ["y_true", "latency_ms"])
    total = F.aggregate(F.transform("sequence", lambda x: x[0]), F.lit(0.0), lambda a, b: a + b)
    oldest = F.element_at("sequence", 1)[1]
    return tidy(out.select(F.col("flow_id").cast("long").alias("seq"), total.alias("sum_class"), oldest.alias("oldest_ms")))


@query
def stream_alerts(spark, sf):
    """Scored flow stream with exactly-once alert files; one row per alert."""
    folder = work_folder(spark, "alerts")
    flows = extract_features(fixtures.packets(spark, sf), keep=["start_seq", "last_us"])
    as_files(flows, f"{folder}/in", "last_us", "flow_id", end=False)
    stream = stream_files(spark, f"{folder}/in", flows.schema)
    predictions = _prediction_columns(_predicted(spark, sf))

    def score(batch: DataFrame) -> DataFrame:
        return complete_features(batch).join(predictions, "start_seq").withColumn("shap_evidence", _no_evidence())

    score_and_alert(stream, score, f"{folder}/alerts", f"{folder}/checkpoint").awaitTermination()
    names = ["flow_id", "threat_class", "confidence", "severity", "model_used", "risk_score"]
    return tidy(spark.read.json(f"{folder}/alerts").select(*names))
