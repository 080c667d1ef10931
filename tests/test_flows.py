import pytest
from helpers import GOLDEN, S, loop, packets, random_packets
from pyspark.sql import functions as F

from flowlens.config import FlowConfig
from flowlens.operators.behaviour import source_behaviour
from flowlens.operators.features import contract_check, with_measures
from flowlens.operators.ordering import running, spanning, ranged
from flowlens.operators.sessionize import build_flows, dense_flow_ids, peak_concurrency, with_reason
from flowlens.plans.flows import extract_features

A, B = "10.0.0.1", "10.0.0.2"


CELLS = (None, 7)  # ranges: as the session's settings give, and so many that keys span them


def features(spark, rows, **kw):
    cfg = FlowConfig(**kw)
    return extract_features(packets(spark, rows), cfg, keep=["start_seq"]).orderBy("start_seq").collect()


@pytest.mark.parametrize("mode", ["event_gap", "replay_exact"])
def test_golden_capture(spark, mode):
    p = packets(spark, GOLDEN)
    rows = with_reason(build_flows(p, mode=mode), p).orderBy("start_us").collect()
    assert [r.packet_count for r in rows] == [2, 8, 1, 1, 2]
    assert [r.fwd_packets for r in rows] == [1, 3, 1, 0, 1]
    assert [r.finalize_reason for r in rows] == ["flush", "tcp_close", "tcp_close", "flush", "flush"]
    assert (rows[1].a_ip, rows[1].a_port) == ("192.0.2.10", 80)


def test_first_packet_initiator(spark):
    p = packets(spark, GOLDEN)
    rows = build_flows(p, FlowConfig(initiator="first_packet")).orderBy("start_us").collect()
    assert (rows[1].a_ip, rows[1].a_port, rows[1].fwd_packets) == ("192.0.2.20", 50000, 5)


def test_counters_and_rates(spark):
    (r,) = features(spark, [(0, A, 1, B, 80, "TCP", 100, "A"), (S, A, 1, B, 80, "TCP", 200, "A")])
    assert (r.packet_count, r.byte_count, r.duration, r.packet_rate, r.avg_packet_size) == (2, 300, 1.0, 2.0, 150.0)


def test_byte_ratio(spark):
    (r,) = features(spark, [(0, A, 1, B, 80, "TCP", 1000, "A"), (S, B, 80, A, 1, "TCP", 50, "A")])
    assert r.byte_ratio == 20.0


def test_size_entropy(spark):
    def of(sizes):
        (r,) = features(spark, [(i * S, A, 1, B, 80, "TCP", n, "A") for i, n in enumerate(sizes)])
        return r.entropy

    assert of([60] * 5) == 0.0
    assert of([1, 2, 3, 4]) == pytest.approx(2.0)


def test_periodicity(spark):
    def of(times):
        (r,) = features(spark, [(int(t * S), A, 1, B, 80, "TCP", 60, "A") for t in times])
        return r

    even = of([0, 2, 4, 6, 8])
    assert even.iat_std == 0.0 and even.periodicity_score == 1.0
    assert of([0, 0.1, 5, 5.2, 30, 30.1]).periodicity_score < 0.5


def test_single_packet_has_no_nan(spark):
    (r,) = features(spark, [(0, A, 1, B, 80, "TCP", 60, "A")])
    assert (r.duration, r.packet_rate, r.byte_rate, r.iat_mean, r.iat_std, r.periodicity_score) == (0,) * 6


def test_close_and_exact_timeout(spark):
    p = packets(spark, [(0, A, 1, B, 80, "TCP", 60, "S"), (200_000, A, 1, B, 80, "TCP", 60, "FA")])
    (r,) = with_reason(build_flows(p), p).collect()
    assert (r.packet_count, r.finalize_reason) == (2, "tcp_close")
    for gap, n in ((5 * S - 1, 1), (5 * S, 2)):
        p = packets(spark, [(0, A, 1, B, 53, "UDP", 60), (gap, A, 1, B, 53, "UDP", 60)])
        assert build_flows(p, FlowConfig(udp_timeout_s=5)).count() == n


def test_address_order_is_text_order(spark):
    (r,) = features(spark, [(0, "192.0.2.9", 1, "192.0.2.10", 2, "TCP", 60, "A")])
    assert r.src_ip == "192.0.2.10"


def test_fanout_and_window(spark):
    rows = [(i * S, A, 1, f"10.0.1.{i}", 80, "TCP", 60, "S") for i in range(5)]
    last = features(spark, rows)[-1]
    assert (last.dest_fanout, last.flow_count, last.port_fanout) == (5, 5, 1)
    many = [(i * S, A, i, B, 80, "TCP", 60, "S") for i in range(500)]
    assert max(r.flow_count for r in features(spark, many, source_window_s=10.0)) == 11


def test_source_cap_keeps_the_newest(spark):
    rows = [(i, A, 1, f"10.0.1.{i}", 80, "TCP", 60, "S") for i in range(9)]
    got = features(spark, rows, source_cap=3)
    assert [r.flow_count for r in got] == [1, 2, 3, 3, 3, 3, 3, 3, 3]
    assert got[-1].dest_fanout == 3


def test_history_cap(spark):
    rows = [(i * S, A, 1, B, 80, "TCP", 40 + i % 2 if i < 950 else 99, "A") for i in range(1000)]
    p = packets(spark, rows)
    cfg = FlowConfig(history_cap=50)
    for cells in CELLS:
        r = with_measures(build_flows(p, cfg, cells=cells)).first()
        assert (r.packet_count, r.n_hist, r.n_gap, r.entropy) == (1000, 50, 49, 0.0)


def test_dns_and_tls(spark):
    rows = [
        (0, A, 9, B, 53, "UDP", 60, None, "ab.", "A"),
        (1, A, 9, B, 53, "UDP", 60, None, "aaaa", "TXT"),
        (2, A, 1, B, 443, "TCP", 60, "A", None, None, "one"),
        (3, A, 1, B, 443, "TCP", 60, "A", None, None, "two"),
    ]
    dns, tls = features(spark, rows)
    assert (dns.dns_query_length, dns.dns_entropy, dns.dns_record_type) == (3.0, 0.5, "TXT")
    assert (tls.tls_ja3, tls.tls_sni, tls.dns_record_type) == ("observed", "one", "")


@pytest.mark.parametrize("seed,cap", [(1, 10_000), (2, 4)])
def test_replay_equals_packet_loop(spark, seed, cap):
    rows = random_packets(seed)
    cfg = FlowConfig(source_cap=cap)
    want = loop(rows, cfg)
    p = packets(spark, rows)
    for cells in CELLS:
        flows = with_reason(build_flows(p, cfg, "replay_exact", cells), p)
        seen = source_behaviour(flows, cfg, "replay_visible", p, cells).collect()
        got = {
            r.start_seq: (r.packet_count, r.finalize_reason, (r.dest_fanout, r.port_fanout, r.flow_count)) for r in seen
        }
        assert got == want


@pytest.mark.parametrize("seed", [3, 4])
def test_ranges_do_not_change_results(spark, seed):
    p = packets(spark, random_packets(seed))
    for cfg in (FlowConfig(history_cap=3, source_cap=5), FlowConfig()):
        few = extract_features(p, cfg, cells=1)
        many = extract_features(p, cfg, cells=9)
        assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_one_key_spans_ranges(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"))
    table = ranged(df.withColumn("one", F.lit(1)), ["k", "t"], "test", 8)
    sizes = [r["count"] for r in table.groupBy("cell").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 300
    assert [r.k for r in spanning(table, ["k"]).collect()] == [7]
    made = running(df.withColumn("one", F.lit(1)), ["k"], ["t"], {"n": ("sum", "one"), "top": ("max", "t")}, 8)
    assert made.where("k = 7 AND (n <> t + 1 OR top <> t)").count() == 0
    assert made.where("k <> 7 AND n <> 1").count() == 0


def test_no_window_is_partitioned_by_a_bare_key(spark):
    p = packets(spark, random_packets(5))
    plan = extract_features(p)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("cell#" in line for line in windows)


def test_peak_ids_and_contract(spark):
    p = packets(spark, GOLDEN)
    flows = build_flows(p)
    assert peak_concurrency(flows, capacity=0).first().asDict() == {
        "peak_flows": 1,
        "capacity": 0,
        "over_capacity": 1,
    }
    ids = [r.flow_id for r in dense_flow_ids(flows).orderBy("start_us").collect()]
    assert ids == [f"flow-{i:06d}" for i in range(1, 6)]
    rows = extract_features(p)
    assert contract_check(rows).first().ok
    assert not contract_check(rows.drop("entropy")).first().ok
    assert not contract_check(rows.withColumn("entropy", F.lit(float("nan")))).first().ok
