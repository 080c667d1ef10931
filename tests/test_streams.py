"""Streams of packets: carried over restarts, empty inputs, late rows, equal to the batch jobs."""

import pytest
from helpers import S, packets, random_packets
from pyspark.sql import functions as F

from flowlens.config import FlowConfig
from flowlens.operators.features import with_measures
from flowlens.operators.sessionize import build_flows, with_reason
from flowlens.streaming.common import as_files, stream_files
from flowlens.streaming.sessions import Sessions, sessionize_available

COLUMNS = ["flow_id", "packet_count", "byte_count", "fwd_packets", "last_us", "n_gap", "n_hist", "entropy", "iat_mean", "iat_std", "finalize_reason"]


def rounded(flows):
    rows = with_measures(flows).select(*COLUMNS)
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows.collect())


def test_two_runs_equal_one(spark, tmp_path):
    """The second run continues open flows and waiting packets of the first; a third finds nothing new."""
    p = packets(spark, random_packets(8, n=120)).persist()
    early, late = p.where("seq < 70 OR seq = 75"), p.where("seq >= 70 AND seq <> 75")
    folder, work = str(tmp_path / "in"), str(tmp_path / "work")
    lateness = as_files(early, folder, "t_us", "seq", block_s=900, end=False)
    stream = stream_files(spark, folder, p.schema)
    first = sessionize_available(stream, work, lateness, flush=False).count()
    as_files(late, folder, "t_us", "seq", block_s=900, tick_us=1)
    made = rounded(sessionize_available(stream, work, lateness))
    assert made == rounded(with_reason(build_flows(p), p))
    assert first < len(made)
    assert rounded(sessionize_available(stream, work, lateness)) == made  # nothing new


def test_cells_of_any_width_give_the_same_flows(spark):
    p = packets(spark, random_packets(3, n=150)).persist()
    want = rounded(with_reason(build_flows(p), p))
    for width in (1, 7, 100_000):
        assert rounded(with_reason(build_flows(p, cell_s=width), p)) == want


def test_empty_stream(spark, tmp_path):
    p = packets(spark, [(0, "10.0.0.1", 1, "10.0.0.2", 80, "TCP", 60, "A")]).limit(0)
    lateness = as_files(p, str(tmp_path / "in"), "t_us", "seq")
    stream = stream_files(spark, str(tmp_path / "in"), p.schema)
    assert sessionize_available(stream, str(tmp_path / "work"), lateness).count() == 0


def test_late_packets_are_dropped_and_counted(spark, tmp_path):
    times = [100, 900, 50, 950, 2000]
    p = packets(spark, [(t * S, "10.0.0.1", 1, "10.0.0.2", 80, "UDP", 60) for t in times]).persist()
    for i in range(len(times)):
        p.where(F.col("seq") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_files(spark, str(tmp_path / "in"), p.schema)
    made = sessionize_available(stream, str(tmp_path / "work"), "10 seconds").collect()
    state = Sessions(stream, str(tmp_path / "work"), "10 seconds").state
    assert sorted(r.start_us // S for r in made) == [100, 900] and state.clock(4) == (1990 * S, 1)


def test_a_stream_takes_no_cap(spark):
    p = packets(spark, [(0, "10.0.0.1", 1, "10.0.0.2", 80, "TCP", 60, "A")])
    with pytest.raises(ValueError):
        Sessions(p, "unused", "1 second", FlowConfig(history_cap=5))


def test_windows_on_a_stream_equal_the_batch_jobs(spark, tmp_path):
    """Behaviour, incidents and sequences of several batches, whatever the source, without a call for each source."""
    from flowlens.operators.alerts import incidents
    from flowlens.operators.behaviour import COUNTS, OPENED, source_behaviour
    from flowlens.operators.dataset import host_sequences
    from flowlens.streaming.sources import behaviour_events
    from flowlens.streaming.windows import behaviour_available, incidents_available, sequences_available

    def replayed(rows, name, tie):
        lateness = as_files(rows, str(tmp_path / name / "in"), "t_us", tie, block_s=600, tick_us=1)
        return stream_files(spark, str(tmp_path / name / "in"), rows.schema), str(tmp_path / name), lateness

    def rows(df, *names):
        return sorted(map(str, df.select(*names).collect()))

    flows = build_flows(packets(spark, random_packets(5, n=150))).select("flow_id", *OPENED, "last_us").persist()
    made = behaviour_available(*replayed(behaviour_events(flows), "behaviour", "flow_id"))
    assert rows(made, "flow_id", *COUNTS) == rows(source_behaviour(flows), "flow_id", *COUNTS)
    alerts = spark.range(90).selectExpr(
        "id AS alert_id", "concat('h', id % 3) AS src_ip", "id * 21000000 AS t_us",
        "element_at(array('benign', 'dos', 'c2'), CAST(id % 7 % 3 + 1 AS INT)) AS threat_class", "CAST(id % 10 * 10 AS DOUBLE) AS risk_score",
    ).persist()
    names = ["alert_id", "src_ip", "t_us", "alert_count", "class_count", "max_risk_score"]
    assert rows(incidents_available(*replayed(alerts, "incidents", "alert_id")), *names) == rows(incidents(alerts), *names)
    hosts = alerts.withColumn("flow_id", F.col("alert_id").cast("string"))
    stream, folder, lateness = replayed(hosts, "sequences", "alert_id")
    made = sequences_available(stream, "src_ip", "alert_id", folder, lateness, ["risk_score"], 4)
    want = host_sequences(hosts, "src_ip", ["t_us", "alert_id"], ["risk_score"], 4)
    assert rows(made, "flow_id", "sequence") == rows(want, "flow_id", "sequence")


def test_entropies_do_not_depend_on_the_order_of_rows(spark):
    """To the last bit: a model's threshold may lie between two sums that differ in it."""
    rows = [(i * S // 2, "10.0.0.1", 999, "10.0.0.2", 53, "UDP", 40 + i * i % 91) for i in range(120)]
    name = F.concat(F.lit("q"), F.col("seq") * F.col("seq") * 7919, F.lit(".example.com"))
    p = packets(spark, rows).withColumn("dns_query_name", name).persist()
    found = {
        tuple(with_measures(build_flows(p.repartition(n), cell_s=width)).select("entropy", "dns_entropy").first())
        for n, width in ((1, 30), (3, 1), (7, 2), (5, 11))
    }
    assert len(found) == 1
