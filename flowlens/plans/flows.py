"""Packets to flow feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.config import DEFAULT, FlowConfig
from flowlens.functions.network import dns_name
from flowlens.operators.behaviour import source_behaviour
from flowlens.operators.features import RAW_SUMS, contract_columns, with_measures
from flowlens.operators.sessionize import build_flows, with_reason
from flowlens.storage import written


def clean_packets(packets: DataFrame) -> DataFrame:
    """Drop rows without addresses and normalize DNS names."""
    kept = packets.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    return kept.withColumn("dns_query_name", dns_name(F.col("dns_query_name")))


def extract_features(
    packets: DataFrame,
    cfg: FlowConfig = DEFAULT,
    replay: bool = False,
    keep: Sequence[str] = (),
    cells: int | None = None,
) -> DataFrame:
    """Packet table -> contract feature rows: packets are dealt by (flow key, time), flows by (source, time).

    ``keep`` adds internal flow columns, such as start_us or finalize_reason. ``replay`` selects the
    packet-by-packet semantics instead of the event-time ones. ``cells`` sets the number of ranges.
    """
    packets = clean_packets(packets)
    flows = build_flows(packets, cfg, "replay_exact" if replay else "event_gap", cells)
    if "finalize_reason" in keep:
        flows = with_reason(flows, packets)
    # Measured and written once: what follows, by source, carries finished numbers and reads them again.
    measured = written(with_measures(flows).drop(*RAW_SUMS), "measured-flows")
    mode = "replay_visible" if replay else "past_only"
    seen = source_behaviour(measured, cfg, mode, packets if replay else None, cells)
    return contract_columns(seen, keep)


def measured_flows(packets: DataFrame, cfg: FlowConfig = DEFAULT, replay: bool = False) -> DataFrame:
    """The flow table of a packet table."""
    return build_flows(packets, cfg, "replay_exact" if replay else "event_gap")
