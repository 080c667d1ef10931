"""Packets -> bidirectional flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.config import DEFAULT, MICROS, FlowConfig
from flowlens.functions.measures import text_entropy
from flowlens.functions.network import closes_flow, timeout_us, with_endpoints
from flowlens.operators.ordering import exact_flag, global_rank, neighbour, ranged, ranked, running_on
from flowlens.storage import written

ORDER = ["t_us", "seq"]
CELL_SECONDS = 30


def mark_flows(
    packets: DataFrame, cfg: FlowConfig = DEFAULT, mode: str = "event_gap", cells: int | None = None
) -> DataFrame:
    """Number the flows of every key: adds flow_key, flow_no, is_new, gap_us, close and dns_bits.

    A packet starts a new flow when its key has no earlier packet, when the key was idle for at
    least the protocol timeout, or when the key's previous packet was a TCP FIN or RST.

    * ``event_gap``: idle time is measured between packets of the key.
    * ``replay_exact``: idle flows are only noticed when another packet arrives, so idle time runs
      from the key's previous packet to the packet just before this one in the whole capture.

    Packets are dealt into ranges of (key, time), so a key's previous packet is the row before.
    """
    df = with_endpoints(packets).withColumns(
        {
            "close": closes_flow(F.col("protocol"), F.col("tcp_flags")),
            "tmo_us": timeout_us(F.col("protocol"), cfg),
        }
    )
    if mode == "replay_exact":
        ordered = ranged(df, ORDER, "capture-order", cells)
        df = neighbour(ranked(ordered, "ord"), ["t_us"], "just_before", -1).drop("cell", "place")
        df = df.withColumn("idle_until", F.col("just_before.t_us")).drop("just_before")
    elif mode == "event_gap":
        df = df.withColumn("idle_until", F.col("t_us"))
    else:
        raise ValueError(f"unknown mode {mode!r}")

    table = ranged(df, ["flow_key", *ORDER], "packets-by-key", cells)
    near = neighbour(table.withColumn("dns_bits", _name_bits()), ["flow_key", "t_us", "close"], "prev", -1)
    same = F.col("prev.flow_key") == F.col("flow_key")
    prev_t = F.when(same, F.col("prev.t_us"))
    fresh = prev_t.isNull() | (F.col("idle_until") - prev_t >= F.col("tmo_us")) | F.col("prev.close")
    near = near.withColumns({"is_new": exact_flag(fresh), "prev_t": prev_t})
    near = running_on(near, ["flow_key"], {"flow_no": ("sum", "is_new")}, table)
    gap = F.when(F.col("is_new") == 0, F.col("t_us") - F.col("prev_t"))
    return near.withColumn("gap_us", gap).drop("prev", "prev_t", "idle_until", "tmo_us", "cell", "place")


def _name_bits() -> Column:
    """Entropy of a packet's DNS name. A column below a window, since a sum evaluates its input three times."""
    return text_entropy(F.col("dns_query_name")).cast("decimal(20,15)")


def _weigh_history(marked: DataFrame, cap: int | None) -> DataFrame:
    """Mark the packets that count in totals and those in the packet history.

    Without a cap every packet counts in both. With one, the newest packets of each flow are cut out by
    rank, which Spark limits on the map side, and added as rows that count in the history only.
    """
    if cap is None:
        return marked.withColumns({"in_total": F.lit(1), "in_history": F.lit(1), "gap_in_history": F.lit(1)})
    newest = Window.partitionBy("flow_key", "flow_no").orderBy(*[F.desc(c) for c in ORDER])
    tail = (
        marked.withColumn("from_end", F.row_number().over(newest))
        .filter(F.col("from_end") <= cap)
        .withColumns(
            {
                "in_total": F.lit(0),
                "in_history": F.lit(1),
                "gap_in_history": exact_flag(F.col("from_end") < cap),
            }
        )
        .drop("from_end")
    )
    every = marked.withColumns({"in_total": F.lit(1), "in_history": F.lit(0), "gap_in_history": F.lit(0)})
    return every.unionByName(tail)


def _sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of the packets of each (keys, packet size), in a form that adds up (see ``add_up``).

    ``rows``: packets with in_total, in_history, gap_in_history, gap_us, close, ord and dns_bits.
    """
    counted = F.col("in_total") == 1
    dns = counted & F.col("dns_query_name").isNotNull()
    gap = F.when((F.col("in_history") == 1) & (F.col("gap_in_history") == 1), F.col("gap_us"))
    wide = gap.cast("decimal(19,0)")
    sni = counted & (F.col("tls_sni") != "")
    return rows.groupBy(*keys, "packet_length").agg(
        F.sum("in_total").alias("n"),
        F.sum(F.when(counted & F.col("is_forward"), 1).otherwise(0)).alias("n_fwd"),
        F.sum("in_history").alias("n_hist"),
        F.min("t_us").alias("start_us"),
        F.min(F.when(counted, F.struct("t_us", "seq", "a_port", "b_port", "is_forward"))).alias("head"),
        F.max(F.when(counted, F.struct("t_us", "seq", "close"))).alias("tail"),
        F.min(F.when(counted, F.col("ord"))).alias("first_ord"),
        F.max("ord").alias("last_ord"),
        F.count(gap).alias("n_gap"),
        F.sum(gap).alias("gap_sum"),
        F.sum((wide * wide).cast("decimal(38,0)")).cast("decimal(38,0)").alias("gap_sq"),
        F.count(F.when(dns, 1)).alias("n_dns"),
        F.sum(F.when(dns, F.char_length("dns_query_name"))).alias("dns_len"),
        F.sum(F.when(dns, F.col("dns_bits"))).alias("dns_ent"),
        F.max(F.when(dns, F.struct("t_us", "seq", "dns_record_type"))).alias("dns_last"),
        F.count(F.when(sni, 1)).alias("n_tls"),
        F.min(F.when(sni, F.struct("t_us", "seq", "tls_sni"))).alias("sni_first"),
    )


FLOW_KEYS = ["flow_key", "flow_no", "a_ip", "b_ip", "protocol"]
SUMS = ["n", "n_fwd", "n_hist", "n_gap", "gap_sum", "gap_sq", "n_dns", "dns_len", "dns_ent", "n_tls"]
LEASTS = ["start_us", "head", "first_ord", "sni_first"]
LARGESTS = ["tail", "last_ord", "dns_last"]


def add_up(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``_sizes`` added up by coarser keys; the result adds up again."""
    sums = [F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in SUMS]
    return parts.groupBy(*keys).agg(
        *sums, *[F.min(c).alias(c) for c in LEASTS], *[F.max(c).alias(c) for c in LARGESTS]
    )


def flows_of_sizes(by_size: DataFrame, cfg: FlowConfig = DEFAULT) -> DataFrame:
    """One row per flow from one row per (flow, packet size), which is the histogram behind the size entropy.

    Logarithms are summed as decimals: a flow has the same entropies to the last bit whatever the order of its rows,
    so that a model decides alike on the flows of a stream and of the batch job.
    """
    size, n, n_fwd = F.col("packet_length").cast("long"), F.col("n"), F.col("n_fwd")
    hist = F.col("n_hist").cast("double")
    flows = by_size.groupBy(*FLOW_KEYS).agg(
        F.min("start_us").alias("start_us"),
        F.min("head").alias("head"),
        F.max("tail").alias("tail"),
        F.min("first_ord").alias("first_ord"),
        F.max("last_ord").alias("last_ord"),
        F.sum(n).alias("packet_count"),
        F.sum(size * n).alias("byte_count"),
        F.sum(n_fwd).alias("fwd_packets"),
        F.sum(size * n_fwd).alias("fwd_bytes"),
        F.sum(n - n_fwd).alias("rev_packets"),
        F.sum(size * (n - n_fwd)).alias("rev_bytes"),
        F.sum("n_hist").alias("n_hist"),
        F.sum(F.when(hist > 0, (hist * F.log2(hist)).cast("decimal(28,12)"))).cast("double").alias("hist_clogc"),
        F.sum("n_gap").alias("n_gap"),
        F.sum("gap_sum").alias("gap_sum"),
        F.sum("gap_sq").alias("gap_sq"),
        F.sum("n_dns").alias("n_dns"),
        F.sum("dns_len").alias("dns_len"),
        F.sum("dns_ent").cast("double").alias("dns_ent"),
        F.max("dns_last").alias("dns_last"),
        F.sum("n_tls").alias("n_tls"),
        F.min("sni_first").alias("sni_first"),
    )
    flows = flows.withColumns(
        {
            "last_us": F.col("tail.t_us"),
            "start_seq": F.col("head.seq"),
            "a_port": F.col("head.a_port"),
            "b_port": F.col("head.b_port"),
            "starts_forward": F.col("head.is_forward"),
            "closed": F.col("tail.close"),
        }
    )
    flows = flows.withColumns(
        {
            "flow_id": F.md5(F.concat_ws("#", "flow_key", "start_us", "start_seq")),
            "dns_record_type": F.coalesce("dns_last.dns_record_type", F.lit("")),
            "tls_sni": F.coalesce("sni_first.tls_sni", F.lit("")),
            "tmo_us": timeout_us(F.col("protocol"), cfg),
        }
    ).drop("dns_last", "sni_first", "head", "tail")
    return _orient(flows, cfg)


def packet_parts(packets: DataFrame, cfg: FlowConfig = DEFAULT, cell_s: int = CELL_SECONDS) -> DataFrame:
    """The packets of each (flow key, cell of time, piece, packet size), added up.

    A piece begins where a packet starts a flow, seen from inside the cell; whether a cell's first packet
    does is left to ``number_pieces``. Packets are shuffled once, by key and cell, so a key that owns
    half of all packets is as many groups as it has cells.
    """
    df = with_endpoints(packets).withColumns(
        {
            "close": closes_flow(F.col("protocol"), F.col("tcp_flags")),
            "cell": F.floor(F.col("t_us") / (cell_s * MICROS)).cast("long"),
            "dns_bits": _name_bits(),
        }
    )
    inside = Window.partitionBy("flow_key", "cell").orderBy(*ORDER)
    before = F.lag(F.struct("t_us", "close")).over(inside)
    rows = df.withColumn("before", before).withColumn("gap", F.col("t_us") - F.col("before.t_us"))
    fresh = (F.col("gap") >= timeout_us(F.col("protocol"), cfg)) | F.col("before.close")
    rows = rows.withColumn("fresh", exact_flag(fresh))
    running_sum = F.sum("fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns(
        {
            "piece": running_sum,
            "gap_us": F.when(F.col("fresh") == 0, F.col("gap")),
            "in_total": F.lit(1),
            "in_history": F.lit(1),
            "gap_in_history": F.lit(1),
            "ord": F.lit(None).cast("long"),
        }
    )
    return _sizes(rows, ["flow_key", "cell", "piece", "a_ip", "b_ip", "protocol"])


def number_pieces(parts: DataFrame, cfg: FlowConfig = DEFAULT) -> DataFrame:
    """The rows of ``packet_parts`` with ``flow_no`` in place of cell and piece.

    One row per key and cell says how the cell begins and ends; the gap between two cells of a flow is
    added as a row of its own, without packets.
    """
    keys = ["flow_key", "protocol", "a_ip", "b_ip"]
    cells = parts.groupBy(*keys, "cell").agg(
        F.min("start_us").alias("first_us"), F.max("tail").alias("tail"), F.max("piece").alias("pieces")
    )
    by_cell = Window.partitionBy(*keys).orderBy("cell")
    cells = cells.withColumn("prev", F.lag("tail").over(by_cell))
    gap = F.col("first_us") - F.col("prev.t_us")
    fresh = F.col("prev").isNull() | (gap >= timeout_us(F.col("protocol"), cfg)) | F.col("prev.close")
    cells = cells.withColumns({"fresh": exact_flag(fresh), "gap": gap})
    total = F.sum(F.col("fresh") + F.col("pieces")).over(by_cell.rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("base", total - F.col("pieces")).drop("prev", "tail", "first_us", "pieces")
    cells = written(cells, "flow-cells")  # read for the numbers and for the gaps
    numbered_parts = parts.join(cells.select(*keys, "cell", "base"), [*keys, "cell"])
    numbered_parts = numbered_parts.withColumn("flow_no", F.col("base") + F.col("piece")).drop("base", "cell", "piece")
    wide = F.col("gap").cast("decimal(19,0)")
    bridge = {
        **{c: F.lit(None) for c in [*LEASTS, *LARGESTS, "packet_length"]},
        **{c: F.lit(0) for c in SUMS},
        "n_gap": F.lit(1),
        "gap_sum": F.col("gap"),
        "gap_sq": wide * wide,
        "flow_no": F.col("base"),
    }
    kinds = {f.name: f.dataType for f in numbered_parts.schema}
    bridges = cells.where("fresh = 0").select(*keys, *[v.cast(kinds[c]).alias(c) for c, v in bridge.items()])
    return numbered_parts.unionByName(bridges)


def build_flows(
    packets: DataFrame,
    cfg: FlowConfig = DEFAULT,
    mode: str = "event_gap",
    cells: int | None = None,
    cell_s: int = CELL_SECONDS,
) -> DataFrame:
    """One row per flow with everything the features need, still in exact integer form.

    ``event_gap`` without a cap adds packets up inside cells of time and only then decides where flows
    begin. A cap and ``replay_exact`` look at single packets, in ranges of (key, time).
    Two chained aggregations, by (flow, packet size) and then by flow, make the flows.
    """
    if mode == "event_gap" and cfg.history(mode) is None:
        parts = written(packet_parts(packets, cfg, cell_s), "flow-parts")
        return flows_of_sizes(add_up(number_pieces(parts, cfg), [*FLOW_KEYS, "packet_length"]), cfg)
    marked = mark_flows(packets, cfg, mode, cells)
    rows = _weigh_history(marked, cfg.history(mode))
    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.lit(None).cast("long"))
    return flows_of_sizes(_sizes(rows, FLOW_KEYS), cfg)


def _orient(flows: DataFrame, cfg: FlowConfig) -> DataFrame:
    """Name the initiator's side: endpoint A by default, or the sender of the first packet."""
    if cfg.initiator == "canonical":
        keep = F.lit(True)
    elif cfg.initiator == "first_packet":
        keep = F.col("starts_forward")
    else:
        raise ValueError(f"unknown initiator {cfg.initiator!r}")
    sides = [("a_ip", "b_ip"), ("a_port", "b_port"), ("fwd_packets", "rev_packets"), ("fwd_bytes", "rev_bytes")]
    if cfg.initiator == "canonical":
        return flows
    swapped = {}
    for x, y in sides:
        swapped[x] = F.when(keep, F.col(x)).otherwise(F.col(y))
        swapped[y] = F.when(keep, F.col(y)).otherwise(F.col(x))
    return flows.withColumns(swapped)


def with_reason(flows: DataFrame, packets: DataFrame) -> DataFrame:
    """Why a flow ended: tcp_close, timeout (some packet came late enough), or flush."""
    end = packets.agg(F.max("t_us").alias("capture_end"))  # one row
    late = F.col("capture_end") - F.col("last_us") >= F.col("tmo_us")
    return (
        flows.crossJoin(F.broadcast(end))
        .withColumn(
            "finalize_reason",
            F.when(F.col("closed"), "tcp_close").when(late, "timeout").otherwise("flush"),
        )
        .drop("capture_end")
    )


def lifecycle_counts(flows: DataFrame) -> DataFrame:
    """Flows created, and finalized by each reason."""
    return flows.groupBy("finalize_reason").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packet_count").alias("packets")
    )


def dense_flow_ids(flows: DataFrame) -> DataFrame:
    """Replace the hash id by flow-000001, flow-000002, ... in order of creation."""
    ranked = global_rank(flows, ["start_us", "start_seq"], "n")
    return ranked.withColumn("flow_id", F.format_string("flow-%06d", "n")).drop("n")


def peak_concurrency(flows: DataFrame, capacity: int = 50_000, cells: int | None = None) -> DataFrame:
    """Largest number of flows open at one time (first packet to last packet, both included).

    Open and end events are summed per instant first; each range of time then yields its total and its
    highest running sum, so only one row per range meets in the last step.
    """
    events = flows.select(
        F.explode(
            F.array(
                F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")),
                F.struct((F.col("last_us") + 1).alias("t"), F.lit(-1).alias("d")),
            )
        ).alias("e")
    )
    steps = events.groupBy(F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    table = ranged(steps, ["t"], "open-flows", cells)
    inside = Window.partitionBy("cell").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    per_cell = (
        table.withColumn("level", F.sum("d").over(inside))
        .groupBy("cell")
        .agg(F.sum("d").alias("total"), F.max("level").alias("top"))
    )
    before = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("total").over(before), F.lit(0))
    peak = per_cell.withColumn("level", base + F.col("top")).agg(F.max("level").cast("long").alias("peak_flows"))
    over = F.greatest(F.col("peak_flows") - F.lit(capacity), F.lit(0)).cast("long")
    return peak.withColumns({"capacity": F.lit(capacity).cast("long"), "over_capacity": over})
