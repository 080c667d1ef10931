"""Source behaviour: what else the flow's endpoint A has opened lately.

For every flow: distinct peers, distinct peer ports and number of flows among the flows its source
opened inside a window. No set is ever collected. Each opened flow is visible to later probes for
one interval; per (source, peer) and per (source, port) overlapping intervals merge into presence
intervals; a distinct count is then a running sum of +1 at the start and -1 after the end of
presence intervals. Work grows with n log n whatever one source owns.

Without a cap a flow is visible for exactly one window. Peers and ports are then added up per cell of time as long as
the window, since only the first and last opening of a cell can begin or end a presence, and running sums are taken
inside cells of a source on top of the sums of its cells before. Rows are dealt by hash, and only probes carry their flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.config import DEFAULT, MICROS, FlowConfig
from flowlens.operators.ordering import count_before, neighbour, ranged, running
from flowlens.storage import written

COUNTS = ["dest_fanout", "port_fanout", "flow_count"]
CELL_SECONDS = 30
OPENED = ["a_ip", "b_ip", "b_port", "start_us"]
REPLAYED = ["flow_id", "a_ip", "b_ip", "b_port", "last_us", "tmo_us", "closed", "first_ord", "last_ord"]


def source_behaviour(
    flows: DataFrame,
    cfg: FlowConfig = DEFAULT,
    mode: str = "past_only",
    packets: DataFrame | None = None,
    cells: int | None = None,
) -> DataFrame:
    """Add dest_fanout, port_fanout and flow_count to flows.

    * ``past_only``: flows of the same source opened in [last packet - window, last packet].
    * ``replay_visible``: what a packet-by-packet replay would see when it finalizes the flow; needs
      ``replay_exact`` flows and the packet table.

    With a cap, only the newest opened flows of a source are remembered.
    """
    if mode == "past_only":
        if cfg.openings("past_only") is None:
            probes = flows.select("a_ip", F.col("last_us").alias("at"), F.struct(*flows.columns).alias("row"))
            return count_recent(probes, flows, cfg.source_window_us).select("row.*", *COUNTS)
        rows = _past_only(flows, cfg, cells)
    elif mode == "replay_visible":
        if packets is None:
            raise ValueError("replay_visible needs the packet table")
        # Steps and intervals need few columns; whole flows are met again once, by id, and not in every range.
        flows = written(flows, "replayed-flows")
        seen = _count_covering(_replay_visible(flows.select(*REPLAYED), packets, cfg, cells), cells)
        return flows.join(seen.select("flow_id", *COUNTS), "flow_id").select(*flows.columns, *COUNTS)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return _count_covering(rows, cells)


def behaviour_among(flows: DataFrame, openings: DataFrame, cfg: FlowConfig = DEFAULT, cells: int | None = None) -> DataFrame:
    """``past_only`` behaviour of `flows`, which see the further `openings` too (flow_id, a_ip, b_ip, b_port,
    start_us, start_seq; those of the flows themselves are not counted twice)."""
    if cfg.source_cap is not None:
        raise ValueError("a cap on openings needs all of a source's flows at once")
    others = openings.join(flows.select("flow_id"), "flow_id", "left_anti")
    opened = flows.select(*OPENED).unionByName(others.select(*OPENED))
    probes = flows.select("a_ip", F.col("last_us").alias("at"), F.struct(*flows.columns).alias("row"))
    return count_recent(probes, opened, cfg.source_window_us).select("row.*", *COUNTS)


def count_recent(probes: DataFrame, opened: DataFrame, window_us: int, cell_s: int = CELL_SECONDS) -> DataFrame:
    """The rows of `probes` (a_ip, at, row) with what their source opened in [at - window, at].

    ``opened``: a_ip, b_ip, b_port and start_us of all openings, those of the probes included.
    """
    steps = [f"d_{c}" for c in COUNTS]
    presence = written(_presence(opened, window_us), "presence")
    seen = F.array(
        F.struct(F.col("start_us").alias("at"), F.lit(1).cast("long").alias("d_flow_count")),
        F.struct((F.col("start_us") + window_us + 1).alias("at"), F.lit(-1).cast("long").alias("d_flow_count")),
    )
    every = opened.select("a_ip", F.explode(seen).alias("e")).select("a_ip", "e.*")
    every = every.unionByName(presence, allowMissingColumns=True).unionByName(probes, allowMissingColumns=True)
    every = every.withColumn("cell", F.floor(F.col("at") / (cell_s * MICROS)).cast("long"))
    sums = every.groupBy("a_ip", "cell").agg(*[F.sum(c).alias(c) for c in steps])  # a row per source and cell
    before = Window.partitionBy("a_ip").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("a_ip", "cell", *[F.sum(c).over(before).alias(c) for c in steps])
    # the sum of the cells before comes first in a cell, steps come before probes of their time
    inside = Window.partitionBy("a_ip", "cell").orderBy(F.asc_nulls_first("at"), F.col("row").isNotNull())
    running_sum = {c: F.sum(f"d_{c}").over(inside.rowsBetween(Window.unboundedPreceding, 0)) for c in COUNTS}
    made = every.unionByName(base, allowMissingColumns=True).withColumns(running_sum).where(F.col("row").isNotNull())
    return made.select("row", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])


def _presence(opened: DataFrame, window_us: int) -> DataFrame:
    """Steps (a_ip, at, d_<count>) of the number of peers and ports that a source opened within a window.

    Openings of one peer inside a cell as long as the window are less than a window apart, so only a cell's first
    can begin a presence and only its last can end one.
    """
    values = F.array(
        F.struct(F.lit("dest_fanout").alias("kind"), F.col("b_ip").alias("v")),
        F.struct(F.lit("port_fanout").alias("kind"), F.col("b_port").cast("string").alias("v")),
    )
    rows = opened.select("a_ip", "start_us", F.explode(values).alias("e")).where("e.v IS NOT NULL")
    cell = F.floor(F.col("start_us") / F.lit(max(window_us, 1))).cast("long").alias("cell")
    cells = rows.groupBy("a_ip", F.col("e.kind").alias("kind"), F.col("e.v").alias("v"), cell)
    cells = cells.agg(F.min("start_us").alias("first"), F.max("start_us").alias("last"))
    by_cell = Window.partitionBy("a_ip", "kind", "v").orderBy("cell")
    cells = cells.withColumns({"before": F.lag("last").over(by_cell), "after": F.lead("first").over(by_cell)})
    opens = F.col("before").isNull() | (F.col("first") > F.col("before") + window_us)
    closes = F.col("after").isNull() | (F.col("after") > F.col("last") + window_us)

    def step(at, sign):
        return F.struct(at.alias("at"), F.lit(sign).cast("long").alias("sign"))

    steps = F.array_compact(
        F.array(F.when(opens, step(F.col("first"), 1)), F.when(closes, step(F.col("last") + window_us + 1, -1)))
    )
    signs = {f"d_{c}": F.when(F.col("kind") == c, F.col("e.sign")).otherwise(0) for c in COUNTS}
    return cells.select("a_ip", "kind", F.explode(steps).alias("e")).select(
        "a_ip", "e.at", *[x.cast("long").alias(c) for c, x in signs.items()]
    )


def _payload(flows: DataFrame) -> DataFrame:
    return flows.select(
        "a_ip",
        "b_ip",
        F.col("b_port").cast("string").alias("b_port"),
        "flow_id",
        F.struct(*flows.columns).alias("flow"),
    )


def _past_only(flows: DataFrame, cfg: FlowConfig, cells: int | None) -> DataFrame:
    """Visibility in time: from the flow's start until the window passes or the cap evicts it."""
    rows = _payload(flows).withColumns(
        {
            "first": F.col("flow.start_us"),
            "tie": F.col("flow.start_seq"),
            "probe": F.col("flow.last_us"),
        }
    )
    rows = _nth_newer(rows, "first", cfg.openings("past_only"), ["first", "tie"], cells)
    end = F.least(F.col("first") + cfg.source_window_us, F.col("nth") - 1)
    return rows.withColumn("last", end).drop("nth")


def _nth_newer(rows: DataFrame, column: str, n: int | None, order: list[str], cells: int | None) -> DataFrame:
    """Add ``nth``: ``column`` of the n-th later row of the same source, null if there is none."""
    if n is None:
        return rows.withColumn("nth", F.lit(None).cast("long"))
    numbered = running(rows.withColumn("one", F.lit(1)), ["a_ip"], order, {"open_no": ("sum", "one")}, cells)
    numbered = written(numbered.drop("one"), "openings")
    later = numbered.filter(F.col("open_no") > n).select(
        "a_ip", (F.col("open_no") - n).alias("open_no"), F.col(column).alias("nth")
    )
    return numbered.join(later, ["a_ip", "open_no"], "left").drop("open_no")


def _replay_visible(flows: DataFrame, packets: DataFrame, cfg: FlowConfig, cells: int | None) -> DataFrame:
    """Visibility in finalization steps: the steps of the source at which the flow is remembered.

    A source's flows are finalized one after the other (its step number is ``probe``). At a step,
    flows created up to the packet that triggered it are known, and flows older than the latest
    end seen so far minus the window have been forgotten. Both limits only move forward, so each
    flow is visible during one interval of steps.
    """
    times = packets.select("t_us")
    # The packet that triggers finalization; one after the last stands for the final flush.
    asked = flows.withColumn("idle_at", F.col("last_us") + F.col("tmo_us"))
    timed = count_before(asked, "idle_at", times, "t_us", "n_before", cells).drop("idle_at")
    timed = timed.withColumn(
        "trigger", F.when(F.col("closed"), F.col("last_ord")).otherwise(F.col("n_before") + 1)
    ).drop("n_before")

    # Step numbers and the latest end so far, per source in order of finalization.
    steps = running(
        timed.withColumn("one", F.lit(1)),
        ["a_ip"],
        ["trigger", F.desc("closed"), "first_ord"],
        {"step": ("sum", "one"), "seen_until": ("max", "last_us")},
        cells,
    ).drop("one")
    steps = steps.withColumn("forget_before", F.col("seen_until") - cfg.source_window_us)
    steps = count_before(steps, "forget_before", times, "t_us", "forgotten", cells)

    # Meet steps and openings in packet order: a step forgets (0) before a packet opens a flow (1),
    # and looks (2) after it.
    flow = F.struct(*flows.columns)
    met = steps.select(
        "a_ip",
        F.explode(
            F.array(
                F.struct((F.col("forgotten") + 1).alias("at"), F.lit(0).alias("kind")),
                F.struct(F.col("first_ord").alias("at"), F.lit(1).alias("kind")),
                F.struct(F.col("trigger").alias("at"), F.lit(2).alias("kind")),
            )
        ).alias("e"),
        flow.alias("flow"),
        F.col("step").alias("probe"),
    ).select(
        "a_ip",
        F.col("e.at").alias("at"),
        F.col("e.kind").alias("kind"),
        F.when(F.col("e.kind") == 0, 1).otherwise(0).alias("one_forgets"),
        F.when(F.col("e.kind") == 2, 1).otherwise(0).alias("one_looks"),
        F.when(F.col("e.kind") == 1, F.col("flow")).alias("flow"),
        "probe",
    )
    met = running(
        met,
        ["a_ip"],
        ["at", "kind"],
        {"n_forgets": ("sum", "one_forgets"), "n_looks": ("sum", "one_looks")},
        cells,
    ).filter(F.col("kind") == 1)
    rows = met.select(
        "a_ip",
        F.col("flow.b_ip").alias("b_ip"),
        F.col("flow.b_port").cast("string").alias("b_port"),
        F.col("flow.flow_id").alias("flow_id"),
        "flow",
        (F.col("n_looks") + 1).alias("first"),
        F.col("n_forgets").alias("until"),
        F.col("at").alias("tie"),
        "probe",
    )
    rows = _nth_newer(rows, "first", cfg.openings("replay_visible"), ["tie"], cells)
    return rows.withColumn("last", F.least("until", F.col("nth") - 1)).drop("until", "nth")


def _count_covering(rows: DataFrame, cells: int | None) -> DataFrame:
    """Per flow, what is visible at its probe position.

    ``rows``: a_ip, b_ip, b_port, flow_id, flow (the row to return), the interval [first, last] in
    which the flow is visible, its order among equal starts (tie), and its own probe position.
    Later openings of a source never end earlier, so neighbours decide how intervals merge.
    """
    flow_type = rows.schema["flow"].dataType
    kinds = rows.withColumn(
        "item",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.col("flow_id").alias("v")),
                F.struct(F.lit(1).alias("kind"), F.col("b_ip").alias("v")),
                F.struct(F.lit(2).alias("kind"), F.col("b_port").alias("v")),
            )
        ),
    ).select(
        "a_ip",
        F.col("item.kind").alias("kind"),
        F.col("item.v").alias("v"),
        "first",
        "last",
        "tie",
        F.when(F.col("item.kind") == 0, F.col("probe")).alias("probe"),
        F.when(F.col("item.kind") == 0, F.col("flow")).otherwise(F.lit(None).cast(flow_type)).alias("flow"),
    )
    visible = F.col("first") <= F.col("last")
    kinds = kinds.filter((F.col("kind") == 0) | (F.col("v").isNotNull() & visible))
    table = ranged(kinds, ["a_ip", "kind", "v", "first", "tie"], "presence", cells)
    ends = neighbour(table, ["a_ip", "kind", "v", "last"], "prev", -1)
    ends = neighbour(ends, ["a_ip", "kind", "v", "first"], "next", 1)

    def same(side):
        return (F.col(f"{side}.a_ip") == F.col("a_ip")) & (F.col(f"{side}.kind") == F.col("kind")) & (F.col(f"{side}.v") == F.col("v"))

    before, after = F.when(same("prev"), F.col("prev.last")), F.when(same("next"), F.col("next.first"))
    opens = visible & (before.isNull() | (F.col("first") > before))
    closes = visible & (after.isNull() | (after > F.col("last")))

    def event(at, sign, is_probe):
        return F.struct(at.alias("at"), F.lit(sign).alias("sign"), F.lit(is_probe).alias("is_probe"))

    events = ends.select(
        "a_ip",
        "kind",
        "flow",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(opens, event(F.col("first"), 1, False)),
                    F.when(closes, event(F.col("last") + 1, -1, False)),
                    F.when(F.col("kind") == 0, event(F.col("probe"), 0, True)),
                )
            )
        ).alias("e"),
    ).select(
        "a_ip",
        F.col("e.at").alias("at"),
        F.when(F.col("e.is_probe"), F.col("flow")).otherwise(F.lit(None).cast(flow_type)).alias("flow"),
        *[
            F.when(F.col("kind") == kind, F.col("e.sign")).otherwise(0).alias(f"d_{name}")
            for kind, name in ((1, "dest_fanout"), (2, "port_fanout"), (0, "flow_count"))
        ],
    )
    counted = running(
        events.withColumn("asks", F.col("flow").isNotNull()),
        ["a_ip"],
        ["at", "asks"],
        {c: ("sum", f"d_{c}") for c in COUNTS},
        cells,
    )
    return counted.filter(F.col("flow").isNotNull()).select("flow.*", *COUNTS)
