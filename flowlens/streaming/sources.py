"""Per-source and per-host state on streams: behaviour window, incidents, host sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.config import (
    CLASSES,
    DEFAULT,
    FEATURE_COLUMNS,
    INCIDENT_CLASSES,
    INCIDENT_RISK,
    INCIDENT_WINDOW_SECONDS,
    MICROS,
    SEQUENCE_LENGTH,
    FlowConfig,
)
from flowlens.operators.alerts import class_bit
from flowlens.shipping import ship
from flowlens.streaming.common import beyond_clock, event_time, use_state_store

ship(__name__)

HELD_OPENS = T.StructType(
    [T.StructField("t_us", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("v", T.StringType())]
)
HELD_PROBES = T.StructType([T.StructField("t_us", T.LongType()), T.StructField("flow_id", T.StringType())])
COUNTS = T.StructType(
    [
        T.StructField("flow_id", T.StringType()),
        T.StructField("dest_fanout", T.LongType()),
        T.StructField("port_fanout", T.LongType()),
        T.StructField("flow_count", T.LongType()),
    ]
)
HELD_ALERTS = T.StructType(
    [
        T.StructField("t_us", T.LongType()),
        T.StructField("alert_id", T.LongType()),
        T.StructField("bits", T.IntegerType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("answered", T.BooleanType()),
    ]
)
INCIDENTS = T.StructType(
    [
        T.StructField("src_ip", T.StringType()),
        T.StructField("alert_id", T.LongType()),
        T.StructField("t_us", T.LongType()),
        T.StructField("alert_count", T.LongType()),
        T.StructField("class_count", T.IntegerType()),
        T.StructField("threat_classes", T.StringType()),
        T.StructField("max_risk_score", T.DoubleType()),
    ]
)


def _passed(t_us: int) -> int:
    """The first watermark, in milliseconds, at which no row of time t_us can come any more."""
    return -(-t_us // 1000)


def behaviour_events(flows: DataFrame) -> DataFrame:
    """Flows as opening and probing events: (a_ip, t_us, is_probe, flow_id, b_ip, b_port)."""
    event = F.explode(
        F.array(
            F.struct(F.col("start_us").alias("t_us"), F.lit(False).alias("is_probe")),
            F.struct(F.col("last_us").alias("t_us"), F.lit(True).alias("is_probe")),
        )
    )
    return flows.select("a_ip", "flow_id", "b_ip", "b_port", event.alias("e")).select(
        "a_ip", "e.t_us", "e.is_probe", "flow_id", "b_ip", "b_port"
    )


class SourceWindow(StatefulProcessor):
    """State per (source, salt): openings of the last window, and probes waiting for the watermark."""

    def __init__(self, window_us: int):
        self.window = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opens = handle.getListState("opens", HELD_OPENS)
        self.probes = handle.getListState("probes", HELD_PROBES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        asked = batch[batch["is_probe"]]
        opened = batch[~batch["is_probe"]]
        if len(opened):
            self.opens.appendList(list(zip(opened["t_us"].tolist(), opened["kind"].tolist(), opened["v"].tolist())))
        if len(asked):
            self.probes.appendList(list(zip(asked["t_us"].tolist(), asked["flow_id"].tolist())))
            self.handle.registerTimer(_passed(int(asked["t_us"].max())))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = pd.DataFrame(list(self.probes.get()), columns=HELD_PROBES.names)
        ready = waiting["t_us"] <= now * 1000
        opens = pd.DataFrame(list(self.opens.get()), columns=HELD_OPENS.names).sort_values("t_us", kind="stable")
        out = []
        for kind in (0, 1, 2):
            out.append(_present(opens[opens["kind"] == kind], waiting.loc[ready, "t_us"].to_numpy(), self.window))
        later = waiting[~ready]
        oldest = min([now * 1000, *later["t_us"].tolist()]) - self.window
        kept = opens[opens["t_us"] >= oldest]
        _replace(self.opens, kept)
        _replace(self.probes, later)
        if len(later):
            self.handle.registerTimer(_passed(int(later["t_us"].max())))
        if ready.any():
            yield pd.DataFrame(
                {
                    "flow_id": waiting.loc[ready, "flow_id"].to_numpy(),
                    "dest_fanout": out[1],
                    "port_fanout": out[2],
                    "flow_count": out[0],
                }
            )

    def close(self) -> None:
        pass


def _present(opens: pd.DataFrame, at: np.ndarray, window: int) -> np.ndarray:
    """Distinct values opened in [t - window, t] for each t, from merged presence intervals."""
    starts, ends = [], []
    for _, times in opens.groupby("v")["t_us"]:
        t = times.to_numpy()
        apart = np.diff(t) > window
        starts.append(t[np.r_[True, apart]])
        ends.append(t[np.r_[apart, True]] + window)
    if not starts:
        return np.zeros(len(at), dtype=np.int64)
    begun = np.searchsorted(np.sort(np.concatenate(starts)), at, side="right")
    over = np.searchsorted(np.sort(np.concatenate(ends)), at, side="left")
    return (begun - over).astype(np.int64)


def _replace(state, frame: pd.DataFrame) -> None:
    if len(frame):
        state.put([tuple(r) for r in frame.itertuples(index=False)])
    else:
        state.clear()


def behaviour_stream(
    events: DataFrame, lateness: str, cfg: FlowConfig = DEFAULT, salts: int = 16
) -> DataFrame:
    """Source behaviour of each probe, once the watermark has passed it.

    ``lateness`` must cover how far rows come out of order; later ones are dropped, and counted in the
    query's progress (``late_rows``).

    ``salts`` spreads a source over several tasks: every value of a source lives in one of them and
    each probe asks all, so that the sums per flow_id (``combine_salts``) are exact.
    """
    use_state_store(events.sparkSession)
    values = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("flow_id").alias("v")),
        F.struct(F.lit(1).alias("kind"), F.col("b_ip").alias("v")),
        F.struct(F.lit(2).alias("kind"), F.col("b_port").cast("string").alias("v")),
    )
    everywhere = F.transform(
        F.sequence(F.lit(0), F.lit(salts - 1)),
        lambda s: F.struct(F.lit(-1).alias("kind"), s.cast("string").alias("v")),
    )
    timed = beyond_clock(event_time(events, "t_us", lateness), F.col("a_ip").isNotNull())
    long = timed.withColumn("item", F.explode(F.when(F.col("is_probe"), everywhere).otherwise(values)))
    salted = long.filter(F.col("item.v").isNotNull()).select(
        "a_ip",
        F.when(F.col("is_probe"), F.col("item.v").cast("int"))
        .otherwise(F.pmod(F.xxhash64("item.kind", "item.v"), F.lit(salts)).cast("int"))
        .alias("salt"),
        "ts",
        "t_us",
        "is_probe",
        "flow_id",
        F.col("item.kind").alias("kind"),
        F.col("item.v").alias("v"),
    )
    return salted.groupBy("a_ip", "salt").transformWithStateInPandas(
        statefulProcessor=SourceWindow(cfg.source_window_us),
        outputStructType=COUNTS,
        outputMode="Append",
        timeMode="EventTime",
    )


def combine_salts(parts: DataFrame) -> DataFrame:
    names = COUNTS.names[1:]
    return parts.groupBy("flow_id").agg(*[F.sum(c).alias(c) for c in names])


def _trailing(times: np.ndarray, bits: np.ndarray, risks: np.ndarray, window: int):
    """Count, classes and highest risk in [t - window, t] for each of the sorted times.

    Spans as long as the window: what is seen is the end of one span and the beginning of the next, so a
    running aggregate in each direction is enough.
    """
    lo, hi = np.searchsorted(times, times - window, "left"), np.searchsorted(times, times, "right")
    span = times // window
    edges = np.flatnonzero(np.r_[True, span[1:] != span[:-1], True])
    forward = [np.empty_like(bits), np.empty_like(risks)]
    back = [np.empty_like(bits), np.empty_like(risks)]
    for a, b in zip(edges[:-1], edges[1:]):
        for out, values, join in ((0, bits, np.bitwise_or), (1, risks, np.maximum)):
            forward[out][a:b] = join.accumulate(values[a:b])
            back[out][a:b] = join.accumulate(values[a:b][::-1])[::-1]
    one = span[lo] == span  # the window starts in its own span: its other half is empty
    last = hi - 1
    classes = np.where(one, forward[0][last], forward[0][last] | back[0][lo])
    risk = np.where(one, forward[1][last], np.maximum(forward[1][last], back[1][lo]))
    return hi - lo, classes, risk


class SourceIncidents(StatefulProcessor):
    """State per source: alerts of the last window; each is answered when the watermark passes it."""

    def __init__(self, window_us: int):
        self.window = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alerts = handle.getListState("alerts", HELD_ALERTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        columns = [batch[c].tolist() for c in HELD_ALERTS.names[:-1]]
        self.alerts.appendList([(*row, False) for row in zip(*columns)])
        self.handle.registerTimer(_passed(int(batch["t_us"].max())))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = pd.DataFrame(list(self.alerts.get()), columns=HELD_ALERTS.names).sort_values("t_us", kind="stable")
        times = held["t_us"].to_numpy()
        bits, risks = held["bits"].to_numpy(), held["risk_score"].to_numpy()
        ready = (times <= now * 1000) & ~held["answered"].to_numpy(dtype=bool)
        n, classes, risk = _trailing(times, bits, risks, self.window)
        n_classes = sum(((classes >> j) & 1 for j in range(len(CLASSES))), np.zeros(len(times), np.int64))
        shown = np.flatnonzero(ready & ((n_classes >= INCIDENT_CLASSES) | (risk > INCIDENT_RISK)))
        rows = [
            (key[0], int(held["alert_id"].iloc[i]), int(times[i]), int(n[i]), int(n_classes[i]),
             ",".join(c for j, c in enumerate(CLASSES) if int(classes[i]) >> j & 1), float(risk[i]))
            for i in shown
        ]
        held["answered"] = held["answered"].to_numpy(dtype=bool) | ready
        waiting = times[~held["answered"].to_numpy(dtype=bool)]
        oldest = min([now * 1000, *waiting.tolist()]) - self.window
        _replace(self.alerts, held[times >= oldest])
        if len(waiting):
            self.handle.registerTimer(_passed(int(waiting.max())))
        if rows:
            yield pd.DataFrame(rows, columns=INCIDENTS.names).astype({"class_count": "int32"})

    def close(self) -> None:
        pass


def incident_stream(
    alerts: DataFrame, lateness: str, window_s: int = INCIDENT_WINDOW_SECONDS
) -> DataFrame:
    """Incidents of an alert stream (alert_id, src_ip, t_us, threat_class, risk_score).

    An alert is answered when the watermark has passed it; ``lateness`` must cover the disorder.
    """
    use_state_store(alerts.sparkSession)
    live = F.coalesce(F.col("threat_class") != "benign", F.lit(False)) & F.col("src_ip").isNotNull()
    timed = beyond_clock(event_time(alerts, "t_us", lateness), live)
    hostile = timed.select(
        "ts", "src_ip", "t_us", "alert_id", class_bit(F.col("threat_class")).alias("bits"), "risk_score"
    )
    return hostile.groupBy("src_ip").transformWithStateInPandas(
        statefulProcessor=SourceIncidents(window_s * MICROS),
        outputStructType=INCIDENTS,
        outputMode="Append",
        timeMode="EventTime",
    )


class HostSequences(StatefulProcessor):
    """State per host: its last rows, and rows that wait for the watermark.

    A host idle for the time to live (event time) is forgotten.
    """

    WAITING = T.StructType(
        [
            T.StructField("t_us", T.LongType()),
            T.StructField("tie", T.LongType()),
            T.StructField("flow_id", T.StringType()),
            T.StructField("x", T.ArrayType(T.DoubleType())),
        ]
    )

    def __init__(self, length: int, ttl_ms: int):
        self.length, self.ttl = length, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
        self.recent = handle.getListState("recent", row)
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        self.waiting.appendList(
            [(int(t), int(n), f, [float(v) for v in x]) for t, n, f, x in zip(*(batch[c] for c in self.WAITING.names))]
        )
        last = _passed(int(batch["t_us"].max()))
        self.newest.update((max(last, self.newest.get()[0]) if self.newest.exists() else last,))
        self.handle.registerTimer(last)
        self.handle.registerTimer(self.newest.get()[0] + self.ttl)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in held if r[0] <= now * 1000]
        later = held[len(ready) :]
        if ready:
            known = [list(r[0]) for r in self.recent.get()]
            seen = known + [list(r[3]) for r in ready]
            table = np.array(seen, dtype=float)
            ends = np.arange(len(known), len(seen))[:, None] + np.arange(1 - self.length, 1)
            self.recent.put([(x,) for x in seen[-self.length :]])
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(_passed(later[-1][0]))
            else:
                self.waiting.clear()
            # short histories repeat their first row
            yield pd.DataFrame({"flow_id": [r[2] for r in ready], "sequence": table[np.maximum(ends, 0)].tolist()})
        elif not later and self.newest.exists() and now >= self.newest.get()[0] + self.ttl:
            self.recent.clear()
            self.newest.clear()

    def close(self) -> None:
        pass


def sequence_stream(
    flows: DataFrame,
    host: str,
    t_us: str,
    tie: str,
    lateness: str,
    columns: Sequence[str] = tuple(FEATURE_COLUMNS),
    length: int = SEQUENCE_LENGTH,
    ttl_s: int = 86_400,
) -> DataFrame:
    """(flow_id, sequence) of every flow of a stream, in order of time.

    A host's rows wait until the watermark has passed them, so ``lateness`` must cover the disorder.
    """
    use_state_store(flows.sparkSession)
    rows = flows.select(
        F.col(host).alias("host"),
        F.col(t_us).alias("t_us"),
        F.col(tie).cast("long").alias("tie"),
        "flow_id",
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"),
    )
    out = T.StructType(
        [
            T.StructField("flow_id", T.StringType()),
            T.StructField("sequence", T.ArrayType(T.ArrayType(T.DoubleType()))),
        ]
    )
    live = beyond_clock(event_time(rows, "t_us", lateness), F.col("host").isNotNull())
    return live.groupBy("host").transformWithStateInPandas(
        statefulProcessor=HostSequences(length, ttl_s * 1000),
        outputStructType=out,
        outputMode="Append",
        timeMode="EventTime",
    )
