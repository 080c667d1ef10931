"""Packet rows for tests, and the flow rules as a plain packet-by-packet loop to compare with."""

from __future__ import annotations

import random

from flowlens.sources.tables import PACKET_SCHEMA

S = 1_000_000


def packets(spark, rows):
    """Packet table from (t_us, src, sport, dst, dport, protocol, length, flags, dns name, dns type, sni)."""
    full = []
    for seq, r in enumerate(rows):
        t, src, sp, dst, dp, proto, size, flags, name, kind, sni = (list(r) + [None] * 11)[:11]
        full.append((seq, t, src, dst, sp, dp, proto, size, flags, 0, name, name and len(name), kind, bool(sni), sni))
    return spark.createDataFrame(full, PACKET_SCHEMA)


GOLDEN = [
    (50_000, "192.0.2.20", 51000, "192.0.2.53", 53, "UDP", 76, None, "demo.example.com", "A"),
    (100_000, "192.0.2.53", 53, "192.0.2.20", 51000, "UDP", 92, None, "demo.example.com", "A"),
    (150_000, "192.0.2.20", 50000, "192.0.2.10", 80, "TCP", 54, "S"),
    (200_000, "192.0.2.10", 80, "192.0.2.20", 50000, "TCP", 54, "SA"),
    (250_000, "192.0.2.20", 50000, "192.0.2.10", 80, "TCP", 54, "A"),
    (300_000, "192.0.2.20", 50000, "192.0.2.10", 80, "TCP", 101, "PA"),
    (350_000, "192.0.2.10", 80, "192.0.2.20", 50000, "TCP", 54, "A"),
    (400_000, "192.0.2.10", 80, "192.0.2.20", 50000, "TCP", 107, "PA"),
    (450_000, "192.0.2.20", 50000, "192.0.2.10", 80, "TCP", 54, "A"),
    (500_000, "192.0.2.20", 50000, "192.0.2.10", 80, "TCP", 54, "FA"),
    (550_000, "192.0.2.10", 80, "192.0.2.20", 50000, "TCP", 54, "FA"),
    (600_000, "192.0.2.20", 50000, "192.0.2.10", 80, "TCP", 54, "A"),
    (650_000, "192.0.2.20", None, "192.0.2.10", None, "ICMP", 51),
    (700_000, "192.0.2.10", None, "192.0.2.20", None, "ICMP", 51),
]


def random_packets(seed, n=400):
    """Busy and quiet spells, equal times, gaps of exactly a timeout, one source with most flows."""
    rng = random.Random(seed)
    t, rows = 0, []
    for _ in range(n):
        t += rng.choice([0, 0, 1, 200_000, 1 * S, 3 * S, 29 * S, 30 * S, 60 * S, 120 * S])
        src = rng.choice(["10.0.0.1"] * 4 + ["10.0.0.2", "10.0.0.9", "10.0.0.10"])
        dst = rng.choice(["10.0.0.3", "10.0.0.4", "9.9.9.9"])
        proto = rng.choice(["TCP", "TCP", "UDP", "ICMP", "OTHER"])
        ported = proto in ("TCP", "UDP") and rng.random() < 0.9
        sp, dp = (rng.choice([1000, 1001]), rng.choice([80, 443])) if ported else (None, None)
        flags = rng.choice(["S", "A", "A", "FA", "R"]) if proto == "TCP" else None
        if rng.random() < 0.5:
            src, dst, sp, dp = dst, src, dp, sp
        rows.append((t, src, sp, dst, dp, proto, rng.choice([40, 60, 60, 1500]), flags))
    return rows


def loop(rows, cfg):
    """Flows of a packet-by-packet replay: {first seq: (packets, reason, fanouts)}."""
    active, history, out, made = {}, {}, {}, 0

    def finish(key, reason):
        f = active.pop(key)
        now, seen = f["last"], history.get(f["src"], [])
        seen[:] = [e for e in seen if e[0] >= now - cfg.source_window_us]
        stats = (len({e[1] for e in seen}), len({e[2] for e in seen} - {None}), len(seen))
        out[f["first"]] = (f["n"], reason, stats)

    for seq, r in enumerate(rows):
        t, src, sp, dst, dp, proto, _, flags = r[:8]
        ported = proto in ("TCP", "UDP") and sp is not None and dp is not None
        swap = src > dst or (src == dst and ported and sp > dp)
        (a, ap), (b, bp) = ((dst, dp), (src, sp)) if swap else ((src, sp), (dst, dp))
        key = (a, ap if ported else None, b, bp if ported else None, proto)
        if key not in active:
            active[key] = {"first": seq, "n": 0, "src": a}
            seen = history.setdefault(a, [])
            seen.append((t, b, bp))
            del seen[: -cfg.source_cap]
            made += 1
        f = active[key]
        f["n"] += 1
        f["last"] = t
        if proto == "TCP" and flags and set(flags) & set("FR"):
            finish(key, "tcp_close")
        for k in list(active):
            if t - active[k]["last"] >= int(cfg.timeout_s(k[4]) * S):
                finish(k, "timeout")
    for k in list(active):
        finish(k, "flush")
    return out


def labelled_flows(spark, n, seed=1):
    """Flow rows whose size and pace tell their class: three levels of packets, three of duration."""
    from pyspark.sql import functions as F

    from flowlens.config import CLASSES
    from flowlens.operators.dataset import class_name
    from flowlens.sources.tables import FLOW_SCHEMA

    draw = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1000)) / 1000.0
    kind = (F.col("id") % len(CLASSES)).cast("int")
    made = {
        "flow_id": F.format_string("flow-%05d", "id"),
        "src_ip": F.format_string("10.9.0.%d", F.col("id") % 11),
        "dst_ip": F.lit("10.9.1.1"),
        "protocol": F.when(kind % 2 == 0, "tcp").otherwise("udp"),
        "packet_count": (F.pow(F.lit(8.0), kind % 3) * (2 + draw(1))).cast("long"),
        "byte_count": (F.pow(F.lit(8.0), kind % 3) * 100 * (2 + draw(2))).cast("long"),
        "duration": F.pow(F.lit(9.0), F.floor(kind / 3)) * (1 + draw(3)),
        "entropy": kind * 0.5 + draw(4) * 0.2,
        "packet_rate": (kind + 1) * 3 + draw(5),
        "byte_rate": (7 - kind) * 500 + 100 * draw(6),
        "avg_packet_size": (kind * 3 % 7) * 90 + 20 * draw(7),
        "dest_fanout": (kind * 5 % 7) * 4 + F.floor(3 * draw(8)),
        "iat_mean": (kind * 2 % 7) * 0.4 + 0.1 * draw(9),
    }
    columns = []
    for field in FLOW_SCHEMA:
        empty = F.lit("") if field.dataType.typeName() == "string" else F.lit(0)
        columns.append(made.get(field.name, empty).cast(field.dataType).alias(field.name))
    return spark.range(n).select(*columns, class_name(kind).alias("label"), F.col("id").alias("seq"))
