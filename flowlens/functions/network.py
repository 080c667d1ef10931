"""Packet-level columns: protocol, DNS and TLS fields, canonical endpoints, timeouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.config import DNS_TYPES, MICROS, FlowConfig


def protocol_of_number(number: Column) -> Column:
    """IP protocol number -> TCP, UDP, ICMP or OTHER."""
    return (
        F.when(number == 6, "TCP")
        .when(number == 17, "UDP")
        .when(number == 1, "ICMP")
        .otherwise("OTHER")
    )


def protocol_name(protocol: Column) -> Column:
    return F.upper(F.coalesce(protocol, F.lit("OTHER")))


def dns_type_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in DNS_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.lit("OTHER"))


def dns_name(name: Column) -> Column:
    """A query name without its trailing dots."""
    return F.regexp_replace(name, r"\.+$", "")


def tls_seen(sni: Column) -> Column:
    return F.coalesce(sni != "", F.lit(False))


def timeout_us(protocol: Column, cfg: FlowConfig) -> Column:
    def us(seconds: float) -> Column:
        return F.lit(int(round(seconds * MICROS))).cast("long")

    name = F.upper(F.coalesce(protocol, F.lit("")))
    return (
        F.when(name == "TCP", us(cfg.tcp_timeout_s))
        .when(name == "UDP", us(cfg.udp_timeout_s))
        .otherwise(us(cfg.other_timeout_s))
    )


def closes_flow(protocol: Column, flags: Column) -> Column:
    """True on the TCP packet that ends its flow."""
    has_end = F.contains(flags, F.lit("F")) | F.contains(flags, F.lit("R"))
    return F.coalesce((protocol == "TCP") & has_end, F.lit(False))


def with_endpoints(packets: DataFrame) -> DataFrame:
    """Direction-free flow key.

    Endpoint A is the smaller of the two: text order on the address, then numeric order on the
    port when the addresses are equal. Ports belong to the key only for TCP and UDP packets that
    carry both of them.
    """
    proto = protocol_name(F.col("protocol"))
    keyed = proto.isin("TCP", "UDP") & F.col("src_port").isNotNull() & F.col("dst_port").isNotNull()
    ports_in_order = F.when(keyed, F.col("src_port") <= F.col("dst_port")).otherwise(True)
    forward = (F.col("src_ip") < F.col("dst_ip")) | (
        (F.col("src_ip") == F.col("dst_ip")) & ports_in_order
    )
    out = packets.withColumns({"protocol": proto, "is_forward": forward, "ports_keyed": keyed})

    def pick(a: str, b: str) -> Column:
        return F.when(F.col("is_forward"), F.col(a)).otherwise(F.col(b))

    out = out.withColumns(
        {
            "a_ip": pick("src_ip", "dst_ip"),
            "b_ip": pick("dst_ip", "src_ip"),
            "a_port": pick("src_port", "dst_port"),
            "b_port": pick("dst_port", "src_port"),
        }
    )

    def key_port(port: str) -> Column:
        return F.coalesce(F.when(F.col("ports_keyed"), F.col(port).cast("string")), F.lit("-"))

    return out.withColumn(
        "flow_key",
        F.concat_ws("|", "a_ip", key_port("a_port"), "b_ip", key_port("b_port"), "protocol"),
    ).drop("ports_keyed")
