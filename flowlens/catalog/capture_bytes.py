"""Packet rows -> capture bytes, for checking the decoder on the driver's packets."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.shipping import ship

ship(__name__)

TYPE_CODES = {"A": 1, "AAAA": 28, "CNAME": 5, "TXT": 16, "NS": 2}


# Hosts of the packet view: 10.1.<floor(user / 250)>.<user % 250>, where the third part has no upper limit.
HOSTS, AFTER_HOSTS = 10 << 24 | 1 << 16, 192 << 24


def packed(address: str) -> bytes:
    """Four bytes of a dotted address; what of a part is above 255 is carried into the parts before it.

    Different addresses of the view stay different, and `view_address` reads the host back.
    """
    number = 0
    for part in address.split("."):
        number = number * 256 + int(part)
    if address.startswith("10.1.") and number >= AFTER_HOSTS:
        raise ValueError(f"a capture holds addresses of 32 bits, not {address}")
    return number.to_bytes(4, "big")


def view_address(address: Column) -> Column:
    """The packet view's text of an address that `packed` wrote."""
    parts = F.split(address, r"\.")
    number = sum((parts[i].cast("long") * 256 ** (3 - i) for i in range(1, 4)), parts[0].cast("long") * 256**3)
    host = F.format_string("10.1.%d.%d", F.floor((number - HOSTS) / 256).cast("long"), number % 256)
    return F.when((number >= HOSTS) & (number < AFTER_HOSTS), host).otherwise(address)


def _sized(body: bytes, n: int) -> bytes:
    return len(body).to_bytes(n, "big") + body


def dns_query(name: str, kind: str) -> bytes:
    labels = b"".join(_sized(x.encode(), 1) for x in name.split("."))
    return struct.pack("!6H", 7, 0x0100, 1, 0, 0, 0) + labels + b"\0" + struct.pack("!2H", TYPE_CODES[kind], 1)


def client_hello(name: str) -> bytes:
    entry = b"\0" + _sized(name.encode(), 2)
    extensions = struct.pack("!H", 10) + _sized(_sized(b"\0\x1d", 2), 2) + struct.pack("!H", 0) + _sized(_sized(entry, 2), 2)
    hello = b"\3\3" + bytes(32) + _sized(b"", 1) + _sized(b"\x13\x01", 2) + _sized(b"\0", 1) + _sized(extensions, 2)
    return b"\x16\3\1" + _sized(b"\1" + _sized(hello, 3), 2)


def frame(p) -> bytes:
    """An Ethernet frame for one packet row."""
    if p.protocol == "TCP":
        flags = sum(1 << "FSRPAUECN".index(x) for x in p.tcp_flags or "")
        payload = client_hello(p.tls_sni) if isinstance(p.tls_sni, str) else b""
        body = struct.pack("!HHIIHHHH", int(p.src_port), int(p.dst_port), 1, 1, 5 << 12 | flags, 8192, 0, 0) + payload
        number = 6
    elif p.protocol == "UDP":
        payload = dns_query(p.dns_query_name, p.dns_record_type)
        body = struct.pack("!4H", int(p.src_port), int(p.dst_port), 8 + len(payload), 0) + payload
        number = 17
    else:
        body, number = struct.pack("!BBHHH", 8, 0, 0, 1, 1), 1
    ends = packed(p.src_ip) + packed(p.dst_ip)
    header = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(body), 1, 0, 64, number, 0) + ends
    return bytes(12) + b"\x08\x00" + header + body


def capture(packets: pd.DataFrame) -> bytes:
    """A whole capture file."""
    parts = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)]
    for p in packets.itertuples(index=False):
        data = frame(p)
        parts.append(struct.pack("<4I", p.t_us // 1_000_000, p.t_us % 1_000_000, len(data), len(data)) + data)
    return b"".join(parts)


def _encode(frames):
    for packets in frames:
        yield pd.DataFrame({"path": [f"capture-{uuid.uuid4().hex}"], "content": [capture(packets)]})


def capture_files(packets: DataFrame) -> DataFrame:
    """Capture files (path, content) that hold the packets, one per Arrow batch."""
    return packets.mapInPandas(_encode, "path string, content binary")
