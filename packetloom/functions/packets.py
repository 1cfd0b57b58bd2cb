"""Column expressions over packets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = 1, 2, 4, 8, 16, 32, 64, 128
#: Names of flags, in the order in which they are printed.
FLAG_NAMES = ((FIN, "FIN"), (SYN, "SYN"), (RST, "RST"), (PSH, "PSH"), (ACK, "ACK"), (URG, "URG"), (ECE, "ECE"), (CWR, "CWR"))
#: Where a set of flags stands in the life of a connection; others come last.
FLAG_STEPS = {"SYN": 1, "SYN+ACK": 2, "ACK": 3, "PSH+ACK": 4, "FIN": 5, "FIN+ACK": 6, "RST": 7, "RST+ACK": 8}
LAST_STEP = 999


def has(flags: Column, bit: int) -> Column:
    return F.coalesce(flags.bitwiseAND(bit) != 0, F.lit(False))


def is_syn(flags: Column) -> Column:
    return has(flags, SYN) & ~has(flags, ACK)


def is_syn_ack(flags: Column) -> Column:
    return has(flags, SYN) & has(flags, ACK)


def ends_connection(flags: Column) -> Column:
    """FIN or RST."""
    return has(flags, FIN | RST)


def flag_names(flags: Column, separator: str) -> Column:
    names = F.concat_ws(separator, *(F.when(has(flags, bit), F.lit(name)) for bit, name in FLAG_NAMES))
    return F.when(names == "", "NONE").otherwise(names)


def flag_text(flags: Column) -> Column:
    """Such as ``0x012 [SYN, ACK]``; no known flag is ``[NONE]``."""
    hexadecimal = F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(flags)), 3, "0"))
    return F.concat(hexadecimal, F.lit(" ["), flag_names(flags, ", "), F.lit("]"))


def flag_change_text(local: Column, remote: Column) -> Column:
    """Such as ``SYN (Local Side) -> ACK``: the set that comes first in a connection's life is printed first."""
    step = lambda names: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FLAG_STEPS.items() for x in kv)), names), F.lit(LAST_STEP))
    here, there = flag_names(local, "+"), flag_names(remote, "+")
    marked = F.concat(here, F.lit(" (Local Side)"))
    return F.when(step(here) <= step(there), F.concat(marked, F.lit(" -> "), there)).otherwise(F.concat(there, F.lit(" -> "), marked))


def hops(ttl: Column) -> Column:
    """Routers passed since the sender's likely initial TTL of 64, 128 or 255."""
    return F.when(ttl <= 0, 0).when(ttl <= 64, 64 - ttl).when(ttl <= 128, 128 - ttl).otherwise(255 - ttl)


def has_intermediate_device(ttl: Column) -> Column:
    return hops(ttl) > 0


def payload_md5(payload: Column) -> Column:
    """MD5 of at most the first 256 bytes of a hexadecimal payload; empty where there is none or it is not hexadecimal."""
    head = F.regexp_replace(F.substring(payload, 1, 512), ":", "")
    plain = head.rlike("^([0-9a-fA-F]{2})+$")
    return F.coalesce(F.when(plain, F.md5(F.unhex(F.when(plain, head)))), F.lit(""))


def canonical_ends(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> tuple[Column, Column]:
    """The two ends of a flow, the lesser (ip as text, port) first."""
    a, b = F.struct(src_ip.alias("ip"), src_port.alias("port")), F.struct(dst_ip.alias("ip"), dst_port.alias("port"))
    return F.least(a, b), F.greatest(a, b)


def port_pair(port: Column, other: Column) -> Column:
    """Both ports, the lesser first: what address translation leaves of a flow's identity."""
    return F.struct(F.least(port, other).alias("low"), F.greatest(port, other).alias("high"))


def nanoseconds(time: Column) -> Column:
    """A decimal time in whole nanoseconds, cut off."""
    return (time.cast("decimal(28,9)") * 1_000_000_000).cast("bigint")
