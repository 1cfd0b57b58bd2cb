"""Flow ids: SipHash-1-3 with a zero key over a canonical record of both ends, for many rows at once.

A record holds the ends' ports, and for each address a zero word, its length
and its bytes, then a one and the protocol. Numpy works through all records of
one length together, a word at a time.
"""

from __future__ import annotations

import ipaddress

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LHS_GE_RHS, RHS_GT_LHS = 1, 2
#: The initial state of SipHash.
_STATE = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
_U64 = np.uint64


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return x << _U64(bits) | x >> _U64(64 - bits)


def _round(v: list[np.ndarray]) -> None:
    v[0] = v[0] + v[1]
    v[2] = v[2] + v[3]
    v[1] = _rotate(v[1], 13) ^ v[0]
    v[3] = _rotate(v[3], 16) ^ v[2]
    v[0] = _rotate(v[0], 32)
    v[0] = v[0] + v[3]
    v[2] = v[2] + v[1]
    v[3] = _rotate(v[3], 21) ^ v[0]
    v[1] = _rotate(v[1], 17) ^ v[2]
    v[2] = _rotate(v[2], 32)


def siphash13(records: np.ndarray) -> np.ndarray:
    """SipHash-1-3 with a zero key of each row of bytes (n, length), as unsigned 64-bit integers."""
    n, length = records.shape
    padded = np.zeros((n, length // 8 * 8 + 8), dtype=np.uint8)
    padded[:, :length] = records
    padded[:, -1] = length & 0xFF
    v = [np.full(n, x, dtype=_U64) for x in _STATE]
    for word in padded.view("<u8").T.astype(_U64):
        v[3] ^= word
        _round(v)
        v[0] ^= word
    v[2] = v[2] ^ _U64(0xFF)
    for _ in range(3):
        _round(v)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def _bytes_of(values: np.ndarray, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(values.astype(dtype)).view(np.uint8).reshape(len(values), -1)


def _hash(src: pd.Series, dst: pd.Series, src_port: pd.Series, dst_port: pd.Series, protocol: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame({"src": src, "dst": dst, "sp": src_port, "dp": dst_port, "p": protocol})
    parsed = {}
    for text in pd.unique(pd.concat([src, dst], ignore_index=True).dropna()):
        try:
            parsed[text] = ipaddress.ip_address(text)
        except ValueError:
            continue
    out = pd.DataFrame({"flow_hash": pd.array([pd.NA] * len(rows), dtype="Int64"), "side": np.zeros(len(rows), dtype=np.int32)})
    known = rows["src"].isin(parsed) & rows["dst"].isin(parsed) & rows[["sp", "dp", "p"]].notna().all(axis=1)
    for (vs, vd), at in rows[known].groupby([rows["src"].map(lambda t: parsed[t].version if t in parsed else 0), rows["dst"].map(lambda t: parsed[t].version if t in parsed else 0)]).groups.items():
        part = rows.loc[at]
        sp, dp = part["sp"].to_numpy(np.uint16), part["dp"].to_numpy(np.uint16)
        # Ports are compared as a little-endian machine reads their network order.
        forward = np.where(sp == dp, [(parsed[a].version, int(parsed[a])) >= (parsed[b].version, int(parsed[b])) for a, b in zip(part["src"], part["dst"])], sp.byteswap() > dp.byteswap())
        for way, (near, far, p1, p2, v1, v2) in ((True, ("src", "dst", sp, dp, vs, vd)), (False, ("dst", "src", dp, sp, vd, vs))):
            use = forward == way
            if not use.any():
                continue
            n = int(use.sum())
            address = lambda column: np.frombuffer(b"".join(parsed[t].packed for t in part.loc[use, column]), dtype=np.uint8).reshape(n, -1)  # noqa: B023, E731
            number = lambda x: np.tile(np.frombuffer(int(x).to_bytes(8, "little"), dtype=np.uint8), (n, 1))  # noqa: B023, E731
            size = {4: 4, 6: 16}
            record = np.hstack([_bytes_of(p1[use], ">u2"), _bytes_of(p2[use], ">u2"), number(0), number(size[v1]), address(near), number(0), number(size[v2]), address(far), number(1), part.loc[use, "p"].to_numpy(np.uint8).reshape(-1, 1)])
            out.loc[part.index[use], "flow_hash"] = siphash13(record).view(np.int64)
            out.loc[part.index[use], "side"] = LHS_GE_RHS if way else RHS_GT_LHS
    return out


def flow_hash(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column, protocol: Column | None = None) -> Column:
    """struct(flow_hash, side): the same hash for both directions; side 1 where the source is the greater end, else 2.

    An address that is none, or a null, gives a null hash and side 0.
    """
    # No built-in function adds 64-bit integers with wrap-around, so this one crosses to Python in Arrow batches.
    udf = F.pandas_udf(_hash, "flow_hash long, side int")
    return udf(src_ip, dst_ip, src_port, dst_port, F.lit(6) if protocol is None else protocol)


def flow_hash_text(flow: Column) -> Column:
    """Such as ``-123 (LHS>=RHS)``."""
    side = F.when(flow["side"] == LHS_GE_RHS, "LHS>=RHS").when(flow["side"] == RHS_GT_LHS, "RHS>LHS").otherwise("UNKNOWN")
    return F.concat(flow["flow_hash"].cast("string"), F.lit(" ("), side, F.lit(")"))
