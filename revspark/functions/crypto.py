"""HMAC-SHA256 as Catalyst expressions (RFC 2104), so signature checks stay
JVM-side and work on streaming DataFrames.

HMAC(K, m) = H((K' xor opad) || H((K' xor ipad) || m)) with K' the key
padded to the 64-byte block; the padded keys are constants computed once on
the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def key_pads(key: str) -> tuple[bytes, bytes]:
    k = key.encode("utf-8")
    if len(k) > BLOCK:
        k = hashlib.sha256(k).digest()
    k = k.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def hmac_sha256_hex(key: str, msg: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of the UTF-8 bytes of ``msg``."""
    ipad, opad = key_pads(key)
    inner = F.unhex(F.sha2(F.concat(F.lit(bytearray(ipad)), msg.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytearray(opad)), inner), 256)


def hmac_sha256_hex_sql(key: str, msg_sql: str) -> str:
    """DuckDB twin of ``hmac_sha256_hex``."""
    ipad, opad = key_pads(key)
    inner = f"unhex(sha256(unhex('{ipad.hex()}') || encode({msg_sql})))"
    return f"sha256(unhex('{opad.hex()}') || {inner})"
