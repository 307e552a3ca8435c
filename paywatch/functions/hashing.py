"""HMAC-SHA256 as a native expression, and stable ids."""

import hashlib

from pyspark.sql import functions as F

BLOCK = 64


def pads(key):
    """Inner and outer pad of a key. Only these leave the driver; keep plans that hold them out of logs."""
    raw = key.encode("utf-8")
    raw = hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw
    raw = raw.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def hmac_sha256(message, key):
    """Lower-case hex HMAC of a string column (UTF-8)."""
    inner, outer = pads(key)
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def stable_id(prefix, *columns):
    """Prefix plus 12 hex digits of the keys' hash, the same on every run (SQL)."""
    return f"concat('{prefix}', substr(sha2(concat_ws('|', {', '.join(columns)}), 256), 1, 12))"
