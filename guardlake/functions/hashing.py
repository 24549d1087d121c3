"""Keyed and chained hashes as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAIN_TAG = b"guardlake.fingerprint.v1\x00"
GENESIS = "0" * 64


def hmac_sha256(message: Column, key: bytes, tag: bytes = b"") -> Column:
    """Lower hex of HMAC-SHA256 of tag and message bytes. An empty key is an error."""
    if not key:
        raise ValueError("the key is empty")
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    padded = key.ljust(64, b"\x00")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in padded).hex())) for x in (0x36, 0x5C))
    body = F.concat(inner, F.unhex(F.lit(tag.hex())), message.cast("binary"))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(body, 256))), 256)


def fingerprint(content: Column, key: bytes) -> Column:
    return hmac_sha256(content, key, DOMAIN_TAG)


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def hmac_sql(message: str, key: bytes, tag: bytes = b"") -> str:
    """The same in DuckDB SQL; message is a SQL expression of a string."""
    padded = key.ljust(64, b"\x00")
    inner, outer = (bytes(b ^ x for b in padded).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || unhex('{tag.hex()}') || encode({message}))))"
