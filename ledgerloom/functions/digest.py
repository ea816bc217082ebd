"""Digests of texts as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(message: Column, key: str) -> Column:
    """Keyed digest of a text, lower-case hex, from two plain digests over padded keys that are worked out here."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > _BLOCK else k).ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in k)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def changed(content: Column, known_digest: Column) -> Column:
    """Whether a text differs from the one whose digest is known; unknown digests count as different."""
    return ~F.coalesce(F.sha2(content, 256) == known_digest, F.lit(False))
