"""Identifiers: canonical UUIDs and pseudonymous ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def canonical_uuid(text: Column) -> Column:
    """Lower case with dashes; braces and missing dashes are accepted, anything else is null."""
    digits = F.lower(F.regexp_replace(F.trim(text), r"[{}\-]", ""))
    shaped = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), shaped)


def is_uuid(text: Column) -> Column:
    return canonical_uuid(text).isNotNull()


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC as binary, of a key known to the driver: two native SHA-256 over the padded key."""
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > _BLOCK else raw
    raw = raw.ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))


def pseudonym(user_id: Column, salt: str) -> Column:
    """``u_`` and 43 characters of URL-safe base64; null for a blank id."""
    digest = hmac_sha256(salt, F.lower(F.trim(user_id)))
    text = F.rtrim(F.translate(F.base64(digest), "+/", "-_"), F.lit("="))
    return F.when(F.coalesce(user_id, F.lit("")) != "", F.concat(F.lit("u_"), F.left(text, F.lit(43))))
