"""Identifiers: compact binary keys for UUIDs and digests, deterministic UUIDs, content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CANONICAL = "^[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}$"
_PAD = bytes(16)


def pack_uuid(c: Column) -> Column:
    """A UUID text as 16 bytes, a third of what a shuffled row takes as text; letter case does not matter.

    Text that is no canonical UUID becomes 16 zero bytes and its upper-cased text, so the mapping stays one to one and
    ``unpack_uuid`` restores it. Null and empty text give null.
    """
    u = F.upper(c)
    return F.when(u.rlike(_CANONICAL), F.unhex(F.replace(u, F.lit("-"), F.lit("")))).when(
        F.length(F.trim(u)) > 0, F.concat(F.lit(_PAD), F.encode(u, "UTF-8"))
    )


def unpack_uuid(b: Column) -> Column:
    """The upper-case text behind ``pack_uuid``."""
    h = F.hex(b)
    dashed = F.concat_ws("-", *(F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(F.length(b) == 16, dashed).otherwise(F.decode(F.substring(b, 17, 1 << 30), "UTF-8"))


def digest16(*cols: Column) -> Column:
    """A 128-bit digest as 16 bytes; null if any part is null."""
    return F.unhex(F.md5(F.concat_ws("\x00", *cols))) if len(cols) > 1 else F.unhex(F.md5(cols[0]))


def sha256_hex(*cols: Column) -> Column:
    """SHA-256 in hex over the parts joined by a NUL character."""
    return F.sha2(F.concat_ws("\x00", *cols) if len(cols) > 1 else cols[0], 256)


def deterministic_uuid(c: Column) -> Column:
    """Upper-case UUID layout of the first 32 hex digits of the text's SHA-256."""
    h = F.sha2(c, 256)
    return F.upper(F.concat_ws("-", *(F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))))


def short_change_id(*cols: Column) -> Column:
    """Sixteen hex digits that identify a change."""
    return F.substring(F.sha2(F.concat_ws(":", *cols), 256), 1, 16)
