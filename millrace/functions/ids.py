"""Stable identifiers from content (ID1-ID7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column | str) -> Column:
    """20 hex digits of the SHA-256 of the compact JSON array of the parts as text (ID1)."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.substring(F.sha2(F.to_json(F.array(*[c.cast("string") for c in cols])), 256), 1, 20)


def identity_hash(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON object: keys sorted, nulls kept (ID2)."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def unit_interval(value: Column, salt: str) -> Column:
    """The first 8 bytes of SHA-256 of ``salt:value`` as a share of 2^64 - 1 (ID6)."""
    head = F.substring(F.sha2(F.concat(F.lit(salt + ":"), value), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(1.8446744073709552e19)


def catalog_entity_id(*parts: Column | str, target: bool = False) -> Column:
    return F.concat(F.lit("TGT:" if target else "ENT:"), stable_id(*parts))


def nil_entity_id(*parts: Column | str) -> Column:
    return F.concat(F.lit("NIL:"), stable_id(*parts))


def entity_node_id(key: Column) -> Column:
    return F.substring(F.sha1(key), 1, 20)
