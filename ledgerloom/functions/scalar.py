"""Scalar functions of the data model, built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def padded(n: Column, width: int = 16) -> Column:
    """Decimal with leading zeros, as object keys have sequences."""
    return F.lpad(n.cast("string"), width, "0")


def event_key(prefix: Column, sequence: Column, digest: Column) -> Column:
    return F.concat(prefix, F.lit("/events/"), padded(sequence), F.lit("-"), digest, F.lit(".cbor.zst"))


def parse_event_key(key: Column) -> list[Column]:
    """sequence, digest and whether a key's last part has the canonical form; the first two are null if not."""
    pattern = r"^(?:.*/)?([0-9]{16})-([0-9a-f]{64})\.cbor\.zst$"
    ok = F.rlike(key, F.lit(pattern))
    return [F.when(ok, F.regexp_extract(key, pattern, 1)).cast("long").alias("sequence"), F.when(ok, F.regexp_extract(key, pattern, 2)).alias("digest"), ok.alias("canonical")]


def length_prefixed(value: Column) -> Column:
    """Length as 8 big-endian bytes, then the bytes."""
    raw = F.encode(value, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value).cast("long")), 16, "0")), raw)


def domain_digest(domain: str, *values: Column) -> Column:
    """SHA-256 over a domain name, a zero byte and length-prefixed values."""
    return F.sha2(F.concat(F.lit(domain.encode() + b"\0"), *(length_prefixed(v) for v in values)), 256)


def scope_id(workspace: Column, campaign: Column) -> Column:
    """Scope id: SHA-256 over a two-field map of text strings in deterministic binary form."""

    def text(c: Column) -> Column:
        n = F.octet_length(c).cast("long")
        head = F.when(n < 24, F.unhex(F.lpad(F.hex(n + 0x60), 2, "0"))).when(n < 256, F.unhex(F.concat(F.lit("78"), F.lpad(F.hex(n), 2, "0")))).otherwise(F.unhex(F.concat(F.lit("79"), F.lpad(F.hex(n), 4, "0"))))
        return F.concat(head, F.encode(c, "UTF-8"))

    return F.sha2(F.concat(F.unhex(F.lit("A2")), text(F.lit("campaign_id")), text(campaign), text(F.lit("workspace_id")), text(workspace)), 256)


def bounded_text(text: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` bytes that ends between characters.

    A cut character leaves a lead byte whose sequence is incomplete: at most three bytes to drop.
    """
    raw = F.substring(F.encode(text, "UTF-8"), 1, limit)
    n = F.octet_length(raw)
    shown = F.when(F.octet_length(text) <= limit, text)
    for back in range(4):
        part = F.substring(raw, F.lit(1), n - back)
        shown = F.coalesce(shown, F.when(F.is_valid_utf8(part.cast("string")), part.cast("string")))
    return shown


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def div_ceil(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("long")
