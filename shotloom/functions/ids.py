"""Content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEAD_TAIL_BYTES = 1 << 20


def content_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the first 16 hex digits of the SHA-256 over the joined parts."""
    joined = F.concat(*[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, 16))


def whole_fingerprint(content: Column) -> Column:
    """24 hex digits over the size and the whole content: equal for equal contents only.

    Up to ``HEAD_TAIL_BYTES`` it is the same as ``fingerprint``.
    """
    raw = content.cast("binary")
    return F.substring(F.sha2(F.concat(F.octet_length(raw).cast("string").cast("binary"), raw), 256), 1, 24)


def fingerprint(content: Column, chunk: int = HEAD_TAIL_BYTES) -> Column:
    """24 hex digits over size, head and (for content above two chunks) tail.

    A quick identity for large files; contents that differ in between share it.
    ``content`` is binary, or a string whose UTF-8 bytes are taken.
    """
    raw = content.cast("binary")
    size = F.octet_length(raw)
    head = F.substring(raw, 1, chunk)
    tail = F.when(size > 2 * chunk, F.substring(raw, -chunk, chunk)).otherwise(F.lit(b"").cast("binary"))
    return F.substring(F.sha2(F.concat(size.cast("string").cast("binary"), head, tail), 256), 1, 24)
