"""Sampled and full content digests.

A sparse hash reads n segments of a file and is a filter only: files of one class have equal full digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(size: Column, chunks: int, length: int, align: int = 4096) -> Column:
    """Offsets of the segments read: the whole file if it is no longer than chunks * length, else chunks - 1 aligned
    offsets and the exact tail, ascending, each once."""
    span = size - length
    at = F.transform(F.sequence(F.lit(0), F.lit(chunks - 2)), lambda i: ((i * span - (i * span) % (chunks - 1)) / (chunks - 1)).cast("bigint"))
    at = F.transform(at, lambda x: x - x % align)
    return F.when(size <= chunks * length, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(F.concat(at, F.array(span.cast("bigint")))))


def sparse_hash(content: Column, size: Column, chunks: int, length: int, align: int = 4096) -> Column:
    """``sparse_hash_of_bytes`` of a text in UTF-8."""
    return sparse_hash_of_bytes(F.encode(content, "UTF-8"), size, chunks, length, align)


def sparse_hash_of_bytes(bytes_: Column, size: Column, chunks: int, length: int, align: int = 4096) -> Column:
    """SHA-256 of the parameters, the size and the bytes (as hex) of each segment with its offset; only these are read."""
    take = F.when(size <= chunks * length, size).otherwise(F.lit(length))
    part = lambda o: F.concat(o.cast("string"), F.lit(":"), F.hex(F.substring(bytes_, (o + 1).cast("int"), take.cast("int"))))
    parts = F.array_join(F.transform(segments(size, chunks, length, align), part), ";")
    return F.sha2(F.concat(F.lit(f"v1|{chunks}|{length}|"), size.cast("string"), F.lit("|"), parts), 256)


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def remote_key(root_id: Column, path: Column) -> tuple[Column, Column]:
    """Identity of a remote file: a function of its root and path alone."""
    return F.substring(F.sha2(F.concat(F.lit("remote|"), root_id.cast("string")), 256), 1, 32), F.substring(F.sha2(path, 256), 1, 16)


def first_difference(a: Column, b: Column) -> Column:
    """The first byte (from 0) at which two texts in UTF-8 differ, the shorter length if one begins the other, null if they
    are equal."""
    return first_different_byte(F.encode(a, "UTF-8"), F.encode(b, "UTF-8"))


def first_different_byte(a: Column, b: Column) -> Column:
    """``first_difference`` of two binaries: a binary search over prefixes."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    lo = F.aggregate(
        F.sequence(F.lit(0), F.lit(30)),
        F.struct(F.lit(0).alias("lo"), n.alias("hi")),
        lambda s, _: F.when(s.lo >= s.hi, s).otherwise(
            F.when(F.substring(a, F.lit(1), F.ceil((s.lo + s.hi + 1) / 2).cast("int")) == F.substring(b, F.lit(1), F.ceil((s.lo + s.hi + 1) / 2).cast("int")), F.struct(F.least(F.ceil((s.lo + s.hi + 1) / 2).cast("int"), s.hi).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), (F.ceil((s.lo + s.hi + 1) / 2).cast("int") - 1).alias("hi")))
        ),
        lambda s: s.lo,
    )
    return F.when(a != b, lo)
