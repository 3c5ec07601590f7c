"""Content-derived identifiers: the same content always has the same key, so loading twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace of DNS names in RFC 4122, from which version-5 UUIDs of keys are made.
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def stripped(text: Column) -> Column:
    """Text without white space (in the Unicode sense) at both ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def text_checksum(text: Column) -> Column:
    return F.sha2(stripped(text), 256)


def digest(prefix: str, separator: str, parts: list[Column], length: int = 64) -> Column:
    """Prefix and the first ``length`` hex digits of the SHA-256 of the joined parts; nulls count as empty."""
    joined = F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def evidence_id(source_type: Column, source_id: Column, chunk: Column, checksum: Column) -> Column:
    return digest("EV:", "\n", [source_type, source_id, chunk, checksum])


def job_id(evidence: Column, job_type: Column, version: Column) -> Column:
    return digest("JOB:", "\n", [evidence, job_type, version])


def fact_id(*parts: Column) -> Column:
    return digest("SF:", "|", list(parts), 24)


def normalised(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def signal_id(source_type: Column, source_id: Column, subject: Column, kind: Column, excerpt: Column) -> Column:
    return digest("SIG:", "|", [source_type, source_id, normalised(subject), kind, normalised(F.substring(excerpt, 1, 120))], 20)


def propagation_id(signal: Column, target: Column, kind: Column, path: Column) -> Column:
    return digest("SP:", "|", [signal, target, kind, path], 24)


def news_id(title: Column) -> Column:
    return F.concat(F.lit("EV:"), F.substring(F.sha2(stripped(title), 256), 1, 16))


def entity_id(kind: str, name: Column) -> Column:
    length = {"Company": 12, "Product": 16}[kind]
    return F.concat(F.lit("CO:" if kind == "Company" else "P:"), F.substring(F.md5(stripped(name)), 1, length))


def uuid5(key: Column) -> Column:
    """The version-5 UUID of a key in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_DNS)), F.encode(key, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def summary_key(level: int, entity: Column, depth: Column | None = None) -> Column:
    return F.concat_ws(":", F.lit(f"summary:L{level}"), entity, *([depth.cast("string")] if depth is not None else []))
