"""Deterministic keys and hashes as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"
# Domain prefixes of the hashes. A chain written by another product is read with its prefixes, given as `domain`.
SOURCE_BODY = "STRATAMEM_SOURCE_BODY_v1" + NUL
EVENT_LEAF = "STRATAMEM_EVENT_LEAF_v1" + NUL


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix_ and 24 hex digits of the SHA-256 of the NUL-joined prefix and parts. Null parts are left out by concat_ws:
    give coalesced columns."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws(NUL, F.lit(prefix), *parts), 256), 1, 24))


def event_leaf(event_json: Column | str, domain: str = EVENT_LEAF) -> Column:
    """Hex hash of an event's canonical JSON."""
    return F.sha2(F.concat(F.lit(domain), F.col(event_json) if isinstance(event_json, str) else event_json), 256)


def chain_root(parent_hex: Column | str, leaf_hex: Column | str) -> Column:
    """Hex of SHA-256(parent bytes, leaf bytes)."""
    return F.sha2(F.concat(F.unhex(parent_hex), F.unhex(leaf_hex)), 256)


def body_hash(text: Column | str, vector: Column | str | None = None, domain: str = SOURCE_BODY) -> Column:
    """The body hash of a chunk by its text and the little-endian float32 bytes of its vector, either of which may be null.
    Members that are absent print as the word undefined; bodies with neither have the hash of two absences."""
    t = F.col(text) if isinstance(text, str) else text
    v = F.lit(None).cast("binary") if vector is None else F.col(vector) if isinstance(vector, str) else vector
    quoted = lambda c: F.when(c.isNotNull(), F.concat(F.lit('"'), F.sha2(c, 256), F.lit('"'))).otherwise("undefined")
    shown = lambda c: c.isNotNull().cast("string")
    dim = F.when(v.isNotNull(), (F.octet_length(v) / 4).cast("int").cast("string")).otherwise("undefined")
    body = F.concat(F.lit(domain + '{"text_present":'), shown(t), F.lit(',"text_sha256":'), quoted(t), F.lit(',"vector_dim":'), dim, F.lit(',"vector_present":'), shown(v), F.lit(',"vector_sha256":'), quoted(v), F.lit("}"))
    return F.sha2(body, 256)


def database_id(kind: Column | str, owner: Column | str) -> Column:
    """Base64url (no padding) of the JSON array [kind, owner]."""
    text = F.to_json(F.array(kind, owner))
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/=\n\r", "-_"), F.lit("="))


def qualified(ns: Column | str, key: Column | str) -> Column:
    return F.concat(ns, F.lit("::"), key)
