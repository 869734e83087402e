"""Label kinds with JSON Schemas: merging, hashing, matching and checking, and the registry of which database uses which."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamem.sources.tables import normal

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}


def canonical_json(value) -> str:
    """JSON with keys in order and without blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def merged(*ontologies: dict) -> dict:
    """{node: {kind: schema}, edge: {...}}; a later definition of a kind wins."""
    return {part: {k: v for o in ontologies for k, v in o.get(part, {}).items()} for part in ("node", "edge")}


def ontology_hash(ontology: dict) -> str:
    return hashlib.sha256(canonical_json(ontology).encode()).hexdigest()


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a schema: type, required, properties, additionalProperties, enum, const, items, minimum, maximum,
    minLength, maxLength."""
    out = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        fits = any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) or (k == "integer" and isinstance(value, float) and value.is_integer()) for k in kinds)
        if not fits:
            return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += [f"{at}.{k}: not allowed" for k in value if schema.get("additionalProperties") is False and k not in props]
        out += [x for k, v in value.items() if k in props for x in faults(v, props[k], f"{at}.{k}")]
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        out += [x for i, v in enumerate(value) for x in faults(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    return out


def checker(ontology: dict, part: str = "node") -> Callable[[Column | str, Column | str], Column]:
    """A function of (kind, props) columns giving the array of faults; an unknown kind is one, text that isn't JSON too."""
    schemas = ontology.get(part, {})

    @F.pandas_udf("array<string>")
    def check(kind: pd.Series, props: pd.Series) -> pd.Series:
        def one(k, p):
            if k not in schemas:
                return [f"unknown kind {k}"]
            try:
                return faults(json.loads(p or "{}"), schemas[k])
            except ValueError:
                return ["not JSON"]

        return pd.Series([one(k, p) for k, p in zip(kind, props)])

    return check


def history(links: DataFrame) -> DataFrame:
    """kind, owner_key, ontology_hash, linked_at_ms, link_id: each usable link once; blank owners and hashes are left out."""
    rows = links.withColumn("ontology_hash", normal("ontology_hash")).where("ontology_hash <> '' AND trim(owner_key) <> ''")
    return rows.select("kind", "owner_key", "ontology_hash", "linked_at_ms", "link_id").distinct()


def current(links: DataFrame) -> DataFrame:
    """The ontology each database is linked to last."""
    return history(links).groupBy("kind", "owner_key").agg(F.max_by("ontology_hash", F.struct("linked_at_ms", "link_id")).alias("ontology_hash"))


def databases_with(links: DataFrame, ontologies: DataFrame, node_kinds: list[str] = (), edge_kinds: list[str] = ()) -> DataFrame:
    """Databases whose current ontology has all of these kinds."""
    o = ontologies.select(normal("ontology_hash").alias("ontology_hash"), F.from_json("node_kinds_json", "array<string>").alias("n"), F.from_json("edge_kinds_json", "array<string>").alias("e")).dropDuplicates(["ontology_hash"])
    need = lambda have, kinds: F.size(F.array_except(F.array(*map(F.lit, kinds)).cast("array<string>"), have)) == 0
    return current(links).join(o.where(need("n", node_kinds) & need("e", edge_kinds)), "ontology_hash", "left_semi")
