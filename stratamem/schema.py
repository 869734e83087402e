"""The store's tables as StructTypes, the reserved keys and the limits of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"STRING": T.StringType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "BINARY": T.BinaryType(), "ARRAY<FLOAT>": T.ArrayType(T.FloatType()), "ARRAY<STRING>": T.ArrayType(T.StringType())}


def _table(columns: str) -> T.StructType:
    """Columns as in DDL, and the two that every table has."""
    parts = [c.split(" ", 2) for c in f"{columns}, _id STRING NOT NULL, _ts_created DOUBLE NOT NULL".removeprefix(", ").split(", ")]
    return T.StructType([T.StructField(name, _KINDS[kind], not rest) for name, kind, *rest in parts])


TABLES = {
    "memos": _table("namespace STRING NOT NULL, key STRING NOT NULL, kind STRING NOT NULL, edge_id STRING, suppressed BOOLEAN NOT NULL"),
    "source_maps": _table("memory_id STRING NOT NULL, source_key STRING NOT NULL, content_hash STRING"),
    "text_features": _table("memory_id STRING NOT NULL, source_map_id STRING NOT NULL, text STRING NOT NULL"),
    "text_stems": _table("memory_id STRING NOT NULL, source_map_id STRING NOT NULL, stems ARRAY<STRING> NOT NULL"),
    "vector_features": _table("memory_id STRING NOT NULL, source_map_id STRING NOT NULL, vector ARRAY<FLOAT> NOT NULL"),
    "nodes": _table("memory_id STRING NOT NULL, value STRING NOT NULL, properties STRING"),
    "edges": _table("from_node_id STRING NOT NULL, to_node_id STRING NOT NULL, properties STRING"),
    "node_labels": _table("kind STRING NOT NULL, description STRING NOT NULL, schema STRING"),
    "edge_labels": _table("kind STRING NOT NULL, description STRING NOT NULL, schema STRING"),
    "node_label_assignments": _table("node_id STRING NOT NULL, label_id STRING NOT NULL, props STRING NOT NULL"),
    "edge_label_assignments": _table("edge_id STRING NOT NULL, label_id STRING NOT NULL, props STRING NOT NULL"),
    "scopes": _table(""),
    "scope_edges": _table("parent STRING NOT NULL, child STRING NOT NULL"),
    "scope_closure": _table("ancestor STRING NOT NULL, descendant STRING NOT NULL"),
    "memory_scopes": _table("memory_id STRING NOT NULL, scope_id STRING NOT NULL"),
    "memory_provenance": _table("parent_root_hex STRING NOT NULL, root_hex STRING NOT NULL, event_type STRING NOT NULL, event_json STRING NOT NULL, intent_snapshot_id STRING"),
    "namespace_metadata": _table("namespace STRING NOT NULL, display_name STRING, description STRING NOT NULL, suppressed BOOLEAN NOT NULL"),
    "memory_tip_outbox": _table("root_hex STRING NOT NULL, facet STRING NOT NULL, event_type STRING NOT NULL, namespace STRING NOT NULL, memory_key STRING NOT NULL, source_key STRING, edge_id STRING, payload_sha256 STRING"),
    "memory_tip_blobs": _table("content_sha256 STRING NOT NULL, payload BINARY, location STRING NOT NULL, cold_uri STRING"),
}

# Fixed values of the data model.
SYSTEM_PREFIX = "__"
SEARCH_META_KEY = "__mem_search_meta__"
LABEL_PROPS_KEYS = {"node": "__mem_nl_props__/", "edge": "__mem_edge_props__/"}
GENESIS = "0" * 64
MAX_DEPTH, MAX_CHARS = 6, 512
ABSOLUTE_DEPTH, ABSOLUTE_CHARS = 32, 2048
VECTOR_DIMS = (512, 3072)
RRF_K = 60
DEFAULT_TOP_K = 10
HOT_TIPS = 256
PAGE_LIMIT = 100
