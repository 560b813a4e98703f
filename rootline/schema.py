"""The eight tables of a lineage store, and the checks on opening one."""

from __future__ import annotations

from pyspark.sql import types as T

FORMAT_VERSION = 1


class StoreError(Exception):
    """A store can't be used as asked."""


class SchemaMismatchError(StoreError):
    """A folder is no store, or one of another format."""


class NodeNotFoundError(StoreError, KeyError):
    """No node has the id asked for."""


class ArtifactNotFoundError(StoreError, KeyError):
    """A node has no artifact of the name asked for."""


class IntegrityError(StoreError):
    """A change would break a key or a reference, or stored data refers to what is missing."""


class CorruptChunkError(IntegrityError):
    """Stored bytes don't have the digest they are stored under."""


class RuleViolationError(StoreError, ValueError):
    """A step may not follow its parents."""


def _table(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


DDL = {
    "config": "key string, value string",
    "node": "node_id string, step_type string, generation int, created_utc string, created_epoch_seconds double, healthy boolean, duration_seconds double, size_bytes bigint, content_hash string, prov_user string, prov_python string, prov_platform string, prov_git_commit string, prov_git_branch string, prov_git_dirty boolean",
    "edge": "child_id string, parent_id string, ordinal int",
    "metadata": "node_id string, key string, value string, data_type string, grp string, searchable boolean, num_value double",
    "chunk": "digest string, kind int, base_digest string, data binary, length bigint, created_epoch_seconds double",
    "chunk_feature": "feature bigint, digest string",
    "artifact": "node_id string, relpath string, size bigint, sha256 string",
    "artifact_chunk": "node_id string, relpath string, ordinal int, digest string",
}

KEYS = {"config": ["key"], "node": ["node_id"], "edge": ["child_id", "parent_id"], "metadata": ["node_id", "key"], "chunk": ["digest"], "chunk_feature": ["feature", "digest"], "artifact": ["node_id", "relpath"], "artifact_chunk": ["node_id", "relpath", "ordinal"]}

#: Columns of a node that a filter may name; other names are metadata keys.
STRUCTURAL = {"node_id": str, "step_type": str, "generation": int, "created_utc": str, "created_epoch_seconds": float, "healthy": bool, "duration_seconds": float, "size_bytes": int, "content_hash": str}

PROVENANCE = ["prov_user", "prov_python", "prov_platform", "prov_git_commit", "prov_git_branch", "prov_git_dirty"]


def struct(name: str) -> T.StructType:
    """The schema of a table (needs a session)."""
    return _table(DDL[name])
