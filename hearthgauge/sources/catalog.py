"""Catalogue of sources: reading, contract, the files of one district."""

from __future__ import annotations

import json
from pathlib import Path

# Fixed values
SCHEMA_VERSION, MODE = "2.0.0", "production"
READINESS_VERSION, READINESS_SOURCES = "1.0.0", {"market", "park"}


def load_manifest(path: str) -> dict:
    manifest = json.loads(Path(path).read_text(encoding="utf-8"))
    if manifest.get("schemaVersion") != SCHEMA_VERSION or manifest.get("mode") != MODE:
        raise ValueError("the catalogue doesn't keep its contract")
    return manifest


def load_optional(path: str) -> dict | None:
    """A catalogue that may be missing or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def load_readiness(path: str) -> dict | None:
    """The readiness reports, or nothing if they are missing, broken, of another version or name a source that has none."""
    found = load_optional(path)
    if not isinstance(found, dict) or found.get("schemaVersion") != READINESS_VERSION:
        return None
    sources = found.get("sources")
    return found if isinstance(sources, dict) and set(sources) <= READINESS_SOURCES else None


def source_files(manifest: dict, source: str, prefix: str = "", suffix: str = "") -> list[str]:
    """Files of a source under a prefix; none of an unavailable one."""
    state = manifest["sources"].get(source)
    if state is None or state["status"] == "unavailable":
        return []
    return [f for f in state.get("files", []) if f.startswith(prefix) and f.endswith(suffix)]


def retry(what: str, operation, attempts: int = 3):
    """The result of `operation`, tried `attempts` times."""
    error: Exception | None = None
    for _ in range(attempts):
        try:
            return operation()
        except Exception as e:  # noqa: BLE001
            error = e
    raise RuntimeError(f"{what} failed {attempts} times") from error
