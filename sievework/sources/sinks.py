"""Sinks: tables, snapshot metadata, acquisition records."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame

STABLE_FIELDS = ("sha256", "records", "collected_at", "url")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet, the form that later steps read."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and \\n line ends, for tools that want text; blanks stay, and quotes are doubled."""
    options = {"header": True, "lineSep": "\n", "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(**options).csv(path)


def _replace(path: str, payload: dict) -> None:
    """Write a small document whole, then put it in place."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.new", "w", encoding="utf-8") as file:
        json.dump(payload, file, indent=2, sort_keys=True)
    os.replace(f"{path}.new", path)


def _load(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def update_snapshot_metadata(path: str, source: str, entry: dict) -> dict:
    """Add a source's entry once; another entry of the source must agree in its stable fields."""
    document = _load(path) or {"sources": []}
    known = {s["source"]: s for s in document["sources"]}
    if source in known:
        differing = [f for f in STABLE_FIELDS if known[source].get(f) != entry.get(f)]
        if differing:
            raise ValueError(f"snapshot entry of {source} differs in {differing}")
        return document
    document["sources"] = sorted([*document["sources"], {"source": source, **entry}], key=lambda s: s["source"])
    _replace(path, document)
    return document


def record_acquisition(path: str, source: str, status: dict) -> dict:
    """Keep the last status of each source."""
    document = _load(path)
    document[source] = status
    _replace(path, document)
    return document


def archive_metadata(folder: str, payload: dict) -> None:
    """Keep the previous version's metadata once, then write the current one."""
    current = f"{folder}/dataset_metadata.json"
    old = _load(current)
    if old and old.get("version") != payload.get("version"):
        kept = f"{folder}/archive/dataset_metadata_{old.get('version')}.json"
        if not os.path.exists(kept):
            _replace(kept, old)
    _replace(current, payload)
