"""Bundles on disk: a store that activates only verified bundles, and hash-checked copies of frozen files.

A bundle's file is named by its digest and never changes; one small pointer file says which is active and which was
active before. The pointer is replaced whole, so a crash leaves the old state or the new one.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Mapping
from dataclasses import dataclass

from ..operators.integrity import REASONS, bundle_summary, verify_bundle
from .sinks import _load, _replace

SHIPPED, IMPORTED, ROLLED_BACK, NONE = "SHIPPED", "IMPORTED", "ROLLED_BACK", "NONE"


def file_digest(path: str) -> str:
    """SHA-256 of a file, read in blocks."""
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def copy_frozen(source: str, target: str, digests: Mapping[str, str]) -> None:
    """Copy the named files; those whose digest is another than stated are an error, and nothing of theirs is copied."""
    differing = sorted(name for name, digest in digests.items() if file_digest(f"{source}/{name}") != digest)
    if differing:
        raise ValueError(f"frozen files differ from their digests: {differing}")
    os.makedirs(target, exist_ok=True)
    for name in digests:
        shutil.copyfile(f"{source}/{name}", f"{target}/{name}")


@dataclass(frozen=True)
class Status:
    """Where the active bundle comes from, what it holds, and why the last candidate was refused."""

    source: str
    error: str | None = None
    summary: dict | None = None
    sha256: str | None = None
    snapshot_id: str | None = None
    previous_id: str | None = None


def snapshot_id(bundle: dict) -> str | None:
    day = str(bundle.get("createdAt") or "").strip()[:10]
    return f"ti-{day}" if len(day) == 10 else None


def parse_verified(content: bytes) -> tuple[dict | None, str]:
    """(bundle, "ok"), or (None, the first reason against it)."""
    try:
        bundle = json.loads(content)
    except ValueError:
        return None, REASONS[0]
    ok, reason, _ = verify_bundle(bundle)
    return (bundle if ok else None), reason


class BundleStore:
    """A folder of bundles; shipped is the bundle file that serves while none was imported."""

    def __init__(self, folder: str, shipped: str | None = None):
        self.folder, self.shipped, self.pointer = folder, shipped, f"{folder}/pointer.json"

    def _read(self, digest: str | None) -> tuple[dict | None, str]:
        """A stored bundle; its file must still have the digest that names it."""
        path = f"{self.folder}/{digest}.json"
        if digest is None or not os.path.isfile(path):
            return None, "missing"
        with open(path, "rb") as file:
            content = file.read()
        return parse_verified(content) if hashlib.sha256(content).hexdigest() == digest else (None, "digest")

    def _status(self, source: str, bundle: dict, digest: str | None, error: str | None = None) -> Status:
        before = self._read(_load(self.pointer).get("previous"))[0] if source != SHIPPED else None
        return Status(source, error, bundle_summary(bundle), digest, snapshot_id(bundle), snapshot_id(before) if before else None)

    def put(self, content: bytes) -> Status:
        """Activate a bundle if it holds; otherwise the active one stays and the status says why."""
        bundle, reason = parse_verified(content)
        if bundle is None:
            return Status(NONE, reason)
        digest, held = hashlib.sha256(content).hexdigest(), _load(self.pointer)
        os.makedirs(self.folder, exist_ok=True)
        path = f"{self.folder}/{digest}.json"
        with open(f"{path}.new", "wb") as file:
            file.write(content)
        os.replace(f"{path}.new", path)
        if self._read(digest)[0] is None:
            return Status(NONE, "digest")
        _replace(self.pointer, {"active": digest, "previous": held.get("active")})
        return self._status(IMPORTED, bundle, digest)

    def put_file(self, path: str) -> Status:
        """Activate a candidate file, which goes once it is active; a refused one stays for inspection."""
        with open(path, "rb") as file:
            status = self.put(file.read())
        if status.source == IMPORTED:
            os.remove(path)
        return status

    def roll_back(self) -> Status:
        """Make the bundle before active again; the two change places, so a second call undoes the first."""
        held = _load(self.pointer)
        if not held.get("previous"):
            return Status(NONE, "no_previous_bundle")
        bundle, reason = self._read(held["previous"])
        if bundle is None:
            return Status(NONE, reason)
        _replace(self.pointer, {"active": held["previous"], "previous": held["active"]})
        return self._status(ROLLED_BACK, bundle, held["previous"])

    def load(self, candidates: tuple[str, ...] = ()) -> tuple[dict | None, Status]:
        """The bundle to use: candidates are tried first, then the active one, then the shipped one.

        An active bundle that no longer holds is given up for the shipped one, and the status says so.
        """
        refused = [s.error for s in map(self.put_file, filter(os.path.isfile, candidates)) if s.source != IMPORTED]
        error, digest = (refused[-1] if refused else None), _load(self.pointer).get("active")
        if digest:
            bundle, reason = self._read(digest)
            if bundle is not None:
                return bundle, self._status(IMPORTED, bundle, digest, error)
            _replace(self.pointer, _load(self.pointer) | {"active": None})
            error = reason
        if not self.shipped or not os.path.isfile(self.shipped):
            return None, Status(ROLLED_BACK if error else NONE, error)
        with open(self.shipped, "rb") as file:
            content = file.read()
        bundle, reason = parse_verified(content)
        if bundle is None:
            return None, Status(ROLLED_BACK if error else NONE, error or reason)
        return bundle, self._status(ROLLED_BACK if error else SHIPPED, bundle, hashlib.sha256(content).hexdigest(), error)
