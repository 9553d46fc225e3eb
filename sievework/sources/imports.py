"""Imports of feed files: parse one, write it to its label's folder, and describe the snapshot it came from."""

from __future__ import annotations

import os
import shutil
from collections.abc import Collection

from pyspark.sql import SparkSession

from .bundles import file_digest
from .feeds import parse
from .sinks import export_csv, update_snapshot_metadata

# The label folder of each source, and the names that a key file may set.
FEED_FOLDERS = {
    "tranco": "benign",
    "commoncrawl": "benign",
    "phishtank": "phishing",
    "openphish": "phishing",
    "cert_polska": "phishing",
    "phishing_database": "phishing",
    "urlhaus": "malware",
    "threatfox": "malware",
}
KEY_NAMES = ("PHISHTANK_APP_KEY", "URLHAUS_AUTH_KEY", "THREATFOX_AUTH_KEY")


def import_feed(spark: SparkSession, source: str, path: str, root: str, collected_at: str, version: str | None = None, snapshot: bool = False) -> str:
    """Write a feed file's rows below root as <label folder>/<source>_<day>.csv and return that path.

    With snapshot the file itself is kept under snapshots/<day>/<source> and entered in the day's metadata; a file
    of the same source and day with another content is an error. root is a folder that the driver can write to.
    """
    if source not in FEED_FOLDERS:
        raise ValueError(f"no source {source}; there are {sorted(FEED_FOLDERS)}")
    day, kept = f"{root}/snapshots/{collected_at}", path
    if snapshot:
        kept = f"{day}/{source}/{os.path.basename(path)}"
        os.makedirs(os.path.dirname(kept), exist_ok=True)
        if not os.path.exists(kept):
            shutil.copyfile(path, kept)
        elif file_digest(kept) != file_digest(path):
            raise ValueError(f"{kept} already holds another content")
    options = {} if source == "phishtank" else {"collected_at": collected_at}
    if source == "tranco":
        options["list_id"] = version or "unknown"
    out = f"{root}/{FEED_FOLDERS[source]}/{source}_{collected_at}.csv"
    export_csv(parse(spark, source, kept, **options), out, mode="overwrite")
    if snapshot:
        records = spark.read.option("header", True).option("multiLine", True).csv(out).count()
        update_snapshot_metadata(f"{day}/snapshot_metadata.json", source, {"collected_at": collected_at, "sha256": file_digest(kept), "records": records, "version": version})
    return out


def read_keys(path: str, allowed: Collection[str] = KEY_NAMES) -> dict[str, str]:
    """NAME=value lines of a key file, if there is one; other names and other lines are an error."""
    found: dict[str, str] = {}
    if not os.path.exists(path):
        return found
    with open(path, encoding="utf-8-sig") as file:
        for number, line in enumerate(map(str.strip, file), 1):
            if not line or line.startswith("#"):
                continue
            name, equals, value = line.partition("=")
            if not equals:
                raise ValueError(f"line {number} is not NAME=value")
            if name.strip() not in allowed:
                raise ValueError(f"line {number} sets {name.strip()}, which is not allowed")
            found[name.strip()] = value.strip().strip("\"'")
    return found
