"""Hashes, manifests, bundles and histories."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import BRAND_VERSION, FRESH_DAYS, SHORTENER_VERSION, SHORTENERS, STALE_DAYS, brands

# The form of a bundle, which devices read, and the reasons for refusing one, in the order of the tests.
BUNDLE_VERSION = "ti-bundle-v1"
ALGORITHM = "sha256"
POLICY_VERSION = "DecisionPolicyV2"
SECTIONS = ("threatIntel", "brands", "shorteners")
REASONS = (
    "bundle_not_an_object", "unsupported_bundle_version", "missing_payload", "missing_integrity_block", "payload_not_canonicalisable",
    "integrity_digest_mismatch", "missing_payload_sections", "indicator_count_mismatch", "catalog_payload_invalid",
)


def row_hash(columns: Sequence[str]) -> Column:
    """A digest of a row's values; null differs from an empty text."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]), 256)


def blocked_digest(df: DataFrame, digest: str, by: Sequence[str] = ()) -> DataFrame:
    """A digest of a set of row digests that order does not change, without one list of them all.

    Digests are summed by 4096 prefixes of their hexadecimal form; a prefix keeps its count and the sum of four
    parts of its digests as whole numbers, so tasks combine partial sums. The digest is that of the 4096 lines.
    """
    part = lambda k: F.sum(F.conv(F.substring(digest, 4 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    lines = df.groupBy(*by, F.substring(digest, 1, 3).alias("p")).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[part(k) for k in range(4)]).alias("line"), F.count(F.lit(1)).alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: F.concat_ws(":", x.p, x.line)), "\n")
    return lines.groupBy(*by).agg(F.sum("n").alias("rows"), F.sha2(whole, 256).alias("sha256"))


def manifest(views: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dataset_view, rows, sha256) of each view."""
    return blocked_digest(views.withColumn("_h", row_hash(columns)), "_h", ["dataset_view"])


def combined_digest(manifest_rows: DataFrame) -> DataFrame:
    """One row: the digest of the views' sorted "view:sha256" lines."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "dataset_view", "sha256")))
    return manifest_rows.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("combined_sha256"))


def assignment_digest(views: DataFrame, domain: str = "registrable_domain") -> DataFrame:
    """Digest of the distinct (view, domain) pairs."""
    pairs = views.select(F.sha2(F.concat_ws(":", "dataset_view", domain), 256).alias("_h")).distinct()
    return blocked_digest(pairs, "_h")


def seal_manifest(current: dict | None, candidate: dict) -> dict:
    """Seal a manifest once; later candidates must be equal but for their creation time."""
    if current is None:
        return dict(candidate)
    differing = sorted(k for k in current.keys() | candidate.keys() if k != "creationTime" and current.get(k) != candidate.get(k))
    if differing:
        raise ValueError(f"the sealed manifest differs in {differing}")
    return current


def contract_violations(rows: DataFrame, labels: Sequence[str], group: str = "registrable_domain") -> DataFrame:
    """(violation, n) of frozen splits: unknown labels, model URLs that do not follow from the domain, leaking groups."""
    bad_label = F.count_if(~F.coalesce(F.col("label").isin(*labels), F.lit(False)))
    bad_url = F.count_if(~F.col("model_url").eqNullSafe(F.concat(F.lit("https://"), F.col(group), F.lit("/"))))
    counts = rows.agg(bad_label.alias("unknown_label"), bad_url.alias("model_url"))
    leaks = rows.groupBy(group).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("leaking_group"))
    return counts.crossJoin(leaks).unpivot([], ["unknown_label", "model_url", "leaking_group"], "violation", "n")


def staleness(created: Column, today: Column) -> Column:
    """FRESH, STALE, OUTDATED, or UNKNOWN for dates that cannot be read or lie ahead."""
    day = lambda c: F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")
    age = F.datediff(day(today), day(created))
    return F.when(age.isNull() | (age < 0), "UNKNOWN").when(age <= FRESH_DAYS, "FRESH").when(age <= STALE_DAYS, "STALE").otherwise("OUTDATED")


def register_history(history: DataFrame, records: DataFrame, key: str = "snapshot_id", digest: str = "sha256") -> DataFrame:
    """Append records whose id is new; an id with two digests, in the records or in the history, is an error."""
    seen = history.select(key, F.col(digest).alias("_d"), F.lit(True).alias("_known")).unionByName(records.select(key, F.col(digest).alias("_d"), F.lit(False).alias("_known")))
    ids = seen.groupBy(key).agg(F.min("_d").alias("_low"), F.max("_d").alias("_high"), F.count("_d").alias("_some"), F.count(F.lit(1)).alias("_all"), F.bool_or("_known").alias("_known"))
    one = F.col("_low").eqNullSafe(F.col("_high")) & F.col("_some").isin(F.lit(0), F.col("_all"))
    fresh = F.when(one, ~F.col("_known")).otherwise(F.raise_error(F.lit("a registered snapshot has another digest")).cast("boolean"))
    return history.unionByName(records.dropDuplicates([key]).join(ids.where(fresh).select(key), key, "left_semi"))


def history_summary(history: DataFrame, key: str = "snapshot_id", order: str = "seq", part: str | None = None) -> DataFrame:
    """Each record with its predecessor."""
    by = Window.partitionBy(*([part] if part else [])).orderBy(order, key)
    return history.withColumn("previous", F.lag(key).over(by))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace rows of new's keys and add the others."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


# Fixed form: sorted keys, no white space, ASCII escapes.
_CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def canonical_json(payload: Any) -> str:
    """The one text of a payload, which its digest is taken of."""
    return _CANONICAL.encode(payload)


def payload_digest(payload: Any) -> str:
    return hashlib.sha256(canonical_json(payload).encode()).hexdigest()


def bundle_digests(digests: DataFrame, column: str = "digest") -> DataFrame:
    """Distinct lower-case digests of 64 hexadecimal digits."""
    return digests.select(F.lower(F.col(column)).alias("digest")).where(F.col("digest").rlike("^[0-9a-f]{64}$")).distinct()


def catalog_payload() -> dict:
    """The versioned brand and shortener catalogs."""
    entries = [{"brandId": b["id"], "displayName": b["name"], "canonicalDomains": b["domains"], "aliases": b["aliases"]} for b in brands()]
    return {
        "brands": {"catalogVersion": BRAND_VERSION, "entryCount": len(entries), "entries": entries},
        "shorteners": {"catalogVersion": SHORTENER_VERSION, "domainCount": len(SHORTENERS), "domains": list(SHORTENERS)},
    }


def _unfit(value: Any) -> bool:
    """Whether a payload holds floats, text beyond ASCII or other types, which have no stable form."""
    if isinstance(value, dict):
        return any(_unfit(v) for pair in value.items() for v in pair)
    if isinstance(value, list):
        return any(map(_unfit, value))
    return not (value is None or isinstance(value, int) or isinstance(value, str) and value.isascii())


def build_bundle(digests: Sequence[str], created_at: str, policy_version: str = POLICY_VERSION) -> dict:
    """A sealed bundle of digests and catalogs; digests come from bundle_digests and are what a device can hold."""
    listed = sorted({d.lower() for d in digests})
    if any(not re.fullmatch("[0-9a-f]{64}", d) for d in listed):
        raise ValueError("digests need 64 hexadecimal digits")
    intel = {"digestAlgorithm": ALGORITHM, "indicatorCount": len(listed), "indicatorDigests": listed}
    payload = {"threatIntel": intel, **catalog_payload()}
    if _unfit([payload, created_at, policy_version]):
        raise ValueError("a bundle holds ASCII text and whole numbers only")
    seal = {"algorithm": ALGORITHM, "canonicalDigest": payload_digest(payload)}
    return {"bundleVersion": BUNDLE_VERSION, "createdAt": created_at, "policyVersion": policy_version, "payload": payload, "integrity": seal}


def verify_bundle(bundle: Any) -> tuple[bool, str, str]:
    """(whether a bundle holds, the first reason against it or "ok", the digest as far as it was computed)."""
    held = bundle if isinstance(bundle, dict) else {}
    payload, seal = held.get("payload"), held.get("integrity")
    early = (
        isinstance(bundle, dict),
        held.get("bundleVersion") == BUNDLE_VERSION,
        isinstance(payload, dict),
        isinstance(seal, dict) and seal.get("algorithm") == ALGORITHM,
    )
    if not all(early):
        return False, REASONS[early.index(False)], ""
    try:
        actual = payload_digest(payload)
    except (TypeError, ValueError):
        return False, REASONS[4], ""
    parts = [payload.get(s) if isinstance(payload.get(s), dict) else None for s in SECTIONS]
    intel, brand, short = (p or {} for p in parts)
    listed = intel.get("indicatorDigests")
    late = (
        actual == str(seal.get("canonicalDigest", "")),
        None not in parts,
        isinstance(listed, list) and _whole(intel.get("indicatorCount", -1)) == len(listed),
        isinstance(brand.get("entries"), list) and isinstance(short.get("domains"), list),
    )
    return (True, "ok", actual) if all(late) else (False, REASONS[5 + late.index(False)], actual)


def _whole(value: Any) -> int | None:
    """A count that may be given as a number or its text; None for anything else."""
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def bundle_summary(bundle: dict) -> dict:
    """What a bundle says of itself; counts that it does not state are those of its lists."""
    payload, said = bundle.get("payload", {}), ("bundleVersion", "createdAt", "policyVersion")
    counted = {"indicatorCount": ("threatIntel", "indicatorCount", None), "brandCount": ("brands", "entryCount", "entries"), "shortenerCount": ("shorteners", "domainCount", "domains")}
    out = {name: bundle.get(name) for name in said}
    for name, (section, stated, listed) in counted.items():
        held = payload.get(section, {})
        out[name] = int(held.get(stated, len(held.get(listed, []))))
    return out | {"canonicalDigest": bundle.get("integrity", {}).get("canonicalDigest")}


def verified(bundles: DataFrame, column: str = "bundle") -> DataFrame:
    """Add ok and reason of each bundle given as JSON text; each is a small document of its own."""

    @F.pandas_udf("struct<ok: boolean, reason: string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        def parsed(text: str | None) -> Any:
            try:
                return json.loads(text or "null")
            except ValueError:
                return None

        return pd.DataFrame([verify_bundle(parsed(t))[:2] for t in texts], columns=["ok", "reason"])

    return bundles.withColumn("_v", run(column)).select(*bundles.columns, "_v.ok", "_v.reason")
