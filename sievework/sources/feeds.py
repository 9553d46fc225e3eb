"""Feed connectors: one DataFrame factory per format, and their union.

Text formats are read by Spark, so files spread over tasks and bad input fails the query, not the driver. Every
factory gives url, label, source and collected_at, plus what the feed itself says.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import strip
from ..storage import stored
from .dated import file_digests

CSV_SUFFIXES = (".csv", ".csv.gz", ".csv.bz2", ".csv.zip")
FOLDER_LABELS = {"benign": "BENIGN", "phishing": "PHISHING", "malware": "MALWARE"}
# Names that feeds give to a column, in order of preference.
URL_NAMES, DOMAIN_NAMES, LABEL_NAMES = ("url",), ("domain", "hostname"), ("label", "class")
DATE_NAMES = ("collected_at", "submission_time", "dateadded", "date_added")
PHISH_COLUMNS = ("phish_id", "url", "submission_time", "verified", "online")
COMMON = ("url", "label", "source", "collected_at")


def find_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of the names that the frame has, without regard to case and outer white space."""
    have = {c.strip().lower(): c for c in reversed(df.columns)}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def _tagged(df: DataFrame, url: Column, label: str, source: str, collected_at: str | Column, **more: Column) -> DataFrame:
    date = F.lit(collected_at) if isinstance(collected_at, str) else collected_at
    return df.select(url.alias("url"), F.lit(label).alias("label"), F.lit(source).alias("source"), date.cast("string").alias("collected_at"), *[c.alias(n) for n, c in more.items()])


def _fail_if_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} holds no rows")
    return df


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All-text CSV with doubled quotes; a line that does not fit fails the query, and lines that start with # are comments."""
    return spark.read.option("header", header).option("comment", "#").option("mode", "FAILFAST").option("enforceSchema", False).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects, or an object whose entries or data hold them, or one object."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("primitivesAsString", True).json(path)
    inner = next((c for c in ("entries", "data") if c in df.columns and dict(df.dtypes)[c].startswith("array<struct")), None)
    return df.select(F.explode(inner).alias("e")).select("e.*") if inner else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text as url: blank lines and comments go, and of "rank,domain" lines the domain stays."""
    line = strip(F.regexp_replace("value", "^﻿", ""))
    rows = spark.read.text(path).select(line.alias("line")).where("line <> '' and not line like '#%'")
    parts = F.split("line", ",", -1)
    ranked = (F.size(parts) >= 2) & F.get(parts, F.lit(0)).rlike("^\\d+$")
    return rows.select(F.when(ranked, strip(F.get(parts, F.lit(1)))).otherwise(F.col("line")).alias("url"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A file by its suffix."""
    name = path.lower()
    if name.endswith(CSV_SUFFIXES):
        return read_csv(spark, path)
    if name.endswith(".jsonl"):
        return spark.read.option("mode", "FAILFAST").option("primitivesAsString", True).json(path)
    if name.endswith(".json"):
        return read_json(spark, path)
    if name.endswith(".txt"):
        return read_lines(spark, path)
    raise ValueError(f"unsupported file {path}")


def conform(df: DataFrame, default_label: str, stem: str, collected_at: str = "") -> DataFrame:
    """Any raw frame with the four common columns in front; its other columns stay."""
    url, domain, label, date = (find_column(df, n) for n in (URL_NAMES, DOMAIN_NAMES, LABEL_NAMES, DATE_NAMES))
    source = find_column(df, ("source",))
    if url is None and domain is None:
        raise ValueError("no column holds URLs")
    made = {
        "url": F.col(url) if url else F.concat(F.lit("https://"), F.col(domain)),
        "label": F.col(label) if label else F.lit(default_label),
        "source": F.col(source) if source else F.lit(stem),
        "collected_at": F.col(date) if date else F.lit(collected_at),
    }
    rest = [c for c in df.columns if c.strip().lower() not in COMMON]
    return df.select(*[v.cast("string").alias(n) for n, v in made.items()], *rest)


def load_raw(spark: SparkSession, root: str, files: dict[str, Sequence[str]]) -> DataFrame:
    """Union of files (paths below root by label folder) by column name; without files an empty frame."""
    frames = [conform(read_any(spark, f"{root}/{folder}/{f}"), FOLDER_LABELS[folder], f.rpartition("/")[2].split(".")[0]) for folder in FOLDER_LABELS for f in files.get(folder, ())]
    if not frames:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in COMMON))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def tranco(spark: SparkSession, path: str, collected_at: str, list_id: str = "") -> DataFrame:
    """Headerless rank,domain lines; a rank that is no number fails."""
    df = spark.read.schema("rank string, domain string").option("mode", "FAILFAST").csv(path)
    rank = F.when(F.assert_true(F.col("rank").rlike("^\\s*\\d+\\s*$"), F.lit("ranks must be numbers")).isNull(), strip(F.col("rank")).cast("long"))
    return _tagged(df, F.concat(F.lit("https://"), strip(F.col("domain"))), "BENIGN", "tranco", collected_at, rank=rank, list_id=F.lit(list_id), status=F.lit("candidate"))


def phishtank(spark: SparkSession, path: str, verified_only: bool = True, online_only: bool = True) -> DataFrame:
    df = read_csv(spark, path)
    missing = [c for c in PHISH_COLUMNS if find_column(df, (c,)) is None]
    if missing:
        raise ValueError(f"missing columns {missing}")
    for name, wanted in (("verified", verified_only), ("online", online_only)):
        if wanted:
            df = df.where(F.lower(strip(F.col(find_column(df, (name,))))) == "yes")
    return _tagged(df, F.col(find_column(df, ("url",))), "PHISHING", "phishtank", F.col(find_column(df, ("submission_time",))), status=F.lit("verified_online"))


def urlhaus(spark: SparkSession, path: str, collected_at: str) -> DataFrame:
    """CSV whose header is the first commented line that names a url column."""
    head = spark.read.text(path).where("value like '#%' and value like '%,%' and lower(value) like '%url%'").select("value").first()
    if head is None:
        raise ValueError("no header line names a url column")
    names = [n.strip().strip('"').lower() for n in head.value.lstrip("# ").split(",")]
    df = spark.read.schema(", ".join(f"`{n}` string" for n in names)).option("comment", "#").option("mode", "FAILFAST").csv(path)
    url = find_column(df, ("url", "urlhaus_url"))
    date = find_column(df, DATE_NAMES)
    return _tagged(df, F.col(f"`{url}`"), "MALWARE", "urlhaus", F.col(f"`{date}`") if date else collected_at, status=F.lit("listed"))


def commoncrawl(spark: SparkSession, path: str, collected_at: str) -> DataFrame:
    """JSON lines with a url; any other line fails the query."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    url = F.from_json("value", "url string", {"mode": "PERMISSIVE"}).url
    checked = F.when(F.assert_true(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("no url in: "), F.substring("value", 1, 80))).isNull(), url)
    return _tagged(lines, checked, "BENIGN", "commoncrawl_tranco_candidate", collected_at)


def openphish(spark: SparkSession, path: str, collected_at: str) -> DataFrame:
    lines = spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> '' and not line like '#%'")
    return _tagged(_fail_if_empty(lines, path), F.col("line"), "PHISHING", "openphish", collected_at, status=F.lit("community_feed"))


def cert_polska(spark: SparkSession, path: str, collected_at: str) -> DataFrame:
    """A JSON array; entries with a domain, but for outer dots, and without a deletion date stay; none at all is an error."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").option("primitivesAsString", True).json(path)
    value = lambda name: strip(F.col(f"`{c}`")) if (c := find_column(df, (name,))) else F.lit(None).cast("string")
    domain = F.trim(F.coalesce(value("domainaddress") if find_column(df, ("domainaddress",)) else value("domain"), F.lit("")), F.lit("."))
    rows = _fail_if_empty(df.where((domain != "") & (F.coalesce(value("deletedate"), F.lit("")) == "")), path)
    return _tagged(rows, F.concat(F.lit("https://"), domain, F.lit("/")), "PHISHING", "cert_polska", collected_at, insert_date=value("insertdate"), register_position_id=value("registerpositionid"), scope=F.lit("poland"))


def phishing_database(spark: SparkSession, path: str, collected_at: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim(strip(F.col("value")), F.lit(".")).alias("d")).where("d <> '' and not d like '#%'")
    return _tagged(_fail_if_empty(lines, path), F.concat(F.lit("https://"), F.col("d"), F.lit("/")), "PHISHING", "phishing_database", collected_at, status=F.lit("community_report"))


def threatfox(spark: SparkSession, path: str, collected_at: str, threat_types: Sequence[str] = ()) -> DataFrame:
    """Domain indicators of an IOC document; without threat types all are taken; none at all is an error."""
    schema = "query_status string, data array<struct<ioc: string, ioc_type: string, threat_type: string, malware: string, confidence_level: string, first_seen: string, tags: array<string>>>"
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = df.where(F.assert_true(F.col("data").isNotNull(), F.lit("data must be a list")).isNull())
    rows = checked.select(F.explode("data").alias("d")).select("d.*").where("ioc_type = 'domain'")
    if threat_types:
        rows = rows.where(F.lower("threat_type").isin(*[t.lower() for t in threat_types]))
    domain = F.trim(strip(F.col("ioc")), F.lit("."))
    rows = _fail_if_empty(rows.where(domain != ""), path)
    return _tagged(rows, F.concat(F.lit("https://"), domain, F.lit("/")), "MALWARE", "threatfox", collected_at, threat_type=F.col("threat_type"), tags=F.array_join("tags", ", "))


PARSERS: dict[str, Callable[..., DataFrame]] = {
    "tranco": tranco,
    "phishtank": phishtank,
    "urlhaus": urlhaus,
    "commoncrawl": commoncrawl,
    "openphish": openphish,
    "cert_polska": cert_polska,
    "phishing_database": phishing_database,
    "threatfox": threatfox,
}


def parse(spark: SparkSession, name: str, path: str, **options: object) -> DataFrame:
    """A feed by the name of its parser."""
    if name not in PARSERS:
        raise ValueError(f"no parser {name}; there are {sorted(PARSERS)}")
    return PARSERS[name](spark, path, **options)


def discover_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(path, snapshot_date, bytes, sha256, records) of dated snapshot files below root; partial files go.

    Files are listed by Spark and dealt by path; a task reads its files in chunks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    day = F.regexp_extract("path", "/(?:[^/=]+=)?(\\d{4}-\\d{2}-\\d{2})[^/]*/[^/]+$", 1)
    kept = files.where("not path like '%.part' and not path like '%.failures.jsonl'").select("path", day.alias("snapshot_date"), F.col("length").alias("bytes")).where("snapshot_date <> ''")
    kept = stored(kept, "snapshots")
    return kept.join(file_digests(kept.repartition("path")), "path").select("path", "snapshot_date", "bytes", "sha256", "records")


def snapshot_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Metadata documents of all snapshots, in order of their paths."""
    return spark.read.option("multiLine", True).json(f"{root}/snapshots/*/snapshot_metadata.json").select("*", F.col("_metadata.file_path").alias("path")).orderBy("path")
