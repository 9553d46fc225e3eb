"""Public suffix rules as a table that is matched level by level.

A rule's name is known by its hash: the table is one row that holds an array of buckets, at least as many as rules, and
a bucket holds the few names that fall into it. A host's ending of n labels is looked up in one bucket, so work per
host is the number of labels of the longest rule whatever the number of rules, and plans do not grow with them. The
row is written once and broadcast; LARGEST bounds it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

PLAIN, WILD, EXCEPTION = 1, 2, 4
#: Rules that a table may have: some 20 MB of it.
LARGEST = 200_000
ROWS = "_suffixes array<array<struct<name:string,flags:int>>>"


@dataclass(frozen=True)
class SuffixTable:
    """row has one row of buckets; longest is the number of labels of the longest suffix that a rule can give."""

    row: DataFrame
    buckets: int
    longest: int


def read_suffix_rules(path: str, private: bool = False) -> tuple[str, ...]:
    """The rules of a file in the public suffix list's format: one a line, "//" for comments, other scripts in IDNA.

    Rules between the markers of the private section count only with private. Spark reads the file, wherever it is.
    """
    texts = SparkSession.active().read.text(path, wholetext=True).limit(1).collect()
    rules: list[str] = []
    inside = False
    for line in (texts[0].value if texts else "").splitlines():
        if "===BEGIN PRIVATE DOMAINS===" in line or "===END PRIVATE DOMAINS===" in line:
            inside = "===BEGIN" in line
        rule = line.split("//", 1)[0].split()
        if rule and (private or not inside):
            mark = rule[0][:1] if rule[0][0] == "!" else rule[0][:2] if rule[0][:2] == "*." else ""
            rules.append(mark + rule[0][len(mark) :].lower().encode("idna").decode("ascii"))
    if not rules:
        raise ValueError(f"{path} holds no rules")
    return tuple(rules)


def suffix_table(spark: SparkSession, rules: Sequence[str]) -> SuffixTable:
    if len(rules) > LARGEST:
        raise ValueError(f"{len(rules)} rules; a table may have {LARGEST}")
    flags: dict[str, int] = {}
    for rule in rules:
        name = rule.lstrip("!*").removeprefix(".")
        flags[name] = flags.get(name, 0) | (EXCEPTION if rule[0] == "!" else WILD if rule[0] == "*" else PLAIN)
    size = 1 << max(0, len(flags) - 1).bit_length()
    buckets: list[list[tuple[str, int]]] = [[] for _ in range(size)]
    for name, f in flags.items():
        buckets[xxhash.xxh64_intdigest(name.encode(), 42) % size].append((name, f))  # as F.xxhash64 has it
    longest = max(name.count(".") + 1 + bool(f & WILD) for name, f in flags.items())
    return SuffixTable(stored(spark.createDataFrame([(buckets,)], ROWS), "suffixes"), size, longest)


def _flags(ending: Column, table: SuffixTable) -> Column:
    """What the rules say of an ending: bits of PLAIN, WILD and EXCEPTION."""
    bucket = F.get(F.col("_suffixes"), F.xxhash64(ending).bitwiseAND(table.buckets - 1).cast("int"))
    return F.coalesce(F.get(F.filter(bucket, lambda x: x["name"] == ending), F.lit(0)).flags, F.lit(0))


def with_suffix_labels(df: DataFrame, host: str, table: SuffixTable, out: str) -> DataFrame:
    """Add how many last labels of a host are its public suffix: an exception wins, then the longest rule; else 0."""
    levels = range(1, table.longest + 1)
    tails = F.array(*[F.substring_index(host, ".", -n) for n in levels])
    rows = df.crossJoin(F.broadcast(table.row))
    rows = rows.select("*", F.inline(F.array(F.struct(F.transform(tails, lambda t: _flags(t, table)).alias("_flags"), F.size(F.split(host, "\\.")).alias("_size")))))
    bit = lambda n, b: F.get("_flags", F.lit(n - 1)).bitwiseAND(b) != 0
    found = F.lit(0)
    for n in levels:
        wild = bit(n - 1, WILD) if n > 1 else F.lit(False)
        found = F.when((F.col("_size") >= n) & (bit(n, PLAIN) | wild), n).otherwise(found)
    for n in levels[1:]:
        found = F.when((F.col("_size") >= n) & bit(n, EXCEPTION), n - 1).otherwise(found)
    return rows.withColumn(out, found).drop("_suffixes", "_flags", "_size")
