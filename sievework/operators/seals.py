"""Sealed tables: a tree of hash prefixes over row digests, by which two tables are compared from the root down.

A sealed table is stored by the first BUCKET_DIGITS hexadecimal digits of its rows' digests, sorted by digest within
files. Its tree has a node for each prefix of up to DEPTH digits: the number of rows and a digest, which for the longest
prefixes is made of sums of row digests (so tasks combine them) and for others of their children. Tables that differ
are compared level by level below the prefixes that differ; rows are read in the longest differing prefixes only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..storage import stored
from .integrity import row_hash

#: Hexadecimal digits of the tree's longest prefixes: 65,536 of them, whatever the size.
DEPTH = 4
BUCKET_DIGITS = 2
DIGEST, BUCKET = "_digest", "_bucket"
TREE = "prefix string, n long, sha256 string"


@dataclass(frozen=True)
class Seal:
    """rows are the table's rows with their digest and bucket; tree has (prefix, n, sha256)."""

    rows: DataFrame
    tree: DataFrame

    def root(self) -> tuple[int, str]:
        """The count and the digest of the whole table."""
        found = self.tree.where("prefix = ''").first()
        return (found.n, found.sha256) if found else (0, "")


def tree_of(rows: DataFrame) -> DataFrame:
    """(prefix, n, sha256) of all prefixes of the digests of rows."""
    part = lambda k: F.sum(F.conv(F.substring(DIGEST, 4 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    leaves = rows.groupBy(F.substring(DIGEST, 1, DEPTH).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[part(k) for k in range(4)]), 256).alias("sha256"))
    levels = [stored(leaves, "leaves")]
    for depth in range(DEPTH - 1, -1, -1):
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "sha256"))), lambda x: F.concat_ws(":", x.prefix, x.sha256)), "\n")
        levels.append(levels[-1].groupBy(F.substring("prefix", 1, depth).alias("prefix")).agg(F.sum("n").alias("n"), F.sha2(lines, 256).alias("sha256")))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def write_seal(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> Seal:
    """Store df with its tree below path; columns are those that the seal covers."""
    digest = row_hash(list(columns or df.columns))
    rows = df.withColumn(DIGEST, digest).withColumn(BUCKET, F.substring(DIGEST, 1, BUCKET_DIGITS))
    rows.repartition(BUCKET).sortWithinPartitions(BUCKET, DIGEST).write.partitionBy(BUCKET).parquet(f"{path}/rows")
    tree_of(df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")).write.parquet(f"{path}/tree")
    return read_seal(df.sparkSession, path, rows.schema)


def read_seal(spark: SparkSession, path: str, schema: StructType) -> Seal:
    """A stored seal; schema is that of its rows, as an empty table's files do not tell it."""
    fields = [f for f in schema if f.name != BUCKET]
    return Seal(spark.read.schema(StructType([*fields, StructField(BUCKET, StringType())])).parquet(f"{path}/rows"), spark.read.schema(TREE).parquet(f"{path}/tree"))


def differing_prefixes(left: Seal, right: Seal) -> DataFrame:
    """The longest prefixes in which two sealed tables differ, found from the root down: at most 65,536 rows."""
    parents: DataFrame | None = None
    for depth in range(DEPTH + 1):
        sides = [s.tree.where(F.length("prefix") == depth).select("prefix", F.col("sha256").alias(name)) for s, name in ((left, "a"), (right, "b"))]
        if parents is not None:
            sides = [side.join(F.broadcast(parents), F.substring("prefix", 1, depth - 1) == F.col("parent"), "left_semi") for side in sides]
        both = sides[0].join(sides[1], "prefix", "full").where(~F.col("a").eqNullSafe(F.col("b")))
        parents = both.select(F.col("prefix").alias("parent"))
    return parents.withColumnRenamed("parent", "prefix")


def rows_within(seal: Seal, prefixes: Sequence[str]) -> DataFrame:
    """A sealed table's rows in some of the longest prefixes: other buckets are not read."""
    buckets = sorted({p[:BUCKET_DIGITS] for p in prefixes})
    wanted = seal.rows.where(F.col(BUCKET).isin(buckets)) if buckets else seal.rows.where("false")
    return wanted.where(F.substring(DIGEST, 1, DEPTH).isin(list(prefixes))) if len(prefixes) <= 1000 else wanted


def difference(left: Seal, right: Seal, key: str) -> DataFrame:
    """(key, change): rows added, removed or changed from left to right; key is unique in each table."""
    prefixes = [r.prefix for r in differing_prefixes(left, right).collect()]  # 65,536 at most
    old, new = (rows_within(s, prefixes).select(F.col(key), DIGEST) for s in (left, right))
    both = old.withColumnRenamed(DIGEST, "_old").join(new.withColumnRenamed(DIGEST, "_new"), key, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")
