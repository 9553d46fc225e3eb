"""Exact quantiles of many columns and groups by distributed selection.

No buffer holds a group's values. A first pass counts values by a fixed monotone scale, about a thousand steps for each
doubling, and keeps the least and the greatest value of a step. The step that holds a wanted rank is known from
cumulative counts; if all its values are equal the quantile is found. Otherwise the rows of such steps only are
counted again in STEPS equal parts of their range, until the ranges hold one value each. Counting combines in map
tasks, so a group of most rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Steps of the first scale for each doubling of 1 + |value|.
FINE = 1024
#: Parts of a range in later passes.
STEPS = 4096
_INFINITE = 1 << 40


def _scale(v: Column) -> Column:
    """A monotone scale over all doubles; infinities and then NaN at the ends."""
    step = F.signum(v) * F.floor(FINE * F.log2(1 + F.abs(v)))
    ends = F.when(F.isnan(v), 2 * _INFINITE).when(v == float("inf"), _INFINITE).when(v == float("-inf"), -_INFINITE)
    return ends.otherwise(step).cast("long")


def _part(v: Column, low: Column, high: Column) -> Column:
    """The part of the range from low to high (finite, apart) that v falls in."""
    return F.floor((v / 2 - low / 2) / (high / 2 - low / 2) * STEPS).cast("long")


def _cells(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    values = F.array(*[F.col(c).cast("double") + 0.0 for c in columns])
    return df.select(*by, F.posexplode(values).alias("_c", "_v")).where("_v is not null")


def _held(cells: DataFrame, keys: Sequence[str], step: Column) -> DataFrame:
    """Counts, least and greatest value by key and step."""
    return cells.groupBy(*keys, step.alias("_step")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))


def _equal(keys: Sequence[str]) -> Column:
    """Whether keys are equal to those of a renamed side, nulls among them."""
    test = F.lit(True)
    for k in keys:
        test &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return test


def _choose(steps: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """wanted (keys, _rank, _below) with the range that holds each rank and the rows below it.

    A key's steps are as many as its values at most, and a few thousand as a rule.
    """
    order = Window.partitionBy(*keys).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    inside = (F.col("_rank") >= F.col("_below") + F.col("_before")) & (F.col("_rank") < F.col("_below") + F.col("_before") + F.col("_n"))
    found = wanted.join(steps, _equal(keys) & inside)
    return found.select(*[k for k in wanted.columns if k not in ("_below", "_low", "_high")], (F.col("_below") + F.col("_before")).alias("_below"), "_low", "_high")


#: Whether a range holds one value; NaN equals NaN here.
_FOUND = "_low = _high"


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Mapping[str, float], by: Sequence[str] = (), held: bool = False) -> DataFrame:
    """By group: <column>_<name> for each column and share, linear between neighbours.

    Nulls are left out, NaN is greater than all; a column without values in a group is null there, and a group without
    any value has no row. held says that df is a written table, which passes may read again.
    """
    if not all(0 <= p <= 1 for p in shares.values()):
        raise ValueError("shares must be between 0 and 1")
    base = df.select(*by, *columns) if held else stored(df.select(*by, *columns), "values")
    cells, key = _cells(base, columns, by), [*by, "_c"]
    first = stored(_held(cells, key, _scale(F.col("_v"))), "steps")
    totals = first.groupBy(*key).agg(F.sum("_n").alias("_total"))
    places = F.array(*[F.lit(float(p)) * (F.col("_total") - 1) for p in shares.values()])
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(F.floor(x), F.ceil(x)))))
    wanted = totals.select(*key, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_below"))
    picks = stored(_choose(first, wanted, key), "ranks")
    done = picks.where(_FOUND)
    rest = picks.where(f"not {_FOUND}")
    while not rest.isEmpty():
        ranges = rest.select(*key, "_low", "_high").distinct().withColumnsRenamed({k: f"_of_{k}" for k in key} | {"_low": "_from", "_high": "_to"})
        inside = (F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to"))
        inner = cells.join(ranges, _equal(key) & inside).select(*key, "_v", "_from", "_to")
        finer = _held(inner, [*key, "_from", "_to"], _part(F.col("_v"), F.col("_from"), F.col("_to")))
        open_ = rest.withColumnsRenamed({"_low": "_from", "_high": "_to"})
        picks = stored(_choose(finer, open_, [*key, "_from", "_to"]).drop("_from", "_to"), "ranks")
        done = done.unionByName(picks.where(_FOUND))
        rest = picks.where(f"not {_FOUND}")
    at = done.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_low"))).alias("_at"))
    whole = at.join(totals.withColumnsRenamed({k: f"_of_{k}" for k in key}), _equal(key))

    def value(p: float) -> Column:
        place = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = (F.try_element_at("_at", f(place)) for f in (F.floor, F.ceil))
        share = place - F.floor(place)
        return F.when(low == high, low).otherwise(low * (1 - share) + high * share)

    out = [F.max(F.when(F.col("_c") == i, value(p))).alias(f"{c}_{name}") for i, c in enumerate(columns) for name, p in shares.items()]
    return whole.groupBy(*by).agg(*out)


def beside(df: DataFrame, quantiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """df (one row a group) with the groups' quantiles; without groups both are one row at most."""
    if not by:
        return df.join(F.broadcast(quantiles), F.lit(True), "left")
    renamed = quantiles.withColumnsRenamed({k: f"_of_{k}" for k in by})
    return df.join(renamed, _equal(by), "left").drop(*[f"_of_{k}" for k in by])
