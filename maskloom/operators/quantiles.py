"""Exact order statistics and percentiles of groups of any size, from counted bands of values.

No group is sorted or held in a buffer, and no table of all rows is written. Values are first counted by band of magnitude, which is an aggregate with
partial sums: however many rows or equal values a group has, at most some thousand bands of it are shuffled. Running counts over
the bands tell in which one a wanted place lies; only the values of those bands are counted again, in narrower bands, and singly once
they are few. Each turn is one pass over the rows with a join to a table of a few rows for each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.sources.folders import written

#: Bands that a range of values is cut into in each further turn, and the rows in a band from which on its values are counted singly.
BANDS, FEW = 1024, 50_000


def _magnitude(v: Column) -> Column:
    """A band that never falls as the value grows: about three hundredths of the value wide, finer than a millionth around 0."""
    size = F.abs(v)
    return F.signum(v) * F.when(size == float("inf"), 1e9).when(size > 1e300, 5e8).otherwise(F.floor(32 * F.log1p(size * 1e6)).cast("double"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls among them; the right side's are named `__k0`, `__k1`, ..."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & left[f"`{k}`"].eqNullSafe(right[f"__k{i}"])
    return same


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, `__n` (values that are neither null nor NaN) and for each name a struct (value, before, equal) of the value at that place (from 0, a function of `__n`) in its group's
    order, with the rows before its first and the rows equal to it; null where there is no such place. One row per group of `df`."""
    v = F.nanvl(F.col(f"`{value}`").cast("double"), F.lit(None).cast("double"))
    rows = df.select(*[F.col(f"`{k}`") for k in keys], v.alias("__v"))
    bands = rows.groupBy(*keys, _magnitude(F.col("__v")).alias("__band")).agg(F.count("__v").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("__c").over(group.orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = bands.withColumns({"__before": before, "__n": F.sum("__c").over(group), "__first": F.row_number().over(group.orderBy("__band")) == 1})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("__n")).cast("long").alias("place")) for name, f in places.items()])
    here = F.filter(wanted, lambda t: (t["place"] >= F.col("__before")) & (t["place"] < F.col("__before") + F.col("__c")))
    # A row for each place in the band that has it; one without a name for each group.
    kept = F.when(F.col("__first"), F.array_append(here, F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("place")))).otherwise(here)
    state = written(bands.withColumn("__t", F.explode(kept)).select(*keys, "__n", "__t.name", "__t.place", "__before", "__c", "__lo", "__hi"), "order-statistics")
    parts = []
    while True:
        named = F.col("name").isNotNull() & (F.col("__lo") < F.col("__hi"))
        some = state.where(named).agg(F.count("*").alias("open"), F.max("__c").alias("most")).first()
        if not some["open"]:
            parts.append(state)
            break
        parts.append(state.where(~named))
        asked = state.where(named)
        ends = asked.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__lo").alias("__a"), F.col("__hi").alias("__b"), F.col("__before").alias("__base")).distinct()
        within = rows.join(ends if keys else F.broadcast(ends), _same(rows, ends, keys) & (rows["__v"] >= ends["__a"]) & (rows["__v"] <= ends["__b"]))
        # Differences of halves where that of the ends is beyond all numbers.
        apart = lambda x, y: F.when(F.col("__b") - F.col("__a") < float("inf"), x - y).otherwise(x / 2 - y / 2)
        share = apart(F.col("__v"), F.col("__a")) / apart(F.col("__b"), F.col("__a"))
        narrow = F.col("__v") if some["most"] <= FEW else F.least(F.lit(BANDS - 1), F.floor(share * BANDS)).cast("double")
        own = [f"__k{i}" for i in range(len(keys))]
        cut = within.groupBy(*own, "__a", "__b", "__base", narrow.alias("__band")).agg(F.count("*").alias("__count"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
        upto = F.sum("__count").over(Window.partitionBy(*own, "__a", "__b").orderBy("__band").rowsBetween(Window.unboundedPreceding, -1))
        cut = cut.withColumn("__start", F.col("__base") + F.coalesce(upto, F.lit(0)))
        hit = _same(asked, cut, keys) & (asked["__lo"] == cut["__a"]) & (asked["__hi"] == cut["__b"]) & (asked["place"] >= cut["__start"]) & (asked["place"] < cut["__start"] + cut["__count"])
        found = asked.join(cut, hit).select(*[asked[f"`{k}`"] for k in keys], "__n", "name", "place", F.col("__start").alias("__before"), F.col("__count").alias("__c"), F.col("__min").alias("__lo"), F.col("__max").alias("__hi"))
        if some["most"] <= FEW:  # single values: nothing is left open
            parts.append(found)
            break
        state = written(found, "order-statistics")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    found = F.struct(F.col("__lo").alias("value"), F.col("__before").alias("before"), F.col("__c").alias("equal"))
    return every.groupBy(*keys).agg(F.max("__n").alias("__n"), *[F.max(F.when(F.col("name") == name, found)).alias(name) for name in places])


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each share (0 to 1): the exact percentile, linear between the two values beside its place; null for a group without values.

    Nulls and NaN do not count. One row per group of `df`; without keys one for all (none where `df` is empty)."""
    place = lambda s, f: lambda n: F.when(n > 0, f((n - 1) * F.lit(float(s))))
    places = {f"__{end}_{name}": place(s, f) for name, s in shares.items() for end, f in (("a", F.floor), ("b", F.ceil))}
    found = order_statistics(df, keys, value, places)

    def between(name: str, s: float) -> Column:
        low, high, at = F.col(f"__a_{name}.value"), F.col(f"__b_{name}.value"), (F.col("__n") - 1) * F.lit(float(s))
        part = at - F.floor(at)
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(name)

    return found.select(*keys, *[between(name, s) for name, s in shares.items()])


def with_percentiles_of(told: DataFrame, df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """`told` (one row per group of `keys`) with the percentiles of the groups of `df`."""
    q = percentiles(df, keys, value, shares)
    q = q.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], *shares)
    return told.join(q, _same(told, q, keys)).drop(*[f"__k{i}" for i in range(len(keys))])


def with_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """`df` with its group's percentiles as columns; nulls in keys are a group."""
    return with_percentiles_of(df, df, keys, value, shares)
