"""Algebra on run-length masks: runs (keys, start, end), the end exclusive, along any order of places. No table of voxels is made; all work is linear in the runs but for their sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.functions.arrays import running_sum


def of_counts(encoded: DataFrame, keys: list[str], counts: str = "counts") -> DataFrame:
    """The foreground runs of run lengths that begin with the background; empty runs are left out."""
    ends = running_sum(F.transform(counts, lambda n: n.cast("long")))
    run = F.transform(F.arrays_zip(F.col(counts).alias("n"), ends.alias("end")), lambda r, i: F.struct((r["end"] - r["n"]).alias("start"), r["end"].alias("end"), (i % 2).alias("odd")))
    x = encoded.select(*keys, F.explode(F.filter(run, lambda r: (r["odd"] == 1) & (r["end"] > r["start"]))).alias("r"))
    return x.select(*keys, "r.start", "r.end")


def to_counts(runs: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Run lengths over `size` places, background first, of disjoint runs."""
    lists = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x"))
    ends = lambda i: F.when(i > 0, F.get("x", i - 1)["end"]).otherwise(F.lit(0).cast("long"))
    flat = F.flatten(F.transform("x", lambda e, i: F.array(e["start"].cast("long") - ends(i), (e["end"] - e["start"]).cast("long"))))
    last = F.get("x", F.size("x") - 1)["end"]
    return lists.select(*keys, F.when(last < size, F.concat(flat, F.array(F.lit(size).cast("long") - last))).otherwise(flat).alias("counts"))


def combined(a: DataFrame, b: DataFrame, keys: list[str], inside: Callable[[Column, Column], Column]) -> DataFrame:
    """Runs of the places for which `inside` holds of (in a, in b); it has to be false where a place is in neither.

    Starts and ends of both are steps up and down; between two steps the running sums say whether a place is in either. Runs of one mask may overlap."""
    steps = [m.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("up")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("up")))).alias("s")).select(*keys, "s.at", *[(F.col("s.up") if i == own else F.lit(0)).alias(f"u{i}") for i in (0, 1)]) for own, m in enumerate((a, b))]
    at = steps[0].unionByName(steps[1]).groupBy(*keys, "at").agg(F.sum("u0").alias("u0"), F.sum("u1").alias("u1"))
    order = Window.partitionBy(*keys).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    here = at.withColumns({"ina": F.sum("u0").over(so_far) > 0, "inb": F.sum("u1").over(so_far) > 0})
    here = here.select(*keys, "at", inside(F.col("ina"), F.col("inb")).alias("in_"))
    turn = here.withColumn("was", F.coalesce(F.lag("in_").over(order), F.lit(False))).where("in_ <> was")
    return turn.withColumn("end", F.lead("at").over(order)).where("in_").select(*keys, F.col("at").alias("start"), "end")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return combined(a, b, keys, lambda x, y: x & ~y)


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return combined(a, b, keys, lambda x, y: x | y)


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return combined(a, b, keys, lambda x, y: x & y)


def area(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("area"))


def box(runs: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Half-open box of runs along lines of `length` places (place = line * length + offset): line0, line1, offset0, offset1. A run over a line's end has the whole line."""
    first, last = F.floor(F.col("start") / length), F.floor((F.col("end") - 1) / length)
    over = last > first
    low, high = F.when(over, 0).otherwise(F.col("start") % length), F.when(over, length).otherwise((F.col("end") - 1) % length + 1)
    return runs.groupBy(*keys).agg(F.min(first).alias("line0"), (F.max(last) + 1).alias("line1"), F.min(low).alias("offset0"), F.max(high).alias("offset1"))


def places(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.select(*keys, F.explode(F.sequence("start", F.col("end") - 1)).alias("p"))
