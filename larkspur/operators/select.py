"""Seeded selection: quotas, round-robin, budgets, splits. Sampling order is md5(seed|key), so results don't
depend on partitioning; counts per stratum follow the stated rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scores import order_key
from larkspur.sources.scratch import cut

from .screen import places, prefix_sums

#: Rows of a group that one window numbers at most.
WINDOW = 500_000


def _largest(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def _in_hash_order(df: DataFrame, groups: dict[str, list[str]], seed: int, key: list[str]) -> DataFrame:
    """df, written, with _h, _one and a struct of each of the groups' columns, in which nulls are equal."""
    rows = df.withColumns({"_h": order_key(seed, *key), "_one": F.lit(1), **{n: F.struct(*(F.col(c) for c in cols)) for n, cols in groups.items()}})
    return cut(rows, "selection")


def waterfill(caps: DataFrame, quota: int | str, order: list[str], by: list[str] | None = None, cap: str = "cap") -> DataFrame:
    """caps with `take`: the quota (a number, or a column constant in the group) spread evenly under each
    row's cap; what is left over goes one by one to the largest remaining capacity, ties in `order`."""
    q, part = (F.lit(quota) if isinstance(quota, int) else F.col(quota)), by or [F.lit(1)]
    w = Window.partitionBy(*part)
    asc = w.orderBy(cap, *order)
    m = F.count(F.lit(1)).over(w)
    i = F.row_number().over(asc)
    before = F.coalesce(F.sum(cap).over(asc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = caps.withColumn("_left", m - i + 1).withColumn("_before", before).withColumn("_q", q.cast("long"))
    full = F.col("_before") + F.col("_left") * F.col(cap) > F.col("_q")
    level = F.min_by(F.when(full, F.floor((F.col("_q") - F.col("_before")) / F.col("_left"))), F.when(full, F.struct(F.col(cap), *order))).over(w)
    rows = rows.withColumn("_level", level).withColumn("_base", F.when(F.col("_level").isNull(), F.col(cap)).otherwise(F.least(F.col(cap), F.col("_level"))))
    rows = rows.withColumn("_rest", F.least(F.col("_q"), F.sum(cap).over(w)) - F.sum("_base").over(w))
    more = F.row_number().over(w.orderBy(F.desc(F.col(cap) - F.col("_base")), *order))
    rows = rows.withColumn("_more", more)
    take = F.col("_base") + F.when((F.col("_more") <= F.col("_rest")) & (F.col(cap) > F.col("_base")), 1).otherwise(0)
    return rows.withColumn("take", take.cast("long")).drop("_left", "_before", "_q", "_level", "_base", "_rest", "_more")


def round_robin(df: DataFrame, by: list[str], cell: list[str], n: int | Column, seed: int, key: list[str], reshuffle: bool = False, largest: int | None = None) -> DataFrame:
    """Up to n rows of each group, dealt in turn from its cells; with reshuffle the cells' order changes each round. Groups of
    up to WINDOW rows are numbered by windows; if there is a larger one (`largest`, counted here unless given), the rounds
    and turns are numbered range by range, and no task has a whole group."""
    turn = [order_key(seed, *cell, "_r")] if reshuffle else [F.col(c) for c in cell]
    if (_largest(df, by) if largest is None else largest) <= WINDOW:
        r = F.row_number().over(Window.partitionBy(*by, *cell).orderBy(order_key(seed, *key), *key))
        k = F.row_number().over(Window.partitionBy(*by).orderBy("_r", *turn, *key))
        return df.withColumn("_r", r).withColumn("_k", k).where(F.col("_k") <= n).drop("_r", "_k")
    most = F.lit(n) if isinstance(n, int) else n
    rows = prefix_sums(_in_hash_order(df, {"_g": by, "_c": [*by, *cell]}, seed, key), ["_h", *key], "_one", F.substring("_h", 1, 3), "_r", ["_c"])
    # a row of round r has r rows of its own cell before it, so later rounds than n are never reached
    rows = cut(rows.withColumn("_r", F.col("_r") + 1).where(F.col("_r") <= most), "selection")
    rows = prefix_sums(rows, ["_r", *turn, *key], "_one", F.floor((F.col("_r") - 1) * 512 / most), "_k", ["_g"])
    return rows.where(F.col("_k") < most).drop("_h", "_one", "_g", "_c", "_r", "_k")


def balanced_select(df: DataFrame, n: int, outer: str, inner: str, spread: list[str], seed: int, key: list[str], outer_order: list[str] | None = None) -> DataFrame:
    """Nested balance: quotas over outer, then over inner inside each outer, then round-robin over spread."""
    cells = cut(df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("cap")), "cells")
    largest = cells.agg(F.max("cap")).first()[0] or 0
    outers = waterfill(cells.groupBy(outer).agg(F.sum("cap").alias("cap")), n, outer_order or [outer]).select(outer, F.col("take").alias("_quota"))
    quotas = waterfill(cells.join(outers, outer), "_quota", [inner], by=[outer]).select(outer, inner, "take")
    return round_robin(df.join(quotas, [outer, inner]), [outer, inner], spread, F.col("take"), seed, key, reshuffle=True, largest=largest).drop("take")


def sample_per_group(df: DataFrame, by: list[str], n: int | Column, seed: int, key: list[str]) -> DataFrame:
    """The first n rows of each group in seeded order. A small number is cut off before the rows move (Spark's group limit);
    for a large one, or one that differs by group, groups of more than WINDOW rows are numbered range by range."""
    if isinstance(n, int) and n <= WINDOW or _largest(df, by) <= WINDOW:
        w = Window.partitionBy(*by).orderBy(order_key(seed, *key), *key)
        return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    rows = prefix_sums(_in_hash_order(df, {"_g": by}, seed, key), ["_h", *key], "_one", F.substring("_h", 1, 3), "_r", ["_g"])
    return rows.where(F.col("_r") < n).drop("_h", "_one", "_g", "_r")


def proportional_select(df: DataFrame, by: list[str], n: int, seed: int, key: list[str], rounding: str = "floor") -> DataFrame:
    """Of each group its share of n: cut to a whole number, at least 1 (floor), or half-even (rint)."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    share = n * F.col("_size") / F.col("_total")
    quota = F.greatest(F.lit(1), F.floor(share)) if rounding == "floor" else F.rint(share)
    quotas = sizes.join(F.broadcast(total)).select(*by, F.least(quota, F.col("_size")).cast("long").alias("_quota"))
    return sample_per_group(df.join(quotas, by), by, F.col("_quota"), seed, key).drop("_quota")


def take_budget(df: DataFrame, weight: str, target: float, seed: int, key: list[str], by: str | None = None, turn: Column | None = None) -> DataFrame:
    """Rows in seeded order while what was taken before is under the target; with by, in turn over its groups, which come
    in the order of `turn` (by default of their names)."""
    rows = df.withColumn("_h", order_key(seed, *key))
    if by is None:
        return prefix_sums(rows, ["_h", *key], weight, F.substring("_h", 1, 2)).where(F.col("before") < target).drop("_h", "before")
    rows = places(rows, [by], ["_h", *key], F.substring("_h", 1, 3)).withColumnRenamed("place", "_r").drop("group_rows")
    # turns come in as many buckets as a group has at most, each of about as many rows
    rows = rows.crossJoin(F.broadcast(rows.agg((F.max("_r") + 1).alias("_turns"))))
    bucket = F.floor(F.col("_r") * 512 / F.col("_turns"))
    rows = rows.withColumn("_turn", F.col(by) if turn is None else turn)
    return prefix_sums(rows, ["_r", "_turn", *key], weight, bucket).where(F.col("before") < target).drop("_h", "_r", "_turn", "_turns", "before")


def holdout_split(df: DataFrame, n: int, max_share: float, seed: int, key: list[str]) -> DataFrame:
    """df with `holdout`: the first min(n, floor(max_share * N)) rows in seeded order."""
    rows = prefix_sums(df.withColumn("_h", order_key(seed, *key)).withColumn("_one", F.lit(1)), ["_h", *key], "_one", F.substring("_h", 1, 2))
    size = df.agg(F.least(F.lit(n), F.floor(F.count(F.lit(1)) * max_share)).alias("_k"))
    return rows.join(F.broadcast(size)).withColumn("holdout", F.col("before") < F.col("_k")).drop("_h", "_one", "before", "_k")


#: The five bands of a ranked list, from share to share.
BANDS = [(0.0, 0.25), (0.25, 0.75), (0.75, 0.9), (0.9, 0.99), (0.99, 1.0)]


def quantile_bands(df: DataFrame, by: list[str], col: str, n: int, seed: int, key: list[str], bands: list[tuple[float, float]] = BANDS) -> DataFrame:
    """Up to n rows from each band of the rows ranked by a score. A band of N rows' shares a to b has the places from
    floor(a N) to before floor(b N), one at least, so bands of few rows may overlap."""
    rows, size = places(df, by, [col, *key]), F.col("group_rows")
    first = [F.floor(a * size) for a, _ in bands]
    last = [F.greatest(F.floor(b * size), f + 1) for (_, b), f in zip(bands, first)]
    mine = F.array_compact(F.array(*(F.when((F.col("place") >= f) & (F.col("place") < e), F.lit(i)) for i, (f, e) in enumerate(zip(first, last)))))
    rows = rows.withColumn("band", F.explode(mine)).drop("place", "group_rows")
    return sample_per_group(rows, [*by, "band"], n, seed, key)


def shuffled(df: DataFrame, seed: int, key: list[str]) -> DataFrame:
    return df.orderBy(order_key(seed, *key), *key)
