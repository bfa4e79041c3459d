"""Bootstrap resamples with exactly as many draws as a group has rows, whatever its size.

A group's rows are numbered in the md5 order of their key. Draw number `slot` of resample `rep` takes the row at
floor(u * rows), with u a 32-bit hash of (group, rep, slot): slot_sql() says the same in SQL. No resample is ever empty,
and none is lost.

Groups of up to LEAF rows are one task's numpy arrays. Larger ones are numbered range by range, their values packed in
slabs of up to SLAB values, and their resamples dealt out in blocks: each slab and block is one task, which makes all slots
of its resamples and adds up what falls into its slab. What leaves a task are the sums of the drawn values, one row a
resample, which are added up over the slabs. The work is draws x slabs: groups over SLAB values cost their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.scores import hash_int, order_key
from larkspur.sources.scratch import cut, sent

from .screen import prefix_sums

LEAF = 4096
#: Resamples of a leaf that are drawn at once.
BLOCK = 256
#: Values of a large group that a task holds.
SLAB = 1 << 22
#: Draws of a task on a large group, and how many it makes at once.
WORK, STEP = 1 << 25, 1 << 15
_ALL = 0xFFFFFFFF


def mix32(h: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser (xor-shifts and two odd factors) on unsigned 64-bit arrays."""
    h = h ^ (h >> np.uint64(16))
    h = (h * np.uint64(0x85EBCA6B)) & np.uint64(_ALL)
    h = h ^ (h >> np.uint64(13))
    h = (h * np.uint64(0xC2B2AE35)) & np.uint64(_ALL)
    return h ^ (h >> np.uint64(16))


def slot_rows(base: int, reps: np.ndarray, slots: int, size: int) -> np.ndarray:
    """reps x slots: the row (0 .. size - 1) that each draw takes."""
    step = np.uint64(0x9E3779B1)
    row = mix32((np.uint64(base) + reps.astype(np.uint64) * step) & np.uint64(_ALL))
    u = mix32((row[:, None] + np.arange(1, slots + 1, dtype=np.uint64) * step) & np.uint64(_ALL))
    return ((u * np.uint64(size)) >> np.uint64(32)).astype(np.int64)


def slot_sql(rows: str, keys: list[str], values: dict[str, str], n: int, seed: int, order: str) -> str:
    """The same in SQL for groups of at most LEAF rows: keys, rep, _n and the sums of `values` (name -> expression) of
    each resample, as a list of common table expressions that ends in `drawn`."""
    by = ", ".join(keys)
    of = f"PARTITION BY {by}" if keys else ""
    text = ", ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    digits = f"list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', substr(md5(concat_ws('|', {text})), i, 1)) - 1), lambda a, b: 16 * a + b)"
    own = ", ".join(f"{e} AS {v}" for v, e in values.items())
    mixed = lambda src: (
        f"SELECT * REPLACE (xor(h, h >> 16) AS h) FROM (SELECT * REPLACE ((h * 3266489909) & {_ALL} AS h) FROM (SELECT * REPLACE (xor(h, h >> 13) AS h) "
        f"FROM (SELECT * REPLACE ((h * 2246822507) & {_ALL} AS h) FROM (SELECT * REPLACE (xor(h, h >> 16) AS h) FROM ({src})))))"
    )
    head = f"{by}, " if keys else ""
    same = " AND ".join([*(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys), "a.j = b.i"])
    start = mixed(f"SELECT *, (CAST(base AS UBIGINT) + CAST(rep AS UBIGINT) * 2654435761) & {_ALL} AS h FROM sized, (SELECT unnest(range(0, {n})) AS rep)")
    slots = mixed(f"SELECT * REPLACE ((h + CAST(slot AS UBIGINT) * 2654435761) & {_ALL} AS h) FROM (SELECT *, unnest(range(1, size + 1)) AS slot FROM ({start}))")
    return f"""placed AS MATERIALIZED (SELECT {head}{own}, row_number() OVER ({of} ORDER BY md5(concat_ws('|', '{seed}', CAST({order} AS VARCHAR)))) - 1 AS i, count(*) OVER ({of}) AS size FROM {rows}),
sized AS (SELECT DISTINCT {head}size, {digits} AS base FROM placed),
slots AS (SELECT {head}rep, CAST((h * CAST(size AS UBIGINT)) >> 32 AS BIGINT) AS j FROM ({slots})),
drawn AS (SELECT {', '.join(f'a.{k}' for k in keys)}{', ' if keys else ''}rep, count(*) AS _n, {', '.join(f'sum({v}) AS {v}' for v in values)} FROM slots a JOIN placed b ON {same} GROUP BY ALL)"""


def _drawn(x: np.ndarray, base: int, size: int, low: int, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(draws of each resample that fall on rows low .. low + len(x) - 1 of a group of `size`, sums of their values)."""
    odd, whole = np.uint32(0x9E3779B1), len(x) == size
    counts, sums = np.zeros(len(reps), np.int64), np.zeros((len(reps), x.shape[1]))
    for i, rep in enumerate(reps):
        row = mix32(np.array([(base + int(rep) * 0x9E3779B1) & _ALL], np.uint64)).astype(np.uint32)
        for at in range(0, size, STEP):
            # the arithmetic of slot_rows(), which wraps at 32 bits by itself
            h = row + np.arange(at + 1, min(size, at + STEP) + 1, dtype=np.uint32) * odd
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
            took = ((h.astype(np.uint64) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
            if not whole:
                took = took[(took >= low) & (took < low + len(x))] - low
            counts[i] += len(took)
            sums[i] += x[took].sum(axis=0)
    return counts, sums


def _large(rows: DataFrame, keys: list[str], names: list[str], n: int, seed: int, sizes: DataFrame, slab: int) -> DataFrame:
    """resampled_sums() of the groups in `sizes` (_name, keys, _size)."""
    slab = max(1, slab // len(names))
    blocks = F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(F.col("_size") * n / WORK))).cast("int")
    sizes = sent(sizes.withColumns({"_root": hash_int(seed, *keys), "_blocks": blocks}))
    tasks = sizes.agg(F.sum(F.col("_blocks") * F.ceil(F.col("_size") / slab))).first()[0]
    mine = rows.select(_name(keys), "_h", *names).join(sizes.select("_name", "_root", "_size", "_blocks"), "_name").withColumn("_one", F.lit(1))
    placed = prefix_sums(mine, ["_h", *names], "_one", F.substring("_h", 1, 3), "_place", ["_name"]).drop("_one", "_h")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_place")[names].to_numpy("<f8")
        return pdf[["_name", "_slab", "_root", "_size", "_blocks"]].iloc[:1].assign(_x=[x.tobytes()])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                x = np.frombuffer(r["_x"], "<f8").reshape(-1, len(names))
                reps = np.arange(r["_block"] * n // r["_blocks"], (r["_block"] + 1) * n // r["_blocks"])
                counts, sums = _drawn(x, r["_root"], r["_size"], r["_slab"] * slab, reps)
                yield pd.DataFrame({"_name": r["_name"], "rep": reps.astype(np.int32), "_n": counts} | {c: sums[:, i] for i, c in enumerate(names)})

    slabs = placed.withColumn("_slab", F.floor(F.col("_place") / slab)).groupBy("_name", "_slab").applyInPandas(pack, "_name string, _slab long, _root long, _size long, _blocks int, _x binary")
    each = cut(slabs, "resample-slabs").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    # a task for each slab and block, dealt by turns: a slab's values are up to 32 MB, so that a task shall not hold many
    sums = each.repartition(min(tasks, 20_000)).mapInPandas(draw, "_name string, rep int, _n long, " + ", ".join(f"`{c}` double" for c in names))
    return sums.groupBy("_name", "rep").agg(F.sum("_n").alias("_n"), *(F.sum(c).alias(c) for c in names)).join(sizes.select("_name", *keys), "_name").select(*keys, "rep", "_n", *names)


def _name(keys: list[str]) -> Column:
    """One column for a group, null keys and all."""
    return (F.to_json(F.struct(*keys)) if keys else F.lit("")).alias("_name")


def resampled_sums(df: DataFrame, keys: list[str], values: dict[str, Column], n: int, seed: int, order: list[str], leaf: int = LEAF, slab: int = SLAB) -> DataFrame:
    """keys, rep (0 .. n - 1), _n and the sum of each value over the rows that a resample draws: n resamples of every group
    with a complete row, each of as many draws as the group has such rows. `order` is the rows' key. Null keys are groups."""
    rows = df.select(*keys, order_key(seed, *order).alias("_h"), *(v.cast("double").alias(c) for c, v in values.items())).na.drop(subset=list(values))
    rows = cut(rows, "resample-rows")
    names = list(values)
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    schema = f"{kinds}_base long, rep int, _n long, " + ", ".join(f"`{c}` double" for c in names)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(["_h", *names], kind="stable")[names].to_numpy(float)
        size = len(x)
        sums = np.empty((n, len(names)))
        for at in range(0, n, BLOCK):
            reps = np.arange(at, min(n, at + BLOCK))
            took = slot_rows(int(pdf["_base"].iloc[0]), reps, size, size)
            for c in range(len(names)):
                sums[reps, c] = x[took, c].sum(axis=1)
        out = pd.DataFrame({k: pdf[k].iloc[[0] * n].to_numpy() for k in keys} | {"_base": pdf["_base"].iloc[0], "rep": np.arange(n, dtype=np.int32), "_n": size})
        for c, name in enumerate(names):
            out[name] = sums[:, c]
        return out

    small = lambda of: of.withColumn("_base", hash_int(seed, *keys)).groupBy(*(keys or ["_base"])).applyInPandas(draw, schema).drop("_base")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > leaf).withColumn("_name", _name(keys))
    sizes = sent(sizes)
    if sizes.isEmpty():
        return small(rows)
    rest = rows.withColumn("_name", _name(keys)).join(sizes.select("_name"), "_name", "left_anti").drop("_name")
    return small(rest).unionByName(_large(rows, keys, names, n, seed, sizes, slab))
