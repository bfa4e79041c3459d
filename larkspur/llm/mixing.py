"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]: w_s(t) = target_s * (1 + slope_s * (2t - 1)),
whose integral over the run is the source's target. Its cumulative demand
D_s(t) = target_s * ((1 - slope_s) * t + slope_s * t^2) is inverted in closed form to give every taken
piece of every document its training position, and the output is range-sorted by position.

Inside a source, documents run in the order of md5(doc_id). A source whose target is r times its size
is passed through floor(r) times, then its first documents once more; of the document at the end of
that pass only as many leading words are taken as the target needs.

The running sums are two-level: sums per (source, md5 prefix), their prefix sums over the small table,
then a window inside each (source, prefix). The prefix is as long as keeps GROUP rows in a group on average,
so a source that holds a third of all rows is spread over many groups at any size.

The range sort needs no sampling pass: all schedules together hand out between half and one and a half times
the mean number of words at any time, so equal stretches of training time are even partitions.

Defined cases: a null or empty text has size 0 and is never taken; a text of any length is counted whole; a
null source is a source of its own, last in order; a null doc_id is ordered by an empty key; rows that repeat
a doc_id are separate documents, tied ones in arbitrary but equal-valued order; an empty table gives an empty
result; extra columns, whatever their names, pass through mix() and don't matter elsewhere.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, word_count

#: Rows of a source that one window task adds up, on average, and words of a partition of the sorted mix.
GROUP, WORDS = 1 << 16, 1 << 22
CAP = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """sizes: source, source_size. Adds place (1-based order), weight and target.

    The targets are the fixed point of sharing the total by weight, stopping at cap * size and sharing
    the excess again. With sources sorted by cap * size / weight, the capped ones are a prefix: the
    level is (total - capped sum) / (weight of the rest) at the first source that isn't capped. One row
    per source goes through these windows, never one per document.
    """
    one = F.lit(1)
    w = F.array(*map(F.lit, weights))
    order = Window.partitionBy(one).orderBy(F.col("source").isNull(), "source")
    placed = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", F.element_at(w, (F.col("place") - 1) % len(weights) + 1))
    by_ratio = Window.partitionBy(one).orderBy(F.col("source_size") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(one)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(before),
        F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = placed.withColumn("level", level)
    # the first source, in ratio order, whose cap is not below its level sets the level for the rest
    free = F.col("level") * F.col("weight") <= F.col("source_size") * cap
    ranked = ranked.withColumn("level", F.min_by(F.when(free, F.col("level")), F.when(free, F.struct(F.col("source_size") / F.col("weight"), F.col("place")))).over(everything))
    return ranked.withColumn("target", F.coalesce(F.least(F.col("level") * F.col("weight"), (F.col("source_size") * cap).cast("double")), F.lit(0.0))).drop("level")


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, source and size. With carry, df's own row comes along as the struct `row`, so no extra column's
    name can clash."""
    row = [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if carry else []
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), *row)


def allot(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> tuple[DataFrame, int]:
    """docs: doc_id, source, size, perhaps row. (docs with source_size, target, taken, passes (whole passes), rest
    (words of the last, partial pass), before (words of its source ahead of it), place and nth (apart for rows of
    one doc_id and source), number of words of the mix)."""
    digits = max(2, ceil(log(max(docs.count(), 1) / GROUP, 16)))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    docs = docs.withColumn("md5", key).withColumn("bucket", F.substring("md5", 1, digits))
    cells = cut(docs.groupBy("source", "bucket").agg(F.sum("size").alias("cell_size")), "mix-cells")
    total = cells.agg(F.sum("cell_size")).first()[0] or 0
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, cap)
    sums = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_before", F.coalesce(F.sum("cell_size").over(sums), F.lit(0))).alias("a")
    cells = cells.join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "a.bucket", "a.cell_before", "b.source_size", "b.target", "b.place")
    # one key that is never null, so that the join's partitions serve the window and rows move once
    cell = F.concat("bucket", F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))).alias("cell")
    joined = docs.select("*", cell).join(cells.select(cell, "cell_before", "source_size", "target", "place"), "cell")
    along = Window.partitionBy("cell").orderBy("md5", "doc_id", "size")
    inside = along.rowsBetween(Window.unboundedPreceding, -1)
    goal = F.floor(F.col("target") + 0.5)
    out = (
        joined.withColumn("before", F.col("cell_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("nth", F.row_number().over(along))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("CAST(floor(target + 0.5) AS BIGINT) DIV source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("passes") * F.col("source_size") - F.col("before"))).cast("long"))
        .withColumn("taken", F.col("passes") * F.col("size") + F.col("rest"))
    )
    row = ["row"] if "row" in docs.columns else []
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "rest", "before", "place", "nth", *row), total


def plan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """allot() of df's documents."""
    return allot(sized(df, doc_id, text, source), weights, cap)[0]


def slope(place: Column) -> Column:
    """The schedule's slope by the source's place: -0.5, 0, 0.5, repeating (early, steady, late sources)."""
    return (F.pmod(place - 1, F.lit(3)) - 1) / 2.0


def position(words_before: Column, target: Column, place: Column) -> Column:
    """Invert D(t) / target = (1 - a) t + a t^2 at the share of demand that is met before this piece."""
    q, a = F.least(F.lit(1.0), words_before / target), slope(place)
    return F.when(a == 0, q).otherwise((a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * q)) / (2 * a))


def leading_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.array_join(F.slice(words, 1, n.cast("int")), " ")


def pieces(planned: DataFrame, words: int) -> DataFrame:
    """allot()'s rows, one per taken piece, with copy (the pass that takes it), `words` (its words) and `at` (its
    training position), range-sorted by it; a document of which nothing is taken isn't there."""
    every = F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1))
    copies = planned.where("taken > 0").select("*", F.explode(every).alias("copy"))
    ahead = F.col("copy") * F.col("source_size") + F.col("before")
    copies = copies.withColumn("at", position(ahead.cast("double"), F.col("target"), F.col("place")))
    copies = copies.withColumn("words", F.when(F.col("copy") == F.col("passes"), F.col("rest")).otherwise(F.col("size")))
    parts = max(1, -(-words // WORDS))
    stretch = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(F.col("at") * parts))).cast("int")
    return copies.repartitionById(parts, stretch).sortWithinPartitions("at", "doc_id")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """The mixed corpus: df's columns, one row per taken piece (a document taken twice is there twice; a
    partial take has its leading words, joined by one space), range-sorted by the last column, the
    training position (`position`, with leading underscores if df has that name)."""
    copies = pieces(*allot(sized(df, doc_id, text, source, carry=True), weights, cap))
    whole = F.col(f"row.`{text}`")
    piece = F.when(F.col("words") < F.col("size"), leading_words(whole, F.col("words"))).otherwise(whole)
    cols = [(piece if c == text else F.col(f"row.`{c}`")).alias(c) for c in df.columns]
    return copies.select(*cols, F.col("at").alias(fresh(df, "position")))


def placed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words of its pieces), position and
    last_position (of its first and last piece; null if nothing is taken). Texts are counted once and left
    behind; the pieces are laid out in training order as in mix() and added up from there."""
    docs = cut(sized(df, doc_id, text, source), "mix-sizes")
    planned, words = allot(docs, weights, cap)
    key = ["doc_id", "source", "nth", "size", "source_size", "target"]
    planned = cut(planned, "mix-plan")
    laid = cut(pieces(planned, words).select(*key, "at", "words"), "mix-pieces")
    none = planned.where("taken = 0").select(*key, F.lit(None).cast("double").alias("at"), F.lit(0).cast("long").alias("words"))
    out = laid.unionByName(none).groupBy(*key).agg(F.sum("words").alias("taken"), F.min("at").alias("position"), F.max("at").alias("last_position"))
    return out.drop("nth")
