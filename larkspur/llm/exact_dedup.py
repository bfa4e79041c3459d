"""Exact deduplication with static binary-fuse filters.

Digests (SHA-256 of the text with A-Z lower-cased) arrive in batches. Every batch is first grouped by
itself (partial aggregation: one row per digest, however large the group). Each digest is then screened
by the static 3-wise binary-fuse filters of all earlier snapshots: a negative is certainly new; only
positives join the snapshot's exact digest buckets. Digests that no snapshot has become the next
immutable snapshot, sharded by digest hash with one filter per shard; the number of shards follows the
snapshot's size, so a filter never outgrows KEYS keys. At the end the texts of all documents in groups
of two or more are compared byte for byte with their group's representative; texts that share a digest
but not the bytes (never seen, but possible) are grouped again by the text itself.

A digest with more than one in HOT of all rows is joined by broadcast (there are fewer than HOT of those),
the others by shuffle, so no task gets a large group of copies; the representative of a large group is
copied to as many keys as the group has thousands.

Defined cases: a null text counts as empty, and empty texts are equal to each other; texts of any length are
hashed and compared whole; a null doc_id ranks below all others; of rows that repeat the largest doc_id of
their group with equal texts one stays (the first as read), the others are copies like any; an empty table
gives an empty result; doc_id must be a number or cast to long (text ids stop the job); extra columns, whatever their
names, don't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fresh, sent

#: Digests per filter shard, at most on average: about 75 kB a filter and 2 MB of pandas rows a task group.
KEYS = 50_000
#: Digests with more than one in HOT of all rows are joined by broadcast; copies that one key of a representative serves.
HOT, COPIES = 1000, 1000
_FIRST = -(2**63)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (murmur style) of keys + seed."""
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, seg: int, count: int) -> np.ndarray:
    """The three slots of each hash: one in each of three neighbouring segments of `seg` (a power of two)."""
    top = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    first = top.astype(np.int64) * seg
    mask = np.uint64(seg - 1)
    return np.stack([first + (h & mask).astype(np.int64), first + seg + ((h >> np.uint64(18)) & mask).astype(np.int64),
        first + 2 * seg + ((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & mask).astype(np.int64)])


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segment count, fingerprints) of distinct uint64 keys. Peeling runs in
    rounds over whole arrays; a seed whose graph doesn't peel is replaced by the next."""
    n = len(keys)
    seg = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    for seed in range(1, 400):
        count = max(1, int(np.ceil(n * factor / seg)) - 2)
        size = (count + 2) * seg
        h = _mix(keys, seed * 0x9E3779B9)
        slots = _slots(h, seg, count)
        deg = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left = [], n
        ready = np.flatnonzero(deg == 1)
        while len(ready):
            key = owner[ready]
            key, at = np.unique(key, return_index=True)
            rounds.append((key, ready[at]))
            left -= len(key)
            touched = slots[:, key].ravel()
            np.subtract.at(deg, touched, 1)
            np.bitwise_xor.at(owner, touched, np.tile(key, 3))
            touched = np.unique(touched)
            ready = touched[deg[touched] == 1]
        if left == 0:
            table, marks = np.zeros(size, np.uint8), _print(h)
            for key, slot in reversed(rounds):
                table[slot] = 0
                table[slot] = marks[key] ^ np.bitwise_xor.reduce(table[slots[:, key]], axis=0)
            return seed, seg, count, table.tobytes()
        factor *= 1.02
    raise ValueError("no seed peels: are the keys distinct?")


def probe_fuse(keys: np.ndarray, seed: int, seg: int, count: int, table: bytes) -> np.ndarray:
    """True where a key may be in the filter; never False for a key that is."""
    h = _mix(keys, int(seed) * 0x9E3779B9)
    got = np.frombuffer(table, np.uint8)[_slots(h, int(seg), int(count))]
    return np.bitwise_xor.reduce(got, axis=0) == _print(h)


def _norm(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _key(doc_id: str) -> Column:
    """The doc_id as a key that is never null."""
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_FIRST))


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (SHA-256, hex, of the normalised text) and row (a number) of every row."""
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.sha2(_norm(text), 256).alias("digest"), F.monotonically_increasing_id().alias("row"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    key = F.xxhash64("digest")
    return groups.withColumn("key", key).withColumn("shard", F.pmod(F.shiftrightunsigned(key, 17), F.lit(shards)).cast("int"))


def build_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """One static filter per shard of an immutable snapshot of distinct digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, seg, count, table = build_fuse(np.unique(pdf["key"].to_numpy(np.int64)).view(np.uint64))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [seed], "seg": [seg], "count": [count], "table": [table]})

    return _sharded(snapshot.select("digest"), shards).select("shard", "key").groupBy("shard").applyInPandas(build, "shard int, seed long, seg long, count long, table binary")


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """incoming (distinct digests: digest, n, max_id, keep_row) with maybe: whether the filter of its shard passes it."""

    def probe(pdf: pd.DataFrame, flt: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy(np.int64).view(np.uint64)
        maybe = probe_fuse(keys, *flt.iloc[0][["seed", "seg", "count", "table"]]) if len(flt) else np.zeros(len(keys), bool)
        return pdf[["digest", "n", "max_id", "keep_row"]].assign(maybe=maybe)

    left = _sharded(incoming, shards).groupBy("shard")
    return left.cogroup(filters.groupBy("shard")).applyInPandas(probe, "digest string, n long, max_id long, keep_row long, maybe boolean")


def _top(doc_id: str, row: str) -> Column:
    """The row that stays: of the largest doc_id the first row."""
    return F.max(F.struct(F.col(doc_id).cast("long").alias("id"), (-F.col(row)).alias("neg")))


def _grouped(rows: DataFrame) -> DataFrame:
    g = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), _top("doc_id", "row").alias("top"))
    return g.select("digest", "n", F.col("top.id").alias("max_id"), (-F.col("top.neg")).alias("keep_row"))


def group_batches(dig: DataFrame, cuts: list[int]) -> DataFrame:
    """Totals per digest (digest, n, max_id, keep_row) of digests that arrive in batches, cut at the given doc_ids."""
    bounds = [None, *cuts, None]
    snapshots: list[tuple[DataFrame, DataFrame, int]] = []
    hits: list[DataFrame] = []

    def within(lo: int | None, hi: int | None) -> Column:
        low = F.lit(True) if lo is None else F.col("doc_id") > lo
        return low if hi is None else low & (F.col("doc_id") <= hi) | (F.col("doc_id").isNull() if lo is None else F.lit(False))

    insides = [within(lo, hi) for lo, hi in zip(bounds, bounds[1:])]
    # a filter's shard meets as many incoming digests as the largest batch has for it, so that sets the shards too
    largest = max(dig.agg(*(F.count_if(i) for i in insides)).first())
    for inside, hi in zip(insides, bounds[1:]):
        new = cut(_grouped(dig.where(inside)), "dedup-batch")
        size = new.count()
        for snap, filters, shards in snapshots:
            screened = cut(screen(new, filters, shards), "dedup-screened")
            maybe = screened.where("maybe").select("digest", "n", "max_id", "keep_row")
            found = cut(maybe.join(snap.select("digest"), "digest", "left_semi"), "dedup-hits")
            hits.append(found)
            false_alarms = maybe.join(found.select("digest"), "digest", "left_anti")
            new = screened.where("NOT maybe").select("digest", "n", "max_id", "keep_row").unionByName(false_alarms)
        if snapshots:
            new = cut(new, "dedup-snapshot")
        shards = max(1, -(-max(size, largest) // KEYS))
        if hi is not None and size:
            snapshots.append((new, cut(build_filters(new, shards), "dedup-filters"), shards))
        else:
            snapshots.append((new, None, 0)) if size else None
    if not snapshots:
        return _grouped(dig)
    entries = snapshots[0][0]
    for snap, _, _ in snapshots[1:]:
        entries = entries.unionByName(snap)
    if not hits:
        return entries
    more = hits[0]
    for h in hits[1:]:
        more = more.unionByName(h)
    more = more.groupBy("digest").agg(F.sum("n").alias("m"), _top("max_id", "keep_row").alias("other"))
    joined = entries.join(more, "digest", "left")
    top = F.greatest(F.struct(F.col("max_id").alias("id"), (-F.col("keep_row")).alias("neg")), "other")
    joined = joined.select("digest", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), top.alias("top"))
    return joined.select("digest", "n", F.col("top.id").alias("max_id"), (-F.col("top.neg")).alias("keep_row"))


def attach(dig: DataFrame, many: DataFrame, hot: int = HOT) -> DataFrame:
    """dig with n, max_id and keep_row of its group; many: the groups of two or more."""
    least = dig.count() / hot
    cols = ["n", "max_id", "keep_row"]
    large = many.where(F.col("n") > least).select("digest", F.struct(*cols).alias("large"))
    small = many.where(F.col("n") <= least).select("digest", F.struct(*cols).alias("small"))
    rows = dig.join(F.broadcast(large), "digest", "left")  # fewer than `hot` rows
    found = rows.where("large IS NOT NULL").select("doc_id", "digest", "row", "large.*")
    others = rows.where("large IS NULL").drop("large").join(small, "digest", "left").select("doc_id", "digest", "row", "small.*")
    return found.unionByName(others)


def verify(df: DataFrame, members: DataFrame, doc_id: str, text: str) -> DataFrame:
    """members: key (of the doc_id), digest, n, is_rep of documents in groups of two or more. The key, digest and
    text of those whose bytes differ from the representative's."""
    keys = sent(members.select("key").distinct(), members.count())
    texts = df.select(_key(doc_id).alias("key"), _norm(text).alias("norm"))
    # the other texts go before anything is hashed
    texts = texts.join(keys, "key", "left_semi").withColumn("digest", F.sha2("norm", 256))
    texts = cut(texts.join(members.select("key", "digest", "n").distinct(), ["key", "digest"]), "dedup-texts")
    parts = F.ceil(F.col("n") / COPIES).cast("int")
    reps = texts.join(members.where("is_rep").select("key", "digest").distinct(), ["key", "digest"], "left_semi")
    reps = reps.groupBy("digest").agg(F.max("norm").alias("rep"), F.max("n").alias("n"))
    reps = reps.select("digest", "rep", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    texts = texts.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
    return texts.join(cut(reps, "dedup-representatives"), ["digest", "part"]).where("norm != rep").select("key", "digest", "norm")


def deduplicate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """Per row of df: doc_id, keep_id (the largest doc_id of its group), group_size, kept, text_sha256."""
    dig = cut(digests(df, doc_id, text), "dedup-digests")
    lo, hi = dig.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [] if lo is None or batches < 2 else sorted(set(int(x) for x in dig.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]))
    groups = cut(group_batches(dig, [c for c in cuts if c < hi] if cuts else []), "dedup-groups")
    rows = cut(attach(dig, groups.where("n > 1")).withColumn("key", _key("doc_id")), "dedup-rows")
    members = rows.where("n > 1").select("key", "digest", "n", (F.col("row") == F.col("keep_row")).alias("is_rep"))
    odd = cut(verify(df, members, doc_id, text), "dedup-odd")
    size = F.coalesce("n", F.lit(1).cast("long"))
    alone = F.col("n").isNull()
    if odd.isEmpty():
        keep, kept = F.when(alone, F.col("doc_id")).otherwise(F.col("max_id")), alone | (F.col("row") == F.col("keep_row"))
        return rows.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))
    null_id = lambda c: F.when(c != _FIRST, c)
    split = odd.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("odd_n"), F.max("key").alias("odd_key"))
    tagged = odd.join(split, ["digest", "norm"]).select("key", "digest", "odd_n", "odd_key").distinct()
    less = split.groupBy("digest").agg(F.sum("odd_n").alias("less"))
    rows = rows.join(tagged, ["key", "digest"], "left").join(less, "digest", "left")
    first = F.when(F.col("odd_key").isNotNull(), F.row_number().over(Window.partitionBy("digest", "key").orderBy("row")))
    keep = F.when(F.col("odd_key").isNotNull(), null_id(F.col("odd_key"))).when(alone, F.col("doc_id")).otherwise(F.col("max_id"))
    size = F.coalesce(F.col("odd_n"), F.col("n") - F.coalesce("less", F.lit(0)), F.lit(1))
    kept = F.when(F.col("odd_key").isNotNull(), (F.col("key") == F.col("odd_key")) & (first == 1)).otherwise(alone | (F.col("row") == F.col("keep_row")))
    return rows.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of equal texts: the one with the largest doc_id (of rows that repeat it, any)."""
    gone, sha = fresh(df, "lost_id"), fresh(df, "lost_sha")
    found = cut(deduplicate(df, doc_id, text).where("NOT kept"), "dedup-lost")
    lost = found.select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(sha))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(gone)) & (F.sha2(_norm(text), 256) == F.col(sha))
    again = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(gone), F.col("text_sha256").alias(sha)).distinct()
    # with few enough lost rows the texts stay where they are
    left = df.join(sent(lost, lost.count()), same, "left_anti")
    if again.isEmpty():
        return left
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    one = df.join(again, same, "left_semi").groupBy(_key(doc_id).alias("lost_key"), F.sha2(_norm(text), 256).alias("lost_sha")).agg(F.any_value(row).alias("lost_row"))
    return left.unionByName(one.select("lost_row.*"))
