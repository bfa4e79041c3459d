"""SimHash near-duplicates through vantage-point trees.

A fingerprint has 64 bits; two link at RADIUS (3) or fewer differing bits. Of its two 32-bit halves one
then differs in at most one bit, so each half has a vantage-point tree of its own with search radius 1.
A node of a tree has a vantage point and a radius: halves within the radius of the point go to the inner
branch, others to the outer one. The upper nodes are fitted on a sample of at most SAMPLE fingerprints (the
first in hash order): the point is the sampled half that spreads the others most, the radius their median
distance. Nodes that fewer than FITTED sampled halves reach have a point drawn from their number and the
median radius of random halves. Leaves are the shards.

A fingerprint is stored in its own leaf, and goes down both trees as a query: by the triangle inequality a
half at distance 1 from another has a distance to any vantage point that differs by at most 1, so a branch
is pruned unless the radius lies within 1 of the query's own distance. What is left of the search ball (the
query's 32 one-bit neighbours, kept as a mask) is parted at each such boundary, so a query reaches only the
leaves that its ball really overlaps, 32 at most besides its own, at any depth. It is sent to those numbered
above its own, so two leaves meet once. The trees' depth follows the number of distinct fingerprints, so
leaves stay small at any size, and every candidate pair is checked exactly. A leaf with more than CROWD rows
(a dense group of near fingerprints) is parted into blocks, and its pairs of blocks are dealt out over the
cluster: every pair is still compared, in many tasks.

Equal fingerprints are merged by partial aggregation before anything else. A leaf emits a spanning
forest of its links, not all pairs. Links become classes by alternating large-star and small-star
steps, each written to the shared folder.

Defined cases: a null or empty text has no words and fingerprint zero, linked like any other; fewer
words than the shingle's width make one shingle; very long texts are hashed whole, in pieces; a null doc_id
takes part but can't be the class id unless the class has no other (then null); repeated rows each get their
row; an empty table gives an empty result; extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, fresh, modest_batches, sent

RADIUS = 3
HALF = 32
SEED = 42
#: Fingerprints an ordinary leaf should hold; sets the depth of the trees.
LEAF = 16
#: Fingerprints that the upper nodes are fitted on at most, and how many of them a node needs for that.
SAMPLE, FITTED = 4096, 64
#: Rows of a leaf, or of a block of a larger one, that one task compares at once.
CROWD = 2048


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """Bit b is set if it is set in over half the XXH64 hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(b" ".join(words), seed)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    total, n = np.zeros(64, np.int64), 0
    while len(part := np.array([digest(s, seed) for s in islice(shingles, 65536)], dtype="<u8")):
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, width) for t in pdf["t"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps})

    modest_batches(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInPandas(rows, f"doc_id {kind}, fp long")


class Tree:
    """A vantage-point tree over 32-bit halves. Nodes are numbered from the root, 1, down: node i has the inner
    branch 2i and the outer branch 2i + 1."""

    def __init__(self, halves: np.ndarray, depth: int):
        """halves: a sample. Its nodes are fitted top-down as long as they have enough of it."""
        self.depth = depth
        fitted: dict[int, tuple[int, int]] = {}
        todo = [(1, halves.astype(np.uint32))] if len(halves) >= FITTED and depth else []
        while todo:
            node, mine = todo.pop()
            at = np.bitwise_count(mine[:16, None] ^ mine[None, :]).astype(np.int64)  # 16 candidate points
            best = int(at.var(axis=1).argmax())
            radius = int(np.median(at[best]))
            inner = at[best] <= radius
            fitted[node] = int(mine[best]), radius
            if node < 1 << (depth - 1):
                todo += [(2 * node + side, part) for side, part in ((0, mine[inner]), (1, mine[~inner])) if len(part) >= FITTED]
        size = 2 * max(fitted, default=0) + 2
        self.point, self.radius = self._drawn(np.arange(size, dtype=np.int64))
        for node, (point, radius) in fitted.items():
            self.point[node], self.radius[node] = point, radius

    @staticmethod
    def _drawn(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Point and radius of nodes that aren't fitted."""
        h = node.astype(np.uint64)
        with np.errstate(over="ignore"):
            for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53), (32, 0x9E3779B97F4A7C15)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return (h >> np.uint64(32)).astype(np.uint32), (HALF // 2 - (h & np.uint64(1)).astype(np.int64))

    def nodes(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = node < len(self.point)
        if top.all():
            return self.point[node], self.radius[node]
        point, radius = self._drawn(node)
        point[top], radius[top] = self.point[node[top]], self.radius[node[top]]
        return point, radius

    def search(self, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the half, leaf, own): each half's own leaf, and the others that hold a part of its ball."""
        who, node = np.arange(len(half)), np.ones(len(half), np.int64)
        ball, own = np.full(len(half), 0xFFFFFFFF, np.uint32), np.ones(len(half), bool)
        for _ in range(self.depth):
            point, radius = self.nodes(node)
            apart = half[who] ^ point
            d = np.bitwise_count(apart).astype(np.int64)
            # flipping a bit that differs brings a half nearer by one, any other bit takes it away by one
            near, far = ball & apart, ball & ~apart
            inner = np.where(d - 1 <= radius, near, np.uint32(0)) | np.where(d + 1 <= radius, far, np.uint32(0))
            outer = ball & ~inner
            stays = d <= radius
            i, o = np.flatnonzero((inner != 0) | (own & stays)), np.flatnonzero((outer != 0) | (own & ~stays))
            who = np.concatenate([who[i], who[o]])
            node = np.concatenate([2 * node[i], 2 * node[o] + 1])
            ball = np.concatenate([inner[i], outer[o]])
            own = np.concatenate([(own & stays)[i], (own & ~stays)[o]])
        return who, node, own


def _halves(fp: np.ndarray, tree: int) -> np.ndarray:
    return ((fp.view(np.uint64) >> np.uint64(HALF * tree)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def grow(fps: DataFrame, n: int) -> list[Tree]:
    """The trees of the low and of the high halves, as deep as n distinct fingerprints need."""
    depth = int(np.clip(np.ceil(np.log2(max(n, 1) / LEAF)), 0, 40))
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE).collect()], np.int64)
    return [Tree(_halves(sample, t), depth) for t in (0, 1)]


def route(fps: DataFrame, trees: list[Tree]) -> DataFrame:
    """fp -> (tree, leaf, home, fp): the fingerprint's own leaf in either tree (home) and, as a query, the
    leaves with higher numbers that its ball of radius 1 overlaps."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), 4096):
                fp = whole["fp"].to_numpy(np.int64)[start : start + 4096]
                for t, tree in enumerate(trees):
                    who, leaf, own = tree.search(_halves(fp, t))
                    mine = np.zeros(len(fp), np.int64)
                    mine[who[own]] = leaf[own]
                    go = own | (leaf > mine[who])
                    yield pd.DataFrame({"tree": np.int32(t), "leaf": leaf[go], "home": own[go], "fp": fp[who[go]]})

    return fps.select("fp").mapInPandas(rows, "tree int, leaf long, home boolean, fp long")


def part_crowds(routed: DataFrame, crowd: int = CROWD) -> DataFrame:
    """routed with `pair`, the number of the block pair that a row goes to. A leaf of up to `crowd` rows is one
    block; the rows of a larger one are dealt to blocks by hash, and a row is copied to each pair of its block."""
    sizes = routed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("rows"))
    large = sizes.where(F.col("rows") > crowd).select("tree", "leaf", F.ceil(F.col("rows") / crowd).cast("int").alias("blocks"))
    rows = routed.join(large, ["tree", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # home block h meets the home blocks from h on, and every query block: pair (h, other block)
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_home = F.transform(other, lambda j: F.least(block, j) * F.col("blocks") + F.greatest(block, j))
    as_query = F.transform(other, lambda j: -1 - (j * F.col("blocks") + block))
    homes_for_queries = F.transform(other, lambda j: -1 - (block * F.col("blocks") + j))
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(F.col("home"), F.concat(as_home, homes_for_queries)).otherwise(as_query)
    return rows.select("tree", "leaf", "home", "fp", F.explode(pairs).alias("pair"))


def _forest(a: np.ndarray, b: np.ndarray, ids: dict[int, int]) -> list[bool]:
    """Which of the links (a, b) join two parts that earlier ones left apart."""
    parent = ids

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        out.append(x != y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return out


def cell_links(home: np.ndarray, query: np.ndarray, among: bool = True, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among home (if asked for) and between query and home, block by block. For
    the home rows, those already joined to a block's first members stay in: every pair is compared."""
    parent: dict[int, int] = {}
    keep_a, keep_b = [], []
    for left, right in ((home, home), (query, home))[not among :]:
        for i in range(0, len(left), block):
            for j in range(i if left is right else 0, len(right), block):
                x, y = left[i : i + block], right[j : j + block]
                a, b = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= RADIUS)
                if left is right and i == j:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    got = np.array(_forest(x[a], y[b], parent), bool)
                    keep_a.append(x[a][got])
                    keep_b.append(y[b][got])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(keep_a), np.concatenate(keep_b)) if keep_a else (none, none)


def links(fps: DataFrame, n: int, crowd: int = CROWD) -> DataFrame:
    """Links a < b between distinct fingerprints that make all classes of the link graph connected."""
    routed = part_crowds(cut(route(fps, grow(fps, n)), "simhash-routed"), crowd)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        keys = ["tree", "leaf", "pair"]

        def flush(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            tree, leaf, pair, home, fp = (pdf[c].to_numpy() for c in (*keys, "home", "fp"))
            fp = fp.view(np.uint64)
            edge = np.flatnonzero((tree[1:] != tree[:-1]) | (leaf[1:] != leaf[:-1]) | (pair[1:] != pair[:-1])) + 1
            starts, ends = np.r_[0, edge], np.r_[edge, len(fp)]
            homes = np.add.reduceat(home.astype(np.int64), starts)
            for s, e, h in zip(starts, ends, homes):
                if h and e - s > 1:
                    # rows come sorted with home rows last; in a pair for queries the homes have met elsewhere
                    a, b = cell_links(fp[e - h : e], fp[s : e - h], pair[s] >= 0)
                    if len(a):
                        yield pd.DataFrame({"a": np.minimum(a.view(np.int64), b.view(np.int64)), "b": np.maximum(a.view(np.int64), b.view(np.int64))})

        for pdf in batches:
            if not len(pdf):
                continue
            tail = np.logical_and.reduce([(pdf[c] == pdf[c].iloc[-1]).to_numpy() for c in keys])
            cutoff = len(pdf) - int(tail.sum())
            if cutoff:
                yield from flush(pd.concat([*held, pdf.iloc[:cutoff]], ignore_index=True))
                held = []
            held.append(pdf.iloc[cutoff:])
        if held:
            yield from flush(pd.concat(held, ignore_index=True))

    by_leaf = routed.repartition("tree", "leaf", "pair").sortWithinPartitions("tree", "leaf", "pair", "home")
    return by_leaf.mapInPandas(match, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node of each node's connected part, by large-star and small-star steps."""
    edges = cut(edges, "simhash-edges")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a != b").distinct()
        # small star: each node's smaller neighbours and itself go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.col("low"), F.explode(F.array("a", "b")).alias("b")).select(F.col("low").alias("a"), "b").where("a != b").distinct()
        nxt = cut(small, "simhash-edges")
        same = nxt.count() == edges.count() and nxt.exceptAll(edges).isEmpty()
        drop(edges)
        edges = nxt
        if same:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Per row of df: doc_id, fp (signed long) and component_id, the smallest doc_id of its class."""
    fps = cut(fingerprints(df, doc_id, text, width), "simhash-fps")
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(links(distinct, distinct.count()))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    placed = cut(placed, "simhash-roots")
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(placed.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """df with one document of each class: the one with the smallest doc_id (rows without a doc_id stay)."""
    name = fresh(df, "gone_id")
    gone = near_duplicates(df, doc_id, text, width).where("doc_id != component_id").select(F.col("doc_id").alias(name)).distinct()
    gone = sent(cut(gone, "simhash-gone"))
    return df.join(gone, F.col(f"`{doc_id}`") == F.col(name), "left_anti")
