"""Vector compression by product codes, with the nearest codebook entry found by equal-average search.

A vector's components become integers, floor(4096 x), and are cut into 8 equal consecutive parts. Each part position
has a codebook of 16 entries, which starts as that part of the vectors with the smallest ids and is moved by rounds of
assigning every part to its nearest entry and replacing each entry by its parts' floored mean.

Equal-average search: the squared distance of a part to an entry is at least the squared difference of their
component sums over the number of components. The entries are sorted by their sum; from the place of the part's
own sum the search goes outward, to whichever side's next entry is closer in sum, and ends as soon as that entry's
bound strictly exceeds the best distance, so that ties are still seen and go to the lower index. All parts of a batch
take their steps together, in numpy arrays that keep those whose search goes on.

A round is one pass over the table: each task adds up its parts by entry, and what moves are at most 128 rows a task.
The codebooks (parts x entries x components, whatever the number of vectors) are all that the driver holds.

Defined cases: a row is dropped if its vector is null, or holds null or non-finite components, or isn't as long as
the vector of the smallest id (by vec_id, then by the vector; null ids last), or is empty. Where the length is no multiple
of the number of parts, the last part ends in zeros. Integers beyond the largest whose errors surely fit into a
long stop there (2**27 for 33 to 64 components). With fewer vectors than entries the codebooks are as short as that.
Rows that repeat a vec_id stay apart, each with its own code; a table without a kept row gives an empty result;
extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL, cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that are searched at once.
CHUNK = 4096
#: A label with at least this share of all rows is hot: its sum is broadcast.
HOT = 1_000


def _bound(width: int) -> int:
    """The largest integer of a component, such that a vector's error stays below 2**63."""
    return 2 ** ((62 - max(0, (width - 1).bit_length())) // 2 - 1)


def integers(vectors: pa.Array, width: int, parts: int = PARTS, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(places of the kept vectors, their integers as vectors x parts x components)."""
    size = -(-width // parts)
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    fits = vectors.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == width)
    keep = np.flatnonzero(fits)
    at = offsets[:-1][keep, None] + np.arange(width)
    flat = vectors.values.cast(pa.float64())
    whole = flat.is_valid().to_numpy(zero_copy_only=False)
    x, whole = flat.fill_null(0.0).to_numpy(zero_copy_only=False)[at], whole[at].all(axis=1)
    good = whole & np.isfinite(x).all(axis=1)
    limit = float(_bound(width))
    with np.errstate(over="ignore"):
        z = np.clip(np.floor(x[good] * scale), -limit, limit).astype(np.int64)
    out = np.zeros((len(z), parts * size), np.int64)
    out[:, :width] = z
    return keep[good], out.reshape(len(z), parts, size)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest row of book, squared distance) for each row of x, the lower index of equal ones."""
    n, size = x.shape
    entries = len(book)
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, place = sums[order], x.sum(axis=1)
    best, which = np.full(n, np.iinfo(np.int64).max), np.full(n, entries, np.int64)
    live = np.arange(n)
    high = np.searchsorted(sums, place)
    low = high - 1
    far = np.float64(np.inf)
    edges = np.r_[sums, 0].astype(np.float64)
    while len(live):
        mine = place[live]
        down = np.where(low >= 0, mine - edges[low], far)
        up = np.where(high < entries, edges[np.minimum(high, entries)] - mine, far)
        gap = np.minimum(down, up)
        going = np.isfinite(gap)
        # gap**2 / size, rounded up, in integers that fit: gap = q size + r
        q, r = np.divmod(np.where(going, gap, 0).astype(np.int64), size)
        going &= q * q * size + 2 * q * r - -(r * r) // size <= best[live]
        live, low, high, down, up = live[going], low[going], high[going], down[going], up[going]
        if not len(live):
            break
        left = down <= up
        entry = order[np.where(left, low, np.minimum(high, entries - 1))]
        low, high = low - left, high + ~left
        step = x[live] - book[entry]
        d = np.einsum("ij,ij->i", step, step)
        better = (d < best[live]) | ((d == best[live]) & (entry < which[live]))
        best[live[better]], which[live[better]] = d[better], entry[better]
    return which, best


def _batches(rows: Iterator[pa.RecordBatch], width: int, parts: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Kept rows and their integers, CHUNK rows at a time."""
    for batch in rows:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            keep, x = integers(part.column("v"), width, parts, scale)
            if len(keep):
                yield part.take(pa.array(keep)), x


def _whole(vector: Column) -> Column:
    """Whether a vector can be kept, but for its length."""
    finite = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def _floats(df: DataFrame, vector: str) -> Column:
    plain = df.schema[vector].dataType.simpleString() in ("array<float>", "array<double>")
    return F.col(f"`{vector}`") if plain else F.col(f"`{vector}`").cast("array<double>")


def fit(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[np.ndarray, int] | None:
    """(codebooks as parts x entries x components, the vectors' length), or None where no row is kept."""
    rows = df.select(F.col(f"`{vec_id}`").alias("id"), _floats(df, vector).alias("v"))
    sure = rows.where(_whole(F.col("v")))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = sure.orderBy(*order).select(F.size("v").alias("n")).first()
    if first is None:
        return None
    width = first["n"]
    seeds = [list(r["v"]) for r in sure.where(F.size("v") == width).orderBy(*order).limit(entries).collect()]  # `entries` vectors
    kind = pa.list_(pa.float32() if df.schema[vector].dataType.simpleString() == "array<float>" else pa.float64())
    books = integers(pa.array(seeds, kind), width, parts, scale)[1].transpose(1, 0, 2).copy()
    size, every = books.shape[2], books.shape[1]

    for _ in range(rounds):

        def partial(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for _, x in _batches(batches, width, parts, scale):
                for p in range(parts):
                    near, _ = nearest(x[:, p], books[p])
                    np.add.at(sums[p], near, x[:, p])
                    counts[p] += np.bincount(near, minlength=every)
            p, e = np.nonzero(counts)
            yield pa.record_batch({"part": pa.array(p.astype(np.int32)), "entry": pa.array(e.astype(np.int32)), "n": pa.array(counts[p, e]), "sums": pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))})

        sums = rows.select("v").mapInArrow(partial, "part int, entry int, n long, sums array<long>")
        wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
        books = books.copy()
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():  # one row an entry
            books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(size)]
    return books, width


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def assign(df: DataFrame, books: np.ndarray, width: int, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """Per kept row: vec_id, label, code (two hex digits a part) and error (squared distances summed over the parts)."""
    kinds = [df.schema[c].dataType.simpleString() for c in (vec_id, label)]
    parts = len(books)
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, x in _batches(batches, width, parts, scale):
            found = [nearest(x[:, p], books[p]) for p in range(parts)]
            code = np.stack([i for i, _ in found], axis=1)
            text = digits[np.stack([code >> 4, code & 15], axis=2).reshape(len(code), 2 * parts)]
            code = pa.array([t.decode() for t in np.ascontiguousarray(text).view(f"S{2 * parts}").ravel().tolist()], pa.string())
            error = pa.array(np.sum([d for _, d in found], axis=0))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), code, error], ["vec_id", "label", "code", "error"])

    source = df.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("label"), _floats(df, vector).alias("v"))
    return source.mapInArrow(rows, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels (nulls together; null beyond a long). The sums of hot
    labels are broadcast, fewer than HOT of them, and so are all if they are few; the others meet by shuffle."""
    sums = cut(coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "codes-labels")
    total = sums.agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("rows")).first()
    if total["labels"] <= SMALL:
        hot, cold = sums, None
    else:
        is_hot = F.col("n") * HOT > total["rows"]
        hot, cold = sums.where(is_hot), sums.where(~is_hot)
    same = F.col("label").eqNullSafe(F.col("of"))
    out = coded.join(F.broadcast(hot), same).drop("of", "n")
    if cold is not None:
        rest = coded.join(F.broadcast(hot), same, "left_anti").join(cold, same).drop("of", "n")
        out = out.unionByName(rest)
    return out


def compress(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", **options: int) -> DataFrame:
    """Per kept row: vec_id, code, error, label_error and codebooks_sha256."""
    kind = df.schema[vec_id].dataType.simpleString()
    fitted = fit(df, vec_id, vector, **options)
    if fitted is None:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    books, width = fitted
    coded = cut(assign(df, books, width, vec_id, vector, label, options.get("scale", SCALE)), "codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
