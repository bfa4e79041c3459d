"""Target-distribution importance resampling: documents are drawn by how much likelier their hashed word features are
in a target corpus than in the whole.

Array-scored weights: texts stay bytes in flat numpy arrays. Word borders come from a table over bytes, the CRC-32 of
all words (and of longer runs, from the state of the run that is one word shorter) advances one byte at a time for
all of them together, and a document's weight is a segmented sum over the array of bucket gains. Counting and
scoring are one pass each; what moves between them is one array of bucket counts a task, and what the driver
holds is that array, whatever the input.

Cutoff: a quantile sketch of the scores gives a bracket around the wanted number of highest scores. Exact counts
above and inside the bracket check it, and it is widened until it holds the cutoff. Only the bracket's rows are
sorted, range by range, to find the row at which the draw ends. The drawn rows alone are range-sorted for their ranks:
each range's number of rows gives the ranks ahead of it, and each is numbered on its own.

Defined cases: null and empty texts have no features, weight 0, and count as documents without words; texts of any
length are read whole, in one array up to CHUNK bytes and one document otherwise; a null doc_id draws its noise as an
empty string and comes last of equal scores; rows that repeat a doc_id are documents of their own, and of such with
equal scores those with more features come first (rows equal in that too are interchangeable); with an empty
corpus nothing is drawn, and with an empty target every document is scored against the smoothed empty one;
extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, modest_batches

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Bytes of text in one array (or one document), and bytes up to which words advance together.
CHUNK, SHORT = 1 << 20, 64
#: Rows of the drawn set that one task ranks, on average.
GROUP = 1 << 18


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32, from its reversed polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_TABLE = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of words once A-Z are lower: digits, a-z, and all bytes of characters beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC states (not yet inverted at the end) after the bytes data[start : start + size] each."""
    state = state.copy()
    live = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
    for j in range(SHORT):
        if not len(live):
            break
        s = state[live]
        state[live] = _TABLE[(s ^ data[starts[live] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
        live = live[sizes[live] > j + 1]
    for i in np.flatnonzero(sizes > SHORT).tolist():
        word = data[starts[i] : starts[i] + sizes[i]].tobytes()
        state[i] = zlib.crc32(word, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def features(data: np.ndarray, offsets: np.ndarray, longest: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text, number of words per text) of texts that lie one after the other, each
    in data[offsets[i] : offsets[i + 1]]."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    # words of two texts that touch are two words
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    size = end - begin
    text = np.searchsorted(offsets, begin, side="right") - 1
    words = np.bincount(text, minlength=len(offsets) - 1)
    space, zero = np.array([32], np.uint8), np.zeros(len(begin), np.int64)
    state = _advance(np.full(len(begin), 0xFFFFFFFF, np.uint32), data, begin, size)
    found, texts = [(state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)], [text]
    for more in range(1, longest):
        n = max(0, len(begin) - more)
        state = _advance(state[:n], space, zero[:n], zero[:n] + 1)
        state = _advance(state, data, begin[more:], size[more:])
        same = text[:n] == text[more:]
        found.append((state[same] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        texts.append(text[:n][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(texts), words


def _chunks(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, their offsets), about CHUNK bytes at a time; null texts are empty."""
    for batch in batches:
        text = batch.column(name).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        blocks = (offsets[1:] - offsets[0]) // CHUNK
        stops = [*(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(text)]
        for i, j in zip([0, *stops], stops):
            if j > i:
                yield batch.slice(i, j - i), raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def bucket_counts(df: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features per bucket over all rows."""
    modest_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for _, data, offsets in _chunks(batches, "t"):
            sums += np.bincount(features(data, offsets, longest, buckets)[0], minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.record_batch({"bucket": pa.array(used), "n": pa.array(sums[used])})

    rows = df.select(F.col(f"`{text}`").alias("t")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.toLocalIterator():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed bucket shares)."""
    n = len(corpus)
    ratio = (target + 1.0) * (float(corpus.sum()) + n) / ((corpus + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, by the hash of a row's id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def scored(df: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = 1, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight and score."""
    modest_batches(df.sparkSession)
    buckets = len(gain)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _chunks(batches, "t"):
            bucket, of, words = features(data, offsets, longest, buckets)
            n = np.bincount(of, minlength=len(words))
            if longest > 1:
                order = np.argsort(of, kind="stable")
                bucket = bucket[order]
            total = np.r_[0, np.cumsum(gain[bucket])]
            stop = np.cumsum(n)
            weight = total[stop] - total[stop - n]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = df.schema[doc_id].dataType.simpleString()
    out = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInArrow(rows, f"doc_id {kind}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def bracket(rows: DataFrame, score: str, k: int, n: int, accuracy: int = 1000) -> tuple[int, int, int]:
    """(low, high, number of rows above high): low <= score <= high holds the k-th highest of the n scores, by a
    quantile sketch whose bracket exact counts check and, if need be, widen."""
    share, slack = 1 - k / n, 1 / accuracy
    while True:
        marks = [max(0.0, share - 2 * slack), min(1.0, share + 2 * slack)]
        low, high = rows.agg(F.percentile_approx(score, marks, accuracy)).first()[0]
        whole = marks == [0.0, 1.0]
        if whole:
            low, high = rows.agg(F.min(score), F.max(score)).first()
        above, reach = rows.agg(F.count_if(F.col(score) > high), F.count_if(F.col(score) >= low)).first()
        if above < k <= reach or whole:
            return low, high, above
        slack *= 4


def numbered(df: DataFrame, order: list[Column], parts: int, name: str) -> DataFrame:
    """df with the place of each row (1, 2, 3 ...) in that order: rows are range-sorted and written, the ranges' numbers
    of rows are added up, and each range is numbered on its own."""
    parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged, "resample-ranges")  # from here on a row's range is fixed
    sizes = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}  # one row a range
    ahead, starts = 0, []
    for i in range(max(sizes, default=-1) + 1):
        starts.append(ahead)
        ahead += sizes.get(i, 0)
    before = F.element_at(F.lit(np.array(starts or [0], np.int64)), F.col("_range") + 1)
    return ranged.withColumn(name, before + F.row_number().over(Window.partitionBy("_range").orderBy(*order))).drop("_range")


def resample(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS,
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of df: doc_id, n_features, weight, score and rank, the place among the drawn rows (null: not drawn)."""
    gain = gains(bucket_counts(df, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    rows = cut(scored(df, gain, doc_id, text, longest, seed), "resample-scores")
    able = rows.where(F.col("n_words") >= least_words)
    cols = ["doc_id", "n_features", "weight", "score"]
    n = able.count()
    k = percent * n // 100
    none = F.lit(None).cast("long").alias("rank")
    if k == 0:
        return rows.select(*cols, none)
    low, high, above = bracket(able, "score", k, n)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features")]
    inside = able.where(F.col("score").between(low, high))
    held = inside.count()
    # the bracket's rows in order; the draw ends at its (k - above)-th
    last = numbered(inside.select("score", "doc_id", "n_features"), order, max(1, -(-held // GROUP)), "place").where(F.col("place") == k - above).first()
    later = F.col("doc_id").isNull() if last["doc_id"] is not None else F.lit(False)
    same_id = F.col("doc_id").isNull() if last["doc_id"] is None else F.col("doc_id") == F.lit(last["doc_id"])
    earlier = F.col("doc_id").isNotNull() if last["doc_id"] is None else F.col("doc_id") < F.lit(last["doc_id"])
    at = F.col("score") == last["score"]
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > last["score"]) | (at & ~later & (earlier | (same_id & (F.col("n_features") >= last["n_features"])))))
    drawn = F.coalesce(drawn, F.lit(False))
    ranked = numbered(rows.where(drawn).select(*cols), order, max(1, -(-k // GROUP)), "rank")
    # rows equal in all of the order may stand on both sides of the end
    rank = F.when(F.col("rank") <= k, F.col("rank")).cast("long").alias("rank")
    return ranked.select(*cols, rank).unionByName(rows.where(~drawn).select(*cols, none))


def drawn_documents(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """df's rows that are drawn; rows that repeat a doc_id are drawn if one of them is, rows without one never."""
    name = fresh(df, "drawn_id")
    ids = resample(df, target, doc_id, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias(name)).distinct()
    return df.join(ids, F.col(f"`{doc_id}`") == F.col(name), "left_semi")
