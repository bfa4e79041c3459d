"""Token-ID files: context-mixing range coding in independent, checksummed blocks.

A file is a Parquet file of blocks; a block is a self-contained byte string. Its ids are dealt to lanes
(contiguous stretches, one range coder each) that advance in step and share one adaptive model, so every
step is a handful of array operations over all lanes. The model starts afresh in each block:

- order 0: adaptive counts of all ids;
- order 1: per preceding id, the id it predicts and a confidence;
- order 2: per hashed pair of preceding ids, the same.

The three are mixed by weights that are learned per pair of confidences, apart for predictions that agree.
The coder's unit interval holds the order-2 prediction first (weight w2), then the order-1 prediction if
it is another id (w1), then every id's count share of what is left (w0); an id is coded in the first of
these that it has. The decoder repeats the model's steps exactly (integer arithmetic only).

Layout of a block, little-endian: magic "LKT2", u32 ids, u32 lanes, u32 vocabulary, u32 documents, u32
CRC-32 of the ids as u32; per document i64 doc_id, u8 null flag, i64 start (within its file), i64 ids in
the document, i64 offset of this block's part in the document, u32 ids of that part; per lane u32 words;
then the lanes' 32-bit words; last a CRC-32 of all bytes before it.

Ids are written in ascending doc_id order (null first), range-partitioned, one file of many blocks a
partition; the manifest (file number, first position, ids) has one row a file, its first positions come
from a two-level running sum.

Defined cases: null and empty texts have the end id only; a text of any length is split over blocks; rows
that repeat a doc_id are written one after the other, in any order of theirs; an empty table gives no
block; doc_id must be a number or cast to long (text ids stop the job); extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.sources.scratch import fresh_path

from .bpe import encode, vocab_size
from .common import cut, drop

MAGIC = b"LKT2"
#: Ids a block is closed at (a longer document is split over blocks), and ids a file has on average.
BLOCK, FILE = 1 << 21, 1 << 24
LANES = 1 << 14
#: Characters beyond which a document's parts are encoded apart: a part costs a shuffle.
LONG = 1 << 18
#: Bits of the coder's total, of the order-2 table, and steps between refreshes of counts and weights.
TOTAL, HASH_BITS, REFRESH = 28, 18, 16
#: Bits after the point in the scale from counts to the coder's units.
FINE = 32
LEVELS, STEP = 8, 8
LEAST = 1 << 23  # the least share of order 0; above the largest sum of its counts
#: A row group holds a block or two, so writing and reading a file needs little memory, however large it is.
_SMALL_GROUPS = {"parquet.block.size": 1 << 22, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: Files whose sizes one task adds up.
SUMMED = 4096
_REPLACE = 99
#: How a confidence moves at a miss and at a hit: a hit raises it; a miss halves it, or puts the new id in
#: place of a weak prediction or of none.
_MOVE = np.array([[_REPLACE if c == 0 or not h and c == 1 else int(c < 7) if h else (c >> 1) - c for c in range(8)] for h in (0, 1)], np.int32).ravel()
_HEAD, _DOC = struct.Struct("<4sIIIII"), struct.Struct("<qBqqqI")
_WORD, _TOTAL, _FINE = np.uint64(32), np.uint64(TOTAL), np.uint64(FINE)
_FULL = np.uint64(1 << 32)  # a range below this gives out a word


class _Model:
    """The shared adaptive model of a block's lanes. Both directions take the same steps on whole numbers,
    so they agree to the bit."""

    def __init__(self, vocab: int, lanes: int, decoder: bool = False):
        self.v, self.decoder = vocab, decoder
        self.count = np.ones(vocab, np.int64)
        # predictions as id * LEVELS + confidence; at first an id beyond the vocabulary, confidence 0
        self.t1 = np.full(vocab + 1, vocab * LEVELS, np.int32)
        self.t2 = np.full(1 << HASH_BITS, vocab * LEVELS, np.int32)
        self.seen = np.tile(np.array([1, 1, 6], np.int64), (2 * LEVELS * LEVELS, 1))
        self.prev = np.full(lanes, vocab, np.int32)
        self.slot = np.zeros(lanes, np.int32)
        self.late: list[np.ndarray] = []
        self.hits: list[np.ndarray] = []
        self._refresh()

    def _refresh(self) -> None:
        if self.late:
            self.count += 2 * np.bincount(np.concatenate(self.late), minlength=self.v)
            self.seen += np.bincount(np.concatenate(self.hits), minlength=self.seen.size).reshape(-1, 3)
            self.late, self.hits = [], []
        self.cum = np.r_[0, np.cumsum(self.count)].astype(np.uint64)
        total, state = int(self.cum[-1]), np.arange(len(self.seen))
        w = self.seen * ((1 << TOTAL) - LEAST) // self.seen.sum(axis=1, keepdims=True)
        w2 = np.where(state // LEVELS % LEVELS > 0, w[:, 0], 0)
        w1 = np.where((state % LEVELS > 0) & (state < LEVELS * LEVELS), w[:, 1], 0)
        rest = (1 << TOTAL) - w2 - w1
        self.w2, self.w21, self.scale = w2.astype(np.uint64), (w2 + w1).astype(np.uint64), ((rest << FINE) // total).astype(np.uint64)
        if self.decoder:
            self.per_unit = total / rest.astype(np.float64)
            # the id that holds each STEP-th count
            self.holder = np.repeat(np.arange(self.v, dtype=np.int32), np.diff(-(-self.cum.view(np.int64) // STEP)))

    def predict(self, n: int) -> None:
        """Set the predictions x2 and x1, and the weights and scale of their state, for the first n lanes."""
        self.v2, self.v1 = self.t2.take(self.slot[:n]), self.t1.take(self.prev[:n])
        self.x2, self.x1 = self.v2 >> 3, self.v1 >> 3
        self.c2, self.c1 = self.v2 & 7, self.v1 & 7
        state = self.c2 << 3
        state |= self.c1
        state += (self.x1 == self.x2).view(np.int8) << np.int8(6)
        self.state = state
        self.s2, self.s21, self.k = self.w2.take(state), self.w21.take(state), self.scale.take(state)

    def _end(self, y: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where the count share of each id begins, in the coder's units after the predictions."""
        at = self.cum.take(y)
        at *= k
        at >>= _FINE
        return at

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, size = self._end(x, self.k), self._end(x + 1, self.k)
        size -= low
        low += self.s21
        h1, h2 = np.flatnonzero(self.x1 == x), np.flatnonzero(self.x2 == x)
        low[h1] = s = self.s2[h1]
        size[h1] = self.s21[h1] - s
        low[h2], size[h2] = 0, self.s2[h2]
        return low, size

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id whose interval holds each value, and that interval."""
        in2 = at < self.s2
        x = np.where(in2, self.x2, self.x1)
        low, size = np.where(in2, np.uint64(0), self.s2), np.where(in2, self.s2, self.s21 - self.s2)
        rest = np.flatnonzero(at >= self.s21)
        before, k = self.s21[rest], self.k[rest]
        u = at[rest] - before
        y = self.holder.take((u * self.per_unit.take(self.state[rest]) / STEP).astype(np.int32), mode="clip")
        lo, hi = self._end(y, k), self._end(y + 1, k)
        j = np.flatnonzero(hi <= u)
        while len(j):
            y[j] += 1
            lo[j] = hi[j]
            hi[j] = end = self._end(y[j] + 1, k[j])
            j = j[end <= u[j]]
        j = np.flatnonzero(lo > u)
        while len(j):  # rounding at a border
            y[j] -= 1
            hi[j] = lo[j]
            lo[j] = end = self._end(y[j], k[j])
            j = j[end > u[j]]
        x[rest], size[rest] = y, hi - lo
        lo += before
        low[rest] = lo
        return x, low, size

    def learn(self, x: np.ndarray) -> None:
        n = len(x)
        h2, h1 = self.x2 == x, self.x1 == x
        hit = self.state * 3
        hit += np.where(h2, 0, 2 - h1.view(np.int8))
        self.hits.append(hit)
        self.late.append(x)
        fresh = x << 3
        fresh |= 1
        for t, k, v, c, h in ((self.t2, self.slot[:n], self.v2, self.c2, h2), (self.t1, self.prev[:n], self.v1, self.c1, h1)):
            move = _MOVE.take(c + (h.view(np.int8) << 3))
            t[k] = np.where(move == _REPLACE, fresh, v + move)
        slot = self.prev[:n].view(np.uint32) * np.uint32(0x9E3779B1)
        slot += x.view(np.uint32) * np.uint32(0x85EBCA6B)
        slot >>= np.uint32(32 - HASH_BITS)
        self.slot[:n], self.prev[:n] = slot, x
        if len(self.late) >= REFRESH:
            self._refresh()


def _lanes(n: int) -> tuple[int, int, int]:
    """Number of lanes, the least number of ids in a lane, and how many first lanes have one more."""
    lanes = max(1, min(LANES, n // 128))
    return lanes, n // lanes, n % lanes


def _stretches(lanes: int, least: int, more: int) -> np.ndarray:
    """Where each lane's stretch of ids begins."""
    k = np.arange(lanes)
    return k * least + np.minimum(k, more)


def encode_ids(ids: np.ndarray, vocab: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, words per lane, words of all lanes) of a block's ids."""
    lanes, least, more = _lanes(len(ids))
    starts = _stretches(lanes, least, more)
    model = _Model(vocab, lanes)
    words = np.zeros((lanes, least + 4), np.uint32)
    used = np.zeros(lanes, np.int64)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    for step in range(least + (more > 0)):
        m = lanes if step < least else more
        x = ids[starts[:m] + step].astype(np.int32)
        model.predict(m)
        at, size = model.interval(x)
        r = rng[:m] >> _TOTAL
        at *= r
        size *= r
        lo = low[:m] + at
        if len(over := np.flatnonzero(lo < at)):
            k, p = over, used[over] - 1
            while len(k):  # add one to the word before; go on where that overflows
                words[k, p] += np.uint32(1)
                on = words[k, p] == 0
                k, p = k[on], p[on] - 1
        k = np.flatnonzero(size < _FULL)
        top = lo[k]
        words[k, used[k]] = top >> _WORD
        used[k] += 1
        lo[k] = top << _WORD
        size[k] <<= _WORD
        low[:m], rng[:m] = lo, size
        model.learn(x)
    k = np.arange(lanes)
    for _ in range(2):
        words[k, used] = low >> _WORD
        used += 1
        low = low << _WORD
    return lanes, used.astype("<u4"), words[np.arange(words.shape[1])[None, :] < used[:, None]]


def decode_ids(n: int, vocab: int, used: np.ndarray, words: np.ndarray) -> np.ndarray:
    lanes, least, more = _lanes(n)
    starts = _stretches(lanes, least, more)
    model, out = _Model(vocab, lanes, decoder=True), np.zeros(n, np.uint32)
    words = np.r_[words, np.zeros(4, words.dtype)].astype(np.uint64)
    at = np.r_[0, np.cumsum(used.astype(np.int64))[:-1]]
    code = (words[at] << _WORD) | words[at + 1]
    at += 2
    rng = np.full(lanes, (1 << 64) - 1, np.uint64)
    most = np.uint64((1 << TOTAL) - 1)
    for step in range(least + (more > 0)):
        m = lanes if step < least else more
        model.predict(m)
        r = rng[:m] >> _TOTAL
        x, low, size = model.find(np.minimum(code[:m] // r, most))
        low *= r
        size *= r
        cd = code[:m] - low
        k = np.flatnonzero(size < _FULL)
        place = at[k]
        cd[k] = (cd[k] << _WORD) | words[place]
        at[k] = place + 1
        size[k] <<= _WORD
        code[:m], rng[:m] = cd, size
        out[starts[:m] + step] = x
        model.learn(x)
    return out


def pack_block(ids: np.ndarray, docs: list[tuple], vocab: int) -> bytes:
    """docs: (doc_id or None, start, ids in the document, offset of the part, ids of the part)."""
    lanes, used, words = encode_ids(ids, vocab)
    out = [_HEAD.pack(MAGIC, len(ids), lanes, vocab, len(docs), zlib.crc32(ids.astype("<u4").tobytes()))]
    out += [_DOC.pack(0 if d is None else d, d is None, start, n, at, part) for d, start, n, at, part in docs]
    raw = b"".join([*out, used.tobytes(), words.astype("<u4").tobytes()])
    return raw + struct.pack("<I", zlib.crc32(raw))


def unpack_block(raw: bytes) -> tuple[np.ndarray, list[tuple]]:
    """(ids, docs) of a block; ValueError if either checksum fails."""
    if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("a block's bytes are damaged")
    magic, n, lanes, vocab, n_docs, crc = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size
    docs = [(None if null else d, start, size, off, part) for d, null, start, size, off, part in _DOC.iter_unpack(raw[at : at + n_docs * _DOC.size])]
    at += n_docs * _DOC.size
    used = np.frombuffer(raw, "<u4", lanes, at)
    ids = decode_ids(n, vocab, used, np.frombuffer(raw[at + 4 * lanes : -4], "<u4"))
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block decodes to other ids")
    return ids, docs


def write_files(tokens: DataFrame, out: str, vocab: int, block: int = BLOCK, width: int = 4, file: int = FILE) -> None:
    """tokens: doc_id, n_tokens, ids (binary, `width` bytes an id). Writes out/blocks, in files of about `file`
    ids, and out/manifest."""
    spark = tokens.sparkSession
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // file))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, start, seq = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        docs: list[tuple] = []
        size = 0

        def close() -> pd.DataFrame:
            nonlocal held, docs, size, seq
            raw = pack_block(np.concatenate(held), docs, vocab)
            row = pd.DataFrame({"file": [number], "seq": [seq], "n_ids": [size], "block": [raw]})
            held, docs, size, seq = [], [], 0, seq + 1
            return row

        for pdf in batches:
            for doc, raw in zip(pdf["doc_id"].astype(object), pdf["ids"]):
                ids, at = np.frombuffer(raw, f"<u{width}").astype(np.uint32), 0
                while at < len(ids):
                    part = ids[at : at + block - size]
                    held.append(part)
                    docs.append((None if pd.isna(doc) else int(doc), start, len(ids), at, len(part)))
                    at, size = at + len(part), size + len(part)
                    if size >= block:
                        yield close()
                start += len(ids)
        if size:
            yield close()

    ordered = tokens.select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInPandas(rows, "file int, seq int, n_ids long, block binary").write.options(**_SMALL_GROUPS).parquet(f"{out}/blocks")
    sizes = spark.read.parquet(f"{out}/blocks").groupBy("file").agg(F.sum("n_ids").alias("n_ids")).withColumn("group", F.expr(f"file DIV {SUMMED}"))
    before = lambda by, order: F.coalesce(F.sum("n_ids").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("group").agg(F.sum("n_ids").alias("n_ids")).select("group", before(F.lit(1), "group").alias("group_first"))
    manifest = sizes.select("file", "group", "n_ids", before("group", "file").alias("inside")).join(groups, "group")
    manifest.select("file", (F.col("group_first") + F.col("inside")).alias("first"), "n_ids").write.parquet(f"{out}/manifest")


def read_files(spark: SparkSession, out: str) -> DataFrame:
    """Per document: doc_id, start (over all files), n_tokens, ids_crc32."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, raw in zip(pdf["file"], pdf["block"]):
                ids, docs = unpack_block(raw)
                cuts = np.cumsum([d[4] for d in docs])[:-1]
                parts = [x.astype("<u4").tobytes() for x in np.split(ids, cuts)]
                yield pd.DataFrame({
                    "file": file, "doc_id": pd.array([d[0] for d in docs], "Int64"), "at": [d[1] for d in docs], "n_tokens": [d[2] for d in docs], "offset": [d[3] for d in docs],
                    "crc": [zlib.crc32(p) for p in parts], "part": [p if d[4] < d[2] else None for p, d in zip(parts, docs)],
                })

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        crc = 0
        for p in pdf.sort_values("offset")["part"]:
            crc = zlib.crc32(p, crc)
        return pdf.iloc[:1][["file", "doc_id", "at", "n_tokens"]].assign(crc=crc)

    blocks = spark.read.parquet(f"{out}/blocks").select("file", "block")
    # parts of documents that span blocks meet again by document; all others are whole already
    found = blocks.mapInPandas(rows, "file int, doc_id long, at long, n_tokens long, offset long, crc long, part binary")
    found = cut(found, "token-read")
    whole = found.where("part IS NULL").select("file", "doc_id", "at", "n_tokens", "crc")
    split = found.where("part IS NOT NULL").groupBy("file", "at").applyInPandas(join, "file int, doc_id long, at long, n_tokens long, crc long")
    manifest = spark.read.parquet(f"{out}/manifest").select("file", "first")
    every = whole.unionByName(split).join(manifest, "file")
    return every.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def write_and_read(df: DataFrame, path: str, vocab: int | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, file: int = FILE) -> DataFrame:
    """Encode every text, append end_id, write the files under the shared folder and read them back. vocab:
    the number of ids, by default as the tokenizer file has it."""
    spark, vocab = df.sparkSession, vocab or vocab_size(path)
    width = 2 if vocab <= 1 << 16 else 4  # ids travel and wait in as few bytes as the vocabulary needs
    tokens = encode(df, path, doc_id, text, spread=LONG, width=width)
    end = F.lit(bytearray(end_id.to_bytes(width, "little")))
    tokens = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("n_tokens") + 1).alias("n_tokens"), F.concat("ids", end).alias("ids"))
    tokens = cut(tokens, "token-ids")
    out = fresh_path(spark, "tokens")
    write_files(tokens, out, vocab, block, width, file)
    drop(tokens)
    return read_files(spark, out)
