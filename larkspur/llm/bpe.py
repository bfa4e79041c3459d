"""Byte-level BPE encoding and decoding, exact with the tokenizers library.

Short stretches: a text is cut before each space that something other than white space follows. No
pre-token of the byte-level pattern spans such a place and no look-ahead crosses it, so the parts encode
on their own. Arrow splits a slice of texts there, the distinct parts are encoded, many to a text, and the
ids of all parts are gathered at once. First parts, and texts with spaces at other places, are cut by a
pattern, with a bounded cache of their own.

Distinct parts of Western letters and ASCII signs go through tiktoken, which is quicker, all others and
those with an added token through the library. Both give the same ids if ids are merge ranks and each
token's own bytes encode as that one token: what a run of bytes becomes before a merge reaches beyond it
depends on the run alone, so a pair whose bytes are a token's can only stand there as that token's own
merge. Codec checks both for the given file and uses the library alone where either fails.

Long unsplit stretches (no such place within `leaf` characters) are encoded by tree concatenation:
halves are encoded apart, down to leaves that need nothing of each other, and joined upwards. At
each join a window of tokens on both sides is encoded anew; if its first tokens are the left side's and
its last tokens the right side's, the parts are spliced, else the window grows on the side that doesn't
agree until both do, or until it has all of that side. BPE output is valid exactly if all its neighbouring token pairs are,
so agreement at both ends makes the splice the library's own result. Window edges are only set where the
pre-token pattern can't see a difference: between signs of different kinds (letter, number, other), since
none of its tokens spans them but an apostrophe with letters; before white space behind another sign; or
inside a run of one kind, away from apostrophes. No edge is set inside an added token.

Documents beyond `spread` characters are dealt out as chunk rows over the cluster, encoded there in
parallel, and joined in the same way in the task of their document.

Defined cases: null and empty texts have no ids and decode to the empty text; texts of any length are encoded
whole; doc_id may be null or repeated, each row gets its own result; an empty table gives an empty result;
extra columns, whatever their names, don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import modest_batches

LEAF = 2048
SPREAD = 1 << 15
#: Pieces a worker's cache holds; it starts anew beyond that (about 120 MB).
CACHE = 500_000
#: Characters that are encoded at once (or one document), and distinct parts that are encoded as one text.
SLICE, GROUP = 1 << 20, 8192
#: White space and a word up to white space or ASCII punctuation, or else up to white space.
_PIECES = re.compile(r"\s+[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^\s!-/:-@\[-`{-~])|\s+\S+|\S+|\s+").findall
#: White space for one of the two regex engines only; such texts aren't cut.
_DOUBTFUL = re.compile(r"[\x1c-\x1f]").search
#: Parts whose characters are of one class in every version of Unicode: Western letters and ASCII.
_WESTERN = r"\A[!-~\x{A1}-\x{24F}][\t\n\r -~\x{A1}-\x{24F}]*\z"
#: The byte-level pre-token pattern (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocab_size(path: str) -> int:
    """One more than the largest id of a tokenizer file."""
    file = json.loads(open(path, encoding="utf-8").read())
    return 1 + max([*file["model"]["vocab"].values(), *(t["id"] for t in file.get("added_tokens") or [])])


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character: printable Latin-1 as itself, the others
    from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def slices(lens: np.ndarray) -> list[np.ndarray]:
    """Places of the texts in runs of about SLICE characters, or one text."""
    return np.split(np.arange(len(lens)), np.flatnonzero(np.diff(np.cumsum(lens) // SLICE)) + 1) if len(lens) else []


@functools.lru_cache(maxsize=1 << 14)
def _kind(c: str) -> str:
    """L, N, Z (white space) or O (other), as the pre-token pattern tells signs apart; empty where versions of
    Unicode could disagree."""
    kind = unicodedata.category(c)
    if kind == "Cn" or _DOUBTFUL(c) or ord(c) >= 0x2EBF0:
        return ""
    return "Z" if c.isspace() else kind[0] if kind[0] in "LN" else "O"


class Codec:
    """One worker's encoder and decoder of a tokenizer file."""

    _made: dict[tuple[str, int], Codec] = {}

    def __init__(self, path: str, leaf: int = LEAF):
        # one thread a task: Spark's tasks are the parallelism (the library reads this when it first runs)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib, self.leaf = Tokenizer.from_file(path), leaf
        self.lib.no_truncation()
        self.lib.no_padding()
        size = self.lib.get_vocab_size(with_added_tokens=True)
        to_byte, added = _byte_of(), self.lib.get_added_tokens_decoder()
        table = [b""] * size
        for token, i in self.lib.get_vocab(with_added_tokens=True).items():
            table[i] = token.encode() if i in added else bytes(to_byte[c] for c in token)
        self.table = table
        self.lens = np.array([len(b) for b in table], np.int64)
        self.starts = np.r_[0, np.cumsum(self.lens)[:-1]]
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.numbers = [str(i).encode() for i in range(size)]
        self.cache: dict[str, bytes] = {}
        self.added = [t.content for t in added.values()]
        self.quick = self._ranks(json.loads(self.lib.to_str()))

    def _ranks(self, file: dict):
        """The same vocabulary for tiktoken, or None where the two could differ (see above)."""
        model, pre = file["model"], file["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or file["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        vocab = model["vocab"]
        ranks = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        tokens = [t for t in vocab if t not in self.added]
        if ranks != sorted(set(ranks)) or len(tokens) != 256 + len(ranks) or any(len(self.lib.model.tokenize(t)) != 1 for t in tokens):
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks={self.table[vocab[t]]: vocab[t] for t in tokens}, special_tokens={})

    @classmethod
    def get(cls, path: str, leaf: int = LEAF) -> Codec:
        if (path, leaf) not in cls._made:
            cls._made[path, leaf] = cls(path, leaf)
        return cls._made[path, leaf]

    def whole(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _grouped(self, text: str, sizes: np.ndarray, quick: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per word) of a text of words joined by spaces, each of so many bytes, behind
        one more space: every border between them is a safe cut."""
        text = " " + text
        ids = np.array(self.quick.encode_ordinary(text) if quick else self._batch([text])[0], "<u4")
        ends, done = np.cumsum(sizes + 1), np.cumsum(self.lens[ids])
        cuts = np.searchsorted(done, ends) + 1
        if not (done[cuts - 1] == ends).all():
            raise ValueError("a token spans a space")
        return ids, np.diff(cuts, prepend=0)

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words behind a space each, their places, their numbers: -1 for a word that begins
        with white space, and for the empty word)."""
        sizes = pc.binary_length(words).to_numpy().astype(np.int64)
        short = pc.less(pc.utf8_length(words), self.leaf).to_numpy(zero_copy_only=False)
        quick = short & pc.match_substring_regex(words, _WESTERN).to_numpy(zero_copy_only=False) if self.quick else np.zeros(len(words), bool)
        for content in self.added:
            quick &= ~pc.match_substring(words, content).to_numpy(zero_copy_only=False)
        fit, other = quick.copy(), np.flatnonzero(~quick)
        fit[other] = [t != "" and not t[0].isspace() for t in words.take(pa.array(other)).to_pylist()]
        n, order, made = np.full(len(words), -1, np.int64), [], [np.zeros(0, "<u4")]
        for chosen, by in ((quick, True), (fit & short & ~quick, False)):
            places = np.flatnonzero(chosen)
            starts = range(0, len(places), GROUP)
            lists = pa.ListArray.from_arrays(pa.array([*starts, len(places)], pa.int32()), words.take(pa.array(places)))
            for i, text in zip(starts, pc.binary_join(lists, pa.scalar(" ", words.type)).to_pylist()):
                k = places[i : i + GROUP]
                ids, n[k] = self._grouped(text, sizes[k], by)
                made.append(ids)
            order.append(places)
        order.append(np.flatnonzero(fit & ~short))
        for k in order[-1].tolist():
            made.append(np.array(self.tree(" " + words[k].as_py()), "<u4"))
            n[k] = len(made[-1])
        order, at = np.concatenate(order), np.zeros(len(words), np.int64)
        at[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(made), at, n

    def _fill(self, pieces: set[str]) -> None:
        missing = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(missing) > CACHE:
            self.cache = {p: self.cache[p] for p in pieces if p in self.cache}
        for p, x in zip(missing, self._each(missing)):
            self.cache[p] = np.array(x, "<u4").tobytes()

    def _each(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece; long pieces by tree."""
        short = iter(self._batch([p for p in pieces if len(p) <= self.leaf]))
        return [self.tree(p) if len(p) > self.leaf else next(short) for p in pieces]

    def cut(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers, by its pieces."""
        cut = [None if _DOUBTFUL(t) else _PIECES(t) for t in texts]
        self._fill({p for pieces in cut if pieces for p in pieces})
        get = self.cache.__getitem__
        return [np.array(self.whole(t), "<u4").tobytes() if pieces is None else b"".join(map(get, pieces)) for t, pieces in zip(texts, cut)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        texts = [t or "" for t in texts]
        return [x for at in slices(np.fromiter(map(len, texts), np.int64, len(texts))) for x in self._slice([texts[k] for k in at])]

    def _slice(self, texts: list[str]) -> list[bytes]:
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = np.cumsum(pc.list_value_length(parts).to_numpy())
        first = np.r_[0, ends[:-1]]
        parts = parts.flatten()
        head = self.cut(parts.take(pa.array(first)).to_pylist())
        rest = np.ones(len(parts), bool)
        rest[first] = False
        coded = parts.filter(pa.array(rest)).dictionary_encode()
        code = coded.indices.to_numpy()
        ids, places, numbers = self._parts(coded.dictionary)
        n, at = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        n[rest], at[rest] = numbers[code], places[code]
        # a space before white space or the end is no safe cut: such texts are cut by the pattern alone
        odd = np.flatnonzero(np.add.reduceat(n < 0, first, dtype=np.int64))
        np.maximum(n, 0, out=n)
        n[first] = sizes = np.fromiter(map(len, head), np.int64, len(head)) >> 2
        at[first] = len(ids) + np.cumsum(sizes) - sizes
        ids = np.concatenate([ids, np.frombuffer(b"".join(head), "<u4")])
        done = np.cumsum(n)
        raw = ids[np.arange(done[-1]) + np.repeat(at - (done - n), n)].tobytes()
        stops = (4 * done[ends - 1]).tolist()
        out = [raw[i:j] for i, j in zip([0, *stops], stops)]
        for k, x in zip(odd, self.cut([texts[k] for k in odd])):
            out[k] = x
        return out

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return b",".join(map(self.numbers.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids, in UTF-8; malformed sequences become U+FFFD as in the library."""
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        if not len(ids) or not ends[-1]:
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lens), lens)
        raw = self.flat[at].tobytes()
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()

    def tree(self, text: str) -> list[int]:
        """The ids of a long stretch, by halves."""
        parts = [text]
        while max(map(len, parts)) > self.leaf:
            parts = [h for p in parts for h in ((p[: len(p) // 2], p[len(p) // 2 :]) if len(p) > self.leaf else (p,))]
        return self.join(parts, self._batch(parts))

    def join(self, texts: list[str], ids: list[list[int]]) -> list[int]:
        """Join neighbouring parts pairwise until one is left."""
        while len(texts) > 1:
            pairs = range(0, len(texts) - 1, 2)
            joined = [self.splice(texts[i], ids[i], texts[i + 1], ids[i + 1]) for i in pairs]
            merged = [texts[i] + texts[i + 1] for i in pairs]
            if len(texts) % 2:
                joined.append(ids[-1])
                merged.append(texts[-1])
            texts, ids = merged, joined
        return ids[0] if ids else []

    def _edges(self, text: str, ids: list[int], from_end: bool) -> Iterator[tuple[int, int]]:
        """(number of tokens, number of characters) from the start, or the end, of a part, at token ends
        that are character ends too."""
        n = chars = pending = 0
        for i in reversed(ids) if from_end else ids:
            n += 1
            b = self.table[i]
            chars += sum((c & 0xC0) != 0x80 for c in b)
            pending = b[0] & 0xC0 == 0x80 if from_end else 0
            if not pending:
                yield n, chars

    def _quiet(self, text: str, at: int) -> bool:
        """Whether the pre-token pattern behaves alike on either side of a cut here."""
        if at <= 0 or at >= len(text):
            return False
        if any(t in text[max(0, at - len(t) + 1) : at + len(t) - 1] for t in self.added):
            return False
        a, b = _kind(text[at - 1]), _kind(text[at])
        if not a or not b or a == "Z":
            return False
        if a != b and b == "Z":
            return True
        if a != b:
            return text[at - 1] != "'"
        return "'" not in text[max(0, at - 4) : at + 4]

    def splice(self, left: str, a: list[int], right: str, b: list[int], window: int = 8) -> list[int]:
        """The ids of left + right from the ids of both."""
        text, mid = left + right, len(left)
        more, fewer = window, window  # tokens of the left and of the right side
        lo = hi = None
        while True:
            if lo is None:
                lo = next(((n, c) for n, c in self._edges(left, a, True) if n >= more and self._quiet(text, mid - c)), (len(a), mid)) if more < len(a) else (len(a), mid)
            if hi is None:
                near = ((n, c) for n, c in self._edges(right, b, False) if n >= fewer and self._ends(right, b, n, c) and self._quiet(text, mid + c))
                hi = next(near, (len(b), len(right))) if fewer < len(b) else (len(b), len(right))
            middle = self.whole(text[mid - lo[1] : mid + hi[1]])
            agree_lo = lo[0] == len(a) or len(middle) > 3 and middle[:2] == a[len(a) - lo[0] :][:2]
            agree_hi = hi[0] == len(b) or len(middle) > 3 and middle[-2:] == b[: hi[0]][-2:]
            if agree_lo and agree_hi:
                return [*a[: len(a) - lo[0]], *middle, *b[hi[0] :]]
            if not agree_lo:
                more, lo = 4 * more, None
            if not agree_hi:
                fewer, hi = 4 * fewer, None

    def _ends(self, text: str, ids: list[int], n: int, chars: int) -> bool:
        """Whether the first n tokens end where a character ends."""
        return n < len(ids) and self.table[ids[n]][0] & 0xC0 != 0x80 and chars <= len(text)


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False, leaf: int = LEAF, spread: int = SPREAD, width: int = 4, label: Column | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens and ids (binary, little-endian, `width` bytes an id); with digests, instead of the ids,
    ids_sha256 and decoded_sha256, made in the same pass; with a label, a string of the row, it comes along last."""
    modest_batches(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()
    along = [] if label is None else ["label"]
    carried, names = f"doc_id {kind}" + ", label string" * len(along), ["doc_id", *along]
    schema = f"{carried}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary")
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), *([label.cast("string").alias("label")] if along else []), F.col(f"`{text}`").alias("t"))

    def result(codec: Codec, rows: pd.DataFrame, found: list[bytes]) -> pd.DataFrame:
        out = {c: rows[c].reset_index(drop=True) for c in names} | {"n_tokens": [len(x) // 4 for x in found]}
        if not digests:
            return pd.DataFrame(out | {"ids": found if width == 4 else [np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes() for x in found]})
        ids = [np.frombuffer(x, "<u4") for x in found]
        out["ids_sha256"] = [hashlib.sha256(codec.decimal(x)).hexdigest() for x in ids]
        out["decoded_sha256"] = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
        return pd.DataFrame(out)

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.get(path, leaf)
        for pdf in batches:
            for at in slices(pdf["t"].str.len().fillna(0).to_numpy(np.int64)):
                part = pdf.iloc[at]
                yield result(codec, part, codec.encode(part["t"].tolist()))

    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.get(path, leaf)
        for pdf in batches:
            yield pdf.assign(ids=codec.encode(pdf["t"].tolist()))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        codec, pdf = Codec.get(path, leaf), pdf.sort_values("pos")
        ids = codec.join(pdf["t"].tolist(), [np.frombuffer(x, "<u4").tolist() for x in pdf["ids"]])
        return result(codec, pdf.iloc[:1], [np.array(ids, "<u4").tobytes()])

    n = F.length("t")
    out = docs.where(n.isNull() | (n <= spread)).mapInPandas(short, schema)
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / spread)), lambda i: F.substring(F.col("t"), (i * spread + 1).cast("int"), F.lit(spread)))
    long = docs.where(n > spread).withColumn("row", F.monotonically_increasing_id()).select(*names, "row", F.posexplode(parts).alias("pos", "t"))
    long = long.repartition("row", "pos").mapInPandas(chunk, f"{carried}, row long, pos int, t string, ids binary")
    out = out.unionByName(long.groupBy("row").applyInPandas(join, schema))
    return out.select(*(c for c in out.columns if c != "label"), *along)


def decode(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: doc_id and text, decoded from ids (binary as encode() makes it; null: empty text)."""
    kind = df.schema[doc_id].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.get(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [codec.decode(np.frombuffer(x or b"", "<u4")).decode() for x in pdf["ids"]]})

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids")).mapInPandas(rows, f"doc_id {kind}, text string")
