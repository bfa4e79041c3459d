"""SentencePiece BPE encoding and decoding by vectorised merge rounds, exact with the sentencepiece library.

The library merges one pair at a time: the best-scored one of the text, the leftmost of equal ones. Here all words
of a slice of texts are merged together, in flat numpy arrays of symbols:

Words: a text is cut between two characters that stand side by side in no piece of the model. No merge can reach
over such a place, so the stretches between them encode on their own, whatever the white space around them. Arrow
finds the distinct words of a slice, and only these are encoded.

A round takes the smallest pair rank of each word (a segmented minimum) and merges all its pairs of that rank at
once, of overlapping ones those that come first from the left. That is what the library does one after the other,
as long as no new pair comes before the old ones. A piece for which one could (it begins or ends another piece of
the same or a smaller rank) is merged at its leftmost place only. Then merged symbols are taken out, words without
a pair that is a piece leave the arrays, and the next round begins, until no word is left. Pairs are looked up
again only where a neighbour has changed. A word that isn't done after ROUNDS rounds, such as a megabyte of letters
without a cut, is finished pair by pair with a heap, from where it stands.

Characters that aren't pieces become the byte pieces of their UTF-8 form.

Defined cases: null and empty texts have no ids and decode to the empty text; texts of any length are encoded
whole, in parts of about SLICE characters between two cuts; doc_id may be null, repeated or of any type, each row
gets its own result; an empty table gives an empty result; extra columns, whatever their names, don't matter. Equal
scores are broken to the left as in the library. U+2581 in a text is a space to the model and decodes to one. A
model that isn't BPE with byte fallback, or that normalises texts, removes spaces, or has unused or user-defined
pieces, is refused with an error.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SLICE, slices
from .common import modest_batches

SPACE = "▁"
#: Rounds after which a word is finished pair by pair, and the rank of a pair that is no piece.
ROUNDS, NONE = 256, np.int32(2**31 - 1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _first_byte_lost(error: UnicodeError) -> tuple[str, int]:
    """The library writes one U+FFFD for each byte that begins no valid sequence."""
    return "�", error.start + 1


class PieceCodec:
    """One worker's encoder and decoder of a model file."""

    _made: dict[str, PieceCodec] = {}

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, kinds = model.normalizer_spec, [p.type for p in model.pieces]
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = model.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
        if not plain or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or {kind.UNUSED, kind.USER_DEFINED} & set(kinds) or kinds.count(kind.BYTE) != 256:
            raise ValueError(f"{path}: only BPE models with byte fallback and no normalisation can be encoded in rounds")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.bytes = np.zeros(256, np.int32)
        ids, scores, table = {}, {}, []
        for i, p in enumerate(model.pieces):
            if p.type == kind.NORMAL:
                ids[p.piece], scores[p.piece] = i, p.score
                table.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kind.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                table.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                table.append(model.trainer_spec.unk_surface.encode() if p.type == kind.UNKNOWN else b"")
        self.size, self.table = len(table), table
        self.normal = np.array([k == kind.NORMAL for k in kinds])
        self.lens = np.array([len(b) for b in table], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.numbers = [str(i).encode() for i in range(self.size)]
        self._fit(ids, scores)

    def _fit(self, ids: dict[str, int], scores: dict[str, float]) -> None:
        """Tables by character, pair and piece."""
        long = [p for p in ids if len(p) > 1]
        letters = sorted({c for p in long for c in p})
        #: characters of pieces that are no piece themselves count as symbols with numbers of their own
        loose = [c for c in letters if c not in ids]
        self.loose = np.array([ord(c) for c in loose], np.uint32)
        symbol = ids | {c: self.size + i for i, c in enumerate(loose)}
        self.width = self.size + len(loose)
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        at = {c: i for i, c in enumerate(letters, 1)}
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in long:
            self.beside[[at[c] for c in p[:-1]], [at[c] for c in p[1:]]] = True
        order = {s: r for r, s in enumerate(sorted({scores[p] for p in long}, reverse=True))}
        self.rank = np.full(self.width + 1, NONE, np.int32)
        self.alone = np.zeros(len(order) + 1, bool)
        pairs = {}
        for p in long:
            mine = self.rank[ids[p]] = order[scores[p]]
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in symbol and b in symbol:
                    pairs[symbol[a] * self.width + symbol[b]] = ids[p]
                    for part in (a, b):
                        if len(part) > 1 and order[scores[part]] >= mine:
                            self.alone[order[scores[part]]] = True
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()] + [self.width], np.int32)

    @classmethod
    def get(cls, path: str) -> PieceCodec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes; `width` where it makes none."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        found = (at < len(self.keys)) & (left >= 0) & (right >= 0)
        found[found] = self.keys[at[found]] == key[found]
        return np.where(found, self.made[np.where(found, at, -1)], np.int32(self.width))

    def rounds(self, sym: np.ndarray, word: np.ndarray, most: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, their words) once no pair is left; `word` is ascending, one number for each symbol."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = np.full(len(sym), self.width, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        pair[inner] = self.pair(sym[inner], sym[inner + 1])
        for turn in range(most + 1):
            if not len(sym):
                break
            rank = self.rank[pair]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            least = np.minimum.reduceat(rank, first)
            live = least != NONE
            if not live.all():
                keep = np.repeat(live, size)
                done.append((sym[~keep], word[~keep]))
                sym, word, pair, rank, size, least = sym[keep], word[keep], pair[keep], rank[keep], size[live], least[live]
                if not len(sym):
                    break
            if turn == most:
                ends = np.cumsum(size)
                for i, j in zip((ends - size).tolist(), ends.tolist()):
                    rest = np.array(self.one_by_one(sym[i:j].tolist()), np.int32)
                    done.append((rest, np.full(len(rest), word[i], word.dtype)))
                break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # of a run of overlapping pairs every other one, from its left end
            new_run = np.r_[True, np.diff(hit) != 1]
            place = np.arange(len(hit))
            keep = (place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0
            single = self.alone[rank[hit]]
            if single.any():
                keep &= ~single | np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            hit = hit[keep]
            sym[hit] = pair[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            hit = hit - np.arange(len(hit))  # places once the right sides are gone
            sym, word, pair = sym[stay], word[stay], pair[stay]
            pair[hit] = self.width
            near = np.zeros(len(sym), bool)
            near[hit] = near[hit[hit > 0] - 1] = True
            stale = np.flatnonzero(near[:-1])
            pair[stale] = self.width
            stale = stale[word[stale] == word[stale + 1]]
            pair[stale] = self.pair(sym[stale], sym[stale + 1])
        if not done:
            return sym, word
        sym, word = np.concatenate([a for a, _ in done]), np.concatenate([b for _, b in done])
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def one_by_one(self, sym: list[int]) -> list[int]:
        """A word's merges in the library's order, with a heap."""
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        made = dict(zip(self.keys.tolist(), self.made.tolist()))
        heap: list[tuple[int, int, int, int, int]] = []

        def push(i: int, j: int) -> None:
            piece = made.get(sym[i] * self.width + sym[j]) if i >= 0 <= j else None
            if piece is not None:
                heapq.heappush(heap, (int(self.rank[piece]), i, sym[i], sym[j], piece))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = right[i]
            if j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j], right[i] = piece, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            push(left[i], i)
            push(i, right[i])
        out, i = [], 0
        while i >= 0:
            out.append(sym[i])
            i = right[i]
        return out

    def _cuts(self, points: np.ndarray) -> np.ndarray:
        """Whether a cut stands before each character but the first."""
        letter = self.letter[points]
        return ~self.beside[letter[:-1], letter[1:]]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids per word)."""
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
        sym, word = self.rounds(self.symbol[points], np.repeat(np.arange(len(words), dtype=np.int32), sizes))
        lost = (sym < 0) | (sym >= self.size)
        if not lost.any():
            return sym, np.bincount(word, minlength=len(words))
        # a character that isn't a piece: a word of its own, or a loose letter
        char = np.where(sym[lost] < 0, points[(np.cumsum(sizes) - sizes)[word[lost]]], np.r_[self.loose, 0][np.maximum(sym[lost] - self.size, 0)].astype(np.uint32))
        raw = [chr(c).encode() for c in char.tolist()]
        times = np.ones(len(sym), np.int64)
        times[lost] = [len(b) for b in raw]
        sym, word, lost = np.repeat(sym, times), np.repeat(word, times), np.repeat(lost, times)
        sym[lost] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.bincount(word, minlength=len(words))

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that are ready: spaces escaped, cut on either side."""
        whole = "".join(texts)
        if not whole:
            return [np.zeros(0, np.int32)] * len(texts)
        points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        cut = np.r_[True, self._cuts(points)]
        ends = np.cumsum([len(t) for t in texts])
        cut[ends[ends < len(points)]] = True
        begin = np.flatnonzero(cut)
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        offsets = np.r_[0, np.cumsum(width)][np.r_[begin, len(points)]].astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        ids, n = self._words(coded.dictionary)
        at, n = (np.cumsum(n) - n)[code], n[code]
        stop = np.cumsum(n)
        out = ids[np.arange(stop[-1]) + np.repeat(at - (stop - n), n)]
        return np.split(out, np.r_[0, stop][np.searchsorted(begin, ends[:-1])])

    def _parts(self, text: str) -> list[str]:
        """A long text in parts of about SLICE characters, or more where there is no cut."""
        parts, at = [], 0
        while at < len(text):
            size = SLICE
            while at + size < len(text):
                cuts = np.flatnonzero(self._cuts(np.frombuffer(text[at : at + size].encode("utf-32-le"), "<u4")))
                if len(cuts):
                    size = int(cuts[-1]) + 1
                    break
                size *= 2
            parts.append(text[at : at + size])
            at += size
        return parts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        ready = [self.prefix + t.replace(" ", SPACE) if t else "" for t in texts]
        out = []
        for at in slices(np.fromiter(map(len, ready), np.int64, len(ready))):
            some = [ready[k] for k in at]
            if len(some) == 1 and len(some[0]) > 2 * SLICE:
                out.append(np.concatenate([x for part in self._parts(some[0]) for x in self._slice([part])]))
            else:
                out += self._slice(some)
        return out

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return b",".join(map(self.numbers.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids, in UTF-8, without the space that encoding puts before a text."""
        bare = np.flatnonzero(self.lens[ids] == 0)
        # byte pieces on two sides of a control piece belong to two characters
        raw = b"".join(map(self._run, np.split(ids, bare))) if len(bare) else self._run(ids)
        begin = np.flatnonzero(self.lens[ids])[:1]
        strip = self.prefix and raw[:1] == b" " and self.normal[ids[begin]].all()
        return raw[1:] if strip else raw

    def _run(self, ids: np.ndarray) -> bytes:
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        if not len(ids) or not ends[-1]:
            return b""
        raw = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lens), lens)].tobytes()
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            codecs.register_error("larkspur-first-byte", _first_byte_lost)
            return raw.decode("utf-8", "larkspur-first-byte").encode()


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens and ids (array of int); with digests, instead of the ids, ids_sha256 and
    decoded_sha256, made in the same pass."""
    modest_batches(df.sparkSession)
    kind = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = PieceCodec.get(path)
        for pdf in batches:
            for at in slices(pdf["t"].str.len().fillna(0).to_numpy(np.int64)):
                part = pdf.iloc[at]
                ids = codec.encode(part["t"].tolist())
                out = {"doc_id": part["doc_id"].reset_index(drop=True), "n_tokens": [len(x) for x in ids]}
                if digests:
                    out["ids_sha256"] = [hashlib.sha256(codec.decimal(x)).hexdigest() for x in ids]
                    out["decoded_sha256"] = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
                else:
                    out["ids"] = ids
                yield pd.DataFrame(out)

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t")).mapInPandas(rows, schema)


def decode(df: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: doc_id and text, decoded from ids (null: empty text)."""
    kind = df.schema[doc_id].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = PieceCodec.get(path)
        for pdf in batches:
            texts = [codec.decode(np.array([] if x is None else x, np.int64)).decode() for x in pdf["ids"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    return df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{ids}`").alias("ids")).mapInPandas(rows, f"doc_id {kind}, text string")
