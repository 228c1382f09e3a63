"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Method: the model file is only read for its pieces, scores and types; the merging is our
own. A text gets a space in front and is cut into words where a run of spaces begins,
which no piece of the vocabulary crosses (checked on loading). The words of a batch that
are new are encoded together: one flat numpy array of symbols, the rank of every
neighbouring pair, the best rank of each word by a segmented minimum, and all leftmost
occurrences of it merged at once; the array is compacted, only pairs beside a merge are
ranked anew, and the rounds go on until no pair is left. The library merges one pair at a
time, best score first, leftmost on ties. Merging all occurrences at once gives the same
pieces unless the merged piece forms a pair of a better or equal score; pieces for which
the vocabulary has such a pair are marked on loading, and in a round whose best piece is
marked a word merges only its leftmost occurrence. What has no piece falls back to bytes.
Ids are decoded by joining their pieces' bytes.

Defined cases: null or empty texts have no ids and decode to the empty text; texts of any
length and without any space are handled (rounds need memory in proportion to the
batch); U+2581 in a text is a space, as in the library; repeated rows repeat; null
doc_ids and other columns are passed on or ignored.

Scale: one pass over the rows without a shuffle. A task keeps the words it meets in two
generations of a fixed number; words that go on occurring move to the younger one, and
both end with the task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
_WORD = re.compile(" *[^ ]+| +")
_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MODELS: dict[str, PieceModel] = {}


class _PairTable:
    """Open addressing in numpy: the piece that a pair of pieces joins to."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            _, one = np.unique(slot[left][free], return_index=True)
            put = left[free][one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[~np.isin(left, put)]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, or -1."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            same = there == keys[open_]
            out[open_[same]] = self.values[slot[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return out


class _Strings:
    """A byte string for each id, joined for whole arrays of ids at once."""

    def __init__(self, parts: list[bytes]):
        self.length = np.array([len(p) for p in parts], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids in a row, and where each id's bytes end."""
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.repeat(self.start[ids] - (ends - length), length)
        at += np.arange(len(at))
        return self.flat[at].tobytes(), ends


class PieceModel:
    """Pieces of a SentencePiece BPE model, with encode and decode of our own."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with identity normalisation and a leading space are handled")
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.pieces = [p.piece for p in proto.pieces]
        kinds = [p.type for p in proto.pieces]  # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        if 4 in kinds or 5 in kinds:
            raise ValueError("user-defined and unused pieces aren't handled")
        self.unk = kinds.index(2)
        id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 1}
        if SPACE not in id_of or any(SPACE in p.lstrip(SPACE) for p in id_of):
            raise ValueError("a piece crosses a word boundary, or the space has no piece")
        byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 6}
        self.byte_of = {i: b for b, i in byte_id.items()}
        self.byte_id = np.array([byte_id.get(b, self.unk) for b in range(256)], np.int32)
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in id_of.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.char_id[ord(" ")] = id_of[SPACE]
        scores = [p.score for p in proto.pieces]
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in id_of.values()}, reverse=True))}
        self.n = n = len(self.pieces)
        self.rank = np.full(n + 1, _NONE, np.int32)  # the last place is that of -1, no piece
        for i in id_of.values():
            self.rank[i] = order[scores[i]]
        # Every pair of pieces that joins to a piece, as left * n + right; and the pieces that take part in a pair of no worse rank.
        keys, joined, self.eager = [], [], np.zeros(n, bool)
        for piece, i in id_of.items():
            for cut in range(1, len(piece)):
                l, r = id_of.get(piece[:cut]), id_of.get(piece[cut:])
                if l is not None and r is not None:
                    keys.append(l * n + r)
                    joined.append(i)
                    self.eager[l] |= self.rank[i] <= self.rank[l]
                    self.eager[r] |= self.rank[i] <= self.rank[r]
        self.pairs = _PairTable(np.array(keys, np.int64), np.array(joined, np.int32))
        self.text_of = [b"" if k == 3 else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.text_of[self.unk] = " ⁇ ".encode()
        self.surfaces = _Strings([bytes([self.byte_of[i]]) if i in self.byte_of else t for i, t in enumerate(self.text_of)])
        self.decimals = _Strings([b"%d," % i for i in range(n)])

    def _join(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The piece that each symbol of `at` joins to with its right neighbour in its word, or -1."""
        out = np.full(len(at), -1, np.int32)
        ok = np.flatnonzero(at < len(sym) - 1)
        ok = ok[word[at[ok]] == word[at[ok] + 1]]
        left, right = sym[at[ok]].astype(np.int64), sym[at[ok] + 1]
        both = (left >= 0) & (right >= 0)
        out[ok[both]] = self.pairs.get(left[both] * self.n + right[both])
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has; all words in common rounds. No word is empty."""
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        sym, place = self.char_id[text], np.arange(len(text), dtype=np.int32)
        piece = self._join(sym, word, np.arange(len(sym)))
        rank = self.rank[piece]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            length = np.diff(first, append=len(sym))
            ended = best == _NONE
            if (many := int(length[ended].sum())) * 4 >= len(sym):  # words without a pair leave when they are many
                gone = np.repeat(ended, length)
                done.append((place[gone], sym[gone], word[gone]))
                if many == len(sym):
                    break
                sym, word, place, piece, rank = (x[~gone] for x in (sym, word, place, piece, rank))
                best, length = best[~ended], length[~ended]
            hit = np.flatnonzero((rank == np.repeat(best, length)) & (rank != _NONE))
            # Leftmost first: of neighbouring hits every other one, counted from the start of their run.
            index = np.arange(len(hit))
            begins = np.r_[True, hit[1:] != hit[:-1] + 1]
            take = hit[(index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0]
            # A word one of whose best pieces is eager merges its leftmost one only.
            if (eager := self.eager[piece[take]]).any():
                begins = np.r_[True, word[take[1:]] != word[take[:-1]]]
                some = np.logical_or.reduceat(eager, np.flatnonzero(begins))
                take = take[begins | ~some[np.cumsum(begins) - 1]]
            sym[take] = piece[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            sym, word, place, piece, rank = (x[keep] for x in (sym, word, place, piece, rank))
            take = take - np.arange(len(take))
            near = np.r_[take, take[take > 0] - 1]
            piece[near] = self._join(sym, word, near)
            rank[near] = self.rank[piece[near]]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        place, sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        place, sym, word = place[order], sym[order], word[order]
        if len(odd := np.flatnonzero(sym < 0)):
            sym, word = self._spelled(text, place, sym, word, odd)
        return sym, np.bincount(word, minlength=len(words))

    def _spelled(self, text: np.ndarray, place: np.ndarray, sym: np.ndarray, word: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become bytes, or one unknown piece a run of them in a word."""
        code = text[place[odd]]
        if not self.byte_fallback:
            sym[odd] = self.unk
            repeat = odd[(odd > 0) & (sym[odd - 1] == self.unk) & (word[odd - 1] == word[odd])]
            return np.delete(sym, repeat), np.delete(word, repeat)
        wide = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        times = np.ones(len(sym), np.int64)
        times[odd] = wide
        spelled = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        out = np.repeat(sym, times)
        out[np.repeat(sym < 0, times)] = self.byte_id[spelled]
        return out, np.repeat(word, times)

    def encode(self, text: str) -> list[int]:
        words = split(text)
        return self.encode_words([" " + w for w in words])[0].tolist() if words else []

    def decode(self, ids: list[int]) -> str:
        """Runs of byte pieces are UTF-8; bytes that aren't valid there become U+FFFD one by one."""
        out, run, first = [], bytearray(), True
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                first = False
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            piece = self.text_of[i].decode()
            if first and piece.startswith(" ") and i != self.unk:
                piece = piece[1:]
            if self.text_of[i]:
                first = False
            out.append(piece)
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)



def _utf8(data: bytes) -> str:
    out, k = [], 0
    while k < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[k : k + n].decode("utf-8"))
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        k += n
    return "".join(out)


def load(path: str, model: bytes) -> PieceModel:
    """The model, kept for later batches of the same worker."""
    key = f"{path}:{len(model)}"
    if key not in _MODELS:
        _MODELS[key] = PieceModel(model)
    return _MODELS[key]


def _chunks(texts: list[str], most: int) -> Iterator[list[str]]:
    """Consecutive texts of about `most` characters together, so that few words are held at a time."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


class WordCache:
    """Ids and surfaces of words, in two generations of at most MOST words each.

    A word is known by its text without the space in front of it.
    """

    MOST = 40_000

    def __init__(self, model: PieceModel, decimal: bool):
        self.model, self.decimal = model, decimal
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def learn(self, words: set[str]) -> None:
        """Afterwards all words are in the younger generation."""
        new = words - self.young.keys()
        if len(self.young) + len(new) > self.MOST:
            self.old, self.young, new = self.young, {}, words
        again = new & self.old.keys()
        for w in again:
            self.young[w] = self.old[w]
        part = list(new - again)
        if not part:
            return
        ids, count = self.model.encode_words([" " + w for w in part])
        after = np.cumsum(count)
        coded, ends = self.model.decimals.joined(ids) if self.decimal else (ids.astype("<i4").tobytes(), 4 * np.arange(1, len(ids) + 1))
        surface, until = self.model.surfaces.joined(ids)
        a = b = 0
        for w, x, y in zip(part, ends[after - 1].tolist(), until[after - 1].tolist(), strict=True):
            self.young[w] = (coded[a:x], surface[b:y])
            a, b = x, y


def split(text: str) -> list[str]:
    """The words of a text, each without the space in front of it."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    if text[:1] == " " or "  " in text:
        return [w[1:] for w in _WORD.findall(" " + text)]
    return text.split(" ") if text else []


def encoded(texts: list[str], words: WordCache) -> Iterator[tuple[bytes, bytes]]:
    """The ids of each text, as decimals with a comma after each or as little-endian int32, and the UTF-8 bytes that they decode to."""
    for part in _chunks(texts, 500_000):
        cut = [split(t) for t in part]
        words.learn(set().union(*cut))
        get = words.young.__getitem__
        for keys in cut:
            rows = [get(w) for w in keys]
            yield b"".join([r[0] for r in rows]), b"".join([r[1] for r in rows])[1:]


#: What encode_documents gives, by its parameter `give`.
GIVES = {
    "texts": "n_tokens long, ids array<int>, decoded string",
    "digests": "n_tokens long, ids_sha256 string, decoded_sha256 string",
    "round_trip": "n_tokens long, ids array<int>, round_trip boolean",
}


def encode_documents(docs: DataFrame, model_path: str, keep: list[str], give: str = "texts") -> DataFrame:
    """The columns `keep` with n_tokens and, by `give`: ids and decoded text, the SHA-256 of both, or ids and whether they decode to the text."""
    with open(model_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())  # half a megabyte, whatever the corpus
    sha = lambda s: hashlib.sha256(s).hexdigest()

    def start():
        words = WordCache(load(model_path, held.value), give == "digests")

        def run(texts: list[str]) -> list:
            rows = list(encoded(texts, words))
            if give == "digests":
                return [[i.count(b",") for i, _ in rows], [sha(i[:-1]) for i, _ in rows], [sha(d) for _, d in rows]]
            n = np.array([len(i) // 4 for i, _ in rows], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.frombuffer(b"".join([i for i, _ in rows]), "<i4")))
            return [n, ids, [d == t.encode() for (_, d), t in zip(rows, texts, strict=True)] if give == "round_trip" else [d.decode() for _, d in rows]]

        return run

    return common.map_texts(docs, keep, GIVES[give], start)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its number of ids and the hashes of the ids and of the text decoded from them."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode_documents(docs, default_model(), ["doc_id"], give="digests")
