"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is normalised as the model asks (identity; a dummy prefix; spaces become U+2581), cut into words
that no piece can cross, and the words not met before are encoded together: all their symbols lie in
one flat numpy array, every round looks up the rank of each adjacent pair, takes the minimum per word
by a segmented reduction, performs that word's leftmost merges at once and compacts the array, until no
pair is left. Symbols outside the vocabulary fall back to byte pieces.

A word performs all leftmost merges of its minimum in one round only where that equals one merge at a
time: pieces that some extension outranks or ties (runs of U+2581 share one score) merge one by one.

Defined results: null and empty text give no ids and decode to the empty text; every other text is
encoded whole; repeated rows repeat; an empty table stays empty; other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm._common import slices

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_NONE = np.iinfo(np.int32).max


class PieceBpe:
    """Encoder and decoder of one model file; keeps the ids of at most `cache_words` words that were met lately and as many that were met before these."""

    def __init__(self, model_file: str, cache_words: int = 125_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not spec.byte_fallback:
            raise ValueError("only BPE models with identity normalisation and byte fallback are supported")
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        if any(kind in (_USER, _UNUSED) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.unknown_surface = spec.unk_surface.encode()
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in ids):
            raise ValueError("a piece crosses words")
        self._char = np.full(0x110000, -1, np.int32)  # the piece of a character, -1: it falls back to bytes
        self._byte = np.full(256, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self._char[ord(p)] = i
        for i, (p, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                self._byte[int(p[3:5], 16)] = i
        if self._byte.min() < 0:
            raise ValueError("the model lacks a byte piece")
        order = {s: r for r, s in enumerate(sorted({s for p, s, kind in pieces if kind == _NORMAL}, reverse=True))}
        rank = np.full(len(pieces), _NONE, np.int32)
        for p, i in ids.items():
            rank[i] = order[pieces[i][1]]
        pairs = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        left, right, made = (np.array(x, np.int64) for x in ([a for a, _ in pairs], [b for _, b in pairs], list(pairs.values())))
        self._n = len(pieces)
        keys = left * self._n + right
        self._hash(keys)
        self._made = np.zeros(len(self._keys), np.int32)
        self._made[self._slots(keys)] = made
        self._rank = np.full(len(self._keys), _NONE, np.int32)
        self._rank[self._slots(keys)] = rank[made]
        self._single = np.zeros(len(pieces), bool)  # pieces whose merges go one at a time
        self._single[left[rank[made] <= rank[left]]] = True
        self._single[right[rank[made] <= rank[right]]] = True
        self._bytes = [
            b"" if kind == _CONTROL else self.unknown_surface if kind == _UNKNOWN
            else bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(SPACE, " ").encode()
            for p, _, kind in pieces
        ]
        self._is_normal = [kind == _NORMAL for _, _, kind in pieces]
        self._is_byte = np.array([kind == _BYTE for _, _, kind in pieces])
        self._words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        self._most = cache_words

    def _hash(self, keys: np.ndarray) -> None:
        """An open-addressing table of the pairs: an empty slot holds -1, a pair lies at most `_steps` slots past its own."""
        self._bits = max(4, int(len(keys)).bit_length() + 2)
        self._keys = np.full(1 << self._bits, -1, np.int64)
        left, self._steps = keys, 0
        while len(left):
            at = self._home(left, self._steps)
            free = self._keys[at] < 0
            self._keys[at[free]] = left[free]  # the last one of several for a slot has it
            left = left[self._keys[at] != left]
            self._steps += 1

    def _home(self, keys: np.ndarray, step: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)
        return (mixed.astype(np.int64) + step) & ((1 << self._bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where the table holds each key; -1 for those it has not."""
        at = self._home(keys, 0)
        held = self._keys[at]
        out = np.where(held == keys, at, -1)
        todo = np.flatnonzero((held != keys) & (held >= 0))
        for step in range(1, self._steps):
            if not len(todo):
                break
            at = self._home(keys[todo], step)
            held = self._keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (held >= 0)]
        return out

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first symbols of all words in one array, and the word of each: a character's piece, or those of its UTF-8 bytes."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        symbols = self._char[points]
        other = symbols < 0
        if not other.any():
            return symbols, word
        unknown = points[other]
        raw = np.frombuffer(unknown.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        times = np.ones(len(points), np.int64)
        times[other] = 1 + (unknown >= 0x80) + (unknown >= 0x800) + (unknown >= 0x10000)
        symbols = np.repeat(symbols, times)
        symbols[np.repeat(other, times)] = self._byte[raw]
        return symbols, np.repeat(word, times)

    def merge_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, by merge rounds over one flat symbol array."""
        ids, ends = self._merged(words)
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pair of each symbol in `at` and the next one."""
        rank, made = np.full(len(at), _NONE, np.int32), np.zeros(len(at), np.int32)
        inside = np.flatnonzero(at < len(symbols) - 1)
        inside = inside[word[at[inside]] == word[at[inside] + 1]]
        left = at[inside]
        slot = self._slots(symbols[left].astype(np.int64) * self._n + symbols[left + 1])
        hit = slot >= 0
        rank[inside[hit]], made[inside[hit]] = self._rank[slot[hit]], self._made[slot[hit]]
        return rank, made

    def _merged(self, words: list[str]) -> tuple[np.ndarray, list[int]]:
        """The ids of all words one after the other, and where those of each end."""
        symbols, word = self._symbols(words)
        rank, made = self._pairs(symbols, word, np.arange(len(symbols)))
        done: list[tuple[np.ndarray, np.ndarray]] = [(word[:0], symbols[:0])]
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(symbols)])
            open_words = least != _NONE
            stay = np.repeat(open_words, size)
            if not open_words.all():
                done.append((word[~stay], symbols[~stay]))
            at = np.flatnonzero((rank == np.repeat(least, size)) & stay)
            if len(at):
                # leftmost without overlap: every second one of a run of adjacent pairs
                run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
                nth = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
                first = np.r_[True, word[at[1:]] != word[at[:-1]]]
                lone = self._single[made[at[first]]]
                alone = np.repeat(lone, np.diff(np.r_[np.flatnonzero(first), len(at)]))
                at = at[np.where(alone, first, nth % 2 == 0)]
                symbols[at] = made[at]
            stay[at + 1] = False
            # only the pairs of a new symbol with its neighbours are others than before
            fresh = np.zeros(len(symbols), bool)
            fresh[at] = True
            symbols, word, rank, made, fresh = symbols[stay], word[stay], rank[stay], made[stay], fresh[stay]
            fresh[:-1] |= fresh[1:]
            again = np.flatnonzero(fresh)
            rank[again], made[again] = self._pairs(symbols, word, again)
        of, flat = (np.concatenate(x) for x in zip(*done))
        return flat[np.argsort(of, kind="stable")], np.cumsum(np.bincount(of, minlength=len(words))).tolist()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, int32."""
        cut = []
        for t in texts:
            t = (t or "").replace(" ", SPACE)
            cut.append(self._words.findall(SPACE + t if t and self.prefix else t))
        if len(self._known) > self._most:
            self._known, self._before = {}, self._known
        known, before, room = self._known, self._before, {}
        met = {w for words in cut for w in words if w not in known}
        new = []
        for w in met:
            found = before.get(w)
            if found is None:
                new.append(w)
            else:
                room[w] = found
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            ids, ends = self._merged(part)
            raw = ids.tobytes()
            room.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, [0, *ends], ends))
        if len(known) + len(room) <= 2 * self._most:
            known.update(room)
            get = known.__getitem__
        else:
            get = lambda w: known.get(w) if w in known else room[w]
        return [np.frombuffer(b"".join(map(get, words)), np.int32) for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; one leading space, the dummy prefix, is dropped."""
        got = b"".join(map(self._bytes.__getitem__, ids.tolist()))
        if self._prefixed(ids):
            got = got[1:]
        try:
            return got.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Byte pieces that form no character become U+FFFD each."""
        out, run = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self._is_byte[i]:
                run += self._bytes[i]
                continue
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(run[:k].decode())
                        run = run[k:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                out.append(self._bytes[i].decode())
        text = "".join(out)
        return text[1:] if self._prefixed(ids) else text

    def _prefixed(self, ids: np.ndarray) -> bool:
        """Whether the first piece that shows begins with a normal piece's space."""
        first = next((i for i in ids.tolist() if self._bytes[i]), None) if self.prefix else None
        return first is not None and self._is_normal[first] and self._bytes[first].startswith(b" ")


_loaded: dict[str, PieceBpe] = {}


def _of(model_file: str) -> PieceBpe:
    """One encoder per Python worker."""
    if model_file not in _loaded:
        _loaded[model_file] = PieceBpe(model_file)
    return _loaded[model_file]


def encode(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and ids array<int>, one row per row of docs."""
    source = docs.select(F.col(text).cast("string").alias("_text"), *[c for c in keep if c != "ids"])
    names = [*source.columns[1:], "ids"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _of(model_file)
        for batch in slices(batches, 1000, 4 << 20):
            ids = coder.encode(batch.column(0).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            own = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(ends), flat)], names)

    return source.mapInArrow(run, ", ".join([*kinds, "ids array<int>"]))


def decode(coded: DataFrame, model_file: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows of coded with the text of their ids added; a null list decodes to the empty text."""
    rest = [f for f in coded.schema.fields if f.name != to]
    source = coded.select(F.col(ids).cast("array<int>").alias("_ids"), *[F.col(f.name) for f in rest])
    names = [*(f.name for f in rest), to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _of(model_file)
        for batch in slices(batches, 1000, 4 << 20):
            texts = [coder.decode(np.array(x.values if x.is_valid else [], np.int32)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(texts, pa.string())], names)

    return source.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{to}` string"]))
