"""Bound-certified best-fit packing of tokenised documents into sequences of fixed length.

1. Documents become pieces of at most `capacity` tokens; only longer documents are cut.
2. Pieces are dealt by hash into groups of bounded size; each group is packed best-fit decreasing.
   Dual feasible functions give a lower bound on the bins that the group needs: where the bound equals
   the bins used, the group is certified and only the emptiest bins, which hold GIVEN_UP of its unused room,
   are given up again; a group with a gap gives up all bins that are not full.
3. The documents given up meet those of other groups in fewer, newly dealt groups and are packed again,
   until one group is left, IDLE_ROUNDS exchanges in a row save no bin, or the bins of all
   groups are as few as the bound over all lengths. The least wasteful packing of an exchange stays: a later round never uses
   more bins for the same documents than the round before, as the bins given up are kept where the new
   packing of a group needs as many.

Defined results: a null or empty text is the separator id alone; repeated rows are packed one by one;
an empty table gives no rows; columns besides the id and the text play no part. Ids may be null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm._common import cut, slices

#: Share of its unused room that a certified group gives up, emptiest bins first.
GIVEN_UP = 0.9
#: Exchanges in a row that save no bin, after which no other is made.
IDLE_ROUNDS = 3
PIECES = "piece int, start long, length long, ids_crc32 long"


#: ASCII marks but the apostrophe, which the vocabulary's pattern reads together with letters behind it.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def _plain(letters: str) -> bool:
    """Whether this is a run of Latin-1 letters, which NFC leaves alone and lower() maps as the vocabulary's normaliser does."""
    return letters.isalpha() and (letters.isascii() or max(letters) <= "\xff" and not any(c in letters for c in "\xaa\xb5\xba"))


class ChunkTokenizer(dict):
    """Ids of texts from a tokenizers file, remembering the ids of up to `most` space-free chunks.

    The vocabulary drops white space and its pattern never joins what a space or line break separates,
    so that the ids of a text are those of its chunks in order. Nor does it join a run of letters with the
    marks behind it, so that a chunk of this kind is looked up in two parts, letters in lower case and straight
    in the vocabulary's byte alphabet.
    """

    def __init__(self, file: str, most: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__({"": b""})
        self._tokenizer, self._most = Tokenizer.from_file(file), most
        self._model = self._tokenizer.model
        self._model._resize_cache(0)  # every chunk is asked for once
        names = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the alphabet's letter of each byte: those of two-byte characters U+0080 to U+00FF and of ASCII
        self._letters = {c: names.pre_tokenize_str(c)[0][0] for c in map(chr, range(33, 256))}

    def __missing__(self, chunk: str) -> bytes:
        letters = chunk.rstrip(_MARKS)
        if not _plain(letters):
            ids = self._tokenizer.encode(chunk, add_special_tokens=False).ids
        elif len(letters) < len(chunk) or not chunk.islower():
            coded = self[chunk] = self[letters.lower()] + self[chunk[len(letters) :]]
            return coded
        else:
            ids = [t.id for t in self._model.tokenize(chunk if chunk.isascii() else "".join(map(self._letters.__getitem__, chunk)))]
        coded = self[chunk] = np.array(ids, "<u4").tobytes()
        return coded

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self) > self._most:
            self.clear()
            self[""] = b""
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


_loaded: dict[str, ChunkTokenizer] = {}


def tokenized_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, separator: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    source = docs.select(F.col(text).cast("string").alias("_text"), F.col(doc_id).alias("doc_id"))
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _loaded:
            _loaded[tokenizer_file] = ChunkTokenizer(tokenizer_file)
        coder = _loaded[tokenizer_file]
        for batch in slices(batches, 1000, 4 << 20):
            out, at, ids = [], [], []
            for k, got in enumerate(coder.ids([x or "" for x in batch.column(0).to_pylist()])):
                got += end
                for p, i in enumerate(range(0, len(got), 4 * capacity)):
                    part = got[i : i + 4 * capacity]
                    at.append(k)
                    out.append((p, i // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            piece, start, length, crc = zip(*out)
            columns = [batch.column(1).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names)

    return source.mapInArrow(run, f"doc_id {kind}, {PIECES}" + ", ids array<int>" * with_ids)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins for these lengths."""
    return least_bins_by_length(np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1), capacity)


def least_bins_by_length(count: np.ndarray, capacity: int) -> int:
    """The bound from the number of pieces of each length, the best of two families of dual feasible functions."""
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    total, number = np.cumsum(count * size), np.cumsum(count)
    best = -(-total[-1] // capacity)
    eps = np.arange(0, capacity // 2 + 1)  # sizes above capacity - eps count whole, below eps not at all
    whole = number[-1] - number[capacity - eps]
    middle = total[capacity - eps] - np.where(eps > 0, total[np.maximum(eps, 1) - 1], 0)
    best = max(best, int((-(-(whole * capacity + middle) // capacity)).max()))
    for k in range(1, 33):  # sizes are rounded down to multiples of 1/k, exact multiples of 1/(k + 1) stay
        up = size * (k + 1)
        scaled = np.where(up % capacity == 0, size * k, up // capacity * capacity)  # in units of 1/(k * capacity)
        best = max(best, int(-(-int((count * scaled).sum()) // (k * capacity))))
    return int(best)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, given in any order; equal lengths keep their order."""
    order = np.argsort(-np.asarray(lengths), kind="stable")
    bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by what is left
    left_over = 0  # bit r: a bin with r left
    opened = 0
    for i in order.tolist():
        n = int(lengths[i])
        fits = left_over >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                left_over &= ~(1 << r)
        else:
            r, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - r
        r -= n
        if r:
            room[r].append(b)
            left_over |= 1 << r
    return bins, offsets


def _packer(capacity: int, round_no: int, last: bool, names: list[str]):
    def pack(rows: pa.Table) -> pa.Table:
        keys = [("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys))
        lengths, before = rows["length"].to_numpy(), rows["sequence_id"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        used = int(bins.max()) + 1
        bound = least_bins(lengths, capacity)
        ids, dense = np.unique(before, return_inverse=True)
        if round_no and len(ids) <= used:
            offsets = rows["offset"].to_numpy()
        else:
            dense = bins
            ids = (round_no + 1 << 56) + (int(rows["group"][0].as_py()) << 28) + np.arange(used)
        fill = np.bincount(dense, weights=lengths).astype(np.int64)
        if last:
            open_bins = np.zeros(len(ids), bool)
        elif used <= bound:
            by_gap = np.argsort(fill, kind="stable")
            gaps = np.cumsum(capacity - fill[by_gap])
            open_bins = np.zeros(len(ids), bool)
            open_bins[by_gap[: 1 + np.searchsorted(gaps, GIVEN_UP * gaps[-1])]] = gaps[-1] > 0
        else:
            open_bins = fill < capacity
        new = {"sequence_id": ids[dense], "offset": offsets, "given_up": open_bins[dense], "bins": np.full(len(rows), used), "bound": np.full(len(rows), bound)}
        return pa.table([pa.array(new[n]) if n in new else rows[n] for n in names], names)

    return pack


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 20_000) -> DataFrame:
    """The pieces (a written table) with sequence_id and offset. Every length must lie between 1 and capacity."""
    own = pieces.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    schema = f"{kinds}, group int, sequence_id long, offset long, given_up boolean, bins long, bound long"
    names = [*own, "group", "sequence_id", "offset", "given_up", "bins", "bound"]
    # dealt by row: ids may be null or repeat
    todo = pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    count = np.zeros(capacity + 1, np.int64)
    for length, times in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        count[length] = times
    bound, settled = least_bins_by_length(count, capacity), 0
    n, done, round_no, before, idle = int(count.sum()), None, 0, None, 0
    while True:
        groups = max(1, -(-n // group_rows))
        dealt = todo.withColumn("group", F.pmod(F.xxhash64(F.lit(round_no), "sequence_id"), F.lit(groups)).cast("int"))
        packed = dealt.groupBy("group").applyInArrow(_packer(capacity, round_no, groups == 1, names), schema)
        if groups == 1:
            kept = packed.select(*own, "sequence_id", "offset")
            return kept if done is None else done.unionByName(kept)
        packed = cut(packed, f"packed{round_no}")
        kept = packed.where("NOT given_up").select(*own, "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        todo = packed.where("given_up").select(*own, "sequence_id", "offset")
        n, used, opened = packed.agg(*[F.expr(f"count_if({c})") for c in ("given_up", "offset = 0", "given_up AND offset = 0")]).first()  # a bin has one piece at 0
        idle = idle + 1 if before is not None and used >= before else 0
        if not n or idle == IDLE_ROUNDS or settled + used == bound:
            return done.unionByName(todo)
        settled, before, round_no = settled + used - opened, opened, round_no + 1


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(cut(tokenized_pieces(docs, tokenizer_file, capacity), "pieces"), capacity)
