"""Byte-level BPE encoding and decoding over length-bucketed, padded numpy matrices.

A text is cut by the tokenizer's pattern. A piece that is a vocabulary entry is one id; the others are
laid out as byte rows of padded matrices, bucketed by length. Each round every row merges its leftmost
pair of minimum rank; pair ranks come from an open-addressing hash table, and finished rows leave the
matrix by compaction. Pieces beyond the widest bucket are merged by an exact heap, as shifting a very
wide row once a merge would cost the square of its length.

Null texts count as empty and give no ids. Repeated rows are encoded alike; extra columns are kept only
when named in ``keep``. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_CHARS, groups_by_size, slices, strings

#: Widths of the padded matrices in bytes; longer pieces go through the heap.
WIDTHS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512)
#: Cells of a matrix at most, so that a worker's memory is bounded.
MATRIX_CELLS = 300_000
#: Distinct pieces, and characters of them, that a worker remembers before it starts its memory anew.
REMEMBERED, REMEMBERED_CHARS = 150_000, 20_000_000
#: Matches taken at once from a text longer than a chunk.
SLICE = 100_000

_NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read once on the driver; its size is that of the vocabulary, not of the data."""
    with open(path, "rb") as f:
        return f.read()


class PairTable:
    """Open-addressing hash table from (left id, right id) to the rank of their concatenation."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask, self.shift = np.uint64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys = np.full(1 << bits, _EMPTY)
        self.values = np.full(1 << bits, _NONE, dtype=np.int32)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == _EMPTY
            _, first = np.unique(slots[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX) >> self.shift

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the largest int32 where the pair doesn't merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = self._slot(keys)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.values[slots], _NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != _EMPTY))
        while len(open_):
            slots[open_] = (slots[open_] + np.uint64(1)) & self.mask
            seen = self.keys[slots[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (seen != _EMPTY)]
        return out


class _Numbered(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Codec:
    """Vocabulary and encoder of one worker."""

    def __init__(self, raw: bytes, pattern: str):
        rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        self.rank, self.pattern = rank, regex.compile(pattern)
        self.byte_id = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, values = [], []
        for token, r in rank.items():
            for cut in range(1, len(token)):
                a, b = rank.get(token[:cut]), rank.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        self.pairs = PairTable(np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32))
        size = max(rank.values(), default=-1) + 1
        lengths = np.zeros(size, dtype=np.int64)
        for token, r in rank.items():
            lengths[r] = len(token)
        self.token_start = np.concatenate([[0], np.cumsum(lengths)])
        self.token_bytes = np.zeros(self.token_start[-1], dtype=np.uint8)
        for token, r in rank.items():
            self.token_bytes[self.token_start[r] : self.token_start[r + 1]] = np.frombuffer(token, dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known, self.chars = _Numbered(), 0
        self.flat, self.start = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte strings, merged in padded matrices by length: all ids in one array, and their number by piece."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, their numbers of ids, the ids
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(rows), step):
                self._merge_matrix([pieces[i] for i in rows[at : at + step]], rows[at : at + step], width, done)
        for i in np.flatnonzero(lengths > low):
            ids = self._merge_heap(pieces[i])
            done.append((np.array([i]), np.array([len(ids)]), ids))
        counts = np.zeros(len(pieces), dtype=np.int64)
        for rows, n, _ in done:
            counts[rows] = n
        start = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), dtype=np.int32)
        for rows, n, ids in done:
            flat[np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def _merge_matrix(self, pieces: list[bytes], rows: np.ndarray, width: int, done: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        flat = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(-1, width)
        ids, n = self.byte_id[flat], np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        columns = np.arange(width)
        ranks = np.full(ids.shape, _NONE, dtype=np.int32)
        inside = columns[None, :] + 1 < n[:, None]
        r, c = np.nonzero(inside)
        ranks[r, c] = self.pairs.find(ids[r, c], ids[r, c + 1])
        while len(rows):
            at = ranks.argmin(axis=1)  # the first of equals: leftmost
            best = ranks[np.arange(len(rows)), at]
            over = best == _NONE
            if over.any():  # compaction: finished rows leave
                done.append((rows[over], n[over], ids[over][columns[None, :] < n[over][:, None]]))
                stay = ~over
                rows, ids, ranks, n, at, best = rows[stay], ids[stay], ranks[stay], n[stay], at[stay], best[stay]
                if not len(rows):
                    break
            row = np.arange(len(rows))
            take = np.minimum(columns[None, :] + (columns[None, :] > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
            ids[row, at] = best
            n = n - 1
            ranks[row, np.minimum(n, width - 1)] = _NONE
            ranks[row, np.maximum(n - 1, 0)] = _NONE
            ranks[row, at] = _NONE
            k = np.flatnonzero(at + 1 < n)
            ranks[k, at[k]] = self.pairs.find(ids[k, at[k]], ids[k, at[k] + 1])
            k = np.flatnonzero(at > 0)
            ranks[k, at[k] - 1] = self.pairs.find(ids[k, at[k] - 1], ids[k, at[k]])

    def _merge_heap(self, piece: bytes) -> np.ndarray:
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)]
        first = self.pairs.find(ids[:-1], ids[1:])
        ids = ids.tolist()
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = r, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    new = int(self.pairs.find(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if new != _NONE:
                        heapq.heappush(heap, (new, x, ids[x], ids[y]))
        return np.array([x for x in ids if x is not None], dtype=np.int32)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in one array, and the number of ids of each piece."""
        if len(self.known) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self._forget()
        known, old = self.known, len(self.known)
        codes = np.fromiter(map(known.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        if len(known) > old:
            new = [p.encode("utf-8", "surrogatepass") for p in islice(known, old, None)]
            self.chars += sum(map(len, new))
            whole = np.fromiter((self.rank.get(p, -1) for p in new), dtype=np.int32, count=len(new))
            hard = np.flatnonzero(whole < 0)
            ids, counts = self.merge([new[i] for i in hard])
            n = np.ones(len(new), dtype=np.int64)
            n[hard] = counts
            flat = np.repeat(whole, n)
            flat[flat < 0] = ids
            self.flat = np.concatenate([self.flat, flat])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
        return _ragged(self.flat, self.start, codes), self.start[codes + 1] - self.start[codes]

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for a, b in groups_by_size(texts, CHUNK_CHARS // 2):
            if b - a == 1 and len(texts[a] or "") > CHUNK_CHARS // 2:
                found, parts = (m[0] for m in self.pattern.finditer(texts[a])), []
                while pieces := list(islice(found, SLICE)):
                    parts.append(self.encode(pieces)[0])
                out.append(np.concatenate([np.zeros(0, dtype=np.int32), *parts]))
                continue
            lists = [self.pattern.findall(t) if t else [] for t in texts[a:b]]
            ids, counts = self.encode([p for x in lists for p in x])
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0] + [len(x) for x in lists])]
            out += [ids[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
        return out

    def decode_ids(self, lists: list[np.ndarray]) -> list[bytes]:
        out = []
        for ids in lists:
            out.append(_ragged(self.token_bytes, self.token_start, ids.astype(np.int64)).tobytes())
        return out


def _ragged(flat: np.ndarray, start: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """flat[start[c]:start[c + 1]] of each code, one after the other."""
    n = start[codes + 1] - start[codes]
    if not len(codes) or not n.sum():
        return flat[:0]
    ends = np.cumsum(n)
    return flat[np.repeat(start[codes] - (ends - n), n) + np.arange(ends[-1])]


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    key = (hash(raw), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def _ship(df: DataFrame, ranks: str):
    return df.sparkSession.sparkContext.broadcast(read_ranks(ranks))


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Adds column ids: the text's token ids packed as little-endian unsigned 32-bit integers (binary).

    ranks is the path of a rank file on the driver; pattern is its splitting pattern. Result: keep..., ids.
    ``unpack`` turns the packed form into an array column.
    """
    raw = _ship(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value, pattern)
        for batch in slices(batches, len(keep)):
            packed = [x.astype("<u4").tobytes() for x in codec.encode_texts(strings(batch.column(len(keep))))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(packed, pa.binary())], [*keep, ids])

    part = df.select(*keep, F.col(text).cast("string"))
    return part.mapInArrow(run, T.StructType([*part.schema.fields[: len(keep)], T.StructField(ids, T.BinaryType())]))


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id", "ids"), decoded: str = "decoded") -> DataFrame:
    """Adds column decoded: the bytes that packed ids stand for. Null ids count as none. Result: keep..., decoded."""
    raw = _ship(df, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value, pattern)
        for batch in slices(batches, len(keep)):
            lists = [np.frombuffer(b or b"", dtype="<u4") for b in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(codec.decode_ids(lists), pa.binary())], [*keep, decoded])

    part = df.select(*keep, F.col(ids).alias("packed ids"))
    return part.mapInArrow(run, T.StructType([*part.schema.fields[: len(keep)], T.StructField(decoded, T.BinaryType())]))


def unpack(df: DataFrame, ids: str = "ids", into: str = "token_ids") -> DataFrame:
    """Adds the packed ids as an array of long; null ids count as none. A column of the same name is replaced."""
    df = df.drop(into)
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            lists = [np.frombuffer(b or b"", dtype="<u4").astype(np.int64) for b in batch.column(at).to_pylist()]
            starts = pa.array(np.cumsum([0] + [len(x) for x in lists]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(starts, pa.array(np.concatenate(lists)))], [*batch.schema.names, into])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.LongType()))]))


def digest_query(spark, sf_dir: str) -> DataFrame:
    """op6: round trip of every document, as digests of its ids and of its decoded bytes."""
    import public_tokenizers

    from .common import table

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = decode(encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
