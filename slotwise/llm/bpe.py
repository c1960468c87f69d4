"""Byte-level BPE encoding and decoding by padded matrices.

Pieces (the matches of the pre-tokenising pattern) are encoded once per worker and kept in a bounded cache. New
pieces are sorted into length buckets; each bucket is a padded matrix of token ids in which every row merges its
leftmost pair of minimum rank each round. Pair ranks come from an open-addressed hash table; a merge shifts the
row's rest one place left, and rows that have no pair left leave the matrix (compaction). In buckets of over
`LONGEST_ROW` bytes, where a round should not cost a row's whole width, rows are matrices of blocks with the least
rank of each block at hand, merged tokens are linked and compacted when a row is done; the rounds are the same.

Null and empty texts have no tokens; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_schema, batch_of, kept, prepared, slices

NO_RANK = np.iinfo(np.int64).max
LONGEST_ROW = 256
CELLS = 1 << 18
CACHED_PIECES = 50_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Open-addressed table from a pair of ids to the id of the merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values()) + 1
        found: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[left * self.width + right] = rank
        self.bits = max(4, (len(found) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NO_RANK, np.int64)
        keys, values = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        at = self._slot(keys)
        while keys.size:  # the first key of each free slot takes it; the rest go on to the next slot
            free = self.keys[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            taken = np.flatnonzero(free)[first]
            self.keys[slot], self.values[slot] = keys[taken], values[taken]
            left = np.ones(keys.size, bool)
            left[taken] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, NO_RANK where there is none or either side is padding (-1)."""
        keys = np.where((left >= 0) & (right >= 0), left * self.width + right, -2).ravel()
        out = np.full(keys.size, NO_RANK, np.int64)
        open_at = np.flatnonzero(keys >= 0)
        slot = self._slot(keys[open_at])
        while open_at.size:
            seen = self.keys[slot]
            hit = seen == keys[open_at]
            out[open_at[hit]] = self.values[slot[hit]]
            go = ~hit & (seen >= 0)
            open_at, slot = open_at[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(left.shape)


class ByteBPE:
    """Encoder and decoder of one rank table; `pattern` cuts a text into pieces that are merged separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank table lacks {len(missing)} single bytes")
        self.pieces = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes_of: list[bytes] = [b""] * self.pairs.width
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.decimal = [str(i) for i in range(self.pairs.width)]
        self.cache: dict[str, bytes] = {}  # ids as 32-bit integers

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pieces(t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.cache)
        if new:
            if len(self.cache) + len(new) > CACHED_PIECES:
                self.cache.clear()
                new = set(chain.from_iterable(cut))
            new = list(new)
            self.cache.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, pieces)), np.int32).tolist() for pieces in cut]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p:
                buckets.setdefault((len(p) + 3) // 4 * 4 if len(p) <= LONGEST_ROW else 1 << (len(p) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            rows = max(1, CELLS // width)
            for k in range(0, len(members), rows):
                (self._by_matrix if width <= LONGEST_ROW else self._by_blocks)(pieces, members[k : k + rows], out)
        return out

    def _by_matrix(self, pieces: list[bytes], members: list[int], out: list[bytes]) -> None:
        lengths = np.array([len(pieces[i]) for i in members])
        width = int(lengths.max())
        ids = np.full((len(members), width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in members), np.uint8)]
        rank, at = self.pairs.rank(ids[:, :-1], ids[:, 1:]), np.array(members)
        while at.size:
            if not rank.shape[1]:
                done = np.ones(at.size, bool)
            else:
                best = rank.argmin(1)
                merged = rank[np.arange(at.size), best]
                done = merged == NO_RANK
            if done.any():
                self._compact(at[done].tolist(), ids[done], out)
                if done.all():
                    return
                ids, rank, at, best, merged = (x[~done] for x in (ids, rank, at, best, merged))
            rows, cols = np.arange(at.size), np.arange(ids.shape[1] - 1)
            ids[rows, best] = merged
            ids = np.take_along_axis(ids, cols + (cols > best[:, None]), 1)
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= best[:, None]), 1)
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.pairs.rank(ids[left, best[left] - 1], ids[left, best[left]])
            right = np.flatnonzero(best < ids.shape[1] - 1)
            rank[right, best[right]] = self.pairs.rank(ids[right, best[right]], ids[right, best[right] + 1])

    @staticmethod
    def _compact(at: list[int], rows: np.ndarray, out: list[bytes]) -> None:
        """The rows' ids without padding and merged places, as bytes."""
        kept = rows >= 0
        data, ends = rows[kept].astype(np.int32).tobytes(), (np.cumsum(kept.sum(1)) * 4).tolist()
        for i, start, stop in zip(at, [0, *ends], ends, strict=False):
            out[i] = data[start:stop]

    def _by_blocks(self, pieces: list[bytes], members: list[int], out: list[bytes]) -> None:
        """The same rounds for long rows: a round reads a row's block minima and the blocks it changes, not the whole row."""
        lengths = np.array([len(pieces[i]) for i in members])
        width = int(lengths.max() ** 0.5) + 1
        blocks = -(-int(lengths.max()) // width)
        place = np.arange(blocks * width)
        ids = np.full((len(members), place.size), -1, np.int64)
        ids[place < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in members), np.uint8)]
        after = np.where(place + 1 < lengths[:, None], place + 1, -1)
        before = np.broadcast_to(place - 1, ids.shape).copy()
        rank = np.full(ids.shape, NO_RANK, np.int64)
        rank[:, :-1] = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        cells = rank.reshape(len(members), blocks, width)
        least = cells.min(2)
        on = np.arange(len(members))
        while on.size:
            block = least[on].argmin(1)
            merged = least[on, block]
            go = merged != NO_RANK
            on, block, merged = on[go], block[go], merged[go]
            here = block * width + cells[on, block].argmin(1)
            gone, prior = after[on, here], before[on, here]
            follows = after[on, gone]
            ids[on, here], ids[on, gone], rank[on, gone] = merged, -1, NO_RANK
            after[on, here] = follows
            right, left = np.flatnonzero(follows >= 0), np.flatnonzero(prior >= 0)
            before[on[right], follows[right]] = here[right]
            rank[on, here] = self.pairs.rank(merged, np.where(follows >= 0, ids[on, follows], -1))
            rank[on[left], prior[left]] = self.pairs.rank(ids[on[left], prior[left]], merged[left])
            for rows, at in ((on, here), (on, gone), (on[left], prior[left])):
                least[rows, at // width] = cells[rows, at // width].min(1)
        self._compact(members, ids, out)


def _worker(ranks, pattern: str) -> ByteBPE:
    """One codec a worker process and rank table; the broadcast is kept with it so that its id stays its own."""
    return kept(("bpe", id(ranks), pattern), lambda: (ranks, ByteBPE(ranks.value, pattern)))[1]


ROUND_TRIP = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col bigint, ids array<int>) of each row; the rank table (some 50,000 entries) is broadcast."""
    shared, schema = prepared(spark).sparkContext.broadcast(ranks), f"`{id_col}` bigint, ids array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, arrow = _worker(shared, pattern), arrow_schema(schema)
        for part in slices(batches, 1):
            yield batch_of(arrow, [part.column(0), codec.encode(part.column(1).to_pylist())])

    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def decode_documents(spark: SparkSession, encoded: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col bigint, text string) of each row of ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    shared, schema = prepared(spark).sparkContext.broadcast(ranks), f"`{id_col}` bigint, text string"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, arrow = _worker(shared, pattern), arrow_schema(schema)
        for b in batches:
            yield batch_of(arrow, [b.column(0), [codec.decode(x or ()).decode("utf-8", "replace") for x in b.column(1).to_pylist()]])

    return encoded.select(id_col, "ids").mapInArrow(decode, schema)


def round_trip(spark: SparkSession, docs: DataFrame, ranks: dict[bytes, int], pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode its ids, and return ROUND_TRIP: counts and digests, and the ids only if asked for."""
    shared, schema = prepared(spark).sparkContext.broadcast(ranks), ROUND_TRIP + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, arrow = _worker(shared, pattern), arrow_schema(schema)
        for part in slices(batches, 1):
            counts, coded, decoded, every = [], [], [], codec.encode(part.column(1).to_pylist())
            for ids in every:
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield batch_of(arrow, [part.column(0), counts, coded, decoded, *[every] * with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
